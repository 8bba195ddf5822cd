"""Sequence statistics: vocabulary, prefix examples, n-gram counts, Kneser-Ney back-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.operators.scans import global_numbers

SEP = "\u0001"


def vocabulary(sequences: DataFrame, tokens: str, specials: tuple[str, ...] = ("<PAD>", "<UNK>")) -> DataFrame:
    """(token, n, id): specials first, then by frequency, ties by token. Distinct tokens are numbered, not occurrences."""
    n = sequences.select(F.explode(tokens).alias("token")).filter("token IS NOT NULL").groupBy("token").agg(F.count("*").alias("n"))
    v = n.filter(~F.col("token").isin(*specials))
    v = global_numbers(v, [F.desc("n"), F.asc("token")], "id").withColumn("id", (F.col("id") + len(specials)).cast("int"))
    s = sequences.sparkSession.createDataFrame([(t, 0, i) for i, t in enumerate(specials)], "token string, n long, id int")
    return s.unionByName(v)


def encode(sequences: DataFrame, key: str, tokens: str, vocab: DataFrame, unknown: int = 1) -> DataFrame:
    """(key, ids): sequences as token ids, unknown tokens (nulls, too) as ``unknown``. Empty sequences stay empty."""
    e = sequences.select(F.col(key).alias("_key"), F.posexplode_outer(tokens).alias("_p", "_tok"))
    e = e.join(vocab.select(F.col("token").alias("_tok"), F.col("id").alias("_id")), "_tok", "left")
    pair = F.when(F.col("_p").isNotNull(), F.struct("_p", F.coalesce("_id", F.lit(unknown)).alias("_id")))
    ids = F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["_id"])
    return e.groupBy("_key").agg(ids.alias("ids")).withColumnRenamed("_key", key)


def prefix_examples(sequences: DataFrame, key: str, tokens: str, least: int = 1, longest: int = 40) -> DataFrame:
    """(key, position, context, target): one row a position from ``least`` on, with the last ``longest`` tokens before it."""
    n = F.size(tokens)
    pos = F.when(n > least, F.sequence(F.lit(least), n - 1)).otherwise(F.array().cast("array<int>"))
    d = sequences.select(key, F.col(tokens).alias("_t"), F.explode(pos).alias("position"))
    start = F.greatest(F.lit(0), F.col("position") - longest)
    return d.select(key, "position", F.slice("_t", start + 1, F.col("position") - start).alias("context"), F.element_at("_t", F.col("position") + 1).alias("target"))


def ngram_counts(sequences: DataFrame, tokens: str, max_order: int, by: list[str] | None = None) -> DataFrame:
    """(by, order, context, next, c): how often a token follows each context of up to ``max_order`` tokens.

    Contexts are token strings joined by a control character. Counts combine before the shuffle.
    """
    by = by or []
    d = sequences.select(*by, F.col(tokens).alias("_t"), F.posexplode(tokens).alias("_i", "next"))
    d = d.select(*by, "_t", "_i", "next", F.explode(F.sequence(F.lit(0), F.least(F.lit(max_order), F.col("_i")))).alias("order"))
    ctx = F.concat_ws(SEP, F.slice("_t", F.col("_i") - F.col("order") + 1, F.col("order")))
    return d.groupBy(*by, "order", ctx.alias("context"), "next").agg(F.count("*").alias("c"))


def kneser_ney(counts: DataFrame, contexts: DataFrame, key: str, context: str, max_order: int, discount: float = 0.75, by: list[str] | None = None) -> DataFrame:
    """(by, key, token, p): interpolated back-off distribution for each context (an array), over the tokens seen after another one.

    Order 0 is uniform over tokens that ever have a predecessor: each continuation is counted once. An order whose
    context was never seen passes the lower order on. Probabilities are at least 1e-9 and sum to 1. by: columns of counts and
    contexts that tell models apart, such as an entity; a context whose entity has no counts gives no rows.
    """
    by = by or []
    tokens = counts.filter("order = 1").select(*by, F.col("next").alias("token")).distinct()
    # a vocabulary as one array: bounded by the number of kinds of tokens
    vocab = tokens.groupBy(*by).agg(F.sort_array(F.collect_set("token")).alias("_v"))
    q = contexts.select(*by, key, F.col(context).alias("_ctx"))
    q = q.join(vocab, by) if by else q.crossJoin(F.broadcast(vocab))
    d = q.select(*by, key, "_ctx", F.explode("_v").alias("token"), (1.0 / F.size("_v")).alias("p"))
    totals = counts.groupBy(*by, "order", "context").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
    for k in range(1, max_order + 1):
        ctx = F.when(F.size("_ctx") >= k, F.concat_ws(SEP, F.slice("_ctx", F.size("_ctx") - k + 1, F.lit(k))))
        d = d.withColumn("_k", ctx)
        t = totals.filter(F.col("order") == k).select(*by, F.col("context").alias("_k"), "total", "kinds")
        c = counts.filter(F.col("order") == k).select(*by, F.col("context").alias("_k"), F.col("next").alias("token"), "c")
        d = d.join(t, [*by, "_k"], "left").join(c, [*by, "_k", "token"], "left")
        disc = F.least(F.lit(discount), F.col("total").cast("double"))
        here = F.col("p") * disc * F.col("kinds") / F.col("total") + F.greatest(F.coalesce("c", F.lit(0)) - disc, F.lit(0.0)) / F.col("total")
        d = d.select(*by, key, "_ctx", "token", F.when(F.col("total").isNull(), F.col("p")).otherwise(here).alias("p"))
    p = F.greatest(F.col("p"), F.lit(1e-9))
    return d.select(*by, key, "token", (p / F.sum(p).over(Window.partitionBy(*by, key))).alias("p"))


def entity_or_global(rows: DataFrame, models: DataFrame, entity: str, everything: str = "__global__") -> DataFrame:
    """rows with ``model``: their entity if it has a model of its own, whatever its contexts, else the one of all."""
    have = models.select(entity).distinct().withColumn("_has", F.lit(1))
    return rows.join(have, entity, "left").withColumn("model", F.when(F.col("_has") == 1, F.col(entity)).otherwise(everything)).drop("_has")


def entity_of(key: Column) -> Column:
    """Leading letters and digits of an id such as b12_s3; the whole id where it has none."""
    m = F.regexp_extract(key, r"^([A-Za-z]+\d+)", 1)
    return F.when(m == "", key).otherwise(m)
