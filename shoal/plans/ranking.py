"""Ranking and classification metrics, re-ranking, audits, contracts and learned models on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.functions.text import strip
from shoal.operators import metrics as M
from shoal.operators.contracts import Contract, answered_only
from shoal.operators.features import hash_fold
from shoal.operators.joins import co_occurrence
from shoal.operators.models import balanced_weights, boosted_scores, boosted_values, out_of_fold, temporal_split, threshold_search
from shoal.operators.ranking import best_similar, diverse_by_history, top_k
from shoal.plans.registry import Registry, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

# a score and a label out of the events: value against a digest of the id
_SCORED = """s AS (SELECT event_id, event_type, user_id, round(value) AS score, CAST((('0x' || substr(sha256('y:' || CAST(event_id AS VARCHAR)), 1, 4))::BIGINT % 100) < value AS INTEGER) AS label FROM events)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    y = F.conv(F.substring(F.sha2(F.concat(F.lit("y:"), F.col("event_id").cast("string")), 256), 1, 4), 16, 10).cast("long") % 100
    return table(spark, d, "events").select("event_id", "event_type", "user_id", F.round("value").alias("score"), (y < F.col("value")).cast("int").alias("label"))


@query(
    "ndcg_at_20",
    """WITH r AS (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, k) AS rank FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE ts < TIMESTAMP '2024-01-20') GROUP BY 1, 2),
    rel AS (SELECT DISTINCT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND event_type = 'purchase'),
    h AS (SELECT user_id, sum(1 / log2(rank + 1)) AS dcg FROM r JOIN rel USING (user_id, k) WHERE rank <= 20 GROUP BY 1), n AS (SELECT user_id, count(*) AS n FROM rel GROUP BY 1)
    SELECT n.user_id, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(20, n) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM n LEFT JOIN h USING (user_id)""",
)
def ndcg_at_20(spark: SparkSession, d: str) -> DataFrame:
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))
    n = e.filter(F.col("ts") < cut).groupBy("user_id", "k").agg(F.count("*").alias("n"))
    ranked = top_k(n, ["user_id"], [F.desc("n"), F.asc("k")], 20)
    rel = e.filter((F.col("ts") >= cut) & (F.col("event_type") == "purchase"))
    return M.ndcg(ranked, rel, "user_id", "k").withColumn("ndcg", F.round("ndcg", 6))


_STEPS = """st AS (SELECT {by} -score AS neg, sum(label) AS pos, count(*) AS n FROM s WHERE score IS NOT NULL AND label IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM st WINDOW w AS ({part} ORDER BY neg))"""


@query(
    "average_precision",
    f"""WITH {_SCORED}, {_STEPS.format(by="", part="")} SELECT round(sum(pos * cp / cn) / sum(pos), 6) AS average_precision FROM c""",
)
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return M.average_precision(_scored(spark, d), "score", "label").withColumn("average_precision", F.round("average_precision", 6))


@query(
    "average_precision_by_type",
    f"""WITH {_SCORED}, {_STEPS.format(by="event_type,", part="PARTITION BY event_type")} SELECT event_type, round(sum(pos * cp / cn) / sum(pos), 6) AS average_precision FROM c GROUP BY 1""",
)
def average_precision_by_type(spark: SparkSession, d: str) -> DataFrame:
    return M.average_precision(_scored(spark, d), "score", "label", ["event_type"]).withColumn("average_precision", F.round("average_precision", 6))


_AUC = """SELECT {g} round(coalesce((sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * (count(*) - sum(label)), 0), 0.5), 6) AS auc
FROM (SELECT *, rank() OVER ({p} ORDER BY score) + (count(*) OVER (PARTITION BY {q} score) - 1) / 2.0 AS r FROM s WHERE score IS NOT NULL) {e}"""


@query("auc_overall", f"WITH {_SCORED} " + _AUC.format(g="", p="", q="", e=""))
def auc_overall(spark: SparkSession, d: str) -> DataFrame:
    return M.auc(_scored(spark, d), "score", "label").withColumn("auc", F.round("auc", 6))


@query("auc_by_type", f"WITH {_SCORED} " + _AUC.format(g="event_type,", p="PARTITION BY event_type", q="event_type,", e="GROUP BY event_type"))
def auc_by_type(spark: SparkSession, d: str) -> DataFrame:
    return M.auc(_scored(spark, d), "score", "label", ["event_type"]).withColumn("auc", F.round("auc", 6))


@query(
    "stratified_auc_gain",
    f"WITH {_SCORED}, a AS ({_AUC.format(g='event_type,', p='PARTITION BY event_type', q='event_type,', e='GROUP BY event_type').replace('round(', '(').replace(', 6) AS auc', ') AS auc')}) SELECT round(avg(greatest(0, 2 * auc - 1)), 6) AS gain FROM a",
)
def stratified_auc_gain(spark: SparkSession, d: str) -> DataFrame:
    a = M.auc(_scored(spark, d), "score", "label", ["event_type"])
    return a.agg(F.round(F.avg(F.greatest(F.lit(0.0), 2 * F.col("auc") - 1)), 6).alias("gain"))


@query(
    "spearman_by_nation",
    """WITH r AS (SELECT c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY x) + (count(*) OVER (PARTITION BY c_nationkey, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY c_nationkey ORDER BY y) + (count(*) OVER (PARTITION BY c_nationkey, y) - 1) / 2.0 AS b
    FROM (SELECT c_nationkey, round(c_acctbal / 500) AS x, c_custkey % 7 AS y FROM customer)) SELECT c_nationkey, round(coalesce(corr(a, b), 0), 6) + 0.0 AS spearman FROM r GROUP BY 1""",
)
def spearman_by_nation(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_nationkey", F.round(F.col("c_acctbal") / 500).alias("x"), (F.col("c_custkey") % 7).alias("y"))
    return M.spearman_by_group(c, "x", "y", ["c_nationkey"]).withColumn("spearman", F.round("spearman", 6) + 0.0)


@query(
    "precision_lift",
    f"""WITH {_SCORED}, a AS (SELECT avg(label) AS b, avg(label) FILTER (score >= 80) AS p FROM s) SELECT round(b, 6) AS base_rate, round(p, 6) AS precision, round(greatest(0, least(1, (p - b) / (1 - b))), 6) AS lift FROM a""",
)
def precision_lift(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).withColumn("chosen", (F.col("score") >= 80).cast("int"))
    return M.precision_lift(s, "label", "chosen").select(*[F.round(c, 6).alias(c) for c in ("base_rate", "precision", "lift")])


_LISTS = """a AS (SELECT user_id, list(event_id ORDER BY value DESC, event_id) AS l FROM events GROUP BY 1), b AS (SELECT user_id, list(event_id ORDER BY sha256(CAST(event_id AS VARCHAR))) AS l FROM events WHERE value > 30 GROUP BY 1),
z AS (SELECT user_id, list_slice(a.l, 1, 10) AS p, list_slice(b.l, 1, 10) AS t FROM a JOIN b USING (user_id) WHERE len(a.l) >= 10 AND len(b.l) >= 10)"""


def _lists(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    dig = F.sha2(F.col("event_id").cast("string"), 256)
    a = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("o"), "event_id"))), lambda x: x["event_id"]).alias("a"))
    b = e.filter("value > 30").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(dig.alias("o"), "event_id"))), lambda x: x["event_id"]).alias("b"))
    j = a.join(b, "user_id").filter((F.size("a") >= 10) & (F.size("b") >= 10))
    return j.select("user_id", F.slice("a", 1, 10).alias("p"), F.slice("b", 1, 10).alias("t"))


@query(
    "rank_overlap_full",
    f"""WITH {_LISTS} SELECT user_id, round(list_sum(list_transform(range(1, 11), lambda d: pow(0.9, d - 1) * len(list_intersect(p[1:d], t[1:d])) / d)) * 0.1 / (1 - pow(0.9, 10)), 6) AS rbo FROM z""",
)
def rank_overlap_full(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).select("user_id", F.round(M.rank_biased_overlap_full(F.col("p"), F.col("t")), 6).alias("rbo"))


@query(
    "rank_overlap_partial",
    f"""WITH {_LISTS}, w AS (SELECT user_id, p, list_transform(t, lambda x, i: CASE WHEN i IN (2, 5, 7) THEN x END) AS t FROM z),
    v AS (SELECT user_id, list_transform(range(1, 11), lambda d: len(list_filter(t[1:d], lambda x: x IS NOT NULL))) AS n, list_transform(range(1, 11), lambda d: len(list_intersect(p[1:d], list_filter(t[1:d], lambda x: x IS NOT NULL)))) AS h FROM w)
    SELECT user_id, round(list_sum(list_transform(range(1, 11), lambda d: CASE WHEN n[d] > 0 THEN pow(0.9, d - 1) * h[d] / n[d] ELSE 0 END)) / list_sum(list_transform(range(1, 11), lambda d: CASE WHEN n[d] > 0 THEN pow(0.9, d - 1) ELSE 0 END)), 6) AS rbo FROM v""",
)
def rank_overlap_partial(spark: SparkSession, d: str) -> DataFrame:
    x = _lists(spark, d).withColumn("t", F.transform("t", lambda v, i: F.when(i.isin(1, 4, 6), v)))
    return x.select("user_id", F.round(M.rank_biased_overlap(F.col("p"), F.col("t")), 6).alias("rbo"))


_AUDIT = """au AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'price' WHEN 2 THEN 'stale' ELSE 'popular' END AS truth, CAST(value > 40 AS INTEGER) AS flag, CASE WHEN value > 55 THEN 'price' ELSE 'none' END AS mode, event_type = 'view' AS same FROM events)"""


def _audit(spark: SparkSession, d: str) -> DataFrame:
    m, v = F.col("user_id") % 4, F.col("value")
    truth = F.when(m == 0, "none").when(m == 1, "price").when(m == 2, "stale").otherwise("popular")
    return table(spark, d, "events").select(
        "event_id", truth.alias("truth"), (v > 40).cast("int").alias("flag"), F.when(v > 55, "price").otherwise("none").alias("mode"), (F.col("event_type") == "view").alias("same"), v.alias("value")
    )


@query("bucket_balanced_mean", f"WITH {_AUDIT} SELECT round(avg(m), 6) AS bucket_mean FROM (SELECT truth, avg(flag) AS m FROM au GROUP BY 1)")
def bucket_balanced_mean(spark: SparkSession, d: str) -> DataFrame:
    return M.bucket_mean(_audit(spark, d), "truth", "flag").select(F.round("bucket_mean", 6).alias("bucket_mean"))


@query(
    "audit_detection",
    f"""WITH {_AUDIT}, r AS (SELECT truth, avg(flag) AS r FROM au GROUP BY 1), x AS (SELECT avg(r) FILTER (truth <> 'none') AS rec, max(1 - r) FILTER (truth = 'none') AS spec FROM r)
    SELECT round(rec, 6) AS recall, round(spec, 6) AS specificity, round((rec + spec) / 2, 6) AS balanced FROM x""",
)
def audit_detection(spark: SparkSession, d: str) -> DataFrame:
    return M.detection(_audit(spark, d), "truth", "flag").select(*[F.round(c, 6).alias(c) for c in ("recall", "specificity", "balanced")])


@query(
    "audit_consistency",
    f"""WITH {_AUDIT}, v AS (SELECT (flag = 0 AND NOT same) AS a, (flag = 1 AND same) AS b, (flag = 0 AND mode <> 'none') AS c, (flag = 1 AND mode = 'none') AS d FROM au)
    SELECT CAST(sum(a::INT) AS BIGINT) AS v1, CAST(sum(b::INT) AS BIGINT) AS v2, CAST(sum(c::INT) AS BIGINT) AS v3, CAST(sum(d::INT) AS BIGINT) AS v4, round(1 - avg((a OR b OR c OR d)::INT), 6) AS consistency, round(0.7 + 0.3 * (1 - avg((a OR b OR c OR d)::INT)), 6) AS multiplier FROM v""",
)
def audit_consistency(spark: SparkSession, d: str) -> DataFrame:
    c = M.consistency(_audit(spark, d), "flag", "mode", "same")
    return c.withColumns({x: F.round(x, 6) for x in ("consistency", "multiplier")})


@query(
    "composite_score",
    f"""WITH {_AUDIT} SELECT round(greatest(0, least(1, 0.5 * avg(flag) + 0.3 * avg(CAST(mode = 'none' AS INT)) + 0.2 * avg(CAST(same AS INT)))), 6) AS score FROM au""",
)
def composite_score(spark: SparkSession, d: str) -> DataFrame:
    a = _audit(spark, d).agg(F.avg("flag").alias("a"), F.avg((F.col("mode") == "none").cast("double")).alias("b"), F.avg(F.col("same").cast("double")).alias("c"))
    return a.select(F.round(M.weighted({"a": 0.5, "b": 0.3, "c": 0.2}), 6).alias("score"))


@query(
    "topk_accuracy",
    """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rank FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2),
    t AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1)
    SELECT count(*) AS n, round(avg(coalesce((rank <= 1)::INT, 0)), 6) AS top1, round(avg(coalesce((rank <= 3)::INT, 0)), 6) AS top3, round(avg(coalesce((rank <= 5)::INT, 0)), 6) AS top5 FROM t LEFT JOIN r USING (user_id, event_type)""",
)
def topk_accuracy(spark: SparkSession, d: str) -> DataFrame:
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    e = table(spark, d, "events")
    r = top_k(e.filter(F.col("ts") < cut).groupBy("user_id", "event_type").agg(F.count("*").alias("n")), ["user_id"], [F.desc("n"), F.asc("event_type")], 5)
    t = e.filter(F.col("ts") >= cut).groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    a = M.top_k_accuracy(r, t, "user_id", "event_type", "rank")
    return a.select("n", *[F.round(c, 6).alias(c) for c in ("top1", "top3", "top5")])


@query(
    "ungrounded_items",
    r"""SELECT round(avg(CAST(p_partkey IS NULL AS INT)), 6) AS ungrounded FROM (SELECT l_partkey + 150 AS k FROM lineitem) LEFT JOIN part ON k = p_partkey""",
)
def ungrounded_items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select((F.col("l_partkey") + 150).alias("k"))
    return M.ungrounded_rate(items, table(spark, d, "part").select(F.col("p_partkey").alias("k")), "k").select(F.round("ungrounded", 6).alias("ungrounded"))


@query(
    "repeat_share",
    """WITH p AS (SELECT DISTINCT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, ts >= TIMESTAMP '2024-01-20' AS late FROM events)
    SELECT round(avg(CAST(o.k IS NOT NULL AS INT)), 6) AS share FROM (SELECT * FROM p WHERE late) n LEFT JOIN (SELECT * FROM p WHERE NOT late) o ON n.user_id = o.user_id AND n.k = o.k""",
)
def repeat_share(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    late = (F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")).cast("int")
    g = table(spark, d, "events").groupBy("user_id", k.alias("k")).agg(F.max(late).alias("after"), F.min(late).alias("before"))
    return g.filter("after = 1").agg(F.round(F.avg((F.col("before") == 0).cast("double")), 6).alias("share"))


@query(
    "promotion_lift",
    """WITH i AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'view') AS v FROM events GROUP BY 1)
    SELECT k % 5 = 0 AS promoted, round(avg((p + 1) / (v + 20.0)), 6) AS conversion FROM i GROUP BY 1""",
)
def promotion_lift(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    i = table(spark, d, "events").groupBy(k.alias("k")).agg(F.count(F.when(F.col("event_type") == "purchase", 1)).alias("p"), F.count(F.when(F.col("event_type") == "view", 1)).alias("v"))
    return i.groupBy((F.col("k") % 5 == 0).alias("promoted")).agg(F.round(F.avg((F.col("p") + 1) / (F.col("v") + 20.0)), 6).alias("conversion"))


@query("column_leakage", f"WITH s AS (SELECT l_discount AS score, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem), {_STEPS.format(by='', part='')} SELECT round(sum(pos * cp / cn) / sum(pos), 6) AS average_precision FROM c")
def column_leakage(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").select(F.col("l_discount").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return M.average_precision(s, "score", "label").withColumn("average_precision", F.round("average_precision", 6))


# ---------------------------------------------------------------- recommendations


@query("diverse_slates")
def diverse_slates(spark: SparkSession, d: str) -> DataFrame:
    tx = table(spark, d, "sf_transactions").filter("quantity > 0 AND customer_id IS NOT NULL").select("invoice", "customer_id", "invoice_date", F.upper(strip("stock_code")).alias("item"))
    last = tx.agg(F.max("invoice_date").alias("anchor"))
    age = F.datediff("anchor", "invoice_date")
    hist = tx.crossJoin(F.broadcast(last)).groupBy("customer_id", "item").agg(F.pow(F.lit(0.5), F.min(age) / 60.0).alias("w"))
    hist = top_k(hist, ["customer_id"], [F.desc("w"), F.asc("item")], 40).drop("rank")
    return diverse_by_history(hist, co_occurrence(tx, "invoice", "item"), "customer_id", "item", 10)


@query(
    "similar_items_score",
    r"""WITH b AS (SELECT DISTINCT invoice, regexp_replace(upper(stock_code), '^\s+|\s+$', '', 'g') AS i FROM sf_transactions WHERE quantity > 0), n AS (SELECT i, count(*) AS n FROM b GROUP BY i),
    p AS (SELECT a.i AS x, c.i AS y, count(*) AS k FROM b a JOIN b c ON a.invoice = c.invoice AND a.i <> c.i GROUP BY 1, 2), s AS (SELECT x, y, k / sqrt((nx.n + 5.0) * (ny.n + 5.0)) AS sim FROM p JOIN n nx ON nx.i = x JOIN n ny ON ny.i = y),
    m AS (SELECT DISTINCT customer_id, regexp_replace(upper(stock_code), '^\s+|\s+$', '', 'g') AS x FROM sf_transactions WHERE quantity > 0 AND customer_id IS NOT NULL)
    SELECT customer_id, y AS item, round(max(sim), 6) AS best FROM m JOIN s USING (x) GROUP BY 1, 2""",
)
def similar_items_score(spark: SparkSession, d: str) -> DataFrame:
    tx = table(spark, d, "sf_transactions").filter("quantity > 0").select("invoice", "customer_id", F.upper(strip("stock_code")).alias("item"))
    # the largest of rounded values is the largest rounded
    best = F.round(F.col("n_ab") / F.sqrt((F.col("n_a") + 5.0) * (F.col("n_b") + 5.0)), 6)
    return best_similar(tx, co_occurrence(tx, "invoice", "item").select("item_a", "item_b", best.alias("best")), "customer_id", "item", "best")


# ---------------------------------------------------------------- contracts


@query(
    "contract_violations",
    """WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 97 = 0 THEN 99 ELSE o_orderkey % 5 + 1 END AS pos, CASE WHEN o_orderkey % 301 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderpriority AS word, o_custkey AS grp FROM orders WHERE o_orderkey % 50 <> 0
    UNION ALL SELECT o_orderkey, 1, 1.0, 'odd', o_custkey FROM orders WHERE o_orderkey % 211 = 0),
    v AS (SELECT 'row_count' AS check_name, 1 AS n WHERE (SELECT count(*) FROM s) <> (SELECT count(*) FROM orders)
    UNION ALL SELECT 'unknown_key', count(*) FROM s WHERE id NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'missing_key', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT id FROM s)
    UNION ALL SELECT 'duplicate_id', count(*) FROM (SELECT id FROM s GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'integer_pos', count(*) FROM s WHERE NOT pos BETWEEN 1 AND 5
    UNION ALL SELECT 'finite_price', count(*) FROM s WHERE price IS NULL UNION ALL SELECT 'vocabulary_word', count(*) FROM s WHERE word NOT IN (SELECT DISTINCT o_orderpriority FROM orders)
    UNION ALL SELECT 'constant_word', count(*) FROM (SELECT id FROM s GROUP BY id HAVING count(DISTINCT word) > 1) UNION ALL SELECT 'rows_per_group', count(*) FROM (SELECT grp FROM s GROUP BY grp HAVING count(*) <> 10)
    UNION ALL SELECT 'total_pos', CAST((SELECT sum(pos) FROM s) <> 240 AS INT))
    SELECT check_name, CAST(n AS BIGINT) AS violations FROM v WHERE n > 0""",
)
def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    a = o.filter(k % 50 != 0).select(
        k.alias("id"), F.when(k % 97 == 0, 99).otherwise(k % 5 + 1).alias("pos"), F.when(k % 301 != 0, F.col("o_totalprice")).alias("price"), F.col("o_orderpriority").alias("word"), F.col("o_custkey").alias("grp")
    )
    b = o.filter(k % 211 == 0).select(k.alias("id"), F.lit(1).alias("pos"), F.lit(1.0).alias("price"), F.lit("odd").alias("word"), F.col("o_custkey").alias("grp"))
    c = Contract(a.unionByName(b)).columns(["id", "pos"]).row_count(o).same_keys(o.select(k.alias("id")), ["id"]).unique(["id"]).integer_between("pos", 1, 5)
    c = c.finite("price").in_vocabulary("word", o, "o_orderpriority").constant("word", ["id"]).rows_per_group(["grp"], 10).total("pos", 240)
    return c.counts()


@query("partial_answers", "SELECT count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def partial_answers(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return answered_only(table(spark, d, "lineitem"), a, ["l_orderkey"]).agg(F.count("*").alias("n"))


@query("split_leakage", "SELECT count(DISTINCT o_custkey) AS shared FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01')")
def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    before, after = temporal_split(table(spark, d, "orders"), "o_orderdate", F.lit("2000-01-01").cast("timestamp_ntz"))
    return Contract(after).disjoint(before, ["o_custkey"]).violations().agg(F.count("*").alias("shared"))


# ---------------------------------------------------------------- learned models


def _features(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("top"))
    c = table(spark, d, "customer").join(o, "c_custkey", "left")
    return c.select("c_custkey", "c_nationkey", "n", "mean", "top", "c_acctbal", (F.coalesce("top", F.lit(0.0)) > 400_000).cast("int").alias("label"))


@query("boosted_out_of_fold")
def boosted_out_of_fold(spark: SparkSession, d: str) -> DataFrame:
    f = balanced_weights(_features(spark, d), "label")
    s = out_of_fold(f, "c_custkey", 2, lambda a, b: boosted_scores(a, b, "label", ["n", "mean", "c_acctbal"], "weight", rounds=5))
    return M.auc(s, "score", "label").withColumn("auc", F.round("auc", 4))


@query("boosted_ranking")
def boosted_ranking(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d).withColumn("fold", hash_fold(F.col("c_custkey"), 2))
    s = boosted_values(f.filter("fold = 0"), f.filter("fold = 1"), "label", ["n", "mean", "c_acctbal"], rounds=5)
    return top_k(s, ["c_nationkey"], [F.desc("score"), F.asc("c_custkey")], 3).select("c_nationkey", "rank", "c_custkey")


@query(
    "threshold_grid",
    f"""WITH {_SCORED}, g(threshold) AS (VALUES (20.0), (50.0), (80.0)), c AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold) AS h, count(*) FILTER (label = 1) AS p FROM s, g GROUP BY 1)
    SELECT CAST(threshold AS DOUBLE) AS threshold, round(tp / h, 6) AS precision, round(tp / p, 6) AS recall, round(2 * tp / (h + p), 6) AS f1 FROM c""",
)
def threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    t = threshold_search(_scored(spark, d), "score", "label", [20.0, 50.0, 80.0])
    return t.select("threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("balanced_class_weights", f"WITH {_SCORED} SELECT label, round(CASE WHEN label = 1 THEN n / (2.0 * p) ELSE n / (2.0 * (n - p)) END, 6) AS weight FROM (SELECT DISTINCT label FROM s), (SELECT count(*) AS n, sum(label) AS p FROM s)")
def balanced_class_weights(spark: SparkSession, d: str) -> DataFrame:
    return balanced_weights(_scored(spark, d), "label").groupBy("label").agg(F.round(F.max("weight"), 6).alias("weight"))
