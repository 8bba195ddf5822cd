"""Log transduction, sequence statistics, streaming windows and user functions on the test tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoal.operators import sequences as S
from shoal.operators import transduce as X
from shoal.plans.registry import Registry, table
from shoal.session import materialized
from shoal.streaming import windows as W

query = Registry()
QUERIES, SQL = query.queries, query.sql

# ---------------------------------------------------------------- log lines

_TRUTH = """s0 AS (SELECT site, utc_offset_min, row_number() OVER (ORDER BY site) - 1 AS sn FROM sites),
t AS (SELECT event_id, (['F1','F2','F3','F4','F5','F6'])[1 + event_id % 6] AS layout, date_trunc('minute', ts) AS utc, utc_offset_min AS off, site, (['PMP','CMP','FAN','VLV'])[1 + event_id % 4] AS type,
  user_id % 10000 AS number, (event_id * 7 % 1200) / 10.0 - 10 AS tc, 80 + (event_id * 13 % 8000) / 10.0 AS pk, (['OK','WARN','FAULT'])[1 + event_id % 3] AS status FROM events JOIN s0 ON sn = (event_id * 11) % 40),
truth AS (SELECT *, 'ts=' || strftime(utc, '%Y-%m-%dT%H:%M:%SZ') || '|dev=' || type || '-' || lpad(CAST(number AS VARCHAR), 4, '0') || '|site=' || site || '|temp_c=' || printf('%.1f', tc) || '|pres_kpa=' || printf('%.1f', pk) || '|status=' || status AS canonical FROM t)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    sites = table(spark, d, "sites").select("site", F.col("utc_offset_min").alias("offset")).withColumn("sn", F.row_number().over(Window.orderBy("site")) - 1)
    i = F.col("event_id")

    def pick(words: list[str]):
        return F.element_at(F.array(*[F.lit(w) for w in words]), (i % len(words) + 1).cast("int"))

    e = table(spark, d, "events").select(
        "event_id", pick(["F1", "F2", "F3", "F4", "F5", "F6"]).alias("layout"), F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("utc"), ((i * 11) % 40).alias("sn"),
        pick(["PMP", "CMP", "FAN", "VLV"]).alias("type"), (F.col("user_id") % 10_000).cast("int").alias("number"), ((i * 7 % 1200) / 10.0 - 10).alias("tc"), (80 + (i * 13 % 8000) / 10.0).alias("pk"),
        pick(["OK", "WARN", "FAULT"]).alias("status"),
    )
    e = e.join(sites, "sn")
    dev = F.concat("type", F.lit("-"), F.lpad(F.col("number").cast("string"), 4, "0"))
    canon = F.concat(
        F.lit("ts="), F.date_format("utc", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("|dev="), dev, F.lit("|site="), F.col("site"), F.lit("|temp_c="), F.format_string("%.1f", "tc"),
        F.lit("|pres_kpa="), F.format_string("%.1f", "pk"), F.lit("|status="), F.col("status"),
    )
    lines = X.render(e).withColumn("canonical", canon).withColumnRenamed("layout", "true_layout")
    # written as a collector would: parsing starts from stored lines
    return materialized(lines.select("event_id", "true_layout", "raw_line", "canonical"), "lines")


@query("log_canonical", f"WITH {_TRUTH} SELECT event_id, layout, canonical AS output FROM truth")
def log_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Rules learned from every other stretch of 120 lines, then applied to all lines."""
    lines = _lines(spark, d)
    rules, offsets = X.learn_rules(lines.filter(F.floor(F.col("event_id") / 120) % 2 == 0).select("raw_line", "canonical"))
    return X.transduce(lines.select("event_id", "raw_line"), offsets, rules).select("event_id", "layout", "output")


@query(
    "log_quirk_blind",
    f"""WITH {_TRUTH} SELECT layout, count(*) AS n, round(avg((3 + CASE WHEN layout IN ('F2', 'F6') OR off = 0 THEN 1 ELSE 0 END
    + CASE WHEN layout IN ('F2', 'F3', 'F6') OR (layout = 'F4' AND tc = 0) THEN 1 ELSE 0 END + CASE WHEN layout IN ('F2', 'F3', 'F6') THEN 1 ELSE 0 END) / 6.0), 6) AS accuracy FROM truth GROUP BY layout""",
)
def log_quirk_blind(spark: SparkSession, d: str) -> DataFrame:
    """Field accuracy of a reader that knows words and dates but no offsets of sites and no units."""
    known = X.published()
    sites = table(spark, d, "sites").select("site", F.lit(0).alias("utc_offset_min"))
    x = X.transduce(_lines(spark, d).select("event_id", "raw_line", "canonical"), sites, X.Rules({}, known.status, known.types, known.day_first))
    return X.field_accuracy(x).groupBy("layout").agg(F.count("*").alias("n"), F.round(F.avg("accuracy"), 6).alias("accuracy"))


@query("log_exact_match", f"WITH {_TRUTH} SELECT layout, count(*) AS n, round(avg(CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END), 6) AS exact FROM truth GROUP BY 1")
def log_exact_match(spark: SparkSession, d: str) -> DataFrame:
    """Share of lines of each layout that come out to the letter, where every seventh output is spoilt."""
    x = X.transduce(_lines(spark, d).select("event_id", "raw_line", "canonical"), table(spark, d, "sites"))
    x = x.withColumn("output", F.when(F.col("event_id") % 7 == 0, F.concat("output", F.lit("|x=1"))).otherwise(F.col("output")))
    return X.exact_matches(x).withColumn("exact", F.round("exact", 6))


@query("log_rejects", f"WITH {_TRUTH} SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'REJECT' ELSE canonical END AS output FROM truth")
def log_rejects(spark: SparkSession, d: str) -> DataFrame:
    x = _lines(spark, d)
    broken = F.when(F.col("event_id") % 5 == 0, F.regexp_replace("raw_line", r"""[|<>{}:=@,"+]""", "")).otherwise(F.col("raw_line"))
    # a fixed-width line has no marks to lose but its sign: it is cut short instead
    broken = F.when((F.col("event_id") % 5 == 0) & (F.col("true_layout") == "F4"), F.substring("raw_line", 1, 20)).otherwise(broken)
    return X.transduce(x.select("event_id", broken.alias("raw_line")), table(spark, d, "sites")).select("event_id", "output")


@query("log_field_accuracy", f"WITH {_TRUTH} SELECT layout, count(*) AS n, round(avg(CASE WHEN event_id % 7 = 0 THEN 5.0 / 6 ELSE 1 END), 6) AS accuracy FROM truth GROUP BY 1")
def log_field_accuracy(spark: SparkSession, d: str) -> DataFrame:
    x = X.transduce(_lines(spark, d).select("event_id", "raw_line", "canonical"), table(spark, d, "sites"))
    x = x.withColumn("output", F.when(F.col("event_id") % 7 == 0, F.regexp_replace("output", r"status=\w+", "status=?")).otherwise(F.col("output")))
    return X.field_accuracy(x).groupBy("layout").agg(F.count("*").alias("n"), F.round(F.avg("accuracy"), 6).alias("accuracy"))


@query("log_offsets_learned", f"WITH {_TRUTH} SELECT site, CAST(min(off) AS INTEGER) AS utc_offset_min, count(*) AS n FROM truth WHERE layout = 'F1' GROUP BY site")
def log_offsets_learned(spark: SparkSession, d: str) -> DataFrame:
    return X.learn_offsets(_lines(spark, d).select("raw_line", "canonical"))


@query(
    "log_vocabulary_learned",
    f"""WITH {_TRUTH}, v AS (SELECT layout, status AS meaning, CASE layout WHEN 'F2' THEN CASE status WHEN 'OK' THEN '0' WHEN 'WARN' THEN '1' ELSE '2' END WHEN 'F4' THEN CASE status WHEN 'OK' THEN 'O' WHEN 'WARN' THEN 'W' ELSE 'F' END
    WHEN 'F5' THEN CASE status WHEN 'OK' THEN 'RUN' WHEN 'WARN' THEN 'WRN' ELSE 'FLT' END WHEN 'F6' THEN lower(status) ELSE status END AS raw FROM truth) SELECT layout, raw, min(meaning) AS meaning, count(*) AS n, count(DISTINCT meaning) > 1 AS ambiguous FROM v GROUP BY 1, 2""",
)
def log_vocabulary_learned(spark: SparkSession, d: str) -> DataFrame:
    return X.learn_vocabulary(_lines(spark, d).select("raw_line", "canonical"))


@query("log_transforms_learned", "SELECT * FROM (VALUES ('F1','temp','fahrenheit'),('F1','pres','psi'),('F2','temp','as printed'),('F2','pres','as printed'),('F3','temp','as printed'),('F3','pres','as printed'),('F4','temp','in tenths'),('F4','pres','in tenths'),('F5','temp','fahrenheit'),('F5','pres','psi'),('F6','temp','as printed'),('F6','pres','as printed')) t(layout, field, transform)")
def log_transforms_learned(spark: SparkSession, d: str) -> DataFrame:
    return X.learn_numbers(_lines(spark, d).select("raw_line", "canonical")).select("layout", "field", "transform")


@query(
    "log_date_order",
    f"""WITH {_TRUTH}, l AS (SELECT layout, utc + to_minutes(off) AS lo, utc FROM truth WHERE layout IN ('F3', 'F5')), e AS (SELECT layout, day(lo) AS dd, month(lo) AS mm FROM l)
    SELECT layout, CAST(sum(CASE WHEN layout = 'F3' OR dd = mm THEN 1 ELSE 0 END) AS BIGINT) AS day_first, CAST(sum(CASE WHEN layout = 'F5' OR dd = mm THEN 1 ELSE 0 END) AS BIGINT) AS month_first FROM e GROUP BY 1""",
)
def log_date_order(spark: SparkSession, d: str) -> DataFrame:
    return X.date_order_evidence(_lines(spark, d).select("raw_line", "canonical"), table(spark, d, "sites"))


# ---------------------------------------------------------------- sequences


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    e = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return table(spark, d, "events").groupBy("user_id").agg(F.transform(e, lambda x: x["event_type"]).alias("tokens"))


_SEQ = "seq AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS tokens FROM events GROUP BY 1)"


@query(
    "vocabulary_ids",
    "SELECT event_type AS token, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) + 1 AS INTEGER) AS id FROM events GROUP BY 1 UNION ALL SELECT '<PAD>', 0, 0 UNION ALL SELECT '<UNK>', 0, 1",
)
def vocabulary_ids(spark: SparkSession, d: str) -> DataFrame:
    return S.vocabulary(_sequences(spark, d), "tokens").withColumn("id", F.col("id").cast("int"))


@query(
    "encoded_sequences",
    f"""WITH {_SEQ}, v AS (SELECT event_type AS token, row_number() OVER (ORDER BY count(*) DESC, event_type) + 1 AS id FROM events WHERE event_type <> 'error' GROUP BY 1)
    SELECT user_id, list(CAST(coalesce(id, 1) AS INTEGER) ORDER BY ts, event_id) AS ids FROM events LEFT JOIN v ON token = event_type GROUP BY 1""",
)
def encoded_sequences(spark: SparkSession, d: str) -> DataFrame:
    s = _sequences(spark, d)
    vocab = S.vocabulary(s.withColumn("tokens", F.array_remove("tokens", "error")), "tokens")
    return S.encode(s, "user_id", "tokens", vocab).withColumn("ids", F.col("ids").cast("array<int>"))


@query(
    "prefix_examples",
    f"""WITH {_SEQ}, p AS (SELECT user_id, tokens, unnest(range(3, len(tokens))) AS position FROM seq) SELECT user_id, CAST(position AS INTEGER) AS position, array_to_string(tokens[greatest(1, position - 7):position], ' ') AS context, tokens[position + 1] AS target FROM p""",
)
def prefix_examples(spark: SparkSession, d: str) -> DataFrame:
    x = S.prefix_examples(_sequences(spark, d), "user_id", "tokens", 3, 8)
    return x.select("user_id", "position", F.concat_ws(" ", "context").alias("context"), "target")


_NG = f"""{_SEQ}, i AS (SELECT user_id, tokens, unnest(range(0, len(tokens))) AS i FROM seq), o AS (SELECT *, unnest(range(0, least(5, i) + 1)) AS ord FROM i),
ng AS (SELECT CAST(ord AS INTEGER) AS ord, array_to_string(tokens[i - ord + 1:i], '>') AS context, tokens[i + 1] AS nxt, count(*) AS c FROM o GROUP BY 1, 2, 3)"""


@query("ngram_counts", f"WITH {_NG} SELECT ord AS \"order\", context, nxt AS next, c FROM ng")
def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    n = S.ngram_counts(_sequences(spark, d), "tokens", 5)
    return n.select(F.col("order").cast("int").alias("order"), F.replace(F.col("context"), F.lit(S.SEP), F.lit(">")).alias("context"), "next", "c")


def _kn_sql(order: int, model: str) -> str:
    """Interpolated back-off over ng (model, ord, context, nxt, c) for the contexts of q (model, q, ctx)."""
    steps = []
    for k in range(1, order + 1):
        steps.append(
            f"""p{k} AS (SELECT p{k - 1}.model, q, ctx, token, CASE WHEN total IS NULL THEN p ELSE p * least(0.75, total) * kinds / total + greatest(coalesce(c, 0) - least(0.75, total), 0) / total END AS p FROM p{k - 1}
            LEFT JOIN tt ON tt.model = p{k - 1}.model AND tt.ord = {k} AND len(ctx) >= {k} AND tt.context = array_to_string(ctx[-{k}:], '>')
            LEFT JOIN ng ON ng.model = p{k - 1}.model AND ng.ord = {k} AND len(ctx) >= {k} AND ng.context = array_to_string(ctx[-{k}:], '>') AND nxt = token)"""
        )
    return f"""{model}, i AS (SELECT model, tokens, unnest(range(0, len(tokens))) AS i FROM ms), o AS (SELECT *, unnest(range(0, least({order}, i) + 1)) AS ord FROM i),
    ng AS (SELECT model, ord, array_to_string(tokens[i - ord + 1:i], '>') AS context, tokens[i + 1] AS nxt, count(*) AS c FROM o GROUP BY ALL), tok AS (SELECT DISTINCT model, nxt AS token FROM ng WHERE ord = 1),
    p0 AS (SELECT q.model, q, ctx, token, 1.0 / count(*) OVER (PARTITION BY q.model, q) AS p FROM q JOIN tok ON tok.model = q.model), tt AS (SELECT model, ord, context, sum(c) AS total, count(*) AS kinds FROM ng GROUP BY ALL),
    {", ".join(steps)}, kn AS (SELECT model, q, token, greatest(p, 1e-9) / sum(greatest(p, 1e-9)) OVER (PARTITION BY model, q) AS p FROM p{order})"""


_KN = _kn_sql(
    2,
    f"""{_SEQ}, ms AS (SELECT 'all' AS model, tokens FROM seq), q AS (SELECT 'all' AS model, array_to_string(ctx, '>') AS q, ctx FROM (
    SELECT tokens[-2:] AS ctx FROM seq UNION SELECT ['view', 'click'] UNION SELECT ['error', 'error'] UNION SELECT ['purchase', 'nothing']))""",
)
#: Users whose number leaves 6 over 7 have no model of their own.
_KN5 = _kn_sql(
    5,
    f"""{_SEQ}, e AS (SELECT CAST(user_id % 7 AS VARCHAR) AS ent, tokens FROM seq), ms AS (SELECT ent AS model, tokens FROM e WHERE ent <> '6' UNION ALL SELECT '__global__', tokens FROM e),
    q AS (SELECT DISTINCT CASE WHEN ent <> '6' THEN ent ELSE '__global__' END AS model, array_to_string(tokens[-5:], '>') AS q, tokens[-5:] AS ctx FROM e)""",
)


def _last_two(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, q, ctx): the last two tokens of every user; one, where there is one."""
    last = F.slice("tokens", F.greatest(F.size("tokens") - 1, F.lit(1)), F.lit(2))
    return _sequences(spark, d).select("user_id", F.concat_ws(">", last).alias("q"), last.alias("ctx"))


def _kn(spark: SparkSession, d: str) -> DataFrame:
    """The model of the three given contexts and of every user's; each distinct context once."""
    n = S.ngram_counts(_sequences(spark, d), "tokens", 2)
    q = spark.createDataFrame([("view>click", ["view", "click"]), ("error>error", ["error", "error"]), ("purchase>nothing", ["purchase", "nothing"])], "q string, ctx array<string>")
    q = q.unionByName(_last_two(spark, d).select("q", "ctx")).distinct()
    return S.kneser_ney(n, q, "q", "ctx", 2)


@query("kneser_ney", f"WITH {_KN} SELECT q, token, round(p, 8) AS p FROM kn")
def kneser_ney(spark: SparkSession, d: str) -> DataFrame:
    return _kn(spark, d).select("q", "token", F.round("p", 8).alias("p"))


@query(
    "next_symbol",
    f"""WITH {_KN}, best AS (SELECT q, arg_min(token, (-round(p, 8), token)) AS token FROM kn GROUP BY q)
    SELECT user_id, best.q, token FROM best LEFT JOIN (SELECT user_id, array_to_string(tokens[-2:], '>') AS q FROM seq) u ON u.q = best.q""",
)
def next_symbol(spark: SparkSession, d: str) -> DataFrame:
    best = _kn(spark, d).groupBy("q").agg(F.min_by("token", F.struct((-F.round("p", 8)).alias("p"), "token")).alias("token"))
    # a given context that no user's sequence ends in has a null user
    return best.join(_last_two(spark, d).select("user_id", "q"), "q", "left").select("user_id", "q", "token")


@query("kneser_ney_entities", f"WITH {_KN5} SELECT model, q, token, round(p, 8) AS p FROM kn")
def kneser_ney_entities(spark: SparkSession, d: str) -> DataFrame:
    s = _sequences(spark, d).withColumn("ent", (F.col("user_id") % 7).cast("string"))
    own = s.filter("ent <> '6'")
    models = own.withColumn("model", F.col("ent")).unionByName(s.withColumn("model", F.lit("__global__")))
    n = S.ngram_counts(models, "tokens", 5, by=["model"])
    last = F.slice("tokens", F.greatest(F.size("tokens") - 4, F.lit(1)), F.lit(5))
    q = S.entity_or_global(s, own, "ent").select("model", F.concat_ws(">", last).alias("q"), last.alias("ctx")).distinct()
    return S.kneser_ney(n, q, "q", "ctx", 5, by=["model"]).select("model", "q", "token", F.round("p", 8).alias("p"))


@query(
    "entity_models",
    "SELECT event_id, CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 90) THEN CAST(user_id AS VARCHAR) ELSE '__global__' END AS model FROM events",
)
def entity_models(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("user", F.col("user_id").cast("string"))
    return S.entity_or_global(e.select("event_id", "user"), e.filter("event_type = 'signup' AND value > 90"), "user").select("event_id", "model")


@query("entity_prefix", r"SELECT pump_id, CASE WHEN regexp_extract(lower(pump_id) || '_x', '^([A-Za-z]+[0-9]+)', 1) = '' THEN lower(pump_id) || '_x' ELSE regexp_extract(lower(pump_id) || '_x', '^([A-Za-z]+[0-9]+)', 1) END AS entity FROM pump_metadata")
def entity_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pump_metadata").select("pump_id", S.entity_of(F.concat(F.lower("pump_id"), F.lit("_x"))).alias("entity"))


# ---------------------------------------------------------------- streams


def _closed(df: DataFrame) -> DataFrame:
    return df.select(F.unix_seconds("window.start").alias("start_s"), F.unix_seconds("window.end").alias("end_s"), *[c for c in df.columns if c != "window"])


# windows that end after the newest event less the delay stay open
_OPEN = "(SELECT epoch(max(ts)) - 3600 FROM events)"


@query(
    "stream_tumbling",
    f"SELECT CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS start_s, CAST(floor(epoch(ts) / 21600) * 21600 + 21600 AS BIGINT) AS end_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3 HAVING end_s <= {_OPEN}",
)
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    s = W.event_stream(spark, f"{d}/events.parquet", "ts", "1 hour")
    return _closed(W.run_to_end(W.tumbling(s, "ts", "6 hours", ["event_type"], F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")), "tumbling"))


@query(
    "stream_sliding",
    f"""WITH x AS (SELECT ts, unnest([0, 1, 2]) AS k FROM events) SELECT CAST((floor(epoch(ts) / 14400) - k) * 14400 AS BIGINT) AS start_s, CAST((floor(epoch(ts) / 14400) - k) * 14400 + 43200 AS BIGINT) AS end_s, count(*) AS n FROM x GROUP BY 1, 2 HAVING end_s <= {_OPEN}""",
)
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    s = W.event_stream(spark, f"{d}/events.parquet", "ts", "1 hour")
    return _closed(W.run_to_end(W.sliding(s, "ts", "12 hours", "4 hours", [], F.count("*").alias("n")), "sliding"))


@query(
    "stream_sessions",
    f"""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 14400 THEN 1 ELSE 0 END AS f FROM events),
    i AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, CAST(floor(epoch(max(ts)) + 14400) AS BIGINT) AS end_s, user_id, count(*) AS n FROM i GROUP BY user_id, s HAVING epoch(max(ts)) + 14400 <= {_OPEN}""",
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = W.event_stream(spark, f"{d}/events.parquet", "ts", "1 hour")
    return _closed(W.run_to_end(W.sessions(s, "ts", "4 hours", ["user_id"], F.count("*").alias("n")), "sessions"))


@query("stream_first_seen", "SELECT count(DISTINCT (user_id, event_type)) AS n FROM events")
def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    s = W.event_stream(spark, f"{d}/events.parquet", "ts", "3650 days")
    return W.run_to_end(W.first_seen(s, ["user_id", "event_type"]), "first").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- user functions


@query("vectorised_function", "SELECT event_id, round(value * 1.8 + 32, 6) AS f FROM events")
def vectorised_function(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("double")
    def to_f(c: pd.Series) -> pd.Series:
        return c * 1.8 + 32

    return table(spark, d, "events").select("event_id", F.round(to_f("value"), 6).alias("f"))


@query("aggregate_function", "SELECT event_type, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1")
def aggregate_function(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    # the function needs all values of its group: a day of a type at a time, then the days' extremes
    e = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    e = e.select("event_type", F.explode(F.array("hi", "lo")).alias("value"))
    return e.groupBy("event_type").agg(F.round(spread("value"), 6).alias("spread"))


@query("table_function", "SELECT user_id, CAST(unnest(range(1, 1 + user_id % 4)) AS INTEGER) AS part FROM (SELECT DISTINCT user_id FROM events)")
def table_function(spark: SparkSession, d: str) -> DataFrame:
    @F.udtf(returnType=T.StructType([T.StructField("part", T.IntegerType())]))
    class Parts:
        def eval(self, n: int):
            for i in range(1, 1 + n % 4):
                yield (i,)

    spark.udtf.register("shoal_parts", Parts)
    table(spark, d, "events").select("user_id").distinct().createOrReplaceTempView("shoal_users")
    return spark.sql("SELECT user_id, part FROM shoal_users, LATERAL shoal_parts(CAST(user_id AS INT))")


@query("fold_function", "SELECT user_id, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def fold_function(spark: SparkSession, d: str) -> DataFrame:
    # a fold over a day's values, then over the days: both arrays are bounded
    day = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.aggregate(F.sort_array(F.collect_list("value")), F.lit(0.0), lambda a, x: a + x).alias("s"))
    return day.groupBy("user_id").agg(F.round(F.aggregate(F.sort_array(F.collect_list("s")), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))
