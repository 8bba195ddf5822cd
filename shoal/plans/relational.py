"""Scans, projections, joins, aggregates, top-k and set operations on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.functions.text import folded, strip
from shoal.operators.aggregates import mode_of, ordered_list, pearson, quantile_bucket, ranked
from shoal.operators.clean import blank_sentinels, clean_id, clip, is_finite, label_encode, one_hot, to_number, without_sentinel
from shoal.operators.joins import co_occurrence, event_within, expand_steps, greedy_match, one_to_one, outside_periods
from shoal.operators.intervals import downtimes, merge_intervals
from shoal.operators.metrics import cumulative_share
from shoal.operators.ranking import exactly_k, top_k
from shoal.operators.scans import as_of
from shoal.plans.registry import Registry, table
from shoal.session import scratch_path
from shoal.sources.files import read_csv, read_text_columns, write_sorted_csv

query = Registry()
QUERIES, SQL = query.queries, query.sql

CODE_SQL = r"regexp_replace(upper(stock_code), '^\s+|\s+$', '', 'g')"


# ---------------------------------------------------------------- scans and cleaning


@query("csv_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    at = scratch_path(spark, "csv")
    write_sorted_csv(table(spark, d, "nation"), at, ["n_nationkey"], single=True)
    return read_csv(spark, at, "n_nationkey int, n_name string, n_regionkey int")


@query("all_text_scan", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation WHERE TRY_CAST(n_nationkey AS INTEGER) % 2 = 0")
def all_text_scan(spark: SparkSession, d: str) -> DataFrame:
    at = scratch_path(spark, "text")
    write_sorted_csv(table(spark, d, "nation"), at, ["n_nationkey"], single=True)
    df = read_text_columns(spark, at)
    return df.filter(F.col("n_nationkey").try_cast("int") % 2 == 0).select("n_nationkey", "n_name")


@query("pruned_scan", "SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'")
def pruned_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").filter((F.col("l_quantity") >= 45) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber")


@query("normalised_ids", r"SELECT row_id, regexp_replace(lower(user_id), '^\s+|\s+$', '', 'g') AS user_id, regexp_replace(lower(event_type), '^\s+|\s+$', '', 'g') AS event_type FROM rr_train")
def normalised_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rr_train").select("row_id", folded("user_id").alias("user_id"), folded("event_type").alias("event_type"))


@query(
    "clean_customer_ids",
    r"""SELECT invoice, coalesce(CAST(CAST(trunc(TRY_CAST(regexp_replace(customer_id, '^\s+|\s+$', '', 'g') AS DOUBLE)) AS BIGINT) AS VARCHAR), '') AS customer,
    CASE WHEN description IS NULL OR description IN ('nan', 'None', 'NaN', 'NULL') THEN '' ELSE description END AS description FROM sf_transactions""",
)
def clean_customer_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sf_transactions").select("invoice", clean_id(F.col("customer_id")).alias("customer"), blank_sentinels(F.col("description")).alias("description"))


@query("number_coercion", r"SELECT stock_code, count(*) AS n, sum(TRY_CAST(stock_code AS DOUBLE)) AS total FROM sf_transactions GROUP BY stock_code")
def number_coercion(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sf_transactions").groupBy("stock_code").agg(F.count("*").alias("n"), F.sum(to_number(F.col("stock_code"))).alias("total"))


@query(
    "valid_sales",
    rf"""SELECT invoice, {CODE_SQL} AS code, quantity, unit_price FROM sf_transactions WHERE quantity > 0 AND unit_price > 0
    AND invoice NOT LIKE 'C%' AND regexp_full_match({CODE_SQL}, '[0-9]{{5}}[A-Z]*')""",
)
def valid_sales(spark: SparkSession, d: str) -> DataFrame:
    code = F.upper(strip("stock_code"))
    df = table(spark, d, "sf_transactions").filter((F.col("quantity") > 0) & (F.col("unit_price") > 0) & ~F.col("invoice").startswith("C"))
    return df.select("invoice", code.alias("code"), "quantity", "unit_price").filter(F.col("code").rlike(r"^[0-9]{5}[A-Z]*$"))


@query(
    "sales_in_lookback",
    "SELECT invoice, count(*) AS n_lines FROM sf_transactions WHERE invoice_date >= TIMESTAMP '2024-01-01' - INTERVAL 30 DAY AND invoice_date < TIMESTAMP '2024-01-01' GROUP BY invoice",
)
def sales_in_lookback(spark: SparkSession, d: str) -> DataFrame:
    at = F.to_timestamp(F.lit("2024-01-01"))
    t = F.col("invoice_date")
    return table(spark, d, "sf_transactions").filter((t >= at - F.expr("INTERVAL 30 DAYS")) & (t < at)).groupBy("invoice").agg(F.count("*").alias("n_lines"))


@query(
    "sensor_sentinels",
    """SELECT pump_id, count(*) AS n, count(nullif(rpm, -999.0)) AS known, round(avg(nullif(rpm, -999.0)), 4) AS mean_rpm,
    count(CASE WHEN rpm = 0 AND flow_rate_m3_h = 0 THEN 1 END) AS n_down FROM sensor_readings GROUP BY pump_id""",
)
def sensor_sentinels(spark: SparkSession, d: str) -> DataFrame:
    rpm = without_sentinel(F.col("rpm"))
    down = (F.col("rpm") == 0) & (F.col("flow_rate_m3_h") == 0)
    return table(spark, d, "sensor_readings").groupBy("pump_id").agg(
        F.count("*").alias("n"), F.count(rpm).alias("known"), F.round(F.avg(rpm), 4).alias("mean_rpm"), F.count(F.when(down, 1)).alias("n_down")
    )


@query(
    "clipped_values",
    "SELECT event_id, least(greatest(value, 10.0), 90.0) AS clipped, (value IS NOT NULL AND isfinite(value)) AS finite FROM events",
)
def clipped_values(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").select("event_id", clip(v, 10.0, 90.0).alias("clipped"), is_finite(v).alias("finite"))


@query(
    "one_hot_priority",
    """SELECT o_orderkey, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS "p_1-URGENT", CAST(o_orderpriority = '2-HIGH' AS INTEGER) AS "p_2-HIGH",
    CAST(o_orderpriority = '5-LOW' AS INTEGER) AS "p_5-LOW" FROM orders""",
)
def one_hot_priority(spark: SparkSession, d: str) -> DataFrame:
    df = one_hot(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"], "p")
    return df.drop("o_orderpriority")


@query("label_encode_type", "SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code FROM events")
def label_encode_type(spark: SparkSession, d: str) -> DataFrame:
    return label_encode(table(spark, d, "events"), "event_type").select("event_id", F.col("code").cast("int").alias("code"))


@query("json_props", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


@query(
    "scalar_functions",
    """SELECT event_id, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS BIGINT) AS week, lpad(CAST(user_id AS VARCHAR), 6, '0') AS uid,
    round(ln(value + 1), 6) AS lv, round(sqrt(abs(value)), 6) AS sv, sha256('k:' || CAST(event_id AS VARCHAR)) AS digest, split_part(event_type, 'i', 1) AS head FROM events""",
)
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7).alias("week"), F.lpad(F.col("user_id").cast("string"), 6, "0").alias("uid"),
        F.round(F.log1p("value"), 6).alias("lv"), F.round(F.sqrt(F.abs("value")), 6).alias("sv"), F.sha2(F.concat(F.lit("k:"), F.col("event_id").cast("string")), 256).alias("digest"),
        F.substring_index("event_type", "i", 1).alias("head"),
    )


# ---------------------------------------------------------------- joins


@query(
    "orders_enriched",
    """SELECT o_orderkey, c_mktsegment, n_name, coalesce(r_name, 'none') AS r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def orders_enriched(spark: SparkSession, d: str) -> DataFrame:
    o, c, n, r = (table(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return j.select("o_orderkey", "c_mktsegment", "n_name", F.coalesce("r_name", F.lit("none")).alias("r_name"))


@query(
    "two_key_join",
    """WITH a AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
    SELECT a.l_partkey, a.l_suppkey, n, q FROM a LEFT JOIN b USING (l_partkey, l_suppkey)""",
)
def two_key_join(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    a = li.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    b = li.filter("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return a.join(b, ["l_partkey", "l_suppkey"], "left").select("l_partkey", "l_suppkey", "n", "q")


@query(
    "one_to_one_join",
    "SELECT c_custkey, a.c_name AS c_name_x, b.c_name AS c_name_y FROM customer a JOIN (SELECT * FROM customer WHERE c_acctbal > 0) b USING (c_custkey)",
)
def one_to_one_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return one_to_one(c.drop("c_acctbal"), c.filter("c_acctbal > 0").drop("c_acctbal"), ["c_custkey"])


@query("semi_recent_buyers", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01')")
def semi_recent_buyers(spark: SparkSession, d: str) -> DataFrame:
    recent = table(spark, d, "orders").filter(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(recent, "c_custkey", "left_semi").select("c_custkey")


@query("anti_never_bought", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate >= TIMESTAMP '2001-06-01')")
def anti_never_bought(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter(F.col("o_orderdate") >= F.lit("2001-06-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query(
    "right_and_natural_joins",
    """SELECT 'right' AS kind, n_name AS name, count(c_custkey) AS n FROM (SELECT * FROM customer WHERE c_acctbal > 9000) RIGHT JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
    UNION ALL SELECT 'natural', r_name, count(*) FROM (SELECT r_regionkey AS k, r_name FROM region) NATURAL JOIN (SELECT n_regionkey AS k FROM nation) GROUP BY ALL""",
)
def right_and_natural_joins(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    right = c.filter("c_acctbal > 9000").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "right").groupBy(F.lit("right").alias("kind"), F.col("n_name").alias("name")).agg(F.count("c_custkey").alias("n"))
    # the names the two sides share; a hint asks for sorting instead of broadcasting
    left, other = r.select(F.col("r_regionkey").alias("k"), "r_name"), n.select(F.col("n_regionkey").alias("k"))
    natural = left.join(other.hint("merge"), [x for x in left.columns if x in other.columns])
    return right.unionByName(natural.groupBy(F.lit("natural").alias("kind"), F.col("r_name").alias("name")).agg(F.count("*").alias("n")))


@query(
    "full_outer_counts",
    """SELECT user_id, coalesce(v, 0) AS views, coalesce(p, 0) AS purchases FROM (SELECT user_id, count(*) AS v FROM events WHERE event_type = 'view' AND value < 20 GROUP BY 1)
    FULL JOIN (SELECT user_id, count(*) AS p FROM events WHERE event_type = 'purchase' AND value > 80 GROUP BY 1) USING (user_id)""",
)
def full_outer_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    v = e.filter("event_type = 'view' AND value < 20").groupBy("user_id").agg(F.count("*").alias("views"))
    p = e.filter("event_type = 'purchase' AND value > 80").groupBy("user_id").agg(F.count("*").alias("purchases"))
    return v.join(p, "user_id", "full").fillna(0)


@query(
    "membership_flag",
    """SELECT event_id, CAST(EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND CAST(p.ts AS DATE) = CAST(e.ts AS DATE)) AS INTEGER) AS bought_that_day
    FROM events e WHERE event_type = 'view'""",
)
def membership_flag(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    bought = e.filter("event_type = 'purchase'").select("user_id", "day").distinct().withColumn("b", F.lit(1))
    return e.filter("event_type = 'view'").join(bought, ["user_id", "day"], "left").select("event_id", F.coalesce("b", F.lit(0)).alias("bought_that_day"))


@query(
    "failure_within_48h",
    """WITH f AS (SELECT DISTINCT pump_id, CAST(epoch(failure_time) AS BIGINT) AS t FROM failure_log WHERE pump_id IS NOT NULL AND failure_time IS NOT NULL)
    SELECT DISTINCT reading_id, CAST(EXISTS (SELECT 1 FROM f WHERE f.pump_id = r.pump_id AND f.t > epoch(r."timestamp") AND f.t <= epoch(r."timestamp") + 172800) AS INTEGER) AS label FROM sensor_readings r""",
)
def failure_within_48h(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "sensor_readings").select("reading_id", "pump_id", F.unix_seconds("timestamp").alias("t")).distinct()
    f = table(spark, d, "failure_log").select("pump_id", F.unix_seconds("failure_time").alias("t"))
    return event_within(r, f, "pump_id", "t", "t", 48 * 3600).select("reading_id", "label")


@query(
    "readings_outside_downtime",
    """SELECT DISTINCT reading_id FROM sensor_readings r WHERE NOT EXISTS (SELECT 1 FROM failure_log f WHERE f.pump_id = r.pump_id AND f.downtime_hours > 0
    AND epoch(r."timestamp") >= CAST(epoch(f.failure_time) AS BIGINT) AND epoch(r."timestamp") < CAST(epoch(f.failure_time) AS BIGINT) + f.downtime_hours * 3600)""",
)
def readings_outside_downtime(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "sensor_readings").select("reading_id", "pump_id", F.unix_seconds("timestamp").alias("t")).distinct()
    periods = merge_intervals(downtimes(table(spark, d, "failure_log")), "pump_id", "start_s", "end_s").filter("kind = 'down'")
    return outside_periods(r, periods, "pump_id", "t", 7 * 86_400).select("reading_id")


@query(
    "last_failure_as_of",
    """WITH f AS (SELECT pump_id, CAST(epoch(failure_time) AS BIGINT) AS f_s, max(coalesce(downtime_hours, -1)) AS h FROM failure_log WHERE pump_id IS NOT NULL AND failure_time IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT DISTINCT reading_id, pump_id, CAST(epoch("timestamp") AS BIGINT) AS t FROM sensor_readings)
    SELECT reading_id, f_s, h FROM r ASOF LEFT JOIN f ON r.pump_id = f.pump_id AND r.t >= f.f_s""",
)
def last_failure_as_of(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "sensor_readings").select("reading_id", "pump_id", F.unix_seconds("timestamp").alias("t")).distinct()
    f = table(spark, d, "failure_log").filter("pump_id IS NOT NULL").select("pump_id", F.unix_seconds("failure_time").alias("f_s"), F.coalesce("downtime_hours", F.lit(-1)).alias("h"))
    return as_of(r, f, ["pump_id"], "t", "f_s", "floor(_t / 2592000)", ["f_s", "h"]).select("reading_id", "f_s", "h")


@query(
    "copurchase_cosine",
    rf"""WITH b AS (SELECT DISTINCT invoice, {CODE_SQL} AS i FROM sf_transactions WHERE quantity > 0 AND invoice IS NOT NULL AND stock_code IS NOT NULL), n AS (SELECT i, count(*) AS n FROM b GROUP BY i),
    p AS (SELECT a.i AS item_a, c.i AS item_b, count(*) AS n_ab FROM b a JOIN b c ON a.invoice = c.invoice AND a.i <> c.i GROUP BY 1, 2)
    SELECT item_a, item_b, n_ab, round(n_ab / sqrt(CAST(x.n AS DOUBLE) * y.n), 6) AS cosine, round(n_ab / sqrt((x.n + 5.0) * (y.n + 5.0)), 6) AS smoothed
    FROM p JOIN n x ON x.i = item_a JOIN n y ON y.i = item_b""",
)
def copurchase_cosine(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sf_transactions").filter("quantity > 0").select("invoice", F.upper(strip("stock_code")).alias("i"))
    p = co_occurrence(rows, "invoice", "i")
    smoothed = F.col("n_ab") / F.sqrt((F.col("n_a") + 5.0) * (F.col("n_b") + 5.0))
    return p.select("item_a", "item_b", "n_ab", F.round("cosine", 6).alias("cosine"), F.round(smoothed, 6).alias("smoothed"))


@query(
    "neighbours_top5",
    rf"""WITH b AS (SELECT DISTINCT invoice, {CODE_SQL} AS i FROM sf_transactions WHERE quantity > 0 AND invoice IS NOT NULL AND stock_code IS NOT NULL), n AS (SELECT i, count(*) AS n FROM b GROUP BY i),
    p AS (SELECT a.i AS item_a, c.i AS item_b, count(*) AS n_ab FROM b a JOIN b c ON a.invoice = c.invoice AND a.i <> c.i GROUP BY 1, 2),
    q AS (SELECT item_a, item_b, round(n_ab / sqrt(CAST(x.n AS DOUBLE) * y.n), 6) AS cosine FROM p JOIN n x ON x.i = item_a JOIN n y ON y.i = item_b)
    SELECT item_a, item_b, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_a ORDER BY cosine DESC, item_b) AS rn FROM q) WHERE rn <= 5""",
)
def neighbours_top5(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sf_transactions").filter("quantity > 0").select("invoice", F.upper(strip("stock_code")).alias("i"))
    p = co_occurrence(rows, "invoice", "i").withColumn("cosine", F.round("cosine", 6))
    return top_k(p, ["item_a"], [F.desc("cosine"), F.asc("item_b")], 5).select("item_a", "item_b", "rank")


@query(
    "interval_expansion",
    "SELECT o_orderkey, CAST(unnest(range(CAST(l0 AS BIGINT), CAST(l1 AS BIGINT))) AS BIGINT) AS step FROM (SELECT o_orderkey, o_orderkey % 10 AS l0, o_orderkey % 10 + o_custkey % 4 AS l1 FROM orders)",
)
def interval_expansion(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 10).alias("l0"), (F.col("o_orderkey") % 10 + F.col("o_custkey") % 4).alias("l1"))
    return expand_steps(o, "l0", "l1").select("o_orderkey", "step")


@query("greedy_matching")
def greedy_matching(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("x"), F.length("c_name").cast("double").alias("y"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("x"), F.length("s_name").cast("double").alias("y"))
    return greedy_match(s, c, "nation", "key", ["x", "y"]).withColumn("distance", F.round("distance", 6))


@query(
    "candidate_union",
    """WITH top AS (SELECT event_type, user_id FROM (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS rn FROM events GROUP BY 1, 2) WHERE rn <= 3)
    SELECT DISTINCT o, user_id FROM (SELECT event_type AS o, user_id FROM top UNION ALL SELECT event_type, user_id FROM events WHERE value > 99 UNION ALL SELECT 'any', user_id FROM events WHERE event_type = 'signup')""",
)
def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    n = e.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    top = top_k(n, ["event_type"], [F.desc("n"), F.asc("user_id")], 3).select(F.col("event_type").alias("o"), "user_id")
    return top.unionByName(e.filter("value > 99").select(F.col("event_type").alias("o"), "user_id")).unionByName(
        e.filter("event_type = 'signup'").select(F.lit("any").alias("o"), "user_id")
    ).distinct()


@query(
    "users_by_ranks",
    "SELECT c_custkey, CAST(r AS INTEGER) AS rank FROM customer, range(1, 4) t(r)",
)
def users_by_ranks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rank"))


# ---------------------------------------------------------------- aggregates


@query(
    "multi_aggregate",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(avg(l_discount), 6) AS disc, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
    count(DISTINCT l_suppkey) AS supps, median(l_quantity) AS med, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS psd,
    quantile_cont(l_extendedprice, 0.9) AS q90 FROM lineitem GROUP BY 1, 2""",
)
def multi_aggregate(spark: SparkSession, d: str) -> DataFrame:
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum(q).alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"), F.min(p).alias("lo"), F.max(p).alias("hi"), F.count_distinct("l_suppkey").alias("supps"),
        F.median(q).alias("med"), F.round(F.stddev_samp(q), 6).alias("sd"), F.round(F.stddev_pop(q), 6).alias("psd"), F.percentile(p, F.lit(0.9)).alias("q90"),
    )


@query(
    "mode_per_code",
    r"""SELECT code, mode FROM (SELECT code, description AS mode, row_number() OVER (PARTITION BY code ORDER BY n DESC, description) AS rn FROM
    (SELECT upper(trim(stock_code)) AS code, description, count(*) AS n FROM sf_transactions WHERE description IS NOT NULL GROUP BY 1, 2)) WHERE rn = 1""",
)
def mode_per_code(spark: SparkSession, d: str) -> DataFrame:
    return mode_of(table(spark, d, "sf_transactions").withColumn("code", F.upper(F.trim("stock_code"))), ["code"], "description")


@query("ordered_lists", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS keys FROM orders GROUP BY o_custkey")
def ordered_lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(ordered_list("o_orderkey", "o_orderdate").alias("keys"))


@query("sets_per_group", "SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY user_id")
def sets_per_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("kinds"))


@query(
    "conditional_rates",
    "SELECT user_id, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS rate, round(avg(CASE WHEN event_type = 'purchase' THEN value END), 6) AS mean_value, bool_and(value >= 0) AS all_ok FROM events GROUP BY user_id",
)
def conditional_rates(spark: SparkSession, d: str) -> DataFrame:
    buy = F.col("event_type") == "purchase"
    return table(spark, d, "events").groupBy("user_id").agg(
        F.round(F.avg(buy.cast("double")), 6).alias("rate"), F.round(F.avg(F.when(buy, F.col("value"))), 6).alias("mean_value"), F.bool_and(F.col("value") >= 0).alias("all_ok")
    )


@query("frequency_share", "SELECT event_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM events GROUP BY event_type")
def frequency_share(spark: SparkSession, d: str) -> DataFrame:
    return cumulative_share(table(spark, d, "events"), "event_type")


@query(
    "customer_terciles",
    """SELECT c_custkey, CASE WHEN c_acctbal <= a THEN 'low' WHEN c_acctbal <= b THEN 'mid' ELSE 'high' END AS bucket FROM customer,
    (SELECT quantile_cont(c_acctbal, 1.0 / 3) AS a, quantile_cont(c_acctbal, 2.0 / 3) AS b FROM customer)""",
)
def customer_terciles(spark: SparkSession, d: str) -> DataFrame:
    return quantile_bucket(table(spark, d, "customer"), "c_acctbal", [1 / 3, 2 / 3], ["low", "mid", "high"]).select("c_custkey", "bucket")


@query("correlations", "SELECT l_returnflag, round(coalesce(corr(l_quantity, l_extendedprice), 0), 6) + 0.0 AS r FROM lineitem GROUP BY 1")
def correlations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg((F.round(pearson(F.col("l_quantity"), F.col("l_extendedprice")), 6) + 0.0).alias("r"))


@query(
    "average_ranks",
    """SELECT s_suppkey, r, r / count(*) OVER (PARTITION BY s_nationkey) AS r_pct FROM (SELECT s_suppkey, s_nationkey,
    rank() OVER (PARTITION BY s_nationkey ORDER BY round(s_acctbal / 1000)) + (count(*) OVER (PARTITION BY s_nationkey, round(s_acctbal / 1000)) - 1) / 2.0 AS r FROM supplier)""",
)
def average_ranks(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.round(F.col("s_acctbal") / 1000).alias("b"))
    return ranked(s, "b", ["s_nationkey"], "r").select("s_suppkey", "r", "r_pct")


@query(
    "arg_extremes",
    """SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest FROM orders GROUP BY 1""",
)
def arg_extremes(spark: SparkSession, d: str) -> DataFrame:
    by = F.struct("o_totalprice", "o_orderkey")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", by).alias("dearest"), F.min_by("o_orderkey", by).alias("cheapest"))


@query(
    "grouping_sets",
    "SELECT event_type, CAST(user_id % 3 AS BIGINT) AS g, count(*) AS n, CAST(grouping(event_type, user_id % 3) AS BIGINT) AS lvl FROM events GROUP BY CUBE (event_type, user_id % 3)",
)
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("g", F.col("user_id") % 3)
    return e.cube("event_type", "g").agg(F.count("*").alias("n"), F.grouping_id().alias("lvl"))


@query("pivoted_counts", "SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click FROM events GROUP BY user_id HAVING count(*) FILTER (event_type IN ('view', 'click')) > 0")
def pivoted_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter(F.col("event_type").isin("view", "click"))
    return e.groupBy("user_id").pivot("event_type", ["view", "click"]).agg(F.count(F.lit(1))).fillna(0)


@query("distinct_groups", "SELECT count(DISTINCT (user_id, event_type)) AS n FROM events")
def distinct_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.count_distinct("user_id", "event_type").alias("n"))


# ---------------------------------------------------------------- order, top-k, sets


@query(
    "top3_users_per_type",
    """SELECT event_type, user_id, days, CAST(rn AS INTEGER) AS rank FROM (SELECT event_type, user_id, count(DISTINCT CAST(ts AS DATE)) AS days,
    row_number() OVER (PARTITION BY event_type ORDER BY count(DISTINCT CAST(ts AS DATE)) DESC, user_id) AS rn FROM events GROUP BY 1, 2) WHERE rn <= 3""",
)
def top3_users_per_type(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count_distinct(F.to_date("ts")).alias("days"))
    return top_k(n, ["event_type"], [F.desc("days"), F.asc("user_id")], 3)


@query("global_top10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def global_top10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query(
    "exactly_twenty",
    "SELECT s_suppkey, CAST(coalesce(rn <= 20, false) AS INTEGER) AS selected FROM supplier LEFT JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rn FROM supplier WHERE s_acctbal > 1000) USING (s_suppkey)",
)
def exactly_twenty(spark: SparkSession, d: str) -> DataFrame:
    return exactly_k(table(spark, d, "supplier"), "s_suppkey", F.col("s_acctbal") > 1000, [F.desc("s_acctbal")], 20).select("s_suppkey", "selected")


@query("first_and_last_order", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_key FROM orders GROUP BY 1")
def first_and_last_order(spark: SparkSession, d: str) -> DataFrame:
    by = F.struct("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", by).alias("first_key"), F.max_by("o_orderkey", by).alias("last_key"))


@query("running_number", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS n FROM events")
def running_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("n"))


@query(
    "replayed_rows",
    """SELECT pump_id, count(*) AS distinct_rows, CAST(sum(n) AS BIGINT) AS all_rows FROM (SELECT reading_id, pump_id, "timestamp", vibration_mm_s, bearing_temp_c, discharge_pressure_kpa, flow_rate_m3_h, motor_current_a, rpm, maintenance_flag, count(*) AS n
    FROM sensor_readings GROUP BY ALL) GROUP BY pump_id""",
)
def replayed_rows(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "sensor_readings")
    return r.groupBy(*r.columns).agg(F.count("*").alias("n")).groupBy("pump_id").agg(F.count("*").alias("distinct_rows"), F.sum("n").alias("all_rows"))


@query(
    "first_delivery_kept",
    "SELECT reading_id, pump_id FROM (SELECT *, row_number() OVER (PARTITION BY pump_id, \"timestamp\" ORDER BY reading_id) AS rn FROM sensor_readings) WHERE rn = 1",
)
def first_delivery_kept(spark: SparkSession, d: str) -> DataFrame:
    # min combines before the shuffle, a window would not
    return table(spark, d, "sensor_readings").groupBy("pump_id", "timestamp").agg(F.min("reading_id").alias("reading_id")).select("reading_id", "pump_id")


@query("duplicate_keys", "SELECT reading_id, count(*) AS n FROM sensor_readings GROUP BY reading_id HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sensor_readings").groupBy("reading_id").agg(F.count("*").alias("n")).filter("n > 1")


@query("tagged_union", "SELECT 'customer' AS side, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2")
def tagged_union(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n")).withColumn("side", F.lit("customer"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n")).withColumn("side", F.lit("supplier"))
    return c.unionByName(s)


@query("keys_in_both", "SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 95")
def keys_in_both(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.filter("event_type = 'error'").select("user_id").intersect(e.filter("event_type = 'purchase' AND value > 95").select("user_id"))


@query("keys_in_one", "SELECT user_id FROM events WHERE event_type = 'error' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 95")
def keys_in_one(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.filter("event_type = 'error'").select("user_id").subtract(e.filter("event_type = 'purchase' AND value > 95").select("user_id"))


@query(
    "array_overlap",
    """WITH k AS (SELECT user_id, list_sort(list(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT))) AS ks FROM events GROUP BY 1)
    SELECT a.user_id, round(len(list_intersect(a.ks, b.ks)) / CAST(len(a.ks) AS DOUBLE), 6) AS overlap FROM k a JOIN k b ON b.user_id = a.user_id + 1""",
)
def array_overlap(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.get_json_object("props", "$.k").try_cast("bigint")).alias("ks"))
    b = k.select((F.col("user_id") - 1).alias("user_id"), F.col("ks").alias("other"))
    return k.join(b, "user_id").select("user_id", F.round(F.size(F.array_intersect("ks", "other")) / F.size("ks"), 6).alias("overlap"))
