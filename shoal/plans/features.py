"""Feature and assembly queries: catalogs, ranked lists, baselines, blends, parameter grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.functions.text import strip
from shoal.operators import bars as B
from shoal.operators import metrics as M
from shoal.operators.aggregates import mode_of, ranked
from shoal.operators.features import hash_fold
from shoal.operators.ranking import top_k
from shoal.plans.ranking import _AUC, _SCORED, _scored
from shoal.plans.registry import Registry, table
from shoal.plans.timeseries import _BARS, _PNL, _TREND, _trend

query = Registry()
QUERIES, SQL = query.queries, query.sql

_CODE = r"regexp_replace(upper(stock_code), '^\s+|\s+$', '', 'g')"


@query(
    "catalog_summary",
    rf"""WITH b AS (SELECT {_CODE} AS code, description, unit_price, invoice, invoice_date FROM sf_transactions WHERE quantity > 0),
    m AS (SELECT code, description FROM (SELECT code, description, row_number() OVER (PARTITION BY code ORDER BY count(*) DESC, description) AS rn FROM b WHERE description IS NOT NULL GROUP BY 1, 2) WHERE rn = 1)
    SELECT code, m.description AS description, median(unit_price) AS price, count(DISTINCT invoice) AS invoices, CAST(min(invoice_date) AS DATE) AS first_seen, CAST(max(invoice_date) AS DATE) AS last_seen FROM b LEFT JOIN m USING (code) GROUP BY 1, 2""",
)
def catalog_summary(spark: SparkSession, d: str) -> DataFrame:

    b = table(spark, d, "sf_transactions").filter("quantity > 0").withColumn("code", F.upper(strip("stock_code")))
    g = b.groupBy("code").agg(
        F.median("unit_price").alias("price"), F.count_distinct("invoice").alias("invoices"), F.to_date(F.min("invoice_date")).alias("first_seen"), F.to_date(F.max("invoice_date")).alias("last_seen")
    )
    return g.join(mode_of(b, ["code"], "description", "description"), "code", "left")


@query(
    "last_purchase_age",
    r"""SELECT customer_id, upper(trim(stock_code)) AS code, CAST(date_diff('day', CAST(max(invoice_date) AS DATE), DATE '2024-06-01') AS INTEGER) AS age FROM sf_transactions
    WHERE customer_id IS NOT NULL AND quantity > 0 AND invoice_date < TIMESTAMP '2024-06-01' GROUP BY 1, 2""",
)
def last_purchase_age(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "sf_transactions").filter((F.col("quantity") > 0) & F.col("customer_id").isNotNull() & (F.col("invoice_date") < F.lit("2024-06-01").cast("timestamp")))
    last = t.groupBy("customer_id", F.upper(F.trim("stock_code")).alias("code")).agg(F.max("invoice_date").alias("last"))
    return last.select("customer_id", "code", F.datediff(F.lit("2024-06-01").cast("date"), F.to_date("last")).alias("age"))


_SLATE = """sl AS (SELECT o_custkey, list_slice(list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey), 1, 5) AS items FROM orders GROUP BY 1)"""


def _slates(spark: SparkSession, d: str) -> DataFrame:
    t = top_k(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)
    return t.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "o_orderkey"))), lambda x: x["o_orderkey"]).alias("items"))


@query("lists_to_rows", f"WITH {_SLATE} SELECT o_custkey, CAST(i AS INTEGER) AS position, items[i] AS code FROM (SELECT o_custkey, items, unnest(range(1, len(items) + 1)) AS i FROM sl)")
def lists_to_rows(spark: SparkSession, d: str) -> DataFrame:
    return _slates(spark, d).select("o_custkey", F.posexplode("items").alias("p", "code")).select("o_custkey", (F.col("p") + 1).alias("position"), "code")


@query(
    "list_medians",
    f"""WITH {_SLATE} SELECT o_custkey, median(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END) AS med, round(avg(o_totalprice), 4) AS mean, round(avg(CAST(o_orderpriority = '1-URGENT' AS INT)), 6) AS urgent
    FROM (SELECT o_custkey, unnest(items) AS k FROM sl) JOIN orders ON o_orderkey = k AND orders.o_custkey = o_custkey GROUP BY o_custkey""".replace("FROM (SELECT o_custkey, unnest", "FROM (SELECT o_custkey AS c, unnest").replace("AND orders.o_custkey = o_custkey ", "AND o_custkey = c "),
)
def list_medians(spark: SparkSession, d: str) -> DataFrame:
    items = _slates(spark, d).select(F.explode("items").alias("o_orderkey"))
    o = table(spark, d, "orders").join(items, "o_orderkey")
    return o.groupBy("o_custkey").agg(
        F.median(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))).alias("med"), F.round(F.avg("o_totalprice"), 4).alias("mean"),
        F.round(F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")), 6).alias("urgent"),
    )


@query(
    "forced_difference",
    f"""WITH {_SLATE}, p AS (SELECT list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS pool FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20))
    SELECT o_custkey, CASE WHEN o_custkey % 3 = 0 THEN list_concat(items[1:len(items) - 1], [list_filter(pool, lambda x: NOT list_contains(items, x))[1]]) ELSE items END AS items FROM sl, p""",
)
def forced_difference(spark: SparkSession, d: str) -> DataFrame:
    # twenty keys in one row
    pool = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select((-F.col("o_totalprice")).alias("o"), "o_orderkey")
    pool = pool.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "o_orderkey"))), lambda x: x["o_orderkey"]).alias("pool"))
    s = _slates(spark, d).crossJoin(F.broadcast(pool))
    other = F.element_at(F.filter("pool", lambda x: ~F.array_contains(F.col("items"), x)), 1)
    changed = F.concat(F.slice("items", 1, F.size("items") - 1), F.array(other))
    return s.select("o_custkey", F.when(F.col("o_custkey") % 3 == 0, changed).otherwise(F.col("items")).alias("items"))


@query(
    "popular_baseline",
    "WITH p AS (SELECT l_partkey, row_number() OVER (ORDER BY count(DISTINCT l_orderkey) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1) SELECT c_custkey, CAST(rank AS INTEGER) AS rank, l_partkey FROM customer, p WHERE rank <= 10",
)
def popular_baseline(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(10)
    # ten rows: one array for every user
    row = n.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "l_partkey"))), lambda x: x["l_partkey"]).alias("top"))
    c = table(spark, d, "customer").select("c_custkey").crossJoin(F.broadcast(row))
    return c.select("c_custkey", F.posexplode("top").alias("p", "l_partkey")).select("c_custkey", (F.col("p") + 1).alias("rank"), "l_partkey")


@query(
    "random_baseline",
    "SELECT o_custkey, CAST(rn AS INTEGER) AS rank, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY sha256('draw:' || CAST(o_orderkey AS VARCHAR))) AS rn FROM orders) WHERE rn <= 2",
)
def random_baseline(spark: SparkSession, d: str) -> DataFrame:
    h = F.sha2(F.concat(F.lit("draw:"), F.col("o_orderkey").cast("string")), 256)
    return top_k(table(spark, d, "orders").withColumn("h", h), ["o_custkey"], [F.asc("h")], 2).select("o_custkey", "rank", "o_orderkey")


@query(
    "rank_blend",
    """WITH r AS (SELECT s_suppkey, (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0) / count(*) OVER () AS x, (rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0) / count(*) OVER () AS y
    FROM (SELECT s_suppkey, round(s_acctbal / 100) AS a, s_nationkey AS b FROM supplier)) SELECT s_suppkey, round(0.7 * x + 0.3 * y, 6) AS blend FROM r""",
)
def rank_blend(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.round(F.col("s_acctbal") / 100).alias("a"), F.col("s_nationkey").alias("b"))
    s = ranked(ranked(s, "a", [], "ra"), "b", [], "rb")
    return s.select("s_suppkey", F.round(0.7 * F.col("ra_pct") + 0.3 * F.col("rb_pct"), 6).alias("blend"))


@query(
    "carted_not_bought",
    """SELECT user_id, k, CAST(c > 0 AND p = 0 AS INTEGER) AS flag, round((p + 1) / (v + 20.0), 6) AS smoothed FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'view') AS v FROM events GROUP BY 1, 2)""",
)
def carted_not_bought(spark: SparkSession, d: str) -> DataFrame:
    from shoal.operators.features import recent_counts

    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))
    c = recent_counts(e, ["user_id", "k"], "event_type", ["click", "purchase", "view"], F.lit(True))
    return c.select("user_id", "k", ((F.col("n_click") > 0) & (F.col("n_purchase") == 0)).cast("int").alias("flag"), F.round((F.col("n_purchase") + 1) / (F.col("n_view") + 20.0), 6).alias("smoothed"))


@query("rank_position", "SELECT o_orderkey, round((row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1) / count(*) OVER (PARTITION BY o_custkey), 6) AS place FROM orders")
def rank_position(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", F.round((F.row_number().over(w.orderBy("o_totalprice", "o_orderkey")) - 1) / F.count("*").over(w), 6).alias("place"))


@query(
    "other_windows",
    "SELECT o_orderkey, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS dr, lead(o_orderkey) OVER w AS nxt, nth_value(o_orderkey, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS second, CAST(ntile(3) OVER w AS INTEGER) AS third FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
)
def other_windows(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey", F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("dr"), F.lead("o_orderkey").over(w).alias("nxt"),
        F.nth_value("o_orderkey", 2).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("second"), F.ntile(3).over(w).alias("third"),
    )


@query("sequence_split", "SELECT user_id, CAST(('0x' || substr(sha256('split:' || CAST(user_id AS VARCHAR)), 1, 8)) AS BIGINT) % 10 = 0 AS held_out FROM (SELECT DISTINCT user_id FROM events)")
def sequence_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id").distinct().select("user_id", (hash_fold(F.col("user_id"), 10, "split") == 0).alias("held_out"))


_GRID = [(3, 9), (4, 12), (6, 20)]


@query(
    "parameter_grid",
    "WITH "
    + _BARS
    + ", g(fast, slow) AS (VALUES (3, 9), (4, 12), (6, 20)), x AS (SELECT fast, slow, arena, step, "
    + "CASE WHEN fast = 3 THEN a3 WHEN fast = 4 THEN a4 ELSE a6 END > CASE WHEN slow = 9 THEN b9 WHEN slow = 12 THEN b12 ELSE b20 END AS up FROM g, (SELECT arena, step, "
    + ", ".join(f"CASE WHEN step >= {n - 1} THEN avg(close) OVER (PARTITION BY arena ORDER BY step ROWS {n - 1} PRECEDING) END AS {k}{n}" for k, n in (("a", 3), ("a", 4), ("a", 6), ("b", 9), ("b", 12), ("b", 20)))
    + " FROM bars)), e AS (SELECT *, CAST(coalesce(up, false) AS INT) AS pos FROM x), f AS (SELECT *, CASE WHEN pos = 1 AND coalesce(lag(pos) OVER (PARTITION BY fast, arena ORDER BY step), 0) = 0 AND step > 0 THEN 1 ELSE 0 END AS edge FROM e) "
    + "SELECT fast, slow, arena, round(avg(pos), 6) AS exposure, CAST(sum(edge) AS BIGINT) AS entries, avg(pos) BETWEEN 0.05 AND 0.95 AND sum(edge) >= 6 AS acceptable FROM f GROUP BY 1, 2, 3",
)
def parameter_grid(spark: SparkSession, d: str) -> DataFrame:
    bars = B.resample(table(spark, d, "orders"), "o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice", unit="week")
    w = B.arena_window()
    # a column a setting, so that the bars are sorted once
    for fast, slow in _GRID:
        bars = bars.withColumn(f"p{fast}", B.trend_position(fast, slow))
    bars = bars.withColumns({f"e{f}": ((F.col(f"p{f}") == 1) & (F.coalesce(F.lag(f"p{f}").over(w), F.lit(0)) == 0) & (F.col("step") > 0)).cast("int") for f, _ in _GRID})
    rows = F.inline(F.array(*[F.struct(F.lit(f).alias("fast"), F.lit(s).alias("slow"), F.col(f"p{f}").alias("pos"), F.col(f"e{f}").alias("edge")) for f, s in _GRID]))
    g = bars.select("arena", rows).groupBy("fast", "slow", "arena")
    out = g.agg(F.avg("pos").alias("x"), F.sum("edge").alias("entries"))
    return out.select("fast", "slow", "arena", F.round("x", 6).alias("exposure"), "entries", (F.col("x").between(0.05, 0.95) & (F.col("entries") >= 6)).alias("acceptable"))


@query(
    "inconsistency_penalty",
    "SELECT count(*) FILTER (a AND NOT b) AS bad, round(least(count(*) FILTER (a AND NOT b) / 100000.0, 0.05), 6) AS penalty FROM (SELECT value > 60 AS a, event_type IN ('view', 'click') AS b FROM events)",
)
def inconsistency_penalty(spark: SparkSession, d: str) -> DataFrame:
    bad = F.sum(((F.col("value") > 60) & ~F.col("event_type").isin("view", "click")).cast("long"))
    return table(spark, d, "events").agg(bad.alias("bad")).select("bad", F.round(F.least(F.col("bad") / 100_000.0, F.lit(0.05)), 6).alias("penalty"))


@query("auc_without_guard", f"WITH {_SCORED} " + _AUC.format(g="event_type,", p="PARTITION BY event_type", q="event_type,", e="GROUP BY event_type").replace(", 0.5), 6)", ", NULL), 6)"))
def auc_without_guard(spark: SparkSession, d: str) -> DataFrame:
    return M.auc(_scored(spark, d), "score", "label", ["event_type"], single_class=None).withColumn("auc", F.round("auc", 6))


@query(
    "win_rates",
    f"""WITH {_BARS}, {_TREND}, {_PNL} SELECT arena, round(avg(pos), 6) AS exposure, round(coalesce(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) FILTER (pnl <> 0), 0.5), 6) AS win_rate FROM p GROUP BY 1""",
)
def win_rates(spark: SparkSession, d: str) -> DataFrame:
    p = B.profit(_trend(spark, d))
    win = F.avg(F.when(F.col("pnl") != 0, (F.col("pnl") > 0).cast("double")))
    return p.groupBy("arena").agg(F.round(F.avg("pos"), 6).alias("exposure"), F.round(F.coalesce(win, F.lit(0.5)), 6).alias("win_rate"))


# ---------------------------------------------------------------- candidates, sketches, purchase features

_CAND = """WITH past AS (SELECT o_custkey AS u, l_partkey AS i FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '2000-01-01'),
truth AS (SELECT DISTINCT o_custkey AS u, l_partkey AS i FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '2000-01-01'),
pop AS (SELECT i FROM past GROUP BY i ORDER BY count(*) DESC, i LIMIT 20), cand AS (SELECT u, i FROM past UNION SELECT c_custkey, i FROM customer, pop)"""


def _candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(user, item) of what customers bought before the cutoff and the best sellers, and of what they bought after."""
    line = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("u"), F.col("l_partkey").alias("i"), "o_orderdate")
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    past = line.filter(F.col("o_orderdate") < cut).select("u", "i")
    top = past.groupBy("i").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "i").limit(20).select("i")
    # twenty rows
    everyone = table(spark, d, "customer").select(F.col("c_custkey").alias("u")).crossJoin(F.broadcast(top))
    return past.unionByName(everyone), line.filter(F.col("o_orderdate") >= cut).select("u", "i")


@query(
    "candidate_recall",
    f"""{_CAND} SELECT u, count(*) AS n_truth, count(c.i) AS n_hit, (SELECT count(*) FROM cand x WHERE x.u = t.u) AS n_candidates, round(count(c.i) / count(*), 6) AS recall
    FROM truth t LEFT JOIN cand c ON c.u = t.u AND c.i = t.i GROUP BY t.u ORDER BY u""".replace("SELECT u, count(*)", "SELECT t.u AS u, count(*)"),
)
def candidate_recall(spark: SparkSession, d: str) -> DataFrame:
    return M.candidate_recall(*_candidates(spark, d), "u", "i").withColumn("recall", F.round("recall", 6))


@query("candidate_coverage", f"{_CAND} SELECT count(*) AS n_items, count(c.i) AS n_covered, round(count(c.i) / count(*), 6) AS coverage FROM part LEFT JOIN (SELECT DISTINCT i FROM cand) c ON c.i = p_partkey")
def candidate_coverage(spark: SparkSession, d: str) -> DataFrame:
    catalog = table(spark, d, "part").select(F.col("p_partkey").alias("i"))
    return M.catalog_coverage(_candidates(spark, d)[0], catalog, "i").withColumn("coverage", F.round("coverage", 6))


@query("approximate_sketches", "SELECT l_shipmode, true AS distinct_close, true AS quantile_close FROM (SELECT DISTINCT l_returnflag AS l_shipmode FROM lineitem)")
def approximate_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of distinct counts and quantiles lie within their stated error of the exact values."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.count_distinct("l_partkey").alias("b"),
        F.percentile_approx("l_extendedprice", 0.9, 1000).alias("q"), F.count("*").alias("n"), F.expr("percentile(l_extendedprice, array(0.895, 0.905))").alias("r"),
    )
    return g.select("l_shipmode", (F.abs(F.col("a") - F.col("b")) <= 0.1 * F.col("b")).alias("distinct_close"), F.col("q").between(F.col("r")[0], F.col("r")[1]).alias("quantile_close"))


@query(
    "user_category_prices",
    """WITH l AS (SELECT o_custkey, p_brand, p_retailprice FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)
    SELECT o_custkey, p_brand, round(median(p_retailprice), 6) AS med, round(max(p_retailprice) / median(p_retailprice) + 1e-9, 4) AS top_ratio FROM l GROUP BY 1, 2""",
)
def user_category_prices(spark: SparkSession, d: str) -> DataFrame:
    """A customer's median price in each category, and the ratio of the dearest item to it."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    line = line.join(table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    med = F.median("p_retailprice")
    return line.groupBy("o_custkey", "p_brand").agg(F.round(med, 6).alias("med"), F.round(F.max("p_retailprice") / med + 1e-9, 4).alias("top_ratio"))


@query(
    "cold_start_flags",
    f"""WITH s AS (SELECT {_CODE} AS code, invoice_date, unit_price FROM sf_transactions WHERE quantity > 0 AND invoice_date IS NOT NULL), a AS (SELECT max(invoice_date) - INTERVAL 14 DAY AS anchor FROM s),
    m AS (SELECT code, median(unit_price) AS med FROM s, a WHERE invoice_date <= anchor GROUP BY code)
    SELECT s.code, CAST(min(invoice_date) > max(anchor) - INTERVAL 30 DAY AS INTEGER) AS cold, CAST(coalesce(bool_or(invoice_date > anchor AND invoice_date <= anchor + INTERVAL 7 DAY AND unit_price < 0.9 * med), false) AS INTEGER) AS cheap_next
    FROM s CROSS JOIN a LEFT JOIN m ON m.code = s.code GROUP BY s.code""",
)
def cold_start_flags(spark: SparkSession, d: str) -> DataFrame:
    """Items first met within 30 days of an anchor (or after it), and items offered below a tenth under their median in the week after it."""
    s = table(spark, d, "sf_transactions").filter("quantity > 0 AND invoice_date IS NOT NULL").select(F.upper(strip("stock_code")).alias("code"), "invoice_date", "unit_price")
    a = s.agg((F.max("invoice_date") - F.expr("INTERVAL 14 DAYS")).alias("anchor"))
    s = s.crossJoin(F.broadcast(a))
    m = s.filter("invoice_date <= anchor").groupBy("code").agg(F.median("unit_price").alias("med"))
    nxt = (F.col("invoice_date") > F.col("anchor")) & (F.col("invoice_date") <= F.col("anchor") + F.expr("INTERVAL 7 DAYS")) & (F.col("unit_price") < 0.9 * F.col("med"))
    g = s.join(m.withColumnRenamed("code", "_c"), F.col("code").eqNullSafe(F.col("_c")), "left").groupBy("code")
    return g.agg(
        (F.min("invoice_date") > F.max("anchor") - F.expr("INTERVAL 30 DAYS")).cast("int").alias("cold"), F.coalesce(F.bool_or(nxt), F.lit(False)).cast("int").alias("cheap_next")
    )
