"""The pN_ queries of the language-model problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.functions.text import strip
from shoal.llm.cooccur import LLR_01, LLR_1, item_pairs
from shoal.llm.leaks import leaked_items, near_items
from shoal.llm.mixing import mixture
from shoal.llm.reading import fit_reading_model, reading_levels


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sales_lines(tx: DataFrame) -> DataFrame:
    """(invoice, code) of sales of goods: no cancellations, write-offs or service codes."""
    code = F.upper(strip("stock_code"))
    return tx.select("invoice", "quantity", code.alias("code")).filter(
        (F.col("quantity") > 0) & ~F.col("invoice").startswith("C") & F.col("code").rlike(r"^[0-9]{5}[A-Z]*$")
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of codes on 5 or more invoices, on 1 in 1,000 or more, 6 times as often as by chance, and beyond chance at a risk of 1 %.

    The significance test can't drop a pair that meets the other three: its G2 is 9.5 at least.
    """
    pairs = item_pairs(sales_lines(_table(spark, d, "sf_transactions")), "invoice", "code", 5, 0.001, 6.0, LLR_1)
    return pairs.select(F.col("item_a").alias("code_a"), F.col("item_b").alias("code_b"))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of codes that share an invoice, with lift and log-likelihood ratio."""
    pairs = item_pairs(sales_lines(_table(spark, d, "sf_transactions")), "invoice", "code")
    return pairs.select(
        F.col("item_a").alias("code_a"), F.col("item_b").alias("code_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"), (F.round("llr", 4) + 0.0).alias("llr")
    )


def p4_significant(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of codes met together more or less often than by chance at a risk of 0.1 %, by the log-likelihood ratio alone."""
    pairs = item_pairs(sales_lines(_table(spark, d, "sf_transactions")), "invoice", "code", min_llr=LLR_01)
    return pairs.select(F.col("item_a").alias("code_a"), F.col("item_b").alias("code_b"), "n_ab", (F.round("llr", 4) + 0.0).alias("llr"))


_P4 = r"""
WITH b AS (
  SELECT DISTINCT invoice, regexp_replace(upper(stock_code), '^\s+|\s+$', '', 'g') AS code FROM sf_transactions
  WHERE quantity > 0 AND invoice NOT LIKE 'C%'
    AND regexp_full_match(regexp_replace(upper(stock_code), '^\s+|\s+$', '', 'g'), '[0-9]{5}[A-Z]*')),
n AS (SELECT count(DISTINCT invoice) AS n FROM b),
c AS (SELECT code, count(*) AS n_i FROM b GROUP BY code),
p AS (SELECT x.code AS code_a, y.code AS code_b, count(*) AS n_ab FROM b x JOIN b y ON x.invoice = y.invoice AND x.code < y.code GROUP BY 1, 2),
q AS (SELECT p.*, a.n_i AS n_a, b.n_i AS n_b, n.n FROM p JOIN c a ON a.code = code_a JOIN c b ON b.code = code_b CROSS JOIN n)
"""
_XLX = "(CASE WHEN {0} > 0 THEN ({0}) * ln(CAST({0} AS DOUBLE)) ELSE 0 END)"
_G = (
    "2 * ("
    + " + ".join(_XLX.format(x) for x in ("n_ab", "(n_a - n_ab)", "(n_b - n_ab)", "(n - n_a - n_b + n_ab)", "n"))
    + " - "
    + " - ".join(_XLX.format(x) for x in ("n_a", "(n - n_a)", "n_b", "(n - n_b)"))
    + ")"
)
P4_FOUND_SQL = _P4 + "SELECT code_a, code_b FROM q WHERE n_ab >= 5 AND n_ab * 1000 >= n AND n_ab * n >= 6 * n_a * n_b"
P4_PAIRS_SQL = _P4 + f"""SELECT code_a, code_b, n_ab, n_a, n_b, round(n_ab * n / (n_a * n_b), 6) AS lift,
  round(greatest({_G}, 0) * CASE WHEN n_ab * n >= n_a * n_b THEN 1 ELSE -1 END, 4) + 0.0 AS llr FROM q"""

P4_SIGNIFICANT_SQL = _P4 + f"""SELECT code_a, code_b, n_ab, round(g * CASE WHEN n_ab * n >= n_a * n_b THEN 1 ELSE -1 END, 4) + 0.0 AS llr
  FROM (SELECT *, greatest({_G}, 0) AS g FROM q) WHERE g >= {LLR_01}"""


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items of which they hold 12 or more consecutive words."""
    return leaked_items(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold five of the six rarest words of some 30 words of an evaluation item within 40 words, in any order."""
    return near_items(_table(spark, d, "documents"), _table(spark, d, "eval_items"), rare=6, need=5, stretch=30, span=40)


P8_SQL = r"""
WITH dt AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
it AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 10, 1))) AS i FROM dt)),
ig AS (SELECT item_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 1))) AS i FROM it))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""

_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
P8_NEAR_SQL = f"""
WITH dw AS (SELECT doc_id, unnest({_WORDS}) AS term, generate_subscripts({_WORDS}, 1) AS pos FROM documents WHERE text IS NOT NULL),
cf AS (SELECT term, count(*) AS c FROM dw GROUP BY term),
it AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
st AS (SELECT item_id, part, w[part + 1 : part + 30] AS w FROM (SELECT item_id, w, unnest(range(0, greatest(0, len(w) - 16) + 1, 15)) AS part FROM it WHERE len(w) > 0)),
tm AS (SELECT DISTINCT item_id, part, unnest(w) AS term FROM st),
rk AS (SELECT item_id, part, tm.term, row_number() OVER (PARTITION BY item_id, part ORDER BY coalesce(c, 0), tm.term) AS r FROM tm LEFT JOIN cf ON cf.term = tm.term),
pl AS (SELECT *, least(5, count(*) OVER (PARTITION BY item_id, part)) AS need FROM rk WHERE r <= 6),
h AS (SELECT doc_id, item_id, part, need, pl.term, pos FROM pl JOIN dw ON dw.term = pl.term),
g AS (SELECT a.doc_id, a.item_id, a.part, a.need, a.pos, b.term, min(a.pos - b.pos) AS back
  FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND a.part = b.part AND b.pos <= a.pos AND b.pos > a.pos - 40 GROUP BY ALL),
n AS (SELECT doc_id, item_id, part, need, pos, list_sort(list(back)) AS backs FROM g GROUP BY ALL HAVING count(*) >= need)
SELECT doc_id, item_id, min(backs[need] + 1) AS width FROM n GROUP BY doc_id, item_id
"""


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Each record drawn for the mixture, with its size in tokens and its copies."""
    return mixture(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target, allotted and actual share of each source."""
    shares = mixture(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))[1]
    return shares.withColumns({c: F.round(c, 6) for c in ("allotted_share", "actual_share")})


def _reading(spark: SparkSession, d: str):
    return fit_reading_model(_table(spark, d, "documents"), _table(spark, d, "reading_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """English documents written at band 5."""
    return reading_levels(_table(spark, d, "documents"), _reading(spark, d)).filter("band = 5").select("doc_id")


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    """Reading level and band of every document."""
    return reading_levels(_table(spark, d, "documents"), _reading(spark, d)).withColumn("level", F.round("level", 4))


def p10_validation(spark: SparkSession, d: str) -> DataFrame:
    """Error of the out-of-fold levels by the source that was left out."""
    model = _reading(spark, d)
    folds = model.folds if model else []
    f = spark.createDataFrame(folds, "doc_id long, source string, band double, predicted double, level double")
    err = F.abs(F.col("level") - F.col("band"))
    return f.groupBy("source").agg(
        F.count("*").alias("n"), F.round(F.avg(err), 4).alias("mean_error"), F.round(F.avg((F.round("level") == F.round("band")).cast("double")), 4).alias("same_band")
    )


QUERIES = {
    "p4_found": p4_found,
    "p4_pairs": p4_pairs,
    "p4_significant": p4_significant,
    "p8_found": p8_found,
    "p8_near": p8_near,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_levels": p10_levels,
    "p10_validation": p10_validation,
}
SQL = {"p4_found": P4_FOUND_SQL, "p4_pairs": P4_PAIRS_SQL, "p4_significant": P4_SIGNIFICANT_SQL, "p8_found": P8_SQL, "p8_near": P8_NEAR_SQL}
