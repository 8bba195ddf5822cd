"""Queries that write a source of each kind and read it back, and checks on what was read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.operators import sequences as S
from shoal.operators.contracts import Contract
from shoal.plans.registry import Registry, table
from shoal.plans.texts import _sequences
from shoal.session import scratch_path
from shoal.sources.files import (
    as_frame,
    file_digests,
    header,
    load_vocabulary,
    read_csv,
    read_records,
    read_union,
    report,
    save_vocabulary,
    write_sorted_csv,
    write_table,
)

query = Registry()
QUERIES, SQL = query.queries, query.sql

_NATION = "n_nationkey int, n_name string, n_regionkey int"


@query("null_literals", "SELECT n_nationkey, CASE WHEN n_regionkey <> 2 THEN n_name END AS n_name, n_regionkey FROM nation")
def null_literals(spark: SparkSession, d: str) -> DataFrame:
    """A text that stands for a missing value, other than an empty field."""
    at = scratch_path(spark, "nulls")
    n = table(spark, d, "nation").withColumn("n_name", F.when(F.col("n_regionkey") == 2, "N/A").otherwise(F.col("n_name")))
    write_sorted_csv(n, at, ["n_nationkey"], single=True)
    return read_csv(spark, at, _NATION, nulls="N/A")


@query("header_only", "SELECT * FROM (VALUES (1, 'n_nationkey'), (2, 'n_name'), (3, 'n_regionkey')) t(place, name)")
def header_only(spark: SparkSession, d: str) -> DataFrame:
    """The columns of a CSV file, without its rows."""
    at = scratch_path(spark, "header")
    write_sorted_csv(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), at, ["n_nationkey"], single=True)
    return spark.createDataFrame(list(enumerate(header(spark, at), 1)), "place int, name string")


@query("json_records", "SELECT n_nationkey, n_name, n_regionkey, wrapped FROM nation, (VALUES (true), (false)) t(wrapped)")
def json_records(spark: SparkSession, d: str) -> DataFrame:
    """Records as an array under a name, and as an array alone."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    # twenty-five rows
    rows = n.agg(F.collect_list(F.struct(*n.columns)).alias("items"))
    wrapped, plain = scratch_path(spark, "wrapped"), scratch_path(spark, "plain")
    rows.select(F.to_json(F.struct("items"))).coalesce(1).write.text(wrapped)
    rows.select(F.to_json("items")).coalesce(1).write.text(plain)
    a = read_records(spark, wrapped, _NATION).withColumn("wrapped", F.lit(True))
    return a.unionByName(read_records(spark, plain, _NATION).withColumn("wrapped", F.lit(False)))


@query("csv_union", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_union(spark: SparkSession, d: str) -> DataFrame:
    """Files of one exact header as one table."""
    n, paths = table(spark, d, "nation"), []
    for k in range(2):
        paths.append(scratch_path(spark, f"part{k}"))
        write_sorted_csv(n.filter(F.col("n_nationkey") % 2 == k).select("n_nationkey", "n_name", "n_regionkey"), paths[-1], ["n_nationkey"], single=True)
    return read_union(spark, paths, ["n_nationkey", "n_name", "n_regionkey"], _NATION)


@query("frame_or_path", "SELECT r_regionkey, r_name, src FROM region, (VALUES ('frame'), ('parquet'), ('orc')) t(src)")
def frame_or_path(spark: SparkSession, d: str) -> DataFrame:
    """A DataFrame, or the path of one, taken alike."""
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    at = f"{scratch_path(spark, 'region')}.orc"
    write_table(r, at, kind="orc")
    out = as_frame(spark, r).withColumn("src", F.lit("frame"))
    for kind, path in (("parquet", f"{d}/region.parquet"), ("orc", at)):
        out = out.unionByName(as_frame(spark, path).select("r_regionkey", "r_name").withColumn("src", F.lit(kind)))
    return out


@query("orc_folders", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_nationkey = 7 AND c_acctbal > 0")
def orc_folders(spark: SparkSession, d: str) -> DataFrame:
    """ORC in folders by a column; the filter on it opens one folder."""
    at = scratch_path(spark, "orc")
    write_table(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), at, by=["c_nationkey"], kind="orc")
    return spark.read.orc(at).filter("c_nationkey = 7 AND c_acctbal > 0").select("c_custkey", "c_nationkey", "c_acctbal")


@query("json_report", "SELECT count(*) AS n, sum(l_linenumber) AS lines, min(l_quantity) AS least FROM lineitem")
def json_report(spark: SparkSession, d: str) -> DataFrame:
    """A one-row result as a JSON report, read again."""
    text = report(table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"), F.min("l_quantity").alias("least")))
    got = json.loads(text)
    return spark.createDataFrame([(got["n"], got["lines"], got["least"])], "n long, lines long, least double")


@query("file_digest_check", "SELECT 1 AS files, true AS same")
def file_digest_check(spark: SparkSession, d: str) -> DataFrame:
    """A copy of a file has the digest of the file."""
    at = scratch_path(spark, "copy")
    write_sorted_csv(table(spark, d, "region").select("r_regionkey"), at, ["r_regionkey"], single=True)
    a, b = (file_digests(spark, at).filter(F.col("file").endswith(".csv")) for _ in range(2))
    return a.join(b, ["file", "bytes", "sha256"], "full").agg(F.count("*").cast("int").alias("files"), F.every(F.length("sha256") == 64).alias("same"))


@query(
    "vocabulary_checkpoint",
    "SELECT token, n, id, 'events' AS made_of FROM (SELECT event_type AS token, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) + 1 AS INTEGER) AS id FROM events GROUP BY 1 UNION ALL SELECT '<PAD>', 0, 0 UNION ALL SELECT '<UNK>', 0, 1)",
)
def vocabulary_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """A vocabulary saved with its settings and loaded again."""
    at = scratch_path(spark, "vocabulary")
    save_vocabulary(S.vocabulary(_sequences(spark, d), "tokens"), at, made_of="events")
    vocab, settings = load_vocabulary(spark, at)
    return vocab.withColumn("made_of", F.lit(settings["made_of"]))


@query(
    "first_failed_check",
    """SELECT 'finite_price' AS check_name, count(*) AS violations, 'null,null,null,null,null' AS examples FROM orders WHERE o_orderkey % 301 = 0""",
)
def first_failed_check(spark: SparkSession, d: str) -> DataFrame:
    """The first check of a contract that fails, with five examples."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    s = o.select(k.alias("id"), F.when(k % 301 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 5 != 0, F.lit("odd")).otherwise(F.col("o_orderpriority")).alias("word"))
    c = Contract(s).row_count(o).unique(["id"]).finite("price").in_vocabulary("word", o, "o_orderpriority")
    return c.first_failure().withColumn("examples", F.array_join("examples", ","))
