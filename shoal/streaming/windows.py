"""Windowed streaming aggregates and bounded-memory duplicate removal over a Parquet file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.session import scratch_path


def event_stream(spark: SparkSession, path: str, at: str, delay: str, **options: str) -> DataFrame:
    """A Parquet path as a stream with a watermark; a time stamp without zone counts as UTC."""
    schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema).options(**options).parquet(f"{path[:-1]}[{path[-1]}]")
    return s.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)


def tumbling(stream: DataFrame, at: str, size: str, by: list[str], *aggs) -> DataFrame:
    return stream.groupBy(F.window(at, size), *by).agg(*aggs)


def sliding(stream: DataFrame, at: str, size: str, step: str, by: list[str], *aggs) -> DataFrame:
    return stream.groupBy(F.window(at, size, step), *by).agg(*aggs)


def sessions(stream: DataFrame, at: str, gap: str, by: list[str], *aggs) -> DataFrame:
    return stream.groupBy(F.session_window(at, gap).alias("window"), *by).agg(*aggs)


def first_seen(stream: DataFrame, key: list[str]) -> DataFrame:
    """One row a key within the watermark's delay."""
    return stream.dropDuplicatesWithinWatermark(key)


def run_to_end(stream: DataFrame, what: str) -> DataFrame:
    """Run a stream over all that is there, append mode, and read its output.

    Windows that the watermark hasn't passed at the end of the input are not closed and don't come out.
    """
    spark = stream.sparkSession
    at = scratch_path(spark, what)
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out")
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
