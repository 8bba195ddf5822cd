"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings every operator here relies on (UTC, AQE)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shoal")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SHOAL_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset.

    The fallback is a folder of this machine, which is right only for local masters (tests);
    on a cluster without the setting this raises instead of writing where no one else can read.
    """
    conf = spark.sparkContext.getConf()
    d = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    got = spark.sparkContext.getCheckpointDir()
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    d = tempfile.mkdtemp(prefix="shoal-")
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, for one written table or stream."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def materialized(df: DataFrame, what: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: for results that several branches need."""
    at = scratch_path(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def python_partitions(df: DataFrame) -> int:
    """Partitions for work in Python after a shuffle: as many as shuffles have, and one a core at least.

    Given as a number, adaptive execution doesn't merge them by bytes: Python work is bound by CPU, not by size.
    """
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
