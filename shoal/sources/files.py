"""Readers and writers for CSV, JSON, Parquet, ORC and sheets, with stated schemas."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SourceError(ValueError):
    """A source is missing or not of the stated form."""


def read_csv(spark: SparkSession, path: str | list[str], schema: str | T.StructType, columns: list[str] | None = None, nulls: str = "", **options: str) -> DataFrame:
    """CSV with a header and a stated schema; only ``columns`` are parsed if given. A value equal to ``nulls`` is null."""
    df = spark.read.schema(schema).options(header=True, nullValue=nulls, **options).csv(path)
    return df.select(*columns) if columns else df


def read_text_columns(spark: SparkSession, path: str, keep_empty: bool = False) -> DataFrame:
    """CSV with every column a string, as written ("00123" stays). keep_empty: an empty field is '' instead of null."""
    df = spark.read.options(header=True, inferSchema=False, **({"nullValue": "\u0000", "emptyValue": ""} if keep_empty else {})).csv(path)
    return df.fillna("") if keep_empty else df


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names alone; no row is parsed."""
    return spark.read.options(header=True).csv(path).columns


def read_records(spark: SparkSession, path: str, schema: str, wrappers: tuple[str, ...] = ("data", "sequences", "items")) -> DataFrame:
    """JSON records: an array of them, or an object that holds the array under one of ``wrappers``."""
    inner = T.StructType.fromDDL(schema)
    wrapped = T.StructType([T.StructField(w, T.ArrayType(inner)) for w in wrappers] + inner.fields)
    raw = spark.read.option("multiLine", True).schema(wrapped).json(path)
    lists = F.coalesce(*wrappers, F.array(F.struct(*[F.col(f.name) for f in inner.fields])))
    return raw.select(F.inline(lists))


def read_union(spark: SparkSession, paths: list[str], expected: list[str], schema: str, sort: list[str] | None = None) -> DataFrame:
    """Several CSV files of exactly the expected header as one table."""
    for p in paths:
        got = header(spark, p)
        if got != expected:
            raise SourceError(f"{p}: header {got}, expected {expected}")
    df = read_csv(spark, paths, schema)
    return df.orderBy(*sort) if sort else df


def first_existing(candidates: list[str]) -> str:
    """The first of several places that exists."""
    for c in candidates:
        if Path(c).exists():
            return c
    raise SourceError(f"none of these exists: {candidates[:5]}")


def as_frame(spark: SparkSession, source: DataFrame | str, text: bool = False) -> DataFrame:
    """A DataFrame as it is; a path as the table its ending says."""
    if isinstance(source, DataFrame):
        return source
    kind = source.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_text_columns(spark, source) if text else spark.read.options(header=True, inferSchema=True).csv(source)
    if kind in ("parquet", "orc", "json"):
        return spark.read.format(kind).load(source)
    raise SourceError(f"unknown kind of source: {source}")


def read_sheets(spark: SparkSession, path: str, schema: str, out: str) -> DataFrame:
    """All sheets of a workbook, once turned to Parquet at ``out``. Needs a reader of pandas, which may not be installed."""
    import pandas as pd

    try:
        sheets = pd.read_excel(path, sheet_name=None, dtype=str)
    except ImportError as e:
        raise SourceError(f"no reader for workbooks is installed: {e}") from e
    spark.createDataFrame(pd.concat(sheets.values(), ignore_index=True), schema).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def unzip(path: str, member: str, folder: str) -> list[str]:
    """Members of an archive whose names end in ``member``, extracted to a folder."""
    with zipfile.ZipFile(path) as z:
        names = [n for n in z.namelist() if n.endswith(member)]
        if not names:
            raise SourceError(f"{path} has no member {member}")
        return [z.extract(n, folder) for n in names]


def file_digests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, bytes, sha256) of every file under a path that isn't empty, read by the executors."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def require_digests(spark: SparkSession, path: str | list[str], expected: dict[str, str]) -> None:
    """Raise SourceError unless the files under a path are those of ``expected`` (file name -> sha256), no fewer and no other."""
    got = {r["file"]: r["sha256"] for r in file_digests(spark, path).filter(~F.col("file").rlike("^[._]")).collect()}
    wrong = sorted(k for k in got.keys() | expected.keys() if got.get(k) != expected.get(k))
    if wrong:
        raise SourceError(f"files missing, unexpected or changed: {wrong[:5]}")


def save_vocabulary(vocab: DataFrame, path: str, **settings: object) -> None:
    """A vocabulary (token, n, id) and the settings it was made with, as one folder."""
    write_table(vocab, f"{path}/vocabulary")
    spark = vocab.sparkSession
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """What save_vocabulary wrote. Models of Spark ML have save and load of their own."""
    return spark.read.parquet(f"{path}/vocabulary"), json.loads(spark.read.text(f"{path}/settings").first()[0])


def write_sorted_csv(df: DataFrame, path: str, order: list[str], single: bool = False, time: str = "yyyy-MM-dd HH:mm:ss") -> None:
    """CSV in a stated order (over all files in name order) and a fixed time format. single: one file, for small results."""
    d = df.orderBy(*order)
    (d.coalesce(1) if single else d).write.mode("overwrite").options(header=True, timestampFormat=time).csv(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, kind: str = "parquet") -> None:
    """Parquet or ORC, in folders by the columns of ``by``."""
    w = df.write.mode("overwrite").format(kind)
    (w.partitionBy(*by) if by else w).save(path)


def report(df: DataFrame) -> str:
    """A one-row result as a JSON object."""
    rows = [r.asDict(True) for r in df.limit(2).collect()]
    if len(rows) != 1:
        raise SourceError("a report has exactly one row")
    return json.dumps(rows[0], default=str, sort_keys=True)
