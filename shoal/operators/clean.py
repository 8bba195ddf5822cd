"""Cleaning: names, text, numbers, sentinels, categories. All expressions stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.functions.text import strip
from shoal.operators.scans import global_numbers


def blank_sentinels(c: Column, words: tuple[str, ...] = ("nan", "None", "NaN", "NULL")) -> Column:
    """'' for null and for words that stand for a missing text."""
    return F.when(c.isNull() | c.isin(*words), F.lit("")).otherwise(c)


def to_number(c: Column) -> Column:
    """The finite number a text holds, else null. A plain cast would also take Java's type suffixes ("76902D")."""
    x = strip(c)
    return F.when(x.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), x.try_cast("double"))


def clean_id(c: Column) -> Column:
    """An id read as a number, as text without decimals; '' where there is none."""
    return F.coalesce(to_number(c).try_cast("bigint").cast("string"), F.lit(""))


def without_sentinel(c: Column, sentinel: float = -999.0) -> Column:
    return F.nullif(c, F.lit(sentinel))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """c within bounds; null stays null (least and greatest alone would drop it)."""
    x = c
    if low is not None:
        x = F.greatest(x, F.lit(low))
    if high is not None:
        x = F.least(x, F.lit(high))
    return F.when(c.isNotNull(), x)


def is_finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def one_hot(df: DataFrame, column: str, vocabulary: list[str], prefix: str) -> DataFrame:
    """One 0/1 column a word of a stated vocabulary; words outside it and nulls get zeros everywhere."""
    return df.withColumns({f"{prefix}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in vocabulary})


def label_encode(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """Codes from 0 in order of the values; null gets -1. The distinct values are numbered, not the rows."""
    codes = global_numbers(df.select(column).filter(F.col(column).isNotNull()).distinct(), [column], out)
    return df.join(codes, column, "left").withColumn(out, F.coalesce(out, F.lit(-1))).select(*df.columns, out)


def round_half_even_free(c: Column, digits: int = 1) -> Column:
    """Rounded, with -0.0 turned to 0.0."""
    return F.round(c, digits) + F.lit(0.0)
