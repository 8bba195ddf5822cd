"""Text clean-up expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column | str) -> Column:
    """c without white space of any kind at either end (trim() removes blanks only)."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^\s+|\s+$", "")


def folded(c: Column | str) -> Column:
    """c stripped and in lower case, the form in which unevenly spelled ids are compared."""
    return F.lower(strip(c))


def key128(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the columns; null differs from every value."""
    parts = [x for c in cols for x in (c.isNull(), c)]
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)
