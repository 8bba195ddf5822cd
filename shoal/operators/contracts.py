"""Data contracts: every check is a query for its violations, and all checks are one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class InvalidData(ValueError):
    """A contract is broken; the message names the first broken check and up to five examples."""


@dataclass
class Contract:
    """Checks on a table, in the order they count. Each returns rows (check_name, example)."""

    df: DataFrame
    checks: list[DataFrame]

    def __init__(self, df: DataFrame):
        self.df, self.checks = df, []

    def _add(self, name: str, bad: DataFrame, *example: str | Column) -> Contract:
        text = F.concat_ws("|", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("null")) for c in example])
        self.checks.append(bad.select(F.lit(len(self.checks)).alias("seq"), F.lit(name).alias("check_name"), text.alias("example")))
        return self

    def columns(self, names: list[str]) -> Contract:
        missing = [c for c in names if c not in self.df.columns]
        if missing:
            raise InvalidData(f"columns missing: {missing[:5]}")
        return self

    def row_count(self, other: DataFrame) -> Contract:
        n = self.df.agg(F.count("*").alias("a")).crossJoin(other.agg(F.count("*").alias("b")))
        return self._add("row_count", n.filter("a <> b"), "a", "b")

    def same_keys(self, other: DataFrame, key: list[str]) -> Contract:
        self._add("unknown_key", self.df.select(*key).join(other.select(*key), key, "left_anti"), *key)
        return self._add("missing_key", other.select(*key).join(self.df.select(*key), key, "left_anti"), *key)

    def rows_per_group(self, by: list[str], k: int) -> Contract:
        return self._add("rows_per_group", self.df.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") != k), *by, "n")

    def unique(self, key: list[str]) -> Contract:
        return self._add(f"duplicate_{'_'.join(key)}", self.df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1"), *key)

    def integer_between(self, column: str, low: int, high: int) -> Contract:
        x = F.col(column).try_cast("double") if self.df.schema[column].dataType.typeName() == "string" else F.col(column).cast("double")
        ok = F.coalesce((x == F.floor(x)) & (x >= low) & (x <= high), F.lit(False))
        return self._add(f"integer_{column}", self.df.filter(~ok), column)

    def in_vocabulary(self, column: str, vocabulary: DataFrame, word: str) -> Contract:
        v = vocabulary.select(F.col(word).alias("_w")).distinct()
        return self._add(f"vocabulary_{column}", self.df.join(v, self.df[column] == v["_w"], "left_anti"), column)

    def constant(self, column: str, by: list[str]) -> Contract:
        # least and greatest value instead of a distinct count: two values a group, whatever its size
        g = self.df.groupBy(*by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
        return self._add(f"constant_{column}", g.filter("_lo <> _hi"), *by)

    def finite(self, column: str, low: float | None = None, high: float | None = None) -> Contract:
        x = F.col(column).try_cast("double") if self.df.schema[column].dataType.typeName() == "string" else F.col(column).cast("double")
        ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
        ok = ok & (x >= low) if low is not None else ok
        ok = ok & (x <= high) if high is not None else ok
        return self._add(f"finite_{column}", self.df.filter(~F.coalesce(ok, F.lit(False))), column)

    def total(self, column: str, expected: int) -> Contract:
        return self._add(f"total_{column}", self.df.agg(F.coalesce(F.sum(column), F.lit(0)).alias("s")).filter(F.col("s") != expected), "s")

    def disjoint(self, other: DataFrame, key: list[str]) -> Contract:
        return self._add("overlap", self.df.select(*key).join(other.select(*key), key, "left_semi").distinct(), *key)

    def before(self, column: str, cutoff: str) -> Contract:
        return self._add(f"after_cutoff_{column}", self.df.filter(F.col(column) >= F.lit(cutoff).cast("timestamp")), column)

    def violations(self) -> DataFrame:
        """(seq, check_name, example) of every violation."""
        out = self.checks[0]
        for c in self.checks[1:]:
            out = out.unionByName(c)
        return out

    def counts(self) -> DataFrame:
        return self.violations().groupBy("check_name").agg(F.count("*").alias("violations"))

    def first_failure(self, examples: int = 5) -> DataFrame:
        """(check_name, violations, examples): the first check that fails, with its smallest examples; no row if all hold.

        All checks are counted in one pass; of each no more than ``examples`` examples are kept.
        """
        v = self.violations()
        top = v.withColumn("r", F.row_number().over(Window.partitionBy("seq").orderBy("example"))).filter(F.col("r") <= examples)
        top = top.groupBy("seq").agg(F.array_sort(F.collect_list("example")).alias("examples"))
        n = v.groupBy("seq", "check_name").agg(F.count("*").alias("violations"))
        return n.join(top, "seq").orderBy("seq").limit(1).select("check_name", "violations", "examples")

    def require(self) -> DataFrame:
        """The table, if it keeps its contract; one action over all checks."""
        w = self.violations().groupBy("seq", "check_name").agg(F.min("example").alias("e"), F.count("*").alias("n")).orderBy("seq").limit(1).collect()
        if w:
            bad = self.violations().filter(F.col("seq") == w[0]["seq"]).limit(5).collect()
            raise InvalidData(f"{w[0]['check_name']}: {w[0]['n']} violations, such as {[r['example'] for r in bad]}")
        return self.df


def answered_only(submission: DataFrame, answers: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key has an answer: partial answers judge only what they cover."""
    return submission.join(answers.select(*key).distinct(), key, "left_semi")
