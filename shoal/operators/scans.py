"""Ordered scans per entity that split an entity of any size.

A window over a whole entity runs in one task. Here an entity is cut into blocks along its order;
a scan runs within each block, block results are combined in order (one row a block), and each block
takes over what came before. ``block`` is any column that is non-decreasing along the order, such as a month.
Every function needs an order without ties within an entity (add a unique column).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.session import checkpointed

FIRST, NOW, LAST = Window.unboundedPreceding, Window.currentRow, Window.unboundedFollowing


def _window(entity: list[str], order: list[str]):
    return Window.partitionBy(*entity).orderBy(*order)


def _carry(df: DataFrame, entity: list[str], block: str, per_block: list[Column], over_blocks: dict[str, Column]) -> DataFrame:
    """df with columns computed over the summaries of all earlier (or later) blocks of the entity."""
    s = df.groupBy(*entity, block).agg(*per_block).withColumns(over_blocks)
    keys = [*entity, block]
    s = s.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *over_blocks)
    cond = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    return df.join(s, cond, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def numbered(df: DataFrame, entity: list[str], order: list[str], block: str, out: str = "rn") -> DataFrame:
    """Row number (from 1) of each row in its entity's order."""
    w = Window.partitionBy(*entity).orderBy(block)
    d = _carry(df, entity, block, [F.count("*").alias("_n")], {"_before": F.coalesce(F.sum("_n").over(w.rowsBetween(FIRST, -1)), F.lit(0))})
    return d.withColumn(out, F.row_number().over(_window([*entity, block], order)) + F.col("_before")).drop("_before")


def global_numbers(df: DataFrame, order: list[Column | str], out: str = "n") -> DataFrame:
    """Number from 0 of each row in the order of the whole table, without gathering it in one task.

    The rows are range-sorted and checkpointed; a partition's numbers start after the rows of those before it.
    """
    d = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order))
    # the place within a partition is in the lower bits of this id
    d = d.withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    n = d.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = n.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(FIRST, -1)), F.lit(0))).drop("_n")
    # one row a partition
    return d.join(F.broadcast(before), "_pid").withColumn(out, F.col("_at") + F.col("_before")).select(*df.columns, out)


def range_blocks(df: DataFrame, column: str, out: str = "_b", blocks: int = 128) -> DataFrame:
    """df with a block number that doesn't decrease with a numeric column: its place among approximate quantiles (a bounded array)."""
    cuts = df.agg(F.percentile_approx(column, [i / blocks for i in range(1, blocks)], 1000).alias("_cuts"))
    return df.crossJoin(F.broadcast(cuts)).withColumn(out, F.size(F.filter("_cuts", lambda q: q < F.col(column)))).drop("_cuts")


def fill_forward(df: DataFrame, entity: list[str], order: list[str], block: str, columns: list[str], back: bool = False) -> DataFrame:
    """Each null replaced by the entity's last value before it; with ``back``, then by the first one after it.

    A column that is null throughout an entity stays null.
    """
    w = Window.partitionBy(*entity).orderBy(block)
    key = F.struct(*order)
    known = [F.max_by(c, F.when(F.col(c).isNotNull(), key)).alias(f"_l_{c}") for c in columns]
    carried = {f"_c_{c}": F.last(f"_l_{c}", True).over(w.rowsBetween(FIRST, -1)) for c in columns}
    if back:
        known += [F.min_by(c, F.when(F.col(c).isNotNull(), key)).alias(f"_f_{c}") for c in columns]
        carried |= {f"_d_{c}": F.first(f"_f_{c}", True).over(w.rowsBetween(1, LAST)) for c in columns}
    d = _carry(df, entity, block, known, carried)
    local = _window([*entity, block], order)
    new = {}
    for c in columns:
        parts = [F.last(c, True).over(local.rowsBetween(FIRST, NOW)), F.col(f"_c_{c}")]
        if back:
            parts += [F.first(c, True).over(local.rowsBetween(NOW, LAST)), F.col(f"_d_{c}")]
        new[c] = F.coalesce(*parts)
    return d.withColumns(new).select(*df.columns)


def running(df: DataFrame, entity: list[str], order: list[str], block: str, column: str, how: str = "sum", out: str = "running") -> DataFrame:
    """Running sum, max, min or count of a column along the entity's order, up to and with each row; nulls are skipped."""
    total = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[how]
    over = {"count": F.sum}.get(how, total)
    w = Window.partitionBy(*entity).orderBy(block)
    d = _carry(df, entity, block, [total(column).alias("_t")], {"_before": over("_t").over(w.rowsBetween(FIRST, -1))})
    here = total(column).over(_window([*entity, block], order).rowsBetween(FIRST, NOW))
    if how in ("sum", "count"):
        new = F.when(here.isNull(), F.col("_before")).otherwise(here + F.coalesce("_before", F.lit(0)))
    else:
        new = (F.greatest if how == "max" else F.least)(here, F.col("_before"))
    return d.withColumn(out, new).select(*df.columns, out)


def trailing(df: DataFrame, entity: list[str], order: list[str], block: str, rows: int, columns: dict, piece: int = 8192) -> DataFrame:
    """df with columns over trailing frames of at most ``rows`` rows, computed in pieces of ``piece`` rows.

    columns: name -> function of a window (partitioned and ordered) to a column. Each piece is given the ``rows`` rows before it.
    """
    d = numbered(df, entity, order, block, "_rn")
    d = d.withColumn("_p", F.floor((F.col("_rn") - 1) / piece))
    # the last rows of a piece also go to the next one
    tail = (F.col("_rn") - 1) % piece >= piece - rows
    d = d.withColumn("_at", F.explode(F.when(tail, F.array("_p", F.col("_p") + 1)).otherwise(F.array("_p"))))
    w = Window.partitionBy(*entity, "_at").orderBy("_rn")
    d = d.withColumns({k: fn(w) for k, fn in columns.items()})
    return d.filter("_p = _at").select(*df.columns, *columns)


def as_of(left: DataFrame, right: DataFrame, entity: list[str], left_time: str, right_time: str, block: str, values: list[str], strict: bool = False) -> DataFrame:
    """Each left row with the values of the entity's last right row at or before its time (before, if strict).

    ``block`` is a SQL expression over a column ``_t`` (the time), such as "date_trunc('month', _t)". Left rows with a null
    time or without an earlier right row get nulls. Right rows of one time: the largest values in order of ``values`` win.
    """
    r = right.select(*entity, F.col(right_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*values).alias("_v"))
    r = r.groupBy(*entity, "_t", "_side").agg(F.max("_v").alias("_v")).filter("_t IS NOT NULL")
    keep = [c for c in left.columns if c not in entity]
    empty = F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType)
    lf = left.select(*entity, F.col(left_time).alias("_t"), (F.lit(2) if not strict else F.lit(0)).alias("_side"), F.struct(*keep).alias("_row"), empty.alias("_v"))
    r = r.withColumn("_row", F.lit(None).cast(lf.schema["_row"].dataType))
    u = lf.unionByName(r).withColumn("_b", F.expr(block))
    u = fill_forward(u, entity, ["_t", "_side"], "_b", ["_v"])
    v = [F.when(F.col("_t").isNotNull(), F.col(f"_v.{c}")).alias(c if c not in keep else f"{c}_right") for c in values]
    return u.filter("_row IS NOT NULL").select(*entity, *[F.col(f"_row.{c}").alias(c) for c in keep], *v)
