"""Numbers and running values over a whole table in order, without gathering it in one task.

Rows are dealt by ranges of the order and written with the number of their range.  What
a range adds is one row, so the ranges' running values are settled on the driver, and
each task then needs its own rows and one number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


def positioned(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """Rows numbered from 1; `order` must be total for the numbers to be the same each time."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = written(rows, "positions").withColumn("_part", F.shiftright("_id", 33)).withColumn("_in", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    before = _before(rows.groupBy("_part").agg(F.count("*").alias("_v")), "bigint", "sum")
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.coalesce("_first", F.lit(0)) + F.col("_in") + 1).drop("_id", "_part", "_in", "_first")


def running(df: DataFrame, order: Sequence[Column | str], amount: str, name: str, how: str = "sum", own: bool = True) -> DataFrame:
    """`name`: the sum or maximum of `amount` over the rows up to this one, or before it; null where there is none."""
    fold = {"sum": F.sum, "max": F.max}[how]
    rows = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "running")
    kind = rows.agg(fold(amount).alias("v")).schema["v"].dataType.simpleString()
    before = _before(rows.groupBy("_part").agg(fold(amount).cast(kind).alias("_v")), kind, how)
    here = fold(amount).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if own else -1))
    joined = rows.withColumn("_here", here).join(F.broadcast(before), "_part")
    total = F.greatest("_first", "_here") if how == "max" else F.when(F.col("_first").isNotNull() | F.col("_here").isNotNull(), F.coalesce("_first", F.lit(0)) + F.coalesce("_here", F.lit(0)))
    return joined.withColumn(name, total).drop("_part", "_here", "_first")


def _before(parts: DataFrame, kind: str, how: str) -> DataFrame:
    """(_part, _first): what the ranges before each add up to; a row for each range, whatever they hold."""
    out, so_far = [], None
    for r in sorted(parts.collect(), key=lambda r: r["_part"]):
        out.append((r["_part"], so_far))
        if r["_v"] is not None:
            so_far = r["_v"] if so_far is None else so_far + r["_v"] if how == "sum" else max(so_far, r["_v"])
    return parts.sparkSession.createDataFrame(out, f"_part {parts.schema['_part'].dataType.simpleString()}, _first {kind}")
