"""Ranks of all rows of a table, or of those of each group, without gathering any group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise

#: monotonically_increasing_id keeps the partition above this many bits.
_BITS = 33


def ranked(df: DataFrame, *order: str, within: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """Add ``name``: a row's place (long, from 0) in the ascending ``order`` of columns (nulls first) among the rows with equal ``within``.

    Rows are sorted by ranges of ``within`` and ``order``, so a group of any size
    is spread; what the ranges before hold of a group is added from a table with a
    row for each group and range.  Rows equal in all of ``order`` come in any
    order.  ``within`` must not be null.  The sorted rows are written to the shared
    folder: pass narrow ones.
    """
    keys = [*within, *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    placed = materialise(placed, "ranked").withColumn("__range", F.shiftright("__at", _BITS))
    sizes = placed.groupBy(*within, "__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*within).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*within, "__range", (F.col("__first") - F.coalesce(F.sum("__n").over(earlier), F.lit(0))).alias("__shift"))
    return placed.join(starts, [*within, "__range"]).withColumn(name, F.col("__at") - F.col("__shift")).drop("__at", "__range", "__shift")
