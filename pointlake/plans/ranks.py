"""Ranks over a whole table without a window that one task would hold."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.plans import scratch


def ranked(df: DataFrame, by: list[str], name: str = "rank") -> DataFrame:
    """The table with ``name``, 0.. in the order of the columns ``by``.

    Rows are cut into ranges of about equal size, sorted within each, and written with their place in the range; the ranges'
    sizes, one number a task, are added up on the driver. Ties are broken arbitrarily but once: the result is a written table.
    """
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by)
    low = F.monotonically_increasing_id()
    rows = scratch.written(placed.withColumns({"part_": F.shiftright(low, 33).cast("int"), "at_": low.bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    sizes = {r.part_: r.n for r in rows.groupBy("part_").agg(F.count(F.lit(1)).alias("n")).collect()}
    ends = accumulate((sizes.get(p, 0) for p in range(max(sizes, default=-1) + 1)), initial=0)
    before = F.element_at(F.array(*(F.lit(e) for e in ends)).cast("array<bigint>"), F.col("part_") + 1)
    return rows.withColumn(name, before + F.col("at_")).drop("part_", "at_")
