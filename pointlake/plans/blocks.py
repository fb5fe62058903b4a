"""Blocks of space with a rim of fixed width, solved in bulk by vectorised tasks.

A point goes to its own block and to those whose rim holds it, so that everything within the rim's width of a block's own
points is in the block. Blocks with too many rows are cut into smaller ones, down to two rims.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.functions.grid import Grid
from pointlake.plans import scratch

#: Block widths in rims from coarse to fine, rows beyond which a block is cut, and rows of a task.
WIDTHS, BLOCK_ROWS, TASK_ROWS = (16, 4, 2), 100_000, 100_000
XYZ = ("x", "y", "z")
_AT = ("bx", "by", "bz")


def codes(*columns: np.ndarray) -> np.ndarray:
    """A number from 0 for each different row of the columns."""
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        seen = pd.factorize(c)[0].astype(np.int64)
        code = pd.factorize(code * (int(seen.max(initial=0)) + 1) + seen)[0].astype(np.int64)
    return code


@dataclass
class Blocks:
    """The rows of a task: the columns as an Arrow table, block numbers, coordinates, and which rows are at home."""

    table: pa.Table
    block: np.ndarray
    xyz: np.ndarray
    home: np.ndarray
    unit: float

    def grid(self, rows: np.ndarray | None = None) -> Grid:
        """A grid over the rows given, by default all, whose cells are as wide as the rim."""
        rows = np.arange(len(self.block)) if rows is None else rows
        return Grid(self.block[rows], self.xyz[rows], self.table["pid"].to_numpy()[rows], np.full(int(self.block.max(initial=0)) + 1, self.unit))


def _around(edge: float, rim: float, origin: float) -> Column:
    reach = rim * (1 + 1e-9)
    axis = lambda c: F.array_distinct(F.array(*(F.floor((F.col(c) - F.lit(origin + shift)) / edge) for shift in (0.0, reach, -reach))))
    plane = F.flatten(F.transform(axis("x"), lambda x: F.transform(axis("y"), lambda y: F.struct(x.alias("bx"), y.alias("by")))))
    return F.flatten(F.transform(plane, lambda p: F.transform(axis("z"), lambda z: F.struct(p["bx"].alias("bx"), p["by"].alias("by"), z.alias("bz")))))


def in_blocks(points: DataFrame, rim: float, solve: Callable[[Blocks], Iterator[pa.RecordBatch]], schema: str, keys: tuple[str, ...] = ("cloud_id",), origin: float = 0.0) -> DataFrame:
    """What ``solve`` makes of the blocks of all tasks. ``points`` have the keys, pid, x, y, z and what else ``solve`` needs.

    Blocks have a corner where x, y and z are ``origin``. Rows with a null key or unusable coordinates do not take part. The rows are written and counted, and block sizes counted
    where some block could be too large.
    """
    keys = list(keys)
    columns = points.columns
    usable = " AND ".join([*(f"abs({c}) < double('infinity')" for c in XYZ), *(f"`{k}` IS NOT NULL" for k in keys)])
    points = points.where(usable) if scratch.is_written(points) else scratch.written(points.where(usable), "points")
    total = points.count()
    where = [*keys, "width", *_AT]

    def placed(rows: DataFrame, width: float) -> DataFrame:
        out = rows.select(*rows.columns, F.posexplode(_around(width, rim, origin)).alias("n_", "b_")).withColumn("width", F.lit(float(width)))
        return out.withColumns({"at_home": F.col("n_") == 0, **{b: F.col(f"b_.{b}") for b in _AT}}).drop("n_", "b_")

    rows, out = placed(points, WIDTHS[0] * rim), None
    for before, width in zip(WIDTHS, WIDTHS[1:]):
        if total <= BLOCK_ROWS:
            break
        hot = scratch.written(rows.groupBy(*where).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK_ROWS).select(*where), "hot")
        if hot.isEmpty():
            break
        calm = rows.join(hot, where, "left_anti")
        out = calm if out is None else out.unionByName(calm)
        again = rows.join(hot, where, "left_semi").withColumnsRenamed({b: f"p{b}" for b in _AT}).drop("at_home", "width")
        ratio = before // width
        rows = placed(again, width * rim).where(" AND ".join(f"floor({b} / {ratio}) = p{b}" for b in _AT)).drop(*(f"p{b}" for b in _AT))
    rows = rows if out is None else out.unionByName(rows)
    tasks = max(points.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        names = [table[k].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) for k in keys]
        block = codes(*names, *(table[c].to_numpy() for c in ("width", *_AT)))
        xyz = np.column_stack([table[c].to_numpy() for c in XYZ])
        yield from solve(Blocks(table, block, xyz, table["at_home"].to_numpy(zero_copy_only=False).astype(bool), float(rim)))

    return rows.select(*columns, "width", *_AT, "at_home").repartition(tasks, *where).mapInArrow(run, schema)
