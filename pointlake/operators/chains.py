"""Clusters of points linked by chains of short steps (Euclidean clusters), exact and distributed.

Space is cut into blocks; a point also goes to the blocks whose upper border it lies within one step above, so that any two
points within a step meet in some block. Blocks are solved in bulk by vectorised tasks, and local clusters that share a point
are joined by connected components over the local clusters only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.plans import scratch
from pointlake.plans.components import components, labels

#: Block edges in steps, from coarse to fine: a block with more than BLOCK_ROWS points is cut into the next size.
EDGES, BLOCK_ROWS, TASK_ROWS = (64, 8, 2), 200_000, 150_000
#: Point pairs that are compared at a time.
PAIRS = 2_000_000


def _blocks(edge: float, step: float) -> Column:
    """Blocks of a point as an array of structs (bx, by, bz), its own first."""
    reach = step * (1 + 1e-9)
    axis = lambda c: F.array_distinct(F.array(F.floor(F.col(c) / edge), F.floor((F.col(c) - reach) / edge)))
    plane = F.flatten(F.transform(axis("x"), lambda x: F.transform(axis("y"), lambda y: F.struct(x.alias("bx"), y.alias("by")))))
    return F.flatten(F.transform(plane, lambda p: F.transform(axis("z"), lambda z: F.struct(p["bx"].alias("bx"), p["by"].alias("by"), z.alias("bz")))))


def _pairs(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, all of first[i] .. first[i]+size[i]-1: (i, value) pairs."""
    who = np.repeat(np.arange(len(size)), size)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) + first[who]


def local_clusters(block: np.ndarray, xyz: np.ndarray, origin: np.ndarray, step: float) -> np.ndarray:
    """A label for every point: equal within a block for points linked by steps; ``block`` numbers blocks, ``origin`` is their corner.

    Points of one cell (a third of a step's square, in each axis) are always linked. Cells are sorted by a packed key in which
    neighbours along z are adjacent, so candidate cells of each of 13 columns are two binary searches away. A pair of cells is
    first tried by one point each, and point by point only where its cells are still apart.
    """
    side = step / np.sqrt(3) * (1 - 1e-12)
    cell = np.floor((xyz - origin) / side)
    if len(cell) and (cell.max() >= 2**15 or cell.min() < 0):
        # far apart (coordinates beyond whole-number cells): numbered anew, gaps wider than any step kept as such
        for a in range(3):
            seen, place = np.unique(cell[:, a], return_inverse=True)
            cell[:, a] = np.concatenate([[0], np.cumsum(np.minimum(np.diff(seen), 4))])[place]
    cell = cell.astype(np.int64) + 3
    bits = max(8, int(cell.max()).bit_length() + 1) if len(cell) else 8
    key = ((block.astype(np.int64) << bits | cell[:, 0]) << bits | cell[:, 1]) << bits | cell[:, 2]
    order = np.argsort(key, kind="stable")
    keys, first, size = np.unique(key[order], return_index=True, return_counts=True)
    points = xyz[order]
    sides: list[tuple[np.ndarray, np.ndarray]] = []
    for dx, dy, low, high in [(0, 0, 1, 2), *((dx, dy, -2, 2) for dx in range(3) for dy in range(-2, 3) if (dx, dy) > (0, 0))]:
        shift = (dx << bits) + dy << bits
        a = np.searchsorted(keys, keys + (shift + low))
        b = np.searchsorted(keys, keys + (shift + high), side="right")
        sides.append(_pairs(a, b - a))
    u, v = (np.concatenate(s) for s in zip(*sides))
    limit = step * step
    head = points[first]
    near = ((head[u] - head[v]) ** 2).sum(axis=1) <= limit
    own = labels(len(keys), u[near], v[near])
    u, v = u[~near], v[~near]
    apart = own[u] != own[v]
    u, v = u[apart], v[apart]
    # few points first: their links often spare the large products
    work = size[u] * size[v]
    rank = np.argsort(work, kind="stable")
    u, v, work = u[rank], v[rank], work[rank]
    while len(u):
        n = max(1, int(np.searchsorted(np.cumsum(work), PAIRS, side="right")))
        a, b = u[:n], v[:n]
        linked = np.zeros(n, dtype=bool)
        if n == 1 and work[0] > PAIRS:
            left, right = points[first[a[0]] : first[a[0]] + size[a[0]]], points[first[b[0]] : first[b[0]] + size[b[0]]]
            rows = max(1, PAIRS // len(right))
            linked[0] = any((((left[i : i + rows, None] - right) ** 2).sum(axis=2) <= limit).any() for i in range(0, len(left), rows))
        else:
            pair, p = _pairs(first[a], size[a])
            again, q = _pairs(first[b][pair], size[b][pair])
            hit = ((points[p[again]] - points[q]) ** 2).sum(axis=1) <= limit
            linked[pair[again[hit]]] = True
        own = labels(len(keys), a[linked], b[linked], own)
        u, v, work = u[n:], v[n:], work[n:]
        apart = own[u] != own[v]
        u, v, work = u[apart], v[apart], work[apart]
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.repeat(own, size)
    return out


def _solver(keys: list[str], step: float):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        whole = pa.Table.from_batches(parts)
        frame = whole.select([*keys, "bx", "by", "bz", "edge"]).to_pandas(split_blocks=True)
        code = [pd.factorize(frame[k])[0] for k in keys]
        head = np.stack([*code, *(frame[c].to_numpy() for c in ("bx", "by", "bz"))])
        edge = frame["edge"].to_numpy()
        pid = whole["pid"].to_numpy()
        away = ~whole["home"].to_numpy()
        rank = np.lexsort((away, pid, edge, *head[::-1]))
        head, edge, pid = head[:, rank], edge[rank], pid[rank]
        new = np.ones(len(pid), dtype=bool)
        new[1:] = (head[:, 1:] != head[:, :-1]).any(axis=0) | (edge[1:] != edge[:-1])
        once = new.copy()
        once[1:] |= pid[1:] != pid[:-1]  # of rows delivered twice, and of copies beside the original, the first
        block = np.cumsum(new)[once]
        rank, pid = rank[once], pid[once]
        xyz = np.column_stack([whole[c].to_numpy() for c in "xyz"])[rank]
        origin = head[-3:, once].T * edge[once][:, None]
        own = local_clusters(block, xyz, origin, step)
        group, which = np.unique(own, return_inverse=True)
        least = np.full(len(group), np.iinfo(np.int64).max)
        np.minimum.at(least, which, pid)
        kept = pa.array(rank)
        columns = [whole[k].combine_chunks().take(kept) for k in keys]
        columns += [pa.array(pid), pa.array(least[which]), whole["home"].combine_chunks().take(kept), whole["shared"].combine_chunks().take(kept)]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        yield pa.RecordBatch.from_arrays(columns, names=[*keys, "pid", "label", "home", "shared"])

    return solve


def _cut(points: DataFrame, keys: list[str], step: float) -> DataFrame:
    """Points with the blocks they go to; blocks with too many points are cut again, from the points they hold."""
    edge = EDGES[0] * step
    at = lambda e: F.posexplode(_blocks(e, step)).alias("n", "b")
    rows = points.withColumn("many", F.size(_blocks(edge, step))).select(*keys, "pid", "x", "y", "z", "many", at(edge))
    rows = rows.select(*keys, "pid", "x", "y", "z", F.col("b.bx"), F.col("b.by"), F.col("b.bz"), F.lit(edge).alias("edge"), (F.col("n") == 0).alias("home"), (F.col("many") > 1).alias("shared"))
    where = [*keys, "bx", "by", "bz", "edge"]
    for finer in EDGES[1:]:
        hot = scratch.written(rows.groupBy(*where).count().where(F.col("count") > BLOCK_ROWS).drop("count"), "hot")
        if hot.isEmpty():
            break
        inside = rows.join(hot, where, "left_semi")
        small = finer * step
        again = inside.withColumn("many", F.size(_blocks(small, step))).select(*keys, "pid", "x", "y", "z", "home", "shared", "many", at(small))
        # a point's home is the first block of its home block; sub-blocks of different blocks stay apart by their offset
        again = again.select(*keys, "pid", "x", "y", "z", F.col("b.bx"), F.col("b.by"), F.col("b.bz"), F.lit(small).alias("edge"), (F.col("home") & (F.col("n") == 0)).alias("home"), (F.col("shared") | (F.col("many") > 1)).alias("shared"))
        rows = rows.join(hot, where, "left_anti").unionByName(again)
    return rows


def chain_clusters(points: DataFrame, step: float, keys: tuple[str, ...] = ("cloud_id",), smallest: int = 1, largest: int | None = None) -> DataFrame:
    """``(*keys, pid, cluster_pid)``: points of one cloud that a chain of steps of at most ``step`` links, by smallest pid.

    Only clusters of ``smallest`` to ``largest`` points come out. Points with a null, NaN or infinite coordinate or a null pid
    do not take part; rows delivered twice count once; different pids at one place are different points. An empty table gives
    an empty one; other columns are not read. Work is done when this is called: the blocks' result is written to the shared
    folder, as it is read three times.
    """
    if not step > 0:
        raise ValueError("step must be positive")
    if smallest < 1 or (largest is not None and largest < smallest):
        raise ValueError("cluster sizes must satisfy 1 <= smallest <= largest")
    keys = list(keys)
    spark = points.sparkSession
    axes = [F.col(c).cast("double").alias(c) for c in "xyz"]
    bounded = [F.abs(c) < float("inf") for c in map(F.col, "xyz")]
    rows = points.select(*keys, F.col("pid").cast("bigint").alias("pid"), *axes).where(bounded[0] & bounded[1] & bounded[2] & F.col("pid").isNotNull())
    cut = _cut(rows, keys, step)
    tasks = max(spark.sparkContext.defaultParallelism, -(-points.count() // TASK_ROWS))
    kinds = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys)
    found = cut.repartition(tasks, *keys, "bx", "by", "bz", "edge").mapInArrow(_solver(keys, step), f"{kinds}, pid bigint, label bigint, home boolean, shared boolean")
    local = scratch.written(found, "local")
    copies = local.where("shared").groupBy(*keys, "pid").agg(F.min("label").alias("v"), F.collect_set("label").alias("us"))
    roots = components(copies.select(*keys, F.explode("us").alias("u"), "v"), keys)
    sizes = local.where("home").groupBy(*keys, F.col("label").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    named = scratch.written(sizes.join(roots, [*keys, "node"], "left").select(*keys, "node", "n", F.coalesce("root", "node").alias("root")), "named")
    fits = F.col("n").between(smallest, largest if largest is not None else 2**62)
    kept = named.groupBy(*keys, "root").agg(F.sum("n").alias("n")).where(fits).drop("n")
    chosen = named.join(kept, [*keys, "root"], "left_semi").select(*keys, F.col("node").alias("label"), F.col("root").alias("cluster_pid"))
    return local.where("home").select(*keys, "pid", "label").join(chosen, [*keys, "label"]).select(*keys, "pid", "cluster_pid")
