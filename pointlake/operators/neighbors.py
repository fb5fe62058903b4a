"""Neighbour search: pairs within a radius by equality joins on grid cells, k nearest neighbours by blocks with a rim.

For pairs, cells are cubes as wide as the radius; one side is filed under its cell, the other under the 27 cells around it, and
the join on (cloud, cell) is an ordinary hash or sort-merge join. For k nearest neighbours, space is cut into blocks that tasks
search in memory; a block brings a rim of its neighbours along, and only queries that the rim does not settle go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointlake.functions.geometry import XYZ, distance2
from pointlake.functions.grid import PAIRS, Grid
from pointlake.plans import scratch
from pointlake.plans.blocks import WIDTHS, Blocks, codes, in_blocks
from pointlake.schema import positive

KEY = "cloud_id"


def cell(edge: Column | float, shift: float = 0.0) -> list[Column]:
    """Grid cell of a point, anchored at zero."""
    return [F.floor((F.col(c) - F.lit(shift)) / edge) for c in XYZ]


def filed(df: DataFrame, edge: Column | float, around: bool = False) -> DataFrame:
    """Rows with their cell (cx, cy, cz), or one row for each of the 27 cells around it."""
    cells = dict(zip(("cx", "cy", "cz"), cell(edge)))
    df = df.withColumns(cells)
    if not around:
        return df
    offsets = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("ox", "oy", "oz"), o))) for o in product((-1, 0, 1), repeat=3)))
    df = df.withColumn("o_", F.explode(offsets))
    return df.withColumns({c: F.col(c) + F.col(f"o_.o{c[1]}") for c in cells}).drop("o_")


def pairs_within(left: DataFrame, right: DataFrame, radius: float, strict: bool = False) -> DataFrame:
    """Rows aliased ``a`` and ``b`` of two clouds with equal cloud_id and at most ``radius`` apart (below it if ``strict``).

    Columns ``a`` and ``b`` are structs of the rows, ``d2`` the squared distance. A radius of 0 or less gives no rows.
    """
    if radius <= 0:
        out = left.select(F.struct(*left.columns).alias("a")).join(right.select(F.struct(*right.columns).alias("b")), F.lit(False))
        return out.withColumn("d2", F.lit(0.0))
    where = [KEY, "cx", "cy", "cz"]
    a = filed(left.select(F.struct(*left.columns).alias("a"), KEY, *XYZ), radius, around=True).select("a", *where)
    b = filed(right.select(F.struct(*right.columns).alias("b"), KEY, *XYZ), radius).select("b", *where)
    near = F.col("d2") < radius * radius if strict else F.col("d2") <= radius * radius
    return a.join(b, where).select("a", "b", distance2().alias("d2")).where(near)


def radius_neighbors(queries: DataFrame, base: DataFrame, radius: float, exclude_self: bool = False) -> DataFrame:
    """``(cloud_id, pid, neighbor, distance)``: all points of ``base`` within ``radius`` (inclusive) of each query.

    ``exclude_self`` leaves out the point with the query's own pid. A radius of 0 or less gives no rows.
    """
    found = pairs_within(queries.select(KEY, "pid", *XYZ), base.select(KEY, "pid", *XYZ), radius)
    if exclude_self:
        found = found.where(F.col("a.pid") != F.col("b.pid"))
    return found.select(F.col("a.cloud_id"), F.col("a.pid"), F.col("b.pid").alias("neighbor"), F.sqrt("d2").alias("distance"))


#: Blocks are this many cells wide, with a rim of so many cells on every side; a block with more rows is cut into eighths.
SPAN, RIM, BLOCK_ROWS, CUTS = 24, 1.5, 100_000, 4
#: Rows of a task; searches of unfinished queries in pieces of whole clouds that are done at once; and rows of a table that is
#: handed to every task (32 bytes a row and what is carried).
TASK_ROWS, FEW, SMALL = 100_000, 20_000, 400_000


def search_scales(base: DataFrame, k: int) -> DataFrame:
    """``(cloud_id, n, low_x, low_y, low_z, wide, edge)``: per cloud, its box and a cell that holds about k points where it is occupied.

    Two small aggregations: boxes, then distinct counts of occupied cells at a dozen sizes in one pass of sketches. The result,
    a row per cloud, is written, as every round of a search reads it.
    """
    ids = base.select(KEY, *XYZ)
    boxes = ids.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), *(F.min(c).alias(f"low_{c}") for c in XYZ), F.greatest(*(F.max(c) - F.min(c) for c in XYZ)).alias("wide"))
    steps = range(1, 13)
    at = lambda i: F.xxhash64(*(F.floor((F.col(c) - F.col(f"low_{c}")) / F.col("wide") * 2**i) for c in XYZ))
    seen = ids.join(boxes.where("wide > 0"), KEY).groupBy(KEY).agg(*(F.approx_count_distinct(at(i), 0.05).alias(f"e{i}") for i in steps))
    fits = [F.when(F.col("n") / F.col(f"e{i}") <= max(2.0, k + 1.0), F.col("wide") / 2**i) for i in steps]
    edge = F.coalesce(*fits, F.when(F.col("wide") > 0, F.col("wide") / 2**12), F.lit(1.0))
    return scratch.written(boxes.join(seen, KEY, "left").select(*boxes.columns, edge.alias("edge")), "scales")


def _block(edge: Column, rim: Column | float = 0.0) -> Column:
    """Blocks of a point as an array of structs (bx, by, bz), its own first; with a rim also those whose rim holds it."""

    def axis(c: str) -> Column:
        at = F.col(c) - F.col(f"low_{c}")
        own = F.floor(at / edge)
        return F.array(own) if isinstance(rim, float) else F.array_distinct(F.array(own, F.floor((at - rim) / edge), F.floor((at + rim) / edge)))

    plane = F.flatten(F.transform(axis("x"), lambda x: F.transform(axis("y"), lambda y: F.struct(x.alias("bx"), y.alias("by")))))
    return F.flatten(F.transform(plane, lambda p: F.transform(axis("z"), lambda z: F.struct(p["bx"].alias("bx"), p["by"].alias("by"), z.alias("bz")))))


_BLOCK = ("bx", "by", "bz")


def _reach(unit: Column) -> Column:
    """How far around a point its block with the rim reaches."""
    edge = unit * SPAN
    sides = []
    for c, b in zip(XYZ, _BLOCK):
        inside = F.col(c) - F.col(f"low_{c}") - F.col(b) * edge
        sides += [inside, edge - inside]
    # a little less, for what rounding of the borders may hide
    return (F.least(*sides) + unit * RIM) * (1 - 1e-9)


def _placed(rows: DataFrame, unit: Column) -> DataFrame:
    """Rows with the blocks they go to: members also to those whose rim holds them, and asked only in their own."""
    wide = _block(unit * SPAN, unit * RIM)
    blocks = F.when(F.col("member"), wide).otherwise(_block(unit * SPAN))
    out = rows.select("*", F.posexplode(blocks).alias("n_", "b_"))
    return out.withColumns({"unit": unit, **{b: F.col(f"b_.{b}") for b in _BLOCK}, "asked": F.col("asked") & (F.col("n_") == 0)}).drop("n_", "b_")


def _cut(rows: DataFrame, most: int) -> DataFrame:
    """Rows in blocks of bounded size: one with too many rows is cut into blocks an eighth as wide, from the rows it holds."""
    if most <= BLOCK_ROWS:  # no cloud could fill a block too much
        return rows
    where = [KEY, "unit", *_BLOCK]
    out = None
    for _ in range(CUTS):
        hot = scratch.written(rows.groupBy(*where).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK_ROWS).select(*where), "hot")
        if hot.isEmpty():
            break
        calm = rows.join(hot, where, "left_anti")
        out = calm if out is None else out.unionByName(calm)
        again = rows.join(hot, where, "left_semi").withColumnsRenamed({b: f"p{b}" for b in _BLOCK})
        again = _placed(again, F.col("unit") / 8)
        rows = again.where(" AND ".join(f"floor({b} / 8) = p{b}" for b in _BLOCK)).drop(*(f"p{b}" for b in _BLOCK))
    return rows if out is None else out.unionByName(rows)


def _solver(k: int, exclude_self: bool, exclude_place: bool, limit: float, carry: tuple[str, ...], merge: bool):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        whole = pa.Table.from_batches(parts).combine_chunks()
        numbers = {c: whole[c].to_numpy() for c in ("pid", *XYZ, "unit", *_BLOCK, "piece", "reach")}
        asked, member = (whole[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("asked", "member"))
        name = whole[KEY].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        block = codes(name, numbers["unit"], *(numbers[b] for b in _BLOCK), numbers["piece"])
        unit = np.empty(int(block.max()) + 1)
        unit[block] = numbers["unit"]
        xyz = np.column_stack([numbers[c] for c in XYZ])
        m, q = np.flatnonzero(member), np.flatnonzero(asked)
        grid = Grid(block[m], xyz[m], numbers["pid"][m], unit)
        reach = None if merge else numbers["reach"][q]
        who, to, d2, done = grid.nearest(block[q], xyz[q], k, numbers["pid"][q] if exclude_self else None, exclude_place, limit, reach)
        start = np.searchsorted(who, np.arange(len(q))) if np.all(who[1:] >= who[:-1]) else None
        if start is None:
            order = np.argsort(who, kind="stable")
            who, to, d2 = who[order], to[order], d2[order]
            start = np.searchsorted(who, np.arange(len(q)))
        rank = np.arange(len(who)) - start[who] + 1
        # one more row for each query that is not settled here
        left = np.flatnonzero(~done)
        rows = pa.array(np.concatenate([q[who], q[left]]))
        none = pa.nulls(len(left))
        columns = [whole[KEY].combine_chunks().take(rows), pa.array(numbers["pid"][rows.to_numpy()])]
        columns.append(pa.concat_arrays([pa.array(numbers["pid"][m[to]], pa.int64()), none.cast(pa.int64())]))
        columns.append(pa.concat_arrays([pa.array(d2, pa.float64()), none.cast(pa.float64())]))
        columns.append(pa.concat_arrays([pa.array(rank.astype(np.int32)), none.cast(pa.int32())]))
        columns += [pa.concat_arrays([pa.nulls(len(who), pa.float64()), pa.array(numbers[c][q[left]], pa.float64())]) for c in XYZ]
        columns.append(pa.array(numbers["reach"][rows.to_numpy()]))
        if carry:
            at = pa.array(np.concatenate([m[to], np.zeros(len(left), dtype=np.int64)]))
            columns.append(pa.StructArray.from_arrays([whole[c if c in XYZ or c == "pid" else f"c_{c}"].combine_chunks().take(at) for c in carry], names=list(carry)))
        names = [KEY, "pid", "neighbor", "d2", "rank", *XYZ, "reach", *(["to"] if carry else [])]
        for batch in pa.Table.from_arrays(columns, names=names).to_batches(max_chunksize=100_000):
            yield batch

    return solve


class _Held:
    """A small table of clouds with the grid over it, built where it is used and kept by the Python process."""

    def __init__(self, table: pa.Table, k: int) -> None:
        self.table, self.k, self.grid = table, k, None

    def __getstate__(self) -> tuple:
        return self.table, self.k

    def __setstate__(self, state: tuple) -> None:
        self.table, self.k = state
        self.grid = None

    def ready(self) -> Grid:
        if self.grid is None:
            names = self.table[KEY].combine_chunks().dictionary_encode()
            self.codes = {n: i for i, n in enumerate(names.dictionary.to_pylist())}
            block = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            self.pid = self.table["pid"].to_numpy()
            xyz = np.column_stack([self.table[c].to_numpy() for c in XYZ])
            low, high = np.full((len(self.codes), 3), np.inf), np.full((len(self.codes), 3), -np.inf)
            np.minimum.at(low, block, xyz)
            np.maximum.at(high, block, xyz)
            n = np.bincount(block, minlength=len(self.codes))
            # points as of a surface; the grid goes finer where they are denser
            unit = (high - low).max(axis=1, initial=0) * np.sqrt((self.k + 1) / np.maximum(n, 1))
            self.grid = Grid(block, xyz, self.pid, np.where(unit > 0, unit, 1.0))
        return self.grid


class Prepared:
    """A table made ready to be searched for up to about ``k`` neighbours, once for any number of searches.

    The table is written to the shared folder. One of at most ``SMALL`` rows, which is counted, is handed to every task whole;
    for others the scales of their clouds are measured.
    """

    def __init__(self, base: DataFrame, k: int, carry: tuple[str, ...] = ()) -> None:
        self.carry, self.kinds = carry, {c: base.schema[c].dataType.simpleString() for c in carry}
        self.more = [c for c in carry if c not in (*XYZ, "pid")]
        tidy = [KEY, F.col("pid").cast("bigint").alias("pid"), *(F.col(c).cast("double").alias(c) for c in XYZ)]
        plain = not self.more and base.columns == [KEY, "pid", *XYZ] and scratch.is_written(base) and dict(base.dtypes)["pid"] == "bigint"
        self.rows = base if plain else scratch.written(base.select(*tidy, *(F.col(c).alias(f"c_{c}") for c in self.more)), "base")
        self.total, self.held, self.scales = self.rows.count(), None, None
        if self.total <= SMALL:
            self.held = base.sparkSession.sparkContext.broadcast(_Held(self.rows.where(F.col(KEY).isNotNull()).toArrow(), k))
        else:
            self.scales = search_scales(self.rows, k)
            self.most = self.scales.agg(F.max("n")).first()[0] or 0

    def schema(self, key_kind: str) -> str:
        to = [f"to struct<{', '.join(f'`{c}`: {t}' for c, t in self.kinds.items())}>"] if self.carry else []
        return ", ".join([f"{KEY} {key_kind}", "pid bigint, neighbor bigint, d2 double, rank int, x double, y double, z double, reach double", *to])


def _in_held(found: Prepared, queries: DataFrame, k: int, exclude_self: bool, exclude_place: bool, limit: float, schema: str, pose: np.ndarray | None = None) -> DataFrame:
    """The search in a table that every task holds; queries are moved by the pose first.

    The pose is applied here and not as Columns: the plan is then the same in every iteration of a loop, and its code is
    generated once.
    """
    held, carry = found.held, found.carry

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grid = held.value.ready()
            code = held.value.codes
            block = np.array([code.get(n, -1) for n in batch.column(0).to_pylist()], dtype=np.int64)
            q = np.flatnonzero(block >= 0)
            if not len(q):
                continue
            pid = batch.column(1).to_numpy()[q]
            xyz = np.column_stack([batch.column(i).to_numpy() for i in (2, 3, 4)])[q]
            if pose is not None:
                x, y, z = xyz.T
                xyz = np.column_stack([x * pose[i, 0] + y * pose[i, 1] + z * pose[i, 2] + pose[i, 3] for i in range(3)])
            who, to, d2, _ = grid.nearest(block[q], xyz, k, pid if exclude_self else None, exclude_place, limit)
            order = np.argsort(who, kind="stable")
            who, to, d2 = who[order], to[order], d2[order]
            rank = (np.arange(len(who)) - np.searchsorted(who, np.arange(len(q)))[who] + 1).astype(np.int32)
            at_query = [pa.array(xyz[who, i]) for i in range(3)]
            columns = [batch.column(0).take(pa.array(q[who])), pa.array(pid[who]), pa.array(held.value.pid[to]), pa.array(d2), pa.array(rank), *at_query, pa.nulls(len(who), pa.float64())]
            if carry:
                at, table = pa.array(to), held.value.table
                columns.append(pa.StructArray.from_arrays([table[c if c in XYZ or c == "pid" else f"c_{c}"].take(at).combine_chunks() for c in carry], names=list(carry)))
            yield pa.RecordBatch.from_arrays(columns, names=[KEY, "pid", "neighbor", "d2", "rank", *XYZ, "reach", *(["to"] if carry else [])])

    return queries.mapInArrow(search, schema)


def knn(queries: DataFrame, base: DataFrame, k: int, exclude_self: bool = False, exclude_place: bool = False, max_distance: float | None = None, carry: tuple[str, ...] = (), prepared: Prepared | None = None) -> DataFrame:
    """``(cloud_id, pid, neighbor, distance, rank)``: the k nearest points of ``base`` for each query, exactly.

    Ties go to the smaller pid. ``exclude_self`` leaves out the point with the query's pid, ``exclude_place`` all points at the
    query's place. k of 0 gives no rows, fewer than k points all of them; ``max_distance`` (inclusive) bounds the search.
    Columns of ``base`` named in ``carry`` come along as the struct ``to``. Queries of a cloud that the base lacks, or of none,
    have no rows. ``prepared`` is the base made ready once (with the same ``carry``), for loops that search it again and again.

    A small base is handed to all tasks. Otherwise space is cut into blocks with a rim, sized by each cloud's density; a point is sent to its block and to
    those whose rim holds it, about 1.2 copies in one shuffle, and many blocks are searched per task by sorted grids in memory. A
    block with too many rows is cut further. A query whose k neighbours are nearer than the rim's border is settled; the few
    others, in sparse places, go to rounds of wider blocks, of which only those that are asked for are filled, split by row
    where they are large.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    if max_distance is not None:
        positive(max_distance=max_distance)
    limit = np.inf if max_distance is None else float(max_distance)
    columns = [KEY, "pid", *XYZ]
    out = [KEY, "pid", "neighbor", F.sqrt("d2").alias("distance"), "rank", *(["to"] if carry else [])]
    found = Prepared(base, k, carry) if prepared is None else prepared
    schema = found.schema(base.schema[KEY].dataType.simpleString())
    spark = base.sparkSession
    if k == 0 or not found.total:
        return spark.createDataFrame([], schema).select(*out)
    same = queries is base
    tidy = [KEY, F.col("pid").cast("bigint").alias("pid"), *(F.col(c).cast("double").alias(c) for c in XYZ)]
    asked = found.rows.select(*columns) if same else queries.select(*tidy)
    if found.held is not None:
        spread = asked.repartition(spark.sparkContext.defaultParallelism, "pid")
        return _in_held(found, spread, k, exclude_self, exclude_place, limit, schema).select(*out)
    members = found.rows.withColumns({"member": F.lit(True), "asked": F.lit(same)})
    empty = [F.lit(None).cast(found.rows.schema[f"c_{c}"].dataType).alias(f"c_{c}") for c in found.more]
    wanted = lambda df: df.select(*columns, *empty).withColumns({"member": F.lit(False), "asked": F.lit(True)})
    scale = found.scales.select(KEY, *(f"low_{c}" for c in XYZ), "wide", "edge")
    tasks = max(spark.sparkContext.defaultParallelism, -(-found.total // TASK_ROWS))
    shape = [*columns, *(f"c_{c}" for c in found.more), "member", "asked", "unit", *_BLOCK, "piece", "reach"]
    where = [KEY, "unit", *_BLOCK, "piece"]

    rows = members if same else members.unionByName(wanted(asked))
    rows = _cut(_placed(rows.join(scale, KEY), F.col("edge")), found.most).withColumns({"piece": F.lit(0), "reach": _reach(F.col("unit"))})
    near = rows.select(*shape).repartition(tasks, *where).mapInArrow(_solver(k, exclude_self, exclude_place, limit, carry, False), schema)
    near = scratch.written(near, "near")
    done = [near.where("neighbor IS NOT NULL")]
    asked = near.where("neighbor IS NULL").select(*columns)
    factor = 1.0
    while (left := asked.count()) > 0:
        factor *= 4
        unit = F.col("edge") * factor
        # the last round searches whole clouds, in pieces; before it, clouds that a block would hold are searched so too
        last = left * -(-found.most // BLOCK_ROWS) <= max(FEW, found.total // 100)
        everything = F.lit(last) | (unit * SPAN > F.col("wide"))
        whole = lambda df: df.withColumns({"unit": F.when(everything, F.col("edge")).otherwise(F.col("unit")), **{b: F.when(everything, F.lit(0).cast("bigint")).otherwise(F.col(b)) for b in _BLOCK}, "whole": everything})  # noqa: B023, E731
        block = [KEY, "unit", *_BLOCK]
        sent = whole(_placed(wanted(asked).join(scale, KEY), unit))
        sent = sent.withColumn("reach", F.when(F.col("whole"), F.lit(float("inf"))).otherwise(_reach(unit)))
        filled = members.withColumn("asked", F.lit(False)).join(scale, KEY)
        # in whole clouds a member has one place, in blocks also the rims
        filled = whole(filled.withColumns({"unit": unit, **dict.fromkeys(_BLOCK, F.lit(0).cast("bigint"))})) if last else whole(_placed(filled, unit)).dropDuplicates([*block, "pid"])
        if not last:
            sent = scratch.written(sent, "asked")
        filled = filled.join(sent.select(*block).distinct(), block, "left_semi").withColumn("reach", F.lit(0.0))
        if found.most > BLOCK_ROWS:
            pieces = scratch.written(filled.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("pieces")), "pieces")
            filled = filled.join(pieces, block).withColumn("piece", F.pmod(F.xxhash64("pid"), F.col("pieces")).cast("int"))
            each = sent.join(pieces, block).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        else:
            filled, each = filled.withColumn("piece", F.lit(0)), sent.withColumn("piece", F.lit(0))
        both = filled.select(*shape).unionByName(each.select(*shape))
        part = both.repartition(tasks, *where).mapInArrow(_solver(k, exclude_self, exclude_place, limit, carry, True), schema).where("neighbor IS NOT NULL")
        best = part.withColumn("rank", F.row_number().over(Window.partitionBy(KEY, "pid").orderBy("d2", "neighbor"))).where(F.col("rank") <= k)
        best = scratch.written(best, "near")
        if last:
            done.append(best)
            break
        full = best.groupBy(KEY, "pid").agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("far"))
        ends = sent.select(*columns, "reach").join(full, [KEY, "pid"], "left")
        settled = (F.col("reach") >= limit) | (F.coalesce(F.col("n") >= k, F.lit(False)) & (F.sqrt("far") <= F.col("reach")))
        done.append(best.join(ends.where(settled).select(KEY, "pid"), [KEY, "pid"], "left_semi"))
        asked = scratch.written(ends.where(~F.coalesce(settled, F.lit(False))).select(*columns), "left")
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result.select(*out)


def nearest(queries: DataFrame, base: DataFrame, max_distance: float | None = None, carry: tuple[str, ...] = (), prepared: Prepared | None = None) -> DataFrame:
    """``(cloud_id, pid, neighbor, distance)``: the nearest point of ``base`` for each query that has one."""
    return knn(queries, base, 1, max_distance=max_distance, carry=carry, prepared=prepared).drop("rank")


def neighborhoods(cloud: DataFrame, k: int, radius: float | None = None, carry: tuple[str, ...] = XYZ) -> DataFrame:
    """``(cloud_id, pid, neighbor, distance, to)``: each point's neighbours without itself, with their columns ``carry``.

    All points within ``radius`` where there are at least k of them, else (and without a radius) the k nearest.
    """
    take = [KEY, "pid", *XYZ, *(c for c in carry if c not in (*XYZ, "pid"))]
    base = cloud.select(*take)
    if radius is None:
        return knn(base, base, k, exclude_self=True, carry=carry).drop("rank")
    positive(radius=radius)
    pairs = pairs_within(base, base, radius).where(F.col("a.pid") != F.col("b.pid"))
    wide = pairs.select(F.col("a.cloud_id").alias(KEY), F.col("a.pid").alias("pid"), F.col("b.pid").alias("neighbor"), F.sqrt("d2").alias("distance"), F.struct(*(F.col(f"b.{c}").alias(c) for c in carry)).alias("to"))
    wide = scratch.written(wide, "around")
    enough = wide.groupBy(KEY, "pid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(KEY, "pid")
    rest = base.join(enough, [KEY, "pid"], "left_anti")
    return wide.join(enough, [KEY, "pid"], "left_semi").unionByName(knn(rest, base, k, exclude_self=True, carry=carry).drop("rank"))


#: Rims of blocks in radii, the widest first; rows that the smallest block may hold; points whose sums are held at a time.
RIMS, HELD, PART = (32, 8, 2), 500_000, 50_000


def _rim(points: DataFrame, radius: float) -> float:
    """The widest rim whose smallest blocks, two rims wide and as much around them, hold few enough points of a surface."""
    for wide in RIMS[:-1]:
        cells = points.groupBy(KEY, *(F.floor(F.col(c) / (wide * radius)).alias(f"at_{c}") for c in XYZ)).agg(F.count(F.lit(1)).alias("n"))
        if (cells.agg(F.max("n")).first()[0] or 0) * (WIDTHS[-1] + 2) ** 2 <= HELD:
            return wide * radius
    return RIMS[-1] * radius


def folded(points: DataFrame, k: int, radius: float, width: int, fold: Callable, finish: Callable, made: dict[str, str], kept: tuple[str, ...] = (KEY, "pid"), carry: tuple[str, ...] = XYZ) -> tuple[DataFrame, DataFrame | None]:
    """:func:`neighborhoods` within a radius, summed up where they are found: pairs are neither written nor shuffled.

    ``points`` is a written table. ``fold(sums, blocks, rows, q, m, d2)`` adds to the sums (points, width) of the points at
    ``rows`` what their neighbours ``m`` give, q numbers the pairs' points; ``finish(sums, count)`` gives the columns ``made`` (their
    Spark types by name). The first table, a written one, has the columns ``kept``, ``made``, and ``left``: null, or for a point whose k nearest
    are not all in the rim of its block its columns without those of the sums. The second table has the neighbours of
    these, as :func:`neighborhoods`; None if there are none.
    """
    positive(radius=radius)
    columns, rim = points.columns, _rim(points, radius)
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    own = [c for c in columns if c not in (KEY, "pid")]

    def solve(b: Blocks) -> Iterator[pa.RecordBatch]:
        pid, home = b.table["pid"].to_numpy(), np.flatnonzero(b.home)
        grid = Grid(b.block, b.xyz, pid, np.full(int(b.block.max(initial=0)) + 1, float(radius)))
        for first in range(0, len(home), PART):
            rows = home[first : first + PART]
            count, sums = np.zeros(len(rows), dtype=np.int64), np.zeros((len(rows), width))
            for q, m, d2 in grid.within(b.block[rows], b.xyz[rows], radius):
                other = pid[rows[q]] != pid[m]
                q, m, d2 = q[other], m[other], d2[other]
                count += np.bincount(q, minlength=len(rows))
                fold(sums, b, rows, q, m, d2)
            thin = np.flatnonzero(count < k)
            left = np.zeros(len(rows), dtype=bool)
            if len(thin):
                sums[thin] = 0
                q, m, d2, done = grid.nearest(b.block[rows[thin]], b.xyz[rows[thin]], k, pid[rows[thin]], reach=np.full(len(thin), rim * (1 - 1e-9)))
                count[thin] = np.bincount(q, minlength=len(thin))
                for at in range(0, len(q), PAIRS):
                    fold(sums, b, rows, thin[q[at : at + PAIRS]], m[at : at + PAIRS], d2[at : at + PAIRS])
                left[thin] = ~done
            at = pa.array(rows)
            take = lambda c: b.table[c].combine_chunks().take(at)  # noqa: B023, E731
            rest = pa.StructArray.from_arrays([take(c) for c in own], names=own, mask=pa.array(~left))
            yield pa.RecordBatch.from_arrays([*(take(c) for c in kept), *finish(sums, count), rest], names=[*kept, *made, "left"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"{n} {t}" for n, t in made.items()), f"left struct<{', '.join(f'`{c}`: {kinds[c]}' for c in own)}>"])
    # a corner half a block from zero: clouds recorded around it mostly lie in one block
    first = scratch.written(in_blocks(points, rim, solve, schema, origin=-rim * WIDTHS[0] / 2), "folded")
    rest = scratch.written(first.where("left IS NOT NULL").select(KEY, "pid", "left.*"), "rest")
    if rest.isEmpty():
        return first, None
    base = points.join(rest.select(KEY).distinct(), KEY, "left_semi").select(columns)
    return first, scratch.written(knn(rest, base, k, exclude_self=True, carry=carry).drop("rank"), "near")


def moved_nearest(queries: DataFrame, prepared: Prepared, max_distance: float | None, pose: np.ndarray) -> DataFrame | None:
    """``(cloud_id, pid, x, y, z, neighbor, distance, to)`` of moved queries by one pass where they lie, if the base is a small one."""
    if prepared.held is None:
        return None
    rows = queries.select(KEY, "pid", *XYZ)
    limit = np.inf if max_distance is None else float(max_distance)
    found = _in_held(prepared, rows, 1, False, False, limit, prepared.schema(queries.schema[KEY].dataType.simpleString()), pose)
    return found.select(KEY, "pid", *XYZ, "neighbor", F.sqrt("d2").alias("distance"), "to")


def feature_matches(source: DataFrame, target: DataFrame, key: str = "pid", feature: str = "feature") -> DataFrame:
    """``(source, target, distance)``: for each source descriptor the nearest target descriptor (L2), ties to the smaller id.

    Exact, in blocks: targets are broadcast in pieces of bounded size against all sources, so neither side is shuffled by the
    other and the best match per source is kept by a minimum with map-side combination. For millions of descriptors use the
    approximate search over vectors instead.
    """
    import numpy as np
    import pandas as pd

    block = 20_000
    rows = target.select(F.col(key).cast("bigint").alias("id"), F.col(feature).cast("array<double>").alias("f")).where("id IS NOT NULL AND f IS NOT NULL")
    n = rows.count()
    pieces = max(1, -(-n // block))
    src = source.select(F.col(key).cast("bigint").alias("source"), F.col(feature).cast("array<double>").alias("f")).where("source IS NOT NULL AND f IS NOT NULL")
    out = None
    for piece in range(pieces):
        part = rows.where(F.pmod(F.xxhash64("id"), F.lit(pieces)) == piece).orderBy("id").toPandas()
        ids = part["id"].to_numpy()
        known = np.array(part["f"].tolist(), dtype=float).reshape(len(ids), -1)
        held = source.sparkSession.sparkContext.broadcast((ids, known))

        def match(batches, held=held):
            ids, known = held.value
            for b in batches:
                f = np.array(b["f"].tolist(), dtype=float).reshape(len(b), -1)
                if not len(b) or not len(ids):
                    continue
                best, least = np.empty(len(f), dtype=np.int64), np.empty(len(f))
                step = max(1, 2_000_000 // max(1, len(ids) * max(1, f.shape[1])))
                for i in range(0, len(f), step):
                    d = ((f[i : i + step, None, :] - known[None]) ** 2).sum(axis=2)
                    at = d.argmin(axis=1)
                    best[i : i + step], least[i : i + step] = ids[at], d[np.arange(len(at)), at]
                yield pd.DataFrame({"source": b["source"], "target": best, "d2": least})

        found = src.mapInPandas(match, "source bigint, target bigint, d2 double")
        out = found if out is None else out.unionAll(found)
    best = out.groupBy("source").agg(F.min(F.struct("d2", "target")).alias("m"))
    return best.select("source", F.col("m.target").alias("target"), F.sqrt("m.d2").alias("distance"))


def point_distances(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(cloud_id, pid, distance)`` of points with equal cloud and pid in two tables; points without a partner are left out."""
    a, b = (df.select(F.struct(KEY, "pid", *XYZ).alias(n), KEY, "pid") for df, n in ((left, "a"), (right, "b")))
    return a.join(b, [KEY, "pid"]).select(KEY, "pid", F.sqrt(distance2()).alias("distance"))
