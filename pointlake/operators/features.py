"""Local descriptors of points with normals: SPFH, FPFH, SHOT and unique shape context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.functions.geometry import cross, dot, scale, sub, vec
from pointlake.operators.neighbors import KEY, folded, knn
from pointlake.operators.normals import estimate_normals
from pointlake.plans import scratch
from pointlake.plans.blocks import Blocks, in_blocks
from pointlake.schema import positive

BINS = 11
_POINT = ("x", "y", "z", "nx", "ny", "nz")


def _bin(value: Column, low: float, high: float, bins: int) -> Column:
    return F.least(F.greatest(F.floor((value - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def pair_features(pairs: DataFrame) -> DataFrame:
    """Pairs with the bins of their three angles; degenerate pairs are left out."""
    ps, ns, pt, nt = vec(*(f"own.{c}" for c in "xyz")), vec(*(f"own.n{c}" for c in "xyz")), vec(*(f"to.{c}" for c in "xyz")), vec(*(f"to.n{c}" for c in "xyz"))
    far = pairs.where(F.col("distance") >= 1e-10)
    delta = sub(pt, ps)
    far = far.withColumns({f"d{c}": F.try_divide(d, F.col("distance")) for c, d in zip("xyz", delta)})
    d = vec("dx", "dy", "dz")
    far = far.withColumns({f"u{c}": v for c, v in zip("xyz", cross(ns, d))})
    u = vec("ux", "uy", "uz")
    far = far.withColumn("m", F.sqrt(dot(u, u))).where(F.col("m") >= 1e-10)
    v = scale(u, 1 / F.col("m"))
    w = cross(ns, v)
    return far.select(KEY, "pid", "neighbor", "distance", _bin(dot(v, nt), -1, 1, BINS).alias("b0"), (BINS + _bin(dot(ns, d), -1, 1, BINS)).alias("b1"), (2 * BINS + _bin(F.atan2(dot(w, nt), dot(ns, nt)), -np.pi, np.pi, BINS)).alias("b2"))


def spfh(cloud: DataFrame, radius: float = 0.1, k: int = 10) -> DataFrame:
    """``(cloud_id, pid, bin, value)``: the occupied bins of each point's simplified histogram, three times 11 bins.

    Values of a third sum to 1. Neighbours are those within the radius if they are at least k, else the k nearest. Histograms
    are counted in blocks of space, so that pairs are neither written nor shuffled.
    """
    positive(radius=radius)
    width = 3 * BINS
    points = scratch.written(cloud.where(F.col(KEY).isNotNull() & F.col("pid").isNotNull()).select(KEY, "pid", *_POINT), "points")
    scratch.release(cloud.sparkSession)

    def fold(sums: np.ndarray, b: Blocks, rows: np.ndarray, q: np.ndarray, m: np.ndarray, d2: np.ndarray) -> None:
        for at in range(0, len(q), PAIRS):
            q_, m_, d = q[at : at + PAIRS], m[at : at + PAIRS], np.sqrt(d2[at : at + PAIRS])
            normal, normals = (np.column_stack([b.table[f"n{c}"].to_numpy()[at_] for c in "xyz"]) for at_ in (rows[q_], m_))
            bins, good = _bins(b.xyz[rows[q_]], normal, b.xyz[m_], normals, d)
            sums += np.bincount((q_[good, None] * width + bins[good]).ravel(), minlength=sums.size).reshape(sums.shape)

    def finish(sums: np.ndarray, count: np.ndarray) -> list[pa.Array]:
        row, bins = np.nonzero(sums)
        ends = pa.array(np.searchsorted(row, np.arange(len(sums) + 1)), pa.int32())
        lists = (pa.ListArray.from_arrays(ends, pa.array(values, pa.int32())) for values in (bins, sums[row, bins].astype(np.int32)))
        # each pair is in one bin of each third
        return [*lists, pa.array(sums[:, :BINS].sum(axis=1).astype(np.int64))]

    first, near = folded(points, k, radius, width, fold, finish, {"bins": "array<int>", "counts": "array<int>", "n": "bigint"}, carry=_POINT)
    occupied = first.where("left IS NULL").select(KEY, "pid", "n", F.explode(F.arrays_zip("bins", "counts")).alias("o"))
    out = occupied.select(KEY, "pid", F.col("o.bins").alias("bin"), (F.col("o.counts") / F.col("n")).alias("value"))
    if near is not None:
        own = first.where("left IS NOT NULL").select(KEY, "pid", F.col("left").alias("own"))
        out = out.unionByName(_spfh(near.join(own, [KEY, "pid"])))
    return out


def _spfh(pairs: DataFrame) -> DataFrame:
    angles = pair_features(pairs)
    long = angles.select(KEY, "pid", F.explode(F.array("b0", "b1", "b2")).alias("bin"))
    counts = long.groupBy(KEY, "pid", "bin").agg(F.count(F.lit(1)).alias("c"))
    total = angles.groupBy(KEY, "pid").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(total, [KEY, "pid"]).select(KEY, "pid", "bin", (F.col("c") / F.col("n")).alias("value"))


#: Pairs whose histograms are added up at a time.
PAIRS = 200_000


def _bins(own: np.ndarray, normal: np.ndarray, to: np.ndarray, normals: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The three bins of each pair (n, 3), and which pairs are not degenerate: :func:`pair_features` on arrays."""
    near = distance >= 1e-10
    d = (to - own) / np.where(near, distance, 1)[:, None]
    u = np.cross(normal, d)
    m = np.sqrt((u * u).sum(axis=1))
    near &= m >= 1e-10
    v = u * (1 / np.where(m > 0, m, 1))[:, None]  # as the Column form, so that borders fall alike
    w = np.cross(normal, v)
    dot_ = lambda a, b: (a * b).sum(axis=1)
    bin_ = lambda value, low, wide: np.clip(np.nan_to_num(np.floor((value - low) / wide * BINS)), 0, BINS - 1).astype(np.int64)
    angle = np.arctan2(dot_(w, normals), dot_(normal, normals))
    return np.stack([bin_(dot_(v, normals), -1, 2), BINS + bin_(dot_(normal, d), -1, 2), 2 * BINS + bin_(angle, -np.pi, 2 * np.pi)], axis=1), near


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def _even(value: np.ndarray) -> np.ndarray:
    """Each third of the values over its sum; zeros stay."""
    thirds = value.reshape(-1, 3, BINS)
    total = thirds.sum(axis=2, keepdims=True)
    return np.divide(thirds, total, out=np.zeros_like(thirds), where=total > 0).reshape(value.shape)


def _dense(b: Blocks, column: str, width: int) -> np.ndarray:
    return np.asarray(b.table[column].combine_chunks().flatten(), dtype=float).reshape(-1, width)


def fpfh(cloud: DataFrame, radius: float = 0.1, k: int = 10) -> DataFrame:
    """``(cloud_id, pid, feature ARRAY<DOUBLE>)``: 33 values per point, each third summing to 1.

    A point's own histogram plus those of its neighbours weighted by inverse distance over the sum of weights. Points whose
    pairs are all degenerate get zeros.

    Two passes over blocks with a rim of the radius: simplified histograms, then their weighted sums, so that a point's 33
    values travel once or twice and not once for each neighbour. Points with fewer than k others within the radius take
    their k nearest instead, by the neighbour search.
    """
    positive(radius=radius)
    width = 3 * BINS
    kind = cloud.schema[KEY].dataType.simpleString()
    points = scratch.written(cloud.select(KEY, F.col("pid").cast("bigint").alias("pid"), *(F.col(c).cast("double").alias(c) for c in _POINT)), "points")

    def pairs(b: Blocks, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Neighbour pairs (place in home, row, distance) without the point itself."""
        pid = b.table["pid"].to_numpy()
        for q, m, d2 in b.grid().within(b.block[home], b.xyz[home], radius):
            other = pid[home[q]] != pid[m]
            q, m, d = q[other], m[other], np.sqrt(d2[other])
            order = np.argsort(q, kind="stable")
            q, m, d = q[order], m[order], d[order]
            for at in range(0, len(q), PAIRS):
                yield q[at : at + PAIRS], m[at : at + PAIRS], d[at : at + PAIRS]

    def simple(b: Blocks) -> Iterator[pa.RecordBatch]:
        home = np.flatnonzero(b.home)
        normals = np.column_stack([b.table[f"n{c}"].to_numpy() for c in "xyz"])
        count, total = np.zeros(len(home), dtype=np.int64), np.zeros(len(home))
        histogram = np.zeros(len(home) * width)
        for q, m, d in pairs(b, home):
            count += np.bincount(q, minlength=len(home))
            bins, good = _bins(b.xyz[home[q]], normals[home[q]], b.xyz[m], normals[m], d)
            total += np.bincount(q[good], minlength=len(home))
            histogram += np.bincount((q[good, None] * width + bins[good]).ravel(), minlength=len(histogram))
        values = histogram.reshape(-1, width) / np.maximum(total, 1)[:, None]
        rows = pa.array(home)
        columns = [b.table[c].combine_chunks().take(rows) for c in (KEY, "pid")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(count < k), _lists(values)], names=[KEY, "pid", "thin", "h"])

    first = scratch.written(in_blocks(points, radius, simple, f"{KEY} {kind}, pid bigint, thin boolean, h array<double>"), "spfh")
    thin = points.join(first.where("thin").select(KEY, "pid"), [KEY, "pid"], "left_semi")
    some = not first.where("thin").isEmpty()
    histograms = first.select(KEY, "pid", "h", "thin")
    if some:
        near = scratch.written(knn(thin, points, k, exclude_self=True, carry=_POINT).drop("rank"), "thin")
        angles = pair_features(near.join(points.select(KEY, "pid", F.struct(*_POINT).alias("own")), [KEY, "pid"]))
        at = lambda i: F.col(f"b{i // BINS}") == i
        few = angles.groupBy(KEY, "pid").agg(F.array(*(F.count_if(at(i)) / F.count(F.lit(1)) for i in range(width))).alias("own_h"))
        histograms = histograms.join(few, [KEY, "pid"], "left").select(KEY, "pid", F.when(F.col("thin"), F.coalesce("own_h", F.array_repeat(F.lit(0.0), width))).otherwise(F.col("h")).alias("h"), "thin")
    carried = scratch.written(points.select(KEY, "pid", *"xyz").join(histograms, [KEY, "pid"]), "histograms")

    def weighted(b: Blocks) -> Iterator[pa.RecordBatch]:
        home = np.flatnonzero(b.home)
        home = home[~b.table["thin"].to_numpy(zero_copy_only=False).astype(bool)[home]]
        h = _dense(b, "h", width)
        total, lent = np.zeros(len(home)), np.zeros((len(home), width))
        for q, m, d in pairs(b, home):
            far = d >= 1e-10
            q, m, w = q[far], m[far], 1 / d[far]
            if not len(q):
                continue
            total += np.bincount(q, weights=w, minlength=len(home))
            starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            lent[q[starts]] += np.add.reduceat(h[m] * w[:, None], starts, axis=0)
        rows = pa.array(home)
        value = h[home] + lent / np.where(total > 0, total, 1)[:, None]
        yield pa.RecordBatch.from_arrays([*(b.table[c].combine_chunks().take(rows) for c in (KEY, "pid")), _lists(_even(value))], names=[KEY, "pid", "feature"])

    schema = f"{KEY} {kind}, pid bigint, feature array<double>"
    out = in_blocks(carried, radius, weighted, schema)
    if some:
        lent = near.where(F.col("distance") >= 1e-10).select(KEY, "pid", F.col("neighbor"), (1 / F.col("distance")).alias("w")).join(carried.select(KEY, F.col("pid").alias("neighbor"), "h"), [KEY, "neighbor"])
        sums = lent.groupBy(KEY, "pid").agg(F.sum("w").alias("w"), F.array(*(F.sum(F.col("w") * F.col("h")[i]) for i in range(width))).alias("l"))
        few = carried.where("thin").select(KEY, "pid", "h").join(sums, [KEY, "pid"], "left").select(KEY, "pid", "h", F.coalesce("w", F.lit(1.0)).alias("w"), F.coalesce("l", F.array_repeat(F.lit(0.0), width)).alias("l"))

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h, lent = (np.asarray(batch.column(c).flatten(), dtype=float).reshape(-1, width) for c in ("h", "l"))
                value = h + lent / batch.column("w").to_numpy()[:, None]
                yield pa.RecordBatch.from_arrays([batch.column(KEY), batch.column("pid"), _lists(_even(value))], names=[KEY, "pid", "feature"])

        out = out.unionByName(few.mapInArrow(finish, schema))
    return out


def fpfh_of_positions(cloud: DataFrame) -> DataFrame:
    """Descriptors of a cloud without normals: these are estimated from 10 neighbours first."""
    return fpfh(scratch.written(estimate_normals(cloud, 10), "normals"))


def _frames(n: int, q: np.ndarray, delta: np.ndarray, normal: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Local frames (x, y, z) of n points: the normal, and the direction of most spread in its plane, each signed by the majority.

    ``q`` and ``delta`` are the point and the offset of each neighbour, ``normal`` the points' normals.
    """
    dot_ = lambda u, v: (u * v).sum(axis=1)
    total = np.bincount(q, minlength=n)
    turned = lambda v: np.where(2 * np.bincount(q[dot_(delta, v[q]) >= 0], minlength=n) < total, -1.0, 1.0)[:, None]
    length = np.linalg.norm(normal, axis=1)
    z = np.where((length > 1e-10)[:, None], normal / np.where(length > 0, length, 1)[:, None], np.array([0.0, 0.0, 1.0]))
    z = z * turned(z)
    w = np.maximum(radius - np.linalg.norm(delta, axis=1), 0)
    spread = np.empty((n, 3, 3))
    for i in range(3):
        for j in range(i, 3):
            spread[:, i, j] = spread[:, j, i] = np.bincount(q, weights=w * delta[:, i] * delta[:, j], minlength=n)
    x = np.linalg.eigh(spread)[1][:, :, -1] if n else np.empty((0, 3))
    x = x * np.where(np.take_along_axis(x, np.abs(x).argmax(axis=1)[:, None], axis=1) > 0, 1.0, -1.0)
    x = x * turned(x)
    out, left = np.zeros((n, 3)), np.ones(n, dtype=bool)
    for candidate in (x, np.broadcast_to([1.0, 0.0, 0.0], (n, 3)), np.broadcast_to([0.0, 1.0, 0.0], (n, 3))):
        flat = candidate - z * dot_(z, candidate)[:, None]
        size = np.linalg.norm(flat, axis=1)
        take = left & (size > 1e-10)
        out[take] = flat[take] / size[take][:, None]
        left &= ~take
    return out, np.cross(z, out), z


def _signatures(variant: str, radius: float, n: int, q: np.ndarray, delta: np.ndarray, normal: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """The descriptors of n points, from the offsets and normals of their neighbours."""
    size = 352 if variant == "shot" else 128
    x, y, z = _frames(n, q, delta, normal, radius)
    distance = np.linalg.norm(delta, axis=1)
    near = (distance >= 1e-10) & (distance <= radius)
    q, delta, distance, normals = q[near], delta[near], distance[near], normals[near]
    lx, ly, lz = ((delta * v[q]).sum(axis=1) for v in (x, y, z))
    sector = np.minimum(((np.arctan2(ly, lx) + np.pi) / (2 * np.pi) * 8).astype(int), 7)
    if variant == "shot":
        volume = np.where(distance <= radius / 2, 0, 16) + np.where(lz < 0, 0, 8) + sector
        slope = np.minimum(((np.clip((normals * z[q]).sum(axis=1), -1, 1) + 1) / 2 * BINS).astype(int), BINS - 1)
        bins, whole = volume * BINS + slope, np.bincount(q * 32 + volume, minlength=n * 32).reshape(n, 32).repeat(BINS, axis=1)
    else:
        rise = np.minimum(((np.clip(lz / distance, -1, 1) + 1) / 2 * 4).astype(int), 3)
        shell = np.minimum((distance / radius * 4).astype(int), 3)
        bins, whole = sector * 16 + rise * 4 + shell, np.bincount(q, minlength=n)[:, None]
    out = np.bincount(q * size + bins, minlength=n * size).reshape(n, size) / np.maximum(whole, 1)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=np.zeros_like(out), where=length > 1e-10)


def _signature(cloud: DataFrame, variant: str, radius: float, k: int) -> DataFrame:
    """Descriptors in blocks with a rim of the radius; points with fewer than k others in it take their k nearest instead."""
    positive(radius=radius)
    kind = cloud.schema[KEY].dataType.simpleString()
    points = scratch.written(cloud.select(KEY, F.col("pid").cast("bigint").alias("pid"), *(F.col(c).cast("double").alias(c) for c in _POINT)), "points")
    schema = f"{KEY} {kind}, pid bigint, feature array<double>"

    def describe(b: Blocks) -> Iterator[pa.RecordBatch]:
        pid = b.table["pid"].to_numpy()
        normals = np.column_stack([b.table[f"n{c}"].to_numpy() for c in "xyz"])
        home, grid = np.flatnonzero(b.home), b.grid()
        for first in range(0, len(home), 5_000):
            part = home[first : first + 5_000]
            # all pairs of a point are needed at once
            found = [(q[o], m[o]) for q, m, _ in grid.within(b.block[part], b.xyz[part], radius) for o in [pid[part[q]] != pid[m]]]
            q, m = (np.concatenate([f[i] for f in found]) if found else np.empty(0, dtype=np.int64) for i in (0, 1))
            value = _signatures(variant, radius, len(part), q, b.xyz[m] - b.xyz[part[q]], normals[part], normals[m])
            full = np.bincount(q, minlength=len(part)) >= k
            rows = pa.array(part)
            feature = pa.array([v if f else None for v, f in zip(value, full)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.table[c].combine_chunks().take(rows) for c in (KEY, "pid")), feature], names=[KEY, "pid", "feature"])

    first = scratch.written(in_blocks(points, radius, describe, schema), "described")
    thin = points.join(first.where("feature IS NULL").select(KEY, "pid"), [KEY, "pid"], "left_semi")
    near = knn(thin, points, k, exclude_self=True, carry=_POINT)
    lists = near.groupBy(KEY, "pid").agg(F.array_sort(F.collect_list(F.struct("rank", *(F.col(f"to.{c}").alias(f"t{c}") for c in _POINT)))).alias("near"))
    rows = points.join(first.where("feature IS NULL").select(KEY, "pid"), [KEY, "pid"], "left_semi").join(lists, [KEY, "pid"])

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {c: batch.column(c).to_numpy() for c in _POINT}
            held = batch.column("near")
            to = held.flatten()
            q = np.repeat(np.arange(batch.num_rows), np.diff(held.offsets.to_numpy()))
            at = lambda names: np.column_stack([to.field(f"t{c}").to_numpy() for c in names])  # noqa: B023, E731
            mine = lambda names: np.column_stack([own[c] for c in names])  # noqa: B023, E731
            value = _signatures(variant, radius, batch.num_rows, q, at(_POINT[:3]) - mine(_POINT[:3])[q], mine(_POINT[3:]), at(_POINT[3:]))
            yield pa.RecordBatch.from_arrays([batch.column(KEY), batch.column("pid"), _lists(value)], names=[KEY, "pid", "feature"])

    return first.where("feature IS NOT NULL").unionByName(rows.mapInArrow(few, schema))


def shot(cloud: DataFrame, radius: float = 0.2, k: int = 10) -> DataFrame:
    """``(cloud_id, pid, feature)``: 352 values, histograms of normal angles in 32 volumes of a local frame, of length 1."""
    return _signature(cloud, "shot", radius, k)


def unique_shape_context(cloud: DataFrame, radius: float = 0.2, k: int = 10) -> DataFrame:
    """``(cloud_id, pid, feature)``: 128 values, point counts by azimuth, elevation and shell of a local frame, of length 1."""
    return _signature(cloud, "usc", radius, k)
