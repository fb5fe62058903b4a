"""Planes and Euclidean clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointlake.functions.geometry import XYZ, cross, dot, sub, vec
from pointlake.operators.chains import chain_clusters
from pointlake.plans import scratch
from pointlake.plans.ranks import ranked
from pointlake.schema import one_cloud, positive

KEY = "cloud_id"


def plane_from_points(a, b, c) -> tuple[float, float, float, float] | None:
    """Unit plane (a, b, c, d) through three points, None where they are collinear (cross product below 1e-8)."""
    a, b, c = (np.asarray(p, dtype=float) for p in (a, b, c))
    n = np.cross(b - a, c - a)
    length = np.linalg.norm(n)
    if length < 1e-8:
        return None
    n = n / length
    return (*map(float, n), float(-n @ a))


def plane_distance(plane: tuple[float, float, float, float]):
    """Distance of a point to a plane as a Column; 0 for a plane without direction."""
    a, b, c, d = map(float, plane)
    length = float(np.sqrt(a * a + b * b + c * c))
    if length == 0:
        return F.lit(0.0)
    return F.abs(F.lit(a) * F.col("x") + F.lit(b) * F.col("y") + F.lit(c) * F.col("z") + F.lit(d)) / F.lit(length)


def plane_inliers(cloud: DataFrame, plane: tuple[float, float, float, float], threshold: float) -> DataFrame:
    """Points at most ``threshold`` from the plane."""
    return cloud.where(plane_distance(plane) <= threshold)


#: Ranks of a chunk, and planes and points that meet at a time.
CHUNK, PLANES, POINTS = 50_000, 200, 2_000


def _chunk(rank: Column) -> Column:
    return F.floor(rank / CHUNK).cast("int")


def _corners(sizes: DataFrame, iterations: int, seed: int | None) -> DataFrame:
    """``(candidate, corner, rank, chunk)``: three different ranks of a cloud for each of its candidates."""
    i, n = F.col("candidate"), F.col("n")
    # sizes are few rows of many candidates each: spread before they are exploded
    sizes = sizes.where("n >= 3").repartition(sizes.sparkSession.sparkContext.defaultParallelism, KEY)
    drawn = sizes.select(KEY, "first", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(iterations - 1).cast("bigint"))).alias("candidate"))
    if seed is None:
        ranks = [F.pmod(i, n), F.pmod(37 * i + 1, n), F.pmod(101 * i + 2, n)]
    else:
        # three different ranks: each draw is among those left, shifted past the ones before it
        draw = lambda c, left: F.pmod(F.xxhash64(F.lit(seed), F.lit(c), KEY, i), left)
        first, second = draw(0, n), draw(1, n - 1)
        second = second + (second >= first).cast("bigint")
        low, high, third = F.least(first, second), F.greatest(first, second), draw(2, n - 2)
        third = third + (third >= low).cast("bigint")
        ranks = [first, second, third + (third >= high).cast("bigint")]
    a, b, c = ranks
    apart = drawn.withColumns({"r0": a, "r1": b, "r2": c}).where("r0 <> r1 AND r1 <> r2 AND r0 <> r2")
    corners = apart.select("candidate", "first", F.posexplode(F.array("r0", "r1", "r2")).alias("corner", "r_")).withColumn("rank", F.col("first") + F.col("r_"))
    return corners.select("candidate", "corner", "rank", _chunk(F.col("rank")).alias("chunk"))


def _planes(parts: DataFrame, sizes: DataFrame, iterations: int, seed: int | None) -> DataFrame:
    """``(cloud_id, candidate, a, b, c, d)``: planes through the drawn points, those of collinear ones left out."""
    kind = parts.schema[KEY].dataType.simpleString()
    at = [f"{c}{t}" for t in range(3) for c in XYZ]

    def pick(key: tuple, group: pa.Table, drawn: pa.Table) -> pa.Table:
        """A row for each candidate with those of its corners that lie in the chunk."""
        rank = group["rank"].to_numpy()
        order = np.argsort(rank, kind="stable")
        row = order[np.searchsorted(rank, drawn["rank"].to_numpy(), sorter=order)]
        names = group[KEY].combine_chunks()
        code = names.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        _, first, place = np.unique(np.column_stack([code, drawn["candidate"].to_numpy()]), axis=0, return_index=True, return_inverse=True)
        place, corner = place.ravel(), drawn["corner"].to_numpy()
        columns = {KEY: names.take(pa.array(row[first])), "candidate": drawn["candidate"].combine_chunks().take(pa.array(first))}
        for t in range(3):
            mine = corner == t
            value, missing = np.zeros(len(first)), np.ones(len(first), dtype=bool)
            missing[place[mine]] = False
            for c in XYZ:
                value[place[mine]] = group[c].to_numpy()[row[mine]]
                columns[f"{c}{t}"] = pa.array(value.copy(), mask=missing)
        return pa.table(columns)

    schema = f"{KEY} {kind}, candidate bigint, {', '.join(f'{c} double' for c in at)}"
    drawn = parts.groupBy("chunk").cogroup(_corners(sizes, iterations, seed).groupBy("chunk")).applyInArrow(pick, schema)
    met = drawn.groupBy(KEY, "candidate").agg(*(F.max(c).alias(c) for c in at))
    at = [vec(*(f"{c}{t}" for c in XYZ)) for t in range(3)]
    met = met.withColumns(dict(zip(("m0", "m1", "m2"), cross(sub(at[1], at[0]), sub(at[2], at[0])))))
    length = F.sqrt(dot(vec("m0", "m1", "m2"), vec("m0", "m1", "m2")))
    met = met.withColumn("length", length).where("length >= 1e-8").withColumns({n: F.col(m) / F.col("length") for n, m in (("a", "m0"), ("b", "m1"), ("c", "m2"))})
    return met.select(KEY, "candidate", "a", "b", "c", (-dot(vec("a", "b", "c"), at[0])).alias("d"))


def ransac_plane(cloud: DataFrame, threshold: float = 0.01, iterations: int = 1000, seed: int | None = None) -> DataFrame:
    """``(cloud_id, candidate, a, b, c, d, inliers)``: of each cloud the plane through three points with most points within ``threshold``.

    Ties go to the first candidate. Candidates are drawn by rank in pid order: by a hash of the seed over all points, without
    a seed by the fixed recurrence. Chunks of ranks, which hold part of a cloud or many small ones, meet first the corners drawn
    from them and then the planes of their clouds, in vectorised tasks over one shuffle; of a cloud in several chunks the counts
    are added up. Clouds with fewer than 3 points have no plane; if no cloud has 3, and for non-positive parameters, it is an
    error.
    """
    positive(threshold=threshold, iterations=iterations)
    points = ranked(cloud.select(KEY, "pid", *XYZ), [KEY, "pid"])
    first = points.groupBy(KEY).agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    sizes = scratch.written(first, "sizes")
    if sizes.where("n >= 3").isEmpty():
        raise ValueError("at least 3 points are needed")
    sizes = sizes.where(F.col(KEY).isNotNull())
    parts = points.where(F.col(KEY).isNotNull()).select(KEY, *XYZ, "rank", _chunk(F.col("rank")).alias("chunk"))
    low, high = _chunk(F.col("first")), _chunk(F.col("first") + F.col("n") - 1)
    spread = sizes.select(KEY, (low == high).alias("alone"), F.sequence(low, high).alias("chunks"))
    chunks = _planes(parts, sizes, iterations, seed).join(spread, KEY).select(KEY, "candidate", *"abcd", "alone", F.explode("chunks").alias("chunk"))
    kind = cloud.schema[KEY].dataType.simpleString()

    def count(key: tuple, group: pa.Table, held: pa.Table) -> pa.Table:
        """Counts of each plane in the chunk; of a cloud that lies in it alone, the best plane only."""
        names = held[KEY].combine_chunks().dictionary_encode()
        code = names.indices.to_numpy(zero_copy_only=False)
        own = pc.index_in(group[KEY], names.dictionary).to_numpy()
        p, h, alone = np.column_stack([group[c].to_numpy() for c in XYZ]), np.column_stack([held[v].to_numpy() for v in "abcd"]), held["alone"].to_numpy()
        candidate, n, kept = held["candidate"].to_numpy(), np.zeros(len(h), dtype=np.int64), np.ones(len(h), dtype=bool)
        for cloud_code in range(len(names.dictionary)):
            rows, mine = np.flatnonzero(code == cloud_code), p[own == cloud_code]
            for i in range(0, len(rows), PLANES):
                a, b, c, d = h[rows[i : i + PLANES]].T[:, :, None]
                for j in range(0, len(mine), POINTS):
                    x, y, z = mine[j : j + POINTS].T
                    # summed in the order of the Column form, so that borders fall alike
                    gap = x * a
                    gap += y * b
                    gap += z * c
                    gap += d
                    n[rows[i : i + PLANES]] += np.count_nonzero(np.abs(gap, out=gap) <= threshold, axis=1)
            if alone[rows[0]]:
                kept[rows] = False
                kept[rows[np.lexsort((candidate[rows], -n[rows]))[0]]] = True
        return held.select([KEY, "candidate", *"abcd"]).append_column("n", pa.array(n)).filter(pa.array(kept))

    schema = f"{KEY} {kind}, candidate bigint, a double, b double, c double, d double, n bigint"
    counted = parts.groupBy("chunk").cogroup(chunks.groupBy("chunk")).applyInArrow(count, schema)
    hits = counted.groupBy(KEY, "candidate").agg(F.sum("n").alias("inliers"), *(F.max(v).alias(v) for v in "abcd"))
    best = hits.groupBy(KEY).agg(F.max(F.struct("inliers", (-F.col("candidate")).alias("back"), *"abcd")).alias("m"))
    return best.select(KEY, (-F.col("m.back")).alias("candidate"), *(F.col(f"m.{v}").alias(v) for v in "abcd"), F.col("m.inliers").alias("inliers"))


def segment_planes(cloud: DataFrame, threshold: float = 0.01, iterations: int = 1000, seed: int | None = 0) -> DataFrame:
    """The inliers of each cloud's best plane."""
    planes = ransac_plane(cloud, threshold, iterations, seed).select(KEY, *(F.col(c).alias(f"plane_{c}") for c in "abcd"))
    gap = F.abs(F.col("x") * F.col("plane_a") + F.col("y") * F.col("plane_b") + F.col("z") * F.col("plane_c") + F.col("plane_d"))
    return cloud.join(planes, KEY).where(gap <= threshold).select(*cloud.columns)


def segment_plane(cloud: DataFrame, threshold: float = 0.01, iterations: int = 1000, seed: int | None = 0) -> tuple[DataFrame, tuple[float, float, float, float] | None]:
    """The inliers of the best plane of one cloud, and the plane; for several clouds see :func:`segment_planes`."""
    one_cloud(cloud)
    row = ransac_plane(cloud, threshold, iterations, seed).first()
    if row is None:
        return cloud.limit(0), None
    plane = (row.a, row.b, row.c, row.d)
    return plane_inliers(cloud, plane, threshold), plane


def euclidean_clusters(cloud: DataFrame, tolerance: float = 0.02, smallest: int = 100, largest: int = 25_000) -> DataFrame:
    """``(cloud_id, pid, cluster_id, size)``: points linked by steps of ``tolerance``, clusters numbered from the largest.

    Only clusters of ``smallest`` to ``largest`` points; of equal size the one with the smallest pid first. Numbers come from a
    window over clusters, not points.
    """
    members = chain_clusters(cloud, tolerance, smallest=smallest, largest=largest)
    sizes = members.groupBy(KEY, "cluster_pid").agg(F.count(F.lit(1)).alias("size"))
    order = Window.partitionBy(KEY).orderBy(F.desc("size"), "cluster_pid")
    numbered = sizes.withColumn("cluster_id", F.row_number().over(order) - 1)
    return members.join(numbered, [KEY, "cluster_pid"]).select(KEY, "pid", "cluster_id", "size")


def cluster_cloud(cloud: DataFrame, clusters: DataFrame, cluster_id: int) -> DataFrame:
    """The points of one cluster."""
    return cloud.join(clusters.where(F.col("cluster_id") == cluster_id).select(KEY, "pid"), [KEY, "pid"], "left_semi")
