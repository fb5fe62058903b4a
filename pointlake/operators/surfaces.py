"""Surfaces from points: alpha complexes, Delaunay, ball pivoting, Poisson, and the choice among them."""

from __future__ import annotations

from dataclasses import dataclass
from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.functions.geometry import XYZ, cross, dot, sub, vec
from pointlake.operators import volumes
from pointlake.functions.linear import SYMMETRIC, matrices, with_eigen
from pointlake.operators.neighbors import KEY, knn, neighborhoods, pairs_within
from pointlake.operators.normals import COVARIANCE, estimate_normals
from pointlake.operators.voxel import bounds
from pointlake.plans import scratch
from pointlake.plans.ranks import ranked
from pointlake.schema import one_cloud, positive

_FACE = "cloud_id string, a bigint, b bigint, c bigint"
#: Deepest grid that the driver solves: 256 nodes a side, about 2 GB while it works.
MOST_DEPTH = 8


# -- triangles as Columns -------------------------------------------------------------------------------------------------


def circumradius2(a, b, c) -> Column:
    """Squared circumradius of a triangle, null where it has none."""
    ab, bc, ca = sub(b, a), sub(c, b), sub(a, c)
    n = cross(ab, sub(c, a))
    area2 = dot(n, n) / 4
    sides = [dot(s, s) for s in (ab, bc, ca)]
    bad = (area2 < 1e-20) | (F.least(*sides) < 1e-20)
    return F.when(~bad, F.try_divide(sides[0] * sides[1] * sides[2], 16 * area2))


def triangle_area(a, b, c) -> Column:
    n = cross(sub(b, a), sub(c, a))
    return F.sqrt(dot(n, n)) / 2


# The parts of a triangle's score and their weights, here and in ball pivoting: the least angle over 30 degrees,
# twice the ratio of inner to outer radius, and 3 over the ratio of the longest to the shortest side, each at most 1 but the second.
def triangle_quality(triangles: DataFrame) -> DataFrame:
    """Triangles (structs a, b, c) with area, aspect_ratio, min_angle, max_angle, edge_ratio and a score from 0 to 1."""
    p = {n: vec(*(f"{n}.{x}" for x in XYZ)) for n in "abc"}
    side = lambda u, v: F.sqrt(dot(sub(p[v], p[u]), sub(p[v], p[u])))
    t = triangles.withColumns({"la": side("a", "b"), "lb": side("b", "c"), "lc": side("c", "a"), "area": triangle_area(p["a"], p["b"], p["c"])})
    a, b, c = F.col("la"), F.col("lb"), F.col("lc")
    angle = lambda o, u, v: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(u * u + v * v - o * o, 2 * u * v))))
    t = t.withColumns({"ta": angle(a, b, c), "tb": angle(b, a, c)}).withColumn("tc", pi - F.col("ta") - F.col("tb"))
    flat = F.col("area") < 1e-10
    inner = F.col("area") / ((a + b + c) / 2)
    outer = F.try_divide(a * b * c, 4 * F.col("area"))
    t = t.withColumns({
        "aspect_ratio": F.when(flat, 0.0).otherwise(F.coalesce(F.try_divide(inner, outer), F.lit(0.0))),
        "min_angle": F.when(flat, 0.0).otherwise(F.least("ta", "tb", "tc")),
        "max_angle": F.when(flat, pi).otherwise(F.greatest("ta", "tb", "tc")),
        "edge_ratio": F.when(flat, F.lit(float("inf"))).otherwise(F.try_divide(F.greatest(a, b, c), F.least(a, b, c))),
    })
    score = (F.least(F.col("min_angle") / (pi / 6), F.lit(1.0)) + F.col("aspect_ratio") * 2 + F.least(F.try_divide(F.lit(3.0), F.col("edge_ratio")), F.lit(1.0))) / 3
    return t.withColumn("quality_score", F.when(flat, 0.0).otherwise(score)).drop("la", "lb", "lc", "ta", "tb", "tc")


# -- alpha complex --------------------------------------------------------------------------------------------------------


def alpha_triangles(cloud: DataFrame, alpha: float = 1.0, mode: str = "boundary", min_area: float = 1e-8) -> DataFrame:
    """``(cloud_id, a, b, c, circumradius, area, is_boundary)``: triangles of neighbours, a < b < c by pid.

    Candidates join a point with two later points within alpha of it; thin ones and those without area are left out. An edge
    of one candidate makes it a boundary one. ``mode``: ``boundary`` or ``full`` keep circumradii up to alpha, ``adaptive``
    compares with 1.8 times the median distance of points within 3 alpha of the centroid. No candidate is capped.

    Pairs come from the grid join; the third corner is a join of pairs on the first point, whose partners are those within
    alpha: the work per point is bounded by the density inside alpha, the caller's choice.
    """
    positive(alpha=alpha)
    if mode not in ("boundary", "full", "adaptive"):
        raise ValueError("mode must be boundary, full or adaptive")
    ids = cloud.select(KEY, "pid", *XYZ)
    near = pairs_within(ids, ids, alpha).where(F.col("a.pid") < F.col("b.pid"))
    near = scratch.written(near.select(F.col("a.cloud_id").alias(KEY), F.col("a.pid").alias("pid"), "a", "b"), "alpha")
    third = near.select(KEY, "pid", F.col("b").alias("c"))
    t = near.join(third, [KEY, "pid"]).where(F.col("b.pid") < F.col("c.pid"))
    p = {n: vec(*(f"{n}.{x}" for x in XYZ)) for n in "abc"}
    t = t.withColumns({"r2": circumradius2(p["a"], p["b"], p["c"]), "area": triangle_area(p["a"], p["b"], p["c"])})
    side = lambda u, v: F.sqrt(dot(sub(p[v], p[u]), sub(p[v], p[u])))
    t = t.withColumn("round", side("a", "b") + side("b", "c") + side("c", "a"))
    t = t.where(F.col("r2").isNotNull() & (F.col("area") >= min_area) & (F.try_divide(4 * F.col("area"), F.col("round") * F.col("round")) > 0.01))
    named = [F.col(f"{n}.pid").alias(n) for n in "abc"]
    t = scratch.written(t.select(KEY, *named, F.sqrt("r2").alias("circumradius"), "area", *((p["a"][i] + p["b"][i] + p["c"][i]).alias(f"s{x}") for i, x in enumerate(XYZ))), "candidates")
    sides = t.select(KEY, *"abc", F.explode(F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in ("ab", "bc", "ac")))).alias("e"))
    lone = sides.groupBy(KEY, "e.u", "e.v").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*"abc")).alias("t")).where("n = 1").select(KEY, "t.*").distinct()
    t = t.join(lone.withColumn("is_boundary", F.lit(True)), [KEY, *"abc"], "left").withColumn("is_boundary", F.coalesce("is_boundary", F.lit(False)))
    if mode == "adaptive":
        center = t.select(F.struct(KEY, *"abc").alias("t"), KEY, F.xxhash64(*"abc").alias("pid"), *((F.col(f"s{x}") / 3).alias(x) for x in XYZ))
        around = pairs_within(center, ids, alpha * 3, strict=True).where(F.col("d2") > 0)
        # the middle element of the sorted distances, exactly
        local = around.groupBy(F.col("a.t").alias("t")).agg(F.expr("array_sort(collect_list(sqrt(d2)))").alias("ds")).select("t.*", (F.get("ds", F.floor(F.size("ds") / 2).cast("int")) * 1.8).alias("local"))
        t = t.join(local, [KEY, *"abc"], "left").where(F.col("circumradius") <= F.coalesce("local", F.lit(alpha)))
    else:
        t = t.where(F.col("circumradius") <= alpha)
        if mode == "boundary":
            t = t.where("is_boundary")
    return t.select(KEY, *"abc", "circumradius", "area", "is_boundary")


def alpha_statistics(triangles: DataFrame) -> DataFrame:
    """``(cloud_id, triangles, boundary, mean_circumradius)``."""
    return triangles.groupBy(KEY).agg(F.count(F.lit(1)).alias("triangles"), F.count_if("is_boundary").alias("boundary"), F.avg("circumradius").alias("mean_circumradius"))


def neighbor_quantile(cloud: DataFrame, k: int, share: float, factor: float) -> DataFrame:
    """``(cloud_id, value)``: factor times the element at floor(share x n) of the sorted distances to the k-th neighbour.

    The base of the suggested alpha (k, 0.5, 1.8), pivoting radius and support radius. Exact and over all points.
    """
    ids = cloud.select(KEY, "pid", *XYZ)
    d = knn(ids, ids, k, exclude_self=True).where(F.col("rank") == k).select(KEY, "distance")
    return d.groupBy(KEY).agg((F.percentile("distance", F.lit(float(share))) * factor).alias("value"))


# -- Delaunay -------------------------------------------------------------------------------------------------------------


def delaunay_indices(xy: np.ndarray) -> np.ndarray:
    """Triangles (index triples, counterclockwise) of the Delaunay triangulation of points in the plane.

    Points are inserted one at a time; the triangles whose circumcircle holds the new point are found by one vectorised test
    and replaced by a fan over the rim of their union. Of points at one place the first counts.
    """
    _, first = np.unique(np.round(xy / 1e-10) if len(xy) and np.abs(xy).max() < 1e5 else xy, axis=0, return_index=True)
    order = np.sort(first)
    if len(order) < 3:
        return np.empty((0, 3), dtype=int)
    low, high = xy.min(axis=0), xy.max(axis=0)
    middle, wide = (low + high) / 2, max(np.ptp(xy, axis=0).max(), 1e-12)
    points = np.vstack([xy, middle + wide * np.array([[-300.0, -200.0], [300.0, -200.0], [0.0, 400.0]])])
    n = len(xy)
    tri = np.array([[n, n + 1, n + 2]])

    def circles(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c = (points[t[:, i]] for i in range(3))
        u, v = b - a, c - a
        d = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
        uu, vv = (u**2).sum(1), (v**2).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            o = np.stack([(v[:, 1] * uu - u[:, 1] * vv) / d, (u[:, 0] * vv - v[:, 0] * uu) / d], 1)
        return a + o, (o**2).sum(1)

    center, r2 = circles(tri)
    for p in order:
        bad = ((center - points[p]) ** 2).sum(1) < r2 * (1 + 1e-12)
        if not bad.any():
            continue
        edges = np.concatenate([tri[bad][:, [0, 1]], tri[bad][:, [1, 2]], tri[bad][:, [2, 0]]])
        pairs = set(map(tuple, edges.tolist()))
        rim = [e for e in map(tuple, edges.tolist()) if (e[1], e[0]) not in pairs]
        fan = np.array([(u, v, p) for u, v in rim])
        c, r = circles(fan)
        flat = ~np.isfinite(r)
        fan, c, r = fan[~flat], c[~flat], r[~flat]
        tri, center, r2 = np.concatenate([tri[~bad], fan]), np.concatenate([center[~bad], c]), np.concatenate([r2[~bad], r])
    return tri[(tri < n).all(axis=1)]


def _plane(points: np.ndarray, projection: str) -> np.ndarray:
    if projection in ("xy", "xz", "yz"):
        return points[:, ["xyz".index(c) for c in projection]]
    centered = points - points.mean(axis=0)
    axes = np.linalg.eigh(centered.T @ centered)[1][:, ::-1]
    return centered @ axes[:, :2]


def auto_projection(points: np.ndarray) -> str:
    """The plane across an axis along which the points extend less than a tenth of the most, else the principal plane."""
    extent = np.ptp(points, axis=0)
    if len(points) and extent.min() < 0.1 * extent.max():
        return ("yz", "xz", "xy")[int(np.argmin(extent))]
    return "pca"


def delaunay(cloud: DataFrame, projection: str = "pca", min_area: float = 1e-8, max_edge: float | None = None) -> DataFrame:
    """``(cloud_id, a, b, c)``: Delaunay triangles of each cloud in a plane (``xy``, ``xz``, ``yz``, ``pca`` or ``auto``), by pid.

    Triangles smaller than ``min_area`` or with an edge above ``max_edge`` are left out. The triangulation is sequential, one
    task per cloud; split a cloud that does not fit into tiles first. Fewer than 3 points give none.
    """
    if projection not in ("xy", "xz", "yz", "pca", "auto"):
        raise ValueError("unknown projection")

    def triangulate(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pid")
        points, pid = group[list(XYZ)].to_numpy(), group["pid"].to_numpy()
        t = delaunay_indices(_plane(points, auto_projection(points) if projection == "auto" else projection))
        if len(t):
            a, b, c = (points[t[:, i]] for i in range(3))
            keep = np.linalg.norm(np.cross(b - a, c - a), axis=1) / 2 >= min_area
            if max_edge is not None:
                keep &= np.max([np.linalg.norm(q, axis=1) for q in (b - a, c - b, a - c)], axis=0) <= max_edge
            t = t[keep]
        return pd.DataFrame({KEY: group[KEY].iloc[0], "a": pid[t[:, 0]], "b": pid[t[:, 1]], "c": pid[t[:, 2]]})

    return cloud.select(KEY, "pid", *XYZ).groupBy(KEY).applyInPandas(triangulate, _FACE)


# -- ball pivoting --------------------------------------------------------------------------------------------------------


def _quality(points: np.ndarray, i: int, j: int, ks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Area, score and edge ratio of the triangles (i, j, k) for all k."""
    a, b, c = points[i], points[j], points[ks]
    la, lb, lc = np.full(len(ks), np.linalg.norm(b - a)), np.linalg.norm(c - b, axis=1), np.linalg.norm(a - c, axis=1)
    area = np.linalg.norm(np.cross(b - a, c - a), axis=1) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        ta = np.arccos(np.clip((lb**2 + lc**2 - la**2) / (2 * lb * lc), -1, 1))
        tb = np.arccos(np.clip((la**2 + lc**2 - lb**2) / (2 * la * lc), -1, 1))
        least = np.minimum(np.minimum(ta, tb), pi - ta - tb)
        ratio = np.maximum(np.maximum(la, lb), lc) / np.minimum(np.minimum(la, lb), lc)
        aspect = (area / ((la + lb + lc) / 2)) / (la * lb * lc / (4 * area))
        score = (np.minimum(least / (pi / 6), 1) + 2 * aspect + np.minimum(3 / ratio, 1)) / 3
    score = np.where((area < 1e-10) | ~np.isfinite(score), 0, score)
    return area, score, np.where(np.isfinite(ratio), ratio, np.inf)


def adaptive_radii(cloud: DataFrame, factors: tuple[float, ...] = (1.5, 2.0, 3.0), k: int = 1) -> DataFrame:
    """``(cloud_id, radii ARRAY<DOUBLE>)``: multiples of the median distance to the k-th neighbour of each cloud."""
    positive(**{f"factor_{i}": f for i, f in enumerate(factors)})
    return neighbor_quantile(cloud, k, 0.5, 1.0).where("value > 0").select(KEY, F.array(*(F.col("value") * float(f) for f in sorted(factors))).alias("radii"))


def ball_pivoting(cloud: DataFrame, radii: tuple[float, ...] | None = (0.05, 0.1, 0.15, 0.2), quality: float = 0.1, edge_factor: float = 3.0, min_area: float = 1e-8, fallback: bool = False) -> DataFrame:
    """``(cloud_id, a, b, c)``: triangles grown over edges, the balls' radii from small to large.

    From a seed triangle each open edge takes the unused point of best quality within the radius of both ends; an edge is used
    by at most two triangles. A front is sequential, so a cloud is one task. Radii must be positive; without any, those of
    :func:`adaptive_radii` are taken for each cloud. With ``fallback`` a cloud that no ball gives a face is triangulated in its
    plane instead.
    """
    if radii is not None:
        positive(**{f"radius_{i}": r for i, r in enumerate(radii)})
        own = cloud.select(KEY).distinct().withColumn("radii", F.array(*(F.lit(float(r)) for r in sorted(radii))))
    else:
        own = adaptive_radii(cloud)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pid")
        points, pid = group[list(XYZ)].to_numpy(), group["pid"].to_numpy()
        faces: list[tuple[int, int, int]] = []
        used = np.zeros(len(points), dtype=bool)
        for radius in group["radii"].iloc[0]:
            cells: dict[tuple, list[int]] = {}
            for n, key in enumerate(map(tuple, np.floor(points / (2 * radius)).astype(int))):
                cells.setdefault(key, []).append(n)

            def around(p: np.ndarray, cells=cells, radius=radius) -> np.ndarray:
                x, y, z = np.floor(p / (2 * radius)).astype(int)
                found = [n for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) for n in cells.get((x + dx, y + dy, z + dz), ())]
                return np.array(sorted(found), dtype=int)

            def fitting(i: int, j: int, ks: np.ndarray, radius=radius) -> tuple[np.ndarray, np.ndarray]:
                area, score, ratio = _quality(points, i, j, ks)
                ok = (area >= min_area) & (score >= quality) & (ratio * np.sqrt(area) <= radius * edge_factor)
                return ks[ok], score[ok]

            def seed(radius=radius, around=around, fitting=fitting):
                for i in np.nonzero(~used)[0]:
                    near = around(points[i])
                    near = near[(near != i) & ~used[near] & (np.linalg.norm(points[near] - points[i], axis=1) <= 2 * radius)]
                    for j in near:
                        ks = near[(near != j) & (np.linalg.norm(points[near] - points[j], axis=1) <= 2 * radius)]
                        ks, _ = fitting(i, j, ks)
                        if len(ks):
                            return int(i), int(j), int(ks[0])
                return None

            while (start := seed()) is not None:
                grown = [start]
                used[list(start)] = True
                front = [(start[0], start[1]), (start[1], start[2]), (start[2], start[0])]
                seen: set[tuple[int, int]] = set()
                while front:
                    u, v = front.pop()
                    key = (min(u, v), max(u, v))
                    if key in seen:
                        continue
                    seen.add(key)
                    if np.linalg.norm(points[u] - points[v]) > 2 * radius:
                        continue
                    near = around((points[u] + points[v]) / 2)
                    near = near[~used[near] & (np.linalg.norm(points[near] - points[u], axis=1) <= radius) & (np.linalg.norm(points[near] - points[v], axis=1) <= radius)]
                    ks, score = fitting(u, v, near)
                    if not len(ks):
                        continue
                    w = int(ks[np.argmax(score)])
                    grown.append((v, u, w))
                    used[w] = True
                    front += [(u, w), (w, v)]
                faces += grown
        t = np.array(faces, dtype=int).reshape(-1, 3)
        return pd.DataFrame({KEY: group[KEY].iloc[0], "a": pid[t[:, 0]], "b": pid[t[:, 1]], "c": pid[t[:, 2]]})

    rows = cloud.select(KEY, "pid", *XYZ)
    grown = rows.join(own, KEY).groupBy(KEY).applyInPandas(grow, _FACE)
    if not fallback:
        return grown
    grown = scratch.written(grown, "grown")
    return grown.unionByName(delaunay(rows.join(grown.select(KEY).distinct(), KEY, "left_anti"), "auto", min_area))


# -- Poisson --------------------------------------------------------------------------------------------------------------


def poisson_grid(cloud: DataFrame, depth: int = 6, scale: float = 1.1) -> tuple[DataFrame, volumes.Lattice, float]:
    """The indicator's grid, its lattice and the level at the points, of a cloud with normals.

    Normals are spread onto the grid by weighted aggregation in the JVM; the grid of 2^depth nodes a side is solved by a fast
    Fourier transform on the driver. A depth below 3 or above ``MOST_DEPTH``, fewer than 10 points and several clouds are errors.
    """
    if not {"nx", "ny", "nz"} <= set(cloud.columns):
        raise ValueError("normals are needed")
    if not 3 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth must be between 3 and {MOST_DEPTH}, not {depth}")
    one_cloud(cloud)
    n = 2**depth
    low, high = (np.array(v) for v in volumes.cloud_box(cloud))
    if cloud.count() < 10:
        raise ValueError("at least 10 points are needed")
    middle, half = (low + high) / 2, max((high - low).max(), 1e-9) / 2 * scale * 1.25
    lattice = volumes.Lattice.around(middle - half, middle + half, (n, n, n))
    step = lattice.spacing[0]
    at = {f"f{c}": (F.col(c) - float(lattice.origin[t])) / step for t, c in enumerate(XYZ)}
    base = cloud.select(*(v.alias(k) for k, v in at.items()), "nx", "ny", "nz")
    corner = lambda b: F.struct(*((F.floor(f"f{c}") + (b >> t & 1)).cast("int").alias(volumes.IJK[t]) for t, c in enumerate(XYZ)), np.prod([(F.col(f"f{c}") - F.floor(f"f{c}")) if b >> t & 1 else (1 - F.col(f"f{c}") + F.floor(f"f{c}")) for t, c in enumerate(XYZ)]).alias("w"))
    spread = base.select("nx", "ny", "nz", F.explode(F.array(*map(corner, range(8)))).alias("s")).groupBy("s.i", "s.j", "s.k").agg(*(F.sum(F.col("s.w") * F.col(f"n{c}")).alias(f"n{c}") for c in XYZ), F.sum("s.w").alias("w"))
    rows = spread.toPandas()  # at most n cubed rows
    field, weight = np.zeros((3, n, n, n)), np.zeros((n, n, n))
    index = tuple(rows[c].to_numpy().clip(0, n - 1) for c in volumes.IJK)
    for t, c in enumerate(XYZ):
        np.add.at(field[t], index, rows[f"n{c}"].to_numpy())
    np.add.at(weight, index, rows["w"].to_numpy())
    k = np.stack(np.meshgrid(*[np.fft.fftfreq(n) * 2 * np.pi] * 3, indexing="ij"))
    smooth = np.exp(-(k**2).sum(0))
    k2 = (k**2).sum(0)
    k2[0, 0, 0] = 1
    spectrum = sum(1j * k[t] * np.fft.fftn(field[t]) * smooth for t in range(3)) / -k2
    spectrum[0, 0, 0] = 0
    chi = np.real(np.fft.ifftn(spectrum))
    level = float((chi * weight).sum() / weight.sum())
    i, j, l = (x.ravel() for x in np.indices(chi.shape))
    grid = cloud.sparkSession.createDataFrame(pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "k": l.astype("int32"), "value": chi.ravel()}))
    return grid, lattice, level


def poisson(cloud: DataFrame, depth: int = 6, scale: float = 1.1) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of the level set of the Poisson indicator through the points."""
    grid, lattice, level = poisson_grid(cloud, depth, scale)
    return volumes.triangle_mesh(volumes.isosurface(grid, lattice, level), "poisson")


# -- choosing -------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Character:
    """What the choice of an algorithm looks at; all shares lie between 0 and 1."""

    points: int
    has_normals: bool
    uniformity: float
    noise: float
    spacing: float
    flatness: float
    complexity: float = 0.0
    distribution: str = "arbitrary"
    closed: bool = False


def analyze(cloud: DataFrame) -> Character:
    """Counts, spacing, relief and shape of one cloud, as aggregates over all its points; several clouds are an error.

    ``complexity`` is three times the mean share of the least eigenvalue of neighbourhoods, ``distribution`` is planar (the
    least spread below a tenth of the greatest), spherical or cylindrical (distances to the centre, to the main axis, vary by
    less than 15 %) or arbitrary, ``closed`` tells whether points lie in all octants around the centre.
    """
    one_cloud(cloud)
    ids = scratch.written(cloud.select(KEY, F.col("pid").cast("bigint").alias("pid"), *(F.col(c).cast("double").alias(c) for c in XYZ)), "ids")
    box = bounds(ids).first()
    if box is None:
        raise ValueError("the cloud is empty")
    near = scratch.written(neighborhoods(ids, 10), "near")
    d = near.groupBy("pid").agg(F.min("distance").alias("d")).agg(F.avg("d").alias("m"), F.stddev_pop("d").alias("s")).first()
    mean, deviation = d["m"] or 0.0, d["s"] or 0.0
    own = ids.select(KEY, "pid", F.struct(*XYZ).alias("to"))
    local = near.select(KEY, "pid", "to").unionByName(own).groupBy(KEY, "pid").agg(*(F.covar_pop(f"to.{ab[0]}", f"to.{ab[1]}").alias(c) for c, ab in COVARIANCE.items()))
    total = F.col("e_min") + F.col("e_mid") + F.col("e_max")
    relief = with_eigen(local).agg(F.avg(F.try_divide(F.greatest("e_min", F.lit(0.0)), total)).alias("c")).first()["c"] or 0.0
    whole = ids.agg(*(F.avg(c).alias(c) for c in XYZ), *(F.covar_pop(*ab).alias(c) for c, ab in COVARIANCE.items())).first()
    values, vectors = np.linalg.eigh(matrices(*(np.array([whole[c]]) for c in SYMMETRIC))[0])
    at = [F.col(c) - float(whole[c]) for c in XYZ]
    along = sum((a * float(v) for a, v in zip(at, vectors[:, 2])), F.lit(0.0))
    far = F.sqrt(sum((a * a for a in at), F.lit(0.0)))
    round_ = F.sqrt(F.greatest(sum((a * a for a in at), F.lit(0.0)) - along * along, F.lit(0.0)))
    octant = sum((F.when(a > 0, 1 << t).otherwise(0) for t, a in enumerate(at)), F.lit(0))
    shape = ids.agg(*(f(v).alias(f"{n}{k}") for n, v in (("far", far), ("round", round_)) for k, f in (("m", F.avg), ("s", F.stddev_pop))), F.count_distinct(octant).alias("octants")).first()
    varies = lambda n: shape[f"{n}s"] / shape[f"{n}m"] if shape[f"{n}m"] else np.inf
    kind = "planar" if values[0] < 0.01 * values[2] else "spherical" if varies("far") < 0.15 else "cylindrical" if varies("round") < 0.15 else "arbitrary"
    extent = sorted(box[f"max_{c}"] - box[f"min_{c}"] for c in XYZ)
    spread = deviation / mean if mean > 0 else 0.0
    return Character(box["n"], "nx" in cloud.columns, 1 / (1 + spread), min(1.0, spread**2), mean, extent[0] / extent[2] if extent[2] > 0 else 0.0, min(1.0, 3 * relief), kind, kind != "planar" and shape["octants"] == 8)


@dataclass(frozen=True)
class Trait:
    """How an algorithm of this package behaves: its work, and what it bears (0 not at all, 1 fully)."""

    seconds: float  # for a thousand points
    growth: float  # exponent of the points in the work
    noise: float
    gaps: float
    sheet: float  # a flat sheet of points
    solid: float  # a closed body
    needs_normals: bool = False


#: Seconds and growth as measured on one machine (8 threads) for 500 to 4 000 points of a sphere; what is borne and served is a
#: judgement of how the algorithms work: which of them smooth, need even spacing, project to a plane or bound a volume.
TRAITS = {
    "delaunay": Trait(0.4, 0.9, 0.3, 0.9, 1.0, 0.1),
    "ball_pivoting": Trait(0.4, 0.8, 0.4, 0.3, 0.8, 0.6),
    "mls": Trait(2.8, 0.0, 0.9, 0.5, 0.6, 0.7),
    "marching_cubes": Trait(2.8, 0.0, 0.8, 0.5, 0.5, 0.7),
    "poisson": Trait(6.8, 0.0, 0.9, 0.8, 0.2, 1.0, True),
}
ALGORITHMS = tuple(TRAITS)
#: What a second more (as a power of ten) costs against a fault of the surface.
HASTE = {"fast": 0.6, "balanced": 0.15, "high": 0.03, "max": 0.0}


def choose(c: Character, quality: str = "balanced", use_case: str = "general") -> str:
    """The algorithm of least regret: its expected faults on such points plus its time, weighed by the quality asked for.

    Faults: noise and gaps beyond what it bears, and the distance between the cloud's shape, from a sheet to a closed body, and
    those it serves. ``use_case`` doubles what matters there: ``engineering`` gaps, ``organic`` and ``noisy`` noise,
    ``prototyping`` time. Ties go to the first in ``ALGORITHMS``.
    """
    if quality not in HASTE:
        raise ValueError(f"unknown quality {quality}")
    body = 0.0 if c.distribution == "planar" else 1.0 if c.closed or c.distribution == "spherical" else min(1.0, 2 * c.flatness)
    noise = max(c.noise, c.complexity / 2)
    double = lambda *cases: 2.0 if use_case in cases else 1.0

    def regret(t: Trait) -> float:
        serves = (1 - body) * t.sheet + body * t.solid
        faults = double("organic", "noisy") * noise * (1 - t.noise) + double("engineering") * (1 - c.uniformity) * (1 - t.gaps) + (1 - serves)
        time = np.log10(1 + t.seconds * (max(1, c.points) / 1000) ** t.growth)
        return faults + double("prototyping") * HASTE[quality] * time

    return min((n for n, t in TRAITS.items() if c.has_normals or not t.needs_normals), key=lambda n: round(regret(TRAITS[n]), 9))


def reconstruct(cloud: DataFrame, quality: str = "balanced", use_case: str = "general", preferred: str | None = None, fallbacks: tuple[str, ...] = ("delaunay", "ball_pivoting", "mls")) -> tuple[str, DataFrame, DataFrame]:
    """(algorithm, vertices, faces): the preferred or best suited algorithm, else the first fallback that gives faces."""
    about = analyze(cloud)
    tried = [preferred or choose(about, quality, use_case)]
    tried += [f for f in fallbacks if f not in tried]
    own = cloud.select(F.col(KEY).alias("mesh_id"), F.col("pid").alias("vid"), *XYZ)
    problems = []
    for name in tried:
        try:
            if name == "delaunay":
                vertices, faces = own, delaunay(cloud, "auto")
            elif name == "ball_pivoting":
                vertices, faces = own, ball_pivoting(cloud, None)
            elif name == "poisson":
                vertices, faces = poisson(cloud)
            elif name in ("mls", "marching_cubes"):
                normal = cloud if about.has_normals else estimate_normals(cloud, 10)
                vertices, faces = volumes.mls_surface(normal, max(about.spacing * 3, 1e-9))
            else:
                raise ValueError(f"unknown algorithm {name}")
            if name in ("delaunay", "ball_pivoting"):
                faces = ranked(faces.select(F.col(KEY).alias("mesh_id"), *"abc"), ["mesh_id", *"abc"], "fid").select("mesh_id", "fid", *"abc")
            faces = scratch.written(faces, "faces")
            if not faces.isEmpty():
                return name, vertices, faces
            problems.append(f"{name}: no faces")
        except ValueError as e:
            problems.append(f"{name}: {e}")
    raise ValueError("no algorithm gave a surface: " + "; ".join(problems))
