"""Meshes as two tables: topology by edge joins, attributes by aggregates, smoothing by rounds of both.

Vertices are ``(mesh_id, vid, x, y, z, ...)``, faces ``(mesh_id, fid, a, b, c)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.functions.geometry import XYZ, cross, dot, norm, sub, unit, vec
from pointlake.plans import scratch

KEY = "mesh_id"


def corners(faces: DataFrame) -> DataFrame:
    """``(mesh_id, fid, corner, vid)``: one row per corner of a face."""
    return faces.select(KEY, "fid", F.posexplode(F.array("a", "b", "c")).alias("corner", "vid"))


def with_points(vertices: DataFrame, faces: DataFrame, columns: tuple[str, ...] = XYZ) -> DataFrame:
    """Faces with their corners' columns as ``a_x .. c_z``: one shuffle of corners instead of three joins of faces."""
    at = corners(faces).join(vertices.select(KEY, "vid", F.struct(*columns).alias("p")), [KEY, "vid"])
    rows = at.groupBy(KEY, "fid").agg(*(F.max(F.when(F.col("corner") == i, F.col("vid"))).alias(n) for i, n in enumerate("abc")), *(F.first(F.when(F.col("corner") == i, F.col("p")), ignorenulls=True).alias(f"p{n}") for i, n in enumerate("abc")))
    return rows.select(KEY, "fid", *"abc", *(F.col(f"p{n}.{c}").alias(f"{n}_{c}") for n in "abc" for c in columns))


def _area_vector() -> tuple[Column, Column, Column]:
    a, b, c = (vec(*(f"{n}_{x}" for x in XYZ)) for n in "abc")
    return cross(sub(b, a), sub(c, a))


def face_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """``(mesh_id, fid, nx, ny, nz)``: unit normals, null for faces without area."""
    flat = with_points(vertices, faces).select(KEY, "fid", *(c.alias(f"r{x}") for x, c in zip(XYZ, _area_vector())))
    return flat.select(KEY, "fid", *(c.alias(f"n{x}") for x, c in zip(XYZ, unit(vec("rx", "ry", "rz")))))


def edges(faces: DataFrame) -> DataFrame:
    """``(mesh_id, fid, u, v)``: the three directed edges of every face."""
    sides = F.array(*(F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in ("ab", "bc", "ca")))
    return faces.select(KEY, "fid", F.explode(sides).alias("e")).select(KEY, "fid", "e.u", "e.v")


def _undirected(faces: DataFrame) -> DataFrame:
    return edges(faces).select(KEY, "fid", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def adjacency(faces: DataFrame) -> DataFrame:
    """``(mesh_id, vid, neighbor)``: each vertex with those it shares an edge with, once."""
    e = edges(faces)
    return e.select(KEY, F.col("u").alias("vid"), F.col("v").alias("neighbor")).unionAll(e.select(KEY, "v", "u")).distinct()


def twins(faces: DataFrame) -> DataFrame:
    """``(mesh_id, fid, u, v, twin)``: directed edges with the face on their other side, null at boundaries."""
    e = edges(faces)
    other = e.select(KEY, F.col("fid").alias("twin"), F.col("v").alias("u"), F.col("u").alias("v"))
    return e.join(other, [KEY, "u", "v"], "left").select(KEY, "fid", "u", "v", "twin")


def boundary_edges(faces: DataFrame) -> DataFrame:
    """``(mesh_id, u, v)``, u < v: edges of one face only."""
    return _undirected(faces).groupBy(KEY, "u", "v").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(KEY, "u", "v")


def boundary_vertices(faces: DataFrame) -> DataFrame:
    """``(mesh_id, vid)`` of boundary edges."""
    return boundary_edges(faces).select(KEY, F.explode(F.array("u", "v")).alias("vid")).distinct()


def feature_vertices(vertices: DataFrame, faces: DataFrame, angle: float) -> DataFrame:
    """``(mesh_id, vid)`` of edges whose two faces meet at more than ``angle`` radians; faces without area point up."""
    up = [F.coalesce(f"n{x}", F.lit(1.0 if x == "z" else 0.0)).alias(f"n{x}") for x in XYZ]
    sided = _undirected(faces).join(face_normals(vertices, faces).select(KEY, "fid", F.struct(*up).alias("n")), [KEY, "fid"])
    pairs = sided.groupBy(KEY, "u", "v").agg(F.count(F.lit(1)).alias("k"), F.min_by("n", "fid").alias("p"), F.max_by("n", "fid").alias("q")).where("k = 2")
    turn = dot(vec("p.nx", "p.ny", "p.nz"), vec("q.nx", "q.ny", "q.nz"))
    return pairs.where(turn < F.cos(F.lit(angle))).select(KEY, F.explode(F.array("u", "v")).alias("vid")).distinct()


def valence(faces: DataFrame) -> DataFrame:
    """``(mesh_id, vid, valence)``: faces at each vertex that has any."""
    return corners(faces).groupBy(KEY, "vid").agg(F.count(F.lit(1)).alias("valence"))


#: Names of the ten entries of a symmetric 4x4 quadric.
QUADRIC = tuple(f"q{a}{b}" for i, a in enumerate("abcd") for b in "abcd"[i:])


def vertex_quadrics(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """``(mesh_id, vid, qaa .. qdd)``: sums of the outer products of the planes at each vertex; no area counts as plane z = 0."""
    flat = with_points(vertices, faces).withColumns({f"r{x}": c for x, c in zip(XYZ, _area_vector())})
    n = unit(vec("rx", "ry", "rz"))
    flat = flat.withColumns({"pa": n[0], "pb": n[1], "pc": n[2]})
    bad = F.col("pa").isNull()
    d = -(F.col("pa") * F.col("a_x") + F.col("pb") * F.col("a_y") + F.col("pc") * F.col("a_z"))
    planes = flat.select(KEY, F.explode(F.array("a", "b", "c")).alias("vid"), *(F.when(bad, F.lit(v)).otherwise(c).alias(f"p{k}") for k, c, v in (("a", F.col("pa"), 0.0), ("b", F.col("pb"), 0.0), ("c", F.col("pc"), 1.0), ("d", d, 0.0))))
    return planes.groupBy(KEY, "vid").agg(*(F.sum(F.col(f"p{q[1]}") * F.col(f"p{q[2]}")).alias(q) for q in QUADRIC))


def vertex_normals(vertices: DataFrame, faces: DataFrame, smooth: bool = True, normalize: bool = True) -> DataFrame:
    """``(mesh_id, vid, nx, ny, nz)``: area-weighted sums of face normals, or the last face's where not ``smooth``.

    Vertices without faces, and without a direction where ``normalize``, get zeros.
    """
    flat = with_points(vertices, faces).select(KEY, "fid", *"abc", *(c.alias(f"r{x}") for x, c in zip(XYZ, _area_vector())))
    at = flat.select(KEY, "fid", F.explode(F.array("a", "b", "c")).alias("vid"), F.struct("rx", "ry", "rz").alias("r"))
    if smooth:
        total = at.groupBy(KEY, "vid").agg(*(F.sum(f"r.r{x}").alias(f"r{x}") for x in XYZ))
    else:
        total = at.groupBy(KEY, "vid").agg(F.max_by("r", "fid").alias("r")).select(KEY, "vid", "r.*")
    full = vertices.select(KEY, "vid").join(total, [KEY, "vid"], "left")
    r = vec("rx", "ry", "rz")
    return full.select(KEY, "vid", *(F.coalesce(c, F.lit(0.0)).alias(f"n{x}") for x, c in zip(XYZ, unit(r) if normalize else r)))


def default_uvs(vertices: DataFrame) -> DataFrame:
    """Vertices with ``u, v``: x and y over the mesh's box, 0.5 where the box has no extent."""
    box = vertices.groupBy(KEY).agg(*(f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xy"))
    at = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0))), F.lit(0.5))
    return vertices.join(box, KEY).withColumns({"u": at("x"), "v": at("y")}).drop("lo_x", "hi_x", "lo_y", "hi_y")


def tangents(vertices: DataFrame, faces: DataFrame, normals: DataFrame) -> DataFrame:
    """``(mesh_id, vid, tx, ty, tz, handedness)`` from ``u, v`` of the vertices: summed per face, made orthogonal to the normal."""
    f = with_points(vertices, faces, (*XYZ, "u", "v"))
    p = {n: vec(*(f"{n}_{x}" for x in XYZ)) for n in "abc"}
    e1, e2 = sub(p["b"], p["a"]), sub(p["c"], p["a"])
    du1, dv1, du2, dv2 = F.col("b_u") - F.col("a_u"), F.col("b_v") - F.col("a_v"), F.col("c_u") - F.col("a_u"), F.col("c_v") - F.col("a_v")
    det = du1 * dv2 - du2 * dv1
    r = F.when(F.abs(det) > 1e-12, F.try_divide(F.lit(1.0), det)).otherwise(0.0)
    t = [(a * dv2 - b * dv1) * r for a, b in zip(e1, e2)]
    s = [(b * du1 - a * du2) * r for a, b in zip(e1, e2)]
    at = f.select(KEY, F.explode(F.array("a", "b", "c")).alias("vid"), *(c.alias(f"t{x}") for x, c in zip(XYZ, t)), *(c.alias(f"s{x}") for x, c in zip(XYZ, s)))
    total = at.groupBy(KEY, "vid").agg(*(F.sum(f"{k}{x}").alias(f"{k}{x}") for k in "ts" for x in XYZ)).join(normals.select(KEY, "vid", "nx", "ny", "nz"), [KEY, "vid"])
    n, tv = vec("nx", "ny", "nz"), vec("tx", "ty", "tz")
    along = dot(n, tv)
    flat = total.withColumns({f"o{x}": c - k * along for x, c, k in zip(XYZ, tv, n)})
    o = unit(vec("ox", "oy", "oz"))
    hand = F.when(dot(cross(n, tv), vec("sx", "sy", "sz")) < 0, -1.0).otherwise(1.0)
    return flat.select(KEY, "vid", *(F.coalesce(c, F.lit(1.0 if x == "x" else 0.0)).alias(f"t{x}") for x, c in zip(XYZ, o)), hand.alias("handedness"))


def completeness(vertices: DataFrame) -> DataFrame:
    """``(mesh_id, vertices, with_normals, with_uvs, with_tangents, with_colors, score)``: the share of attributes present."""
    groups = {"normals": ("nx", "ny", "nz"), "uvs": ("u", "v"), "tangents": ("tx", "ty", "tz"), "colors": ("r", "g", "b")}
    have = {k: all(c in vertices.columns for c in cs) for k, cs in groups.items()}
    present = lambda k: F.count_if(F.coalesce(*(F.col(c).cast("double") for c in groups[k])).isNotNull()) if have[k] else F.count_if(F.lit(False))
    out = vertices.groupBy(KEY).agg(F.count(F.lit(1)).alias("vertices"), *(present(k).alias(f"with_{k}") for k in groups))
    return out.withColumn("score", sum((F.col(f"with_{k}") / F.col("vertices") for k in groups), F.lit(0.0)) / len(groups))


def invalid_faces(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """``(mesh_id, fid, problem)``: faces with a missing vertex (``missing``) or a repeated one (``repeated``)."""
    lost = corners(faces).join(vertices.select(KEY, "vid"), [KEY, "vid"], "left_anti").select(KEY, "fid", F.lit("missing").alias("problem"))
    same = faces.where("a = b OR b = c OR c = a").select(KEY, "fid", F.lit("repeated").alias("problem"))
    return lost.unionAll(same).distinct()


def compare_meshes(left: DataFrame, right: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """``(mesh_id, vid, difference)``: vertices missing on a side, or with a shared number column further apart than the tolerance."""
    shared = [c for c, t in left.dtypes if c not in (KEY, "vid") and c in right.columns and t in ("double", "float", "int", "bigint", "smallint")]
    both = left.select(KEY, "vid", F.struct(*shared).alias("l")).join(right.select(KEY, "vid", F.struct(*shared).alias("r")), [KEY, "vid"], "full_outer")
    far = F.array_compact(F.array(*(F.when(F.abs(F.col(f"l.{c}") - F.col(f"r.{c}")) > tolerance, c) for c in shared)))
    said = F.when(F.col("l").isNull(), "only right").when(F.col("r").isNull(), "only left").when(F.size(far) > 0, F.array_join(far, ","))
    return both.select(KEY, "vid", said.alias("difference")).where("difference IS NOT NULL")


# -- smoothing ------------------------------------------------------------------------------------------------------------


def _means(values: DataFrame, links: DataFrame, names: tuple[str, ...] = XYZ) -> DataFrame:
    """Mean of the neighbours' values of each vertex that has neighbours, as ``m_x ..``."""
    lent = links.join(values.select(KEY, F.col("vid").alias("neighbor"), *names), [KEY, "neighbor"])
    return lent.groupBy(KEY, "vid").agg(*(F.avg(c).alias(f"m_{c}") for c in names))


def _rounds(vertices: DataFrame, faces: DataFrame, iterations: int, step: Callable[[DataFrame, DataFrame], DataFrame], every: int = 4) -> DataFrame:
    if iterations < 0:
        raise ValueError("iterations must not be negative")
    now = vertices.select(KEY, "vid", *XYZ)
    if iterations == 0:
        return now
    links = scratch.written(adjacency(faces), "links")
    for turn in range(iterations):
        now = step(now, links)
        if (turn + 1) % every == 0 and turn + 1 < iterations:
            now = scratch.written(now, "smooth")  # keeps plans short
    return now


def _laplacian_step(now: DataFrame, links: DataFrame, factor: float) -> DataFrame:
    moved = now.join(_means(now, links), [KEY, "vid"], "left")
    return moved.select(KEY, "vid", *((F.col(c) + F.coalesce(F.col(f"m_{c}") - F.col(c), F.lit(0.0)) * factor).alias(c) for c in XYZ))


def smooth_laplacian(vertices: DataFrame, faces: DataFrame, iterations: int = 10, factor: float = 0.5) -> DataFrame:
    """Vertices moved towards the mean of their neighbours; those without neighbours stay, other columns are dropped."""
    if not 0 < factor <= 1:
        raise ValueError("factor must be above 0 and at most 1")
    return _rounds(vertices, faces, iterations, lambda now, links: _laplacian_step(now, links, factor))


def smooth_taubin(vertices: DataFrame, faces: DataFrame, iterations: int = 10, factor: float = 0.5, back: float = -0.53) -> DataFrame:
    """A step towards the mean and a longer one back, so that the mesh does not shrink; -back must exceed factor."""
    if not 0 < factor <= 1 or not back < 0 or -back <= factor:
        raise ValueError("factor must be in (0, 1] and back below -factor")
    return _rounds(vertices, faces, iterations, lambda now, links: _laplacian_step(_laplacian_step(now, links, factor), links, back), every=2)


def smooth_hc(vertices: DataFrame, faces: DataFrame, iterations: int = 10, alpha: float = 0.0, beta: float = 0.5) -> DataFrame:
    """Means corrected by the neighbourhood's mean shift from a blend of the original and the last position."""
    if not 0 <= alpha <= 1 or not 0 <= beta <= 1:
        raise ValueError("alpha and beta must be between 0 and 1")
    first = vertices.select(KEY, "vid", *(F.col(c).alias(f"p_{c}") for c in XYZ))

    def step(now: DataFrame, links: DataFrame) -> DataFrame:
        mean = now.join(_means(now, links), [KEY, "vid"], "left").join(first, [KEY, "vid"])
        mean = mean.select(KEY, "vid", *(F.coalesce(f"m_{c}", c).alias(f"q_{c}") for c in XYZ), *((F.coalesce(f"m_{c}", c) - (F.col(f"p_{c}") * alpha + F.col(c) * (1 - alpha))).alias(f"b_{c}") for c in XYZ))
        lent = _means(mean, links, tuple(f"b_{c}" for c in XYZ))
        full = mean.join(lent, [KEY, "vid"], "left")
        return full.select(KEY, "vid", *((F.col(f"q_{c}") - (F.col(f"b_{c}") * beta + F.coalesce(f"m_b_{c}", F.lit(0.0)) * (1 - beta))).alias(c) for c in XYZ))

    return _rounds(vertices, faces, iterations, step, every=2)


# -- simplification by clustering -----------------------------------------------------------------------------------------


def _classed(vertices: DataFrame, faces: DataFrame, preserve_boundary: bool, feature_angle: float) -> DataFrame:
    """Vertices with ``class``: 1 at the boundary, 2 at features, else 0."""
    rim = boundary_vertices(faces).withColumn("rim", F.lit(True))
    crease = feature_vertices(vertices, faces, feature_angle).withColumn("crease", F.lit(True))
    out = vertices.join(rim, [KEY, "vid"], "left").join(crease, [KEY, "vid"], "left")
    kind = F.when(F.lit(preserve_boundary) & F.coalesce("rim", F.lit(False)), 1).when(F.coalesce("crease", F.lit(False)), 2).otherwise(0)
    return out.withColumn("class", kind).drop("rim", "crease")


def cell_size(vertices: DataFrame, ratio: float) -> DataFrame:
    """``(mesh_id, lo_x .. lo_z, edge)``: the cell that leaves about (1 - ratio) of the vertices, over extents above 1e-6."""
    box = vertices.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{k}_{c}") for k, f in (("lo", F.min), ("hi", F.max)) for c in XYZ))
    extents = F.filter(F.array(*(F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in XYZ)), lambda e: e > 1e-6)
    target = F.greatest(F.col("n") * (1 - ratio), F.lit(1.0))
    edge = F.when(F.size(extents) == 0, 1.0).otherwise(F.pow(F.aggregate(extents, F.lit(1.0), lambda a, e: a * e) / target, F.try_divide(F.lit(1.0), F.size(extents))))
    return box.select(KEY, *(f"lo_{c}" for c in XYZ), edge.alias("edge"))


def simplify_clustering(vertices: DataFrame, faces: DataFrame, ratio: float, representative: str = "centroid", preserve_boundary: bool = True, feature_angle: float = 0.7853981633974483, clusters: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces after merging the vertices of a grid cell, boundary, feature and inner ones apart.

    ``representative`` is ``centroid``, ``valence`` (weighted by it) or ``error`` (least quadric error, else the centroid).
    A merged vertex keeps its smallest member's id. Faces that lose a corner go, of equal ones the first by fid stays. A ratio
    of 0 returns the mesh as it is. ``clusters`` may give other groups as ``(mesh_id, vid, cluster)``.
    """
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must be between 0 and 1")
    if representative not in ("centroid", "valence", "error"):
        raise ValueError("representative must be centroid, valence or error")
    points = vertices.select(KEY, "vid", *XYZ)
    if ratio == 0:
        return points, faces.select(KEY, "fid", "a", "b", "c")
    if clusters is None:
        grid = _classed(points, faces, preserve_boundary, feature_angle).join(cell_size(points, ratio), KEY)
        cells = [F.floor((F.col(c) - F.col(f"lo_{c}")) / F.col("edge")).alias(f"i{c}") for c in XYZ]
        groups = grid.select(KEY, "vid", *cells, "class")
        names = [KEY, "ix", "iy", "iz", "class"]
        heads = groups.groupBy(*names).agg(F.min("vid").alias("cluster"))
        clusters = groups.join(heads, names).select(KEY, "vid", "cluster")
    clusters = scratch.written(clusters, "clusters")
    members = points.join(clusters, [KEY, "vid"])
    if representative == "valence":
        weighed = members.join(valence(faces), [KEY, "vid"], "left").withColumn("w", F.greatest(F.coalesce("valence", F.lit(1)), F.lit(1)))
        merged = weighed.groupBy(KEY, "cluster").agg(*((F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in XYZ))
    else:
        merged = members.groupBy(KEY, "cluster").agg(*(F.avg(c).alias(c) for c in XYZ))
        if representative == "error":
            total = clusters.join(vertex_quadrics(vertices, faces), [KEY, "vid"]).groupBy(KEY, "cluster").agg(*(F.sum(q).alias(q) for q in QUADRIC))
            several = members.groupBy(KEY, "cluster").agg((F.count(F.lit(1)) > 1).alias("several"))
            best = _least_error(total.join(several, [KEY, "cluster"]).where("several"))
            merged = merged.join(best, [KEY, "cluster"], "left").select(KEY, "cluster", *(F.coalesce(f"o_{c}", c).alias(c) for c in XYZ))
    new = corners(faces).join(clusters, [KEY, "vid"]).groupBy(KEY, "fid").agg(*(F.max(F.when(F.col("corner") == i, F.col("cluster"))).alias(n) for i, n in enumerate("abc")))
    whole = new.where("a <> b AND b <> c AND c <> a").withColumn("s", F.array_sort(F.array("a", "b", "c")))
    kept = whole.groupBy(KEY, "s").agg(F.min_by(F.struct("fid", "a", "b", "c"), "fid").alias("f")).select(KEY, "f.*")
    kept = scratch.written(kept, "faces")
    used = kept.select(KEY, F.explode(F.array("a", "b", "c")).alias("cluster")).distinct()
    return merged.join(used, [KEY, "cluster"], "left_semi").select(KEY, F.col("cluster").alias("vid"), *XYZ), kept


def _least_error(total: DataFrame) -> DataFrame:
    """The place of least error of summed quadrics by Cramer's rule, null where the matrix has no inverse."""
    q = {n: F.col(n) for n in QUADRIC}
    a, b, c, e, f, i = q["qaa"], q["qab"], q["qac"], q["qbb"], q["qbc"], q["qcc"]
    x, y, z = -q["qad"], -q["qbd"], -q["qcd"]
    det = a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c)
    solved = (x * (e * i - f * f) - b * (y * i - f * z) + c * (y * f - e * z), a * (y * i - f * z) - x * (b * i - f * c) + c * (b * z - y * c), a * (e * z - y * f) - b * (b * z - y * c) + x * (b * f - e * c))
    ok = F.abs(det) > 1e-12
    return total.select(KEY, "cluster", *(F.when(ok, F.try_divide(s, det)).alias(f"o_{n}") for n, s in zip(XYZ, solved)))


def octree_clusters(vertices: DataFrame, faces: DataFrame, max_depth: int = 6, error_threshold: float = 1e-3, preserve_boundary: bool = True, feature_angle: float = 0.7853981633974483) -> DataFrame:
    """``(mesh_id, vid, cluster)`` for :func:`simplify_clustering`: cells halve until their quadric error is small.

    Level by level: all cells of a level are aggregated at once, those whose vertices' quadrics at the centroid sum to more
    than the threshold (and hold more than one) pass their vertices to the next level. Boundary and feature vertices are
    grouped by the finest cells, apart from the others.
    """
    points = _classed(vertices.select(KEY, "vid", *XYZ), faces, preserve_boundary, feature_angle)
    box = points.groupBy(KEY).agg(*(F.min(c).alias(f"lo_{c}") for c in XYZ), F.greatest(*(F.max(c) - F.min(c) for c in XYZ), F.lit(1e-6)).alias("extent"))
    zero = [F.coalesce(q, F.lit(0.0)).alias(q) for q in QUADRIC]
    rows = points.join(vertex_quadrics(vertices, faces), [KEY, "vid"], "left").join(box, KEY)
    rows = scratch.written(rows.select(KEY, "vid", *XYZ, "class", "extent", *(f"lo_{c}" for c in XYZ), *zero), "octree")
    cells = lambda level: [F.floor((F.col(c) - F.col(f"lo_{c}")) / (F.col("extent") * 1.0001 / 2**level)).alias(f"i{c}") for c in XYZ]
    names = [KEY, "ix", "iy", "iz", "class"]

    def closed(part: DataFrame) -> DataFrame:
        return part.join(part.groupBy(*names).agg(F.min("vid").alias("cluster")), names).select(KEY, "vid", "cluster")

    out = closed(rows.where("class > 0").select("*", *cells(min(max_depth, 6))))
    active = rows.where("class = 0")
    for level in range(max_depth + 1):
        part = active.select("*", *cells(level))
        if level == max_depth:
            return out.unionByName(closed(part))
        center = part.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m_{c}") for c in XYZ), *(F.sum(q).alias(f"s_{q}") for q in QUADRIC))
        m = {"a": F.col("m_x"), "b": F.col("m_y"), "c": F.col("m_z"), "d": F.lit(1.0)}
        error = sum((F.col(f"s_{q}") * m[q[1]] * m[q[2]] * (1 if q[1] == q[2] else 2) for q in QUADRIC), F.lit(0.0))
        split = center.where((F.col("n") > 1) & (error > error_threshold)).select(*names)
        out = scratch.written(out.unionByName(closed(part.join(split, names, "left_anti"))), "closed")
        active = scratch.written(part.join(split, names, "left_semi").drop("ix", "iy", "iz"), "open")
        if active.isEmpty():
            return out
    return out
