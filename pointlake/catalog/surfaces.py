"""Queries on images, grids, surfaces, simplification and registration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.catalog.clouds import EMBEDDINGS, POSE, SCANS, embeddings, image, moved, oriented, r6, rounded, scans
from pointlake.catalog.meshes import SIDE, grid_faces, grid_vertices
from pointlake.operators import mesh, normals, registration, simplify, surfaces, transforms, volumes

XYZ = ("x", "y", "z")
WIDTH, HEIGHT = 64, 48
CAMERA = volumes.Camera(60.0, 58.0, 31.5, 23.5, WIDTH, HEIGHT)
#: The embeddings' cloud lies before this camera.
VIEW = transforms.translation(0.0, 0.0, 1.0)
SPHERE = volumes.Lattice.around((-1, -1, -1), (1, 1, 1), (24, 24, 24))
BLOCK = volumes.Lattice((-0.5, -0.4, 0.6), (0.05, 0.05, 0.05), (20, 16, 20))


def depth_image(spark: SparkSession) -> DataFrame:
    """A generated depth image in millimetres, every seventeenth pixel without depth."""
    row, col = F.floor(F.col("id") / WIDTH).cast("int"), (F.col("id") % WIDTH).cast("int")
    d = F.when(F.col("id") % 17 == 0, 0).otherwise(1000 + (row * 7 + col * 13) % 500).cast("int")
    return spark.range(WIDTH * HEIGHT).select(row.alias("row"), col.alias("col"), d.alias("d"))


def color_image(spark: SparkSession) -> DataFrame:
    v, u = F.floor(F.col("id") / WIDTH).cast("int"), (F.col("id") % WIDTH).cast("int")
    return spark.range(WIDTH * HEIGHT).select(u.alias("u"), v.alias("v"), (u * 3 % 256).alias("r"), (v * 5 % 256).alias("g"), ((u + v) % 256).alias("b"))


def _metres(s: SparkSession) -> DataFrame:
    return depth_image(s).select("row", "col", (F.col("d") / 1000).alias("d"))


def _fused(s: SparkSession) -> DataFrame:
    colors = color_image(s).withColumnsRenamed({"u": "col", "v": "row"})
    first = volumes.tsdf_integrate(volumes.tsdf_volume(s, BLOCK), BLOCK, _metres(s), CAMERA, np.eye(4), 0.2, color=colors)
    return volumes.tsdf_integrate(first, BLOCK, _metres(s).select("row", "col", F.when(F.col("d") > 0, F.col("d") + 0.02).alias("d")), CAMERA, np.eye(4), 0.2, color=colors)


DEPTH = f"(SELECT CAST(id // {WIDTH} AS INT) AS row, CAST(id % {WIDTH} AS INT) AS col, CAST(CASE WHEN id % 17 = 0 THEN 0 ELSE 1000 + ((id // {WIDTH}) * 7 + (id % {WIDTH}) * 13) % 500 END AS INT) AS d FROM range({WIDTH * HEIGHT}) q(id))"
PIXELS = f"(SELECT u, v, (u * 3) % 256 AS r, (v * 5) % 256 AS g, (u + v) % 256 AS b FROM (SELECT id % {WIDTH} AS u, id // {WIDTH} AS v FROM range({WIDTH * HEIGHT}) q(id)))"


def _nodes(lattice: volumes.Lattice) -> str:
    nx, ny, nz = lattice.dims
    place = ", ".join(f"{a} * {lattice.spacing[t]!r}::DOUBLE + ({lattice.origin[t]!r}::DOUBLE) AS {x}" for t, (a, x) in enumerate(zip("ijk", XYZ)))
    return f"(SELECT *, {place} FROM (SELECT CAST(id // {ny * nz} AS INT) AS i, CAST((id % {ny * nz}) // {nz} AS INT) AS j, CAST(id % {nz} AS INT) AS k FROM range({nx * ny * nz}) q(id)))"


def _colorize_sql(view: np.ndarray = VIEW) -> str:
    c = CAMERA
    at = f"(SELECT cloud_id, pid, x / z * {c.fx}::DOUBLE + {c.cx}::DOUBLE AS u, y / z * {c.fy}::DOUBLE + {c.cy}::DOUBLE AS v FROM {moved(EMBEDDINGS, view)} WHERE z >= 1e-4)"
    inner = f"floor(u) >= 0 AND floor(v) >= 0 AND floor(u) + 1 < {c.width} AND floor(v) + 1 < {c.height}"
    corner = lambda du, dv: f"SELECT cloud_id, pid, floor(u) + {du} AS u, floor(v) + {dv} AS v, {'u - floor(u)' if du else '(1 - u + floor(u))'} * {'(v - floor(v))' if dv else '(1 - v + floor(v))'} AS w FROM p WHERE {inner}"
    asked = " UNION ALL ".join([corner(du, dv).replace("u - floor(u) *", "(u - floor(u)) *") for du in (0, 1) for dv in (0, 1)] + [f"SELECT cloud_id, pid, floor(u + 0.5::DOUBLE), floor(v + 0.5::DOUBLE), 1.0::DOUBLE FROM p WHERE NOT ({inner})"])
    return f"""WITH p AS (SELECT * FROM {at}), a AS ({asked}),
s AS (SELECT a.cloud_id, a.pid, sum(w * r) AS r, sum(w * g) AS g, sum(w * b) AS b FROM a JOIN {PIXELS} i ON a.u = i.u AND a.v = i.v GROUP BY a.cloud_id, a.pid),
f AS (SELECT cloud_id, pid, CAST(floor(r + 0.5::DOUBLE) AS INT) AS r, CAST(floor(g + 0.5::DOUBLE) AS INT) AS g, CAST(floor(b + 0.5::DOUBLE) AS INT) AS b FROM s),
o AS (SELECT c.cloud_id, c.pid, coalesce(f.r, 128) AS r, coalesce(f.g, 128) AS g, coalesce(f.b, 128) AS b FROM {EMBEDDINGS} c LEFT JOIN f ON c.pid = f.pid)
SELECT *, NOT (r = 128 AND g = 128 AND b = 128) AS is_colored FROM o"""


def _tsdf_sql() -> str:
    c = CAMERA
    return f"""(WITH n AS (SELECT *, x / z * {c.fx}::DOUBLE + {c.cx}::DOUBLE AS u, y / z * {c.fy}::DOUBLE + {c.cy}::DOUBLE AS v FROM {_nodes(BLOCK)}),
h AS (SELECT n.i, n.j, n.k, n.z, d.d / 1000.0::DOUBLE AS d, p.r, p.g, p.b FROM n LEFT JOIN {DEPTH} d ON d.col = floor(n.u + 0.5::DOUBLE) AND d.row = floor(n.v + 0.5::DOUBLE) AND d.d > 0 LEFT JOIN {PIXELS} p ON p.u = d.col AND p.v = d.row),
s AS (SELECT *, greatest(least(d - z, 0.2::DOUBLE), -0.2::DOUBLE) AS one, greatest(least(d + 0.02::DOUBLE - z, 0.2::DOUBLE), -0.2::DOUBLE) AS two FROM h)
SELECT i, j, k, CASE WHEN d IS NULL THEN 0 ELSE 0.5::DOUBLE * one + 0.5::DOUBLE * two END AS tsdf, CASE WHEN d IS NULL THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
  CAST(coalesce(r, 0) AS INT) AS r, CAST(coalesce(g, 0) AS INT) AS g, CAST(coalesce(b, 0) AS INT) AS b FROM s)"""


def _tsdf_surface_sql() -> str:
    v = _tsdf_sql()
    joins = " ".join(f"JOIN t c{n} ON c{n}.i = c0.i + {n & 1} AND c{n}.j = c0.j + {n >> 1 & 1} AND c{n}.k = c0.k + {n >> 2 & 1}" for n in range(1, 8))
    parts = []
    for e, (a, b) in enumerate(volumes.EDGES):
        t = "CASE WHEN abs(va - vb) < 1e-5 THEN 0.5::DOUBLE ELSE greatest(least(va / (va - vb), 1), 0) END"
        place = ", ".join(r6(f"({n} + {a >> x & 1}{f' + {t}' if (a ^ b) >> x & 1 else ''}) * {BLOCK.spacing[x]!r}::DOUBLE + ({BLOCK.origin[x]!r}::DOUBLE)", c) for x, (n, c) in enumerate(zip("ijk", XYZ)))
        parts.append(f"SELECT i, j, k, {e} AS edge, {place}, r, g, b FROM (SELECT *, v{a} AS va, v{b} AS vb FROM q) WHERE va * vb <= 0")
    return f"WITH t AS (SELECT * FROM {v}), q AS (SELECT c0.*, c0.tsdf AS v0, {', '.join(f'c{n}.tsdf AS v{n}' for n in range(1, 8))} FROM t c0 {joins} WHERE c0.weight >= 0.001) " + " UNION ALL ".join(parts)


def _cube_sql() -> str:
    joins = " ".join(f"JOIN g c{n} ON c{n}.i = c0.i + {n & 1} AND c{n}.j = c0.j + {n >> 1 & 1} AND c{n}.k = c0.k + {n >> 2 & 1}" for n in range(1, 8))
    index = " + ".join(f"CASE WHEN c{n}.value < 0 THEN {1 << n} ELSE 0 END" for n in range(8))
    return f"WITH g AS (SELECT i, j, k, sqrt(x * x + y * y + z * z) - 0.7::DOUBLE AS value FROM {_nodes(SPHERE)}) SELECT c0.i, c0.j, c0.k, CAST({index} AS INT) AS cube_index FROM g c0 {joins}"


ALPHA = 0.06


def _alpha_sql(mode: str = "full") -> str:
    d2 = lambda a, b: f"(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y) + ({a}.z - {b}.z) * ({a}.z - {b}.z))"
    kept = {"full": f"circumradius <= {ALPHA}::DOUBLE", "boundary": f"circumradius <= {ALPHA}::DOUBLE AND l.a IS NOT NULL", "adaptive": f"circumradius <= coalesce(m.loc, {ALPHA}::DOUBLE)"}[mode]
    local = f"""g AS (SELECT k.a, k.b, k.c, sqrt((k.mx - p.x) * (k.mx - p.x) + (k.my - p.y) * (k.my - p.y) + (k.mz - p.z) * (k.mz - p.z)) AS d FROM k JOIN p ON abs(k.mx - p.x) < 3 * {ALPHA}::DOUBLE),
m AS (SELECT a, b, c, list_sort(list(d))[CAST(floor(count(*) / 2) AS INT) + 1] * 1.8::DOUBLE AS loc FROM g WHERE d > 0 AND d * d < {ALPHA}::DOUBLE * 3 * ({ALPHA}::DOUBLE * 3) GROUP BY a, b, c),""" if mode == "adaptive" else ""
    return f"""WITH p AS MATERIALIZED (SELECT * FROM {EMBEDDINGS}),
n AS MATERIALIZED (SELECT a.cloud_id, a.pid AS a, b.pid AS b, a.x AS ax, a.y AS ay, a.z AS az, b.x, b.y, b.z FROM p a JOIN p b ON a.pid < b.pid AND abs(a.x - b.x) <= {ALPHA}::DOUBLE WHERE {d2("a", "b")} <= {ALPHA}::DOUBLE * {ALPHA}::DOUBLE),
t AS (SELECT u.cloud_id, u.a AS a, u.b AS b, v.b AS c, u.ax, u.ay, u.az, u.x AS bx, u.y AS by_, u.z AS bz, v.x AS cx, v.y AS cy, v.z AS cz FROM n u JOIN n v ON u.a = v.a AND u.b < v.b),
s AS (SELECT cloud_id, a, b, c, (ax + bx + cx) / 3 AS mx, (ay + by_ + cy) / 3 AS my, (az + bz + cz) / 3 AS mz, (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) + (bz - az) * (bz - az) AS ab,
  (cx - bx) * (cx - bx) + (cy - by_) * (cy - by_) + (cz - bz) * (cz - bz) AS bc, (ax - cx) * (ax - cx) + (ay - cy) * (ay - cy) + (az - cz) * (az - cz) AS ca,
  bx - ax AS ux, by_ - ay AS uy, bz - az AS uz, cx - ax AS vx, cy - ay AS vy, cz - az AS vz FROM t),
f AS (SELECT *, ((uy * vz - uz * vy) * (uy * vz - uz * vy) + (uz * vx - ux * vz) * (uz * vx - ux * vz) + (ux * vy - uy * vx) * (ux * vy - uy * vx)) / 4 AS area2, sqrt(ab) + sqrt(bc) + sqrt(ca) AS round FROM s),
k AS MATERIALIZED (SELECT *, sqrt(area2) AS area, sqrt(ab * bc * ca / (16 * area2)) AS circumradius FROM f WHERE area2 >= 1e-20 AND least(ab, bc, ca) >= 1e-20 AND sqrt(area2) >= 1e-8 AND 4 * sqrt(area2) / (round * round) > 0.01),
{local}
e AS (SELECT a, b, c, unnest([[a, b], [b, c], [a, c]]) AS e FROM k),
l AS (SELECT DISTINCT t.a AS a, t.b AS b, t.c AS c FROM (SELECT any_value({{'a': a, 'b': b, 'c': c}}) AS t FROM e GROUP BY e HAVING count(*) = 1))
SELECT k.cloud_id, k.a, k.b, k.c, {r6("circumradius", "circumradius")}, {r6("area", "area")}, (l.a IS NOT NULL) AS is_boundary
FROM k LEFT JOIN l ON k.a = l.a AND k.b = l.b AND k.c = l.c {"LEFT JOIN m ON k.a = m.a AND k.b = m.b AND k.c = m.c" if mode == "adaptive" else ""} WHERE {kept}"""


def _distance_sql() -> str:
    box = f"(SELECT {', '.join(f'min({c}) - 0.05::DOUBLE AS l{c}, (max({c}) - min({c}) + 0.1::DOUBLE) / 9 AS s{c}' for c in XYZ)} FROM {EMBEDDINGS})"
    nodes = f"(SELECT CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, CAST(c.i AS INT) AS k, lx + a.i * sx AS x, ly + b.i * sy AS y, lz + c.i * sz AS z FROM {box}, range(10) a(i), range(10) b(i), range(10) c(i))"
    return f"SELECT i, j, k, {r6('value', 'value')} FROM (SELECT i, j, k, sqrt(min((n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y) + (n.z - p.z) * (n.z - p.z))) AS value FROM {nodes} n, {EMBEDDINGS} p GROUP BY i, j, k)"


def _cubes_sql() -> str:
    """Triangles of the sphere's level set, the table of triangles as a list of values."""
    table = ", ".join(f"({n}, {m}, {a}, {b}, {c})" for n, ts in enumerate(volumes.cube_triangles()) for m, (a, b, c) in enumerate(ts))
    joins = " ".join(f"JOIN g c{n} ON c{n}.i = c0.i + {n & 1} AND c{n}.j = c0.j + {n >> 1 & 1} AND c{n}.k = c0.k + {n >> 2 & 1}" for n in range(1, 8))
    index = " + ".join(f"CASE WHEN v{n} < 0 THEN {1 << n} ELSE 0 END" for n in range(8))
    points = []
    for a, b in volumes.EDGES:
        t = f"coalesce((0 - v{a}) / nullif(v{b} - v{a}, 0), 0.5::DOUBLE)"
        place = ", ".join(f"'{c}': ({n} + {a >> x & 1}{f' + {t}' if (a ^ b) >> x & 1 else ''}) * {SPHERE.spacing[x]!r}::DOUBLE + ({SPHERE.origin[x]!r}::DOUBLE)" for x, (n, c) in enumerate(zip("ijk", XYZ)))
        points.append(f"{{{place}}}")
    corner = ", ".join(r6(f"e[t.{c} + 1].{x}", f"{c}_{x}") for c in "abc" for x in XYZ)
    return f"""WITH g AS (SELECT i, j, k, sqrt(x * x + y * y + z * z) - 0.7::DOUBLE AS value FROM {_nodes(SPHERE)}),
q AS (SELECT c0.i, c0.j, c0.k, c0.value AS v0, {", ".join(f"c{n}.value AS v{n}" for n in range(1, 8))} FROM g c0 {joins}),
h AS (SELECT i, j, k, {index} AS ci, [{", ".join(points)}] AS e FROM q)
SELECT h.i, h.j, h.k, CAST(t.n AS INT) AS n, {corner} FROM h JOIN (VALUES {table}) t(ci, n, a, b, c) ON h.ci = t.ci"""


_ORIENTED_SCANS = "(SELECT cloud_id, pid, x, y, z, nx / len AS nx, ny / len AS ny, nz / len AS nz FROM (SELECT DISTINCT cloud_id, pid, x, y, z, nx, ny, nz, sqrt(nx * nx + ny * ny + nz * nz) AS len FROM cloud_normal WHERE isfinite(x) AND isfinite(y) AND isfinite(z)) WHERE len > 1e-6 AND len < 1e6)"


def _plane_system_sql() -> str:
    near = f"""(SELECT a.cloud_id, a.pid, a.x, a.y, a.z, b.x AS tx, b.y AS ty, b.z AS tz, b.nx, b.ny, b.nz,
row_number() OVER (PARTITION BY a.cloud_id, a.pid ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), b.pid) AS r
FROM {moved(SCANS, POSE)} a JOIN {_ORIENTED_SCANS} b ON a.cloud_id = b.cloud_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.01::DOUBLE)"""
    rows = f"(SELECT y * nz - z * ny AS a0, z * nx - x * nz AS a1, x * ny - y * nx AS a2, nx AS a3, ny AS a4, nz AS a5, (tx - x) * nx + (ty - y) * ny + (tz - z) * nz AS b FROM {near} WHERE r = 1)"
    h = [f"round(sum(a{i} * a{j}), 3) + 0 AS h{i}{j}" for i in range(6) for j in range(i, 6)] + [f"round(sum(a{i} * b), 3) + 0 AS g{i}" for i in range(6)]
    return f"SELECT count(*) AS n, round(sum(b * b), 3) AS e, {', '.join(h)} FROM {rows}"


def _plane_system(s: SparkSession, d: str) -> DataFrame:
    pairs = registration.correspondences(scans(s, d), oriented(s, d), POSE, 0.1, carry=(*XYZ, "nx", "ny", "nz"))
    sums = registration.plane_system(pairs)
    return rounded(sums, *(c for c in sums.columns if c != "n"), places=3)


def _weighted_sql() -> str:
    """The field of a constant basis: the weighted mean of normal offsets."""
    r = "sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z))"
    near = f"(SELECT q.cloud_id, q.pid, {r} AS r, (p.x - q.x) * p.nx + (p.y - q.y) * p.ny + (p.z - q.z) * p.nz AS o FROM (SELECT cloud_id, pid, x + 0.01::DOUBLE AS x, y, z FROM {SCANS}) q JOIN {_ORIENTED_SCANS} p ON q.cloud_id = p.cloud_id AND abs(q.x - p.x) <= 0.3005::DOUBLE AND abs(q.y - p.y) <= 0.3005::DOUBLE)"
    w = "pow(greatest(1 - r / 0.3005::DOUBLE, 0), 4) * (4 * r / 0.3005::DOUBLE + 1)"
    fit = f"(SELECT cloud_id, pid, sum({w} * o) / (sum({w}) + 0.000001::DOUBLE) AS value FROM {near} WHERE r <= 0.3005::DOUBLE GROUP BY cloud_id, pid)"
    return f"SELECT c.cloud_id, c.pid, {r6('coalesce(f.value, 0)', 'value')} FROM {SCANS} c LEFT JOIN {fit} f ON c.cloud_id = f.cloud_id AND c.pid = f.pid"


_EYES = (transforms.translation(0.3, 0, 0.6), VIEW)

def _boxes(s: SparkSession, low: float, high: float) -> tuple[DataFrame, DataFrame]:
    points = [("box", 4 * i + 2 * j + k, *(float(high if b else low) for b in (i, j, k))) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    sides = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]
    return s.createDataFrame(points, "mesh_id string, vid bigint, x double, y double, z double"), s.createDataFrame([("box", i, *f) for i, f in enumerate(sides)], "mesh_id string, fid bigint, a bigint, b bigint, c bigint")


def _sheet(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    return grid_vertices(s), grid_faces(s)


def _pair(s, d):
    return embeddings(s, d), image(s, d)


def _oriented_image(s, d):
    return normals.estimate_normals(image(s, d), 10)


def _registered(run):
    return lambda s, d: rounded(run(s, d).frame(s), *(f"m{i}{j}" for i in range(3) for j in range(4)))


def _sphere_cloud(s: SparkSession) -> DataFrame:
    t = F.col("id") * 2.399963229728653
    h = 1 - 2 * (F.col("id") + 0.5) / 1500
    r = F.sqrt(1 - h * h)
    return s.range(1500).select(F.lit("sphere").alias("cloud_id"), F.col("id").alias("pid"), (r * F.cos(t)).alias("x"), (r * F.sin(t)).alias("y"), h.alias("z"), (r * F.cos(t)).alias("nx"), (r * F.sin(t)).alias("ny"), h.alias("nz"))


QUERIES = {
    "depth_to_cloud": lambda s, d: rounded(volumes.depth_to_cloud(depth_image(s), CAMERA), *XYZ),
    "organized_density": lambda s, d: volumes.is_dense(volumes.depth_to_cloud(depth_image(s), CAMERA)),
    "colorize": lambda s, d: volumes.colorize(embeddings(s, d), color_image(s), CAMERA, VIEW).select("cloud_id", "pid", "r", "g", "b", "is_colored"),
    "colorize_from_images": lambda s, d: volumes.colorize_from_images(embeddings(s, d), [(color_image(s), CAMERA, eye) for eye in _EYES]).select("cloud_id", "pid", "r", "g", "b", "is_colored"),
    "tsdf_integrate": lambda s, d: rounded(_fused(s), "tsdf"),
    "tsdf_surface": lambda s, d: rounded(volumes.tsdf_surface(_fused(s), BLOCK), *XYZ),
    "sphere_volume": lambda s, d: rounded(volumes.sphere_volume(s, (0, 0, 0), 0.7, SPHERE), "value"),
    "cube_volume": lambda s, d: rounded(volumes.cube_volume(s, (0, 0, 0), 0.6, SPHERE), "value"),
    "cube_indices": lambda s, d: volumes.cube_index(volumes.sphere_volume(s, (0, 0, 0), 0.7, SPHERE)).select("i", "j", "k", "cube_index"),
    "marching_cubes_sphere": lambda s, d: volumes.isosurface(volumes.sphere_volume(s, (0, 0, 0), 0.7, SPHERE), SPHERE).select("i", "j", "k", "n", *(F.round(f"{c}.{x}", 6).alias(f"{c}_{x}") for c in "abc" for x in XYZ)),
    "distance_grid": lambda s, d: rounded(volumes.distance_grid(embeddings(s, d), (10, 10, 10), 0.05)[0], "value"),
    "scan_mls_constant": lambda s, d: rounded(volumes.mls_field(scans(s, d).withColumn("x", F.col("x") + 0.01), oriented(s, d), 0.3005, "constant"), "value"),
    "scan_mls_quadratic": lambda s, d: volumes.mls_field(scans(s, d), oriented(s, d), 0.3005, gradient=True),
    "icp_plane_system": _plane_system,
    "mls_field": lambda s, d: volumes.mls_field(embeddings(s, d).withColumn("x", F.col("x") + 0.01), normals.estimate_normals(embeddings(s, d), 10), 0.2, "linear"),
    "alpha_triangles": lambda s, d: rounded(surfaces.alpha_triangles(embeddings(s, d), ALPHA, "full"), "circumradius", "area"),
    "alpha_boundary": lambda s, d: rounded(surfaces.alpha_triangles(embeddings(s, d), ALPHA, "boundary"), "circumradius", "area"),
    "alpha_adaptive": lambda s, d: rounded(surfaces.alpha_triangles(embeddings(s, d), ALPHA, "adaptive"), "circumradius", "area"),
    "delaunay": lambda s, d: surfaces.delaunay(embeddings(s, d)),
    "ball_pivoting": lambda s, d: surfaces.ball_pivoting(embeddings(s, d)),
    "poisson": lambda s, d: surfaces.poisson(_sphere_cloud(s), 5)[1],
    "auto_reconstruct": lambda s, d: surfaces.reconstruct(embeddings(s, d))[2],
    "collapse_costs": lambda s, d: simplify.collapse_costs(*_sheet(s)),
    "simplify_quadric": lambda s, d: simplify.simplify_quadric(*_sheet(s), 0.5)[1],
    "simplify_edge_collapse": lambda s, d: simplify.simplify_edge_collapse(*_sheet(s), 0.5)[1],
    "progressive_mesh": lambda s, d: simplify.progressive_splits(*_sheet(s), 0.2).select("mesh_id", "seq", "kept", "gone"),
    "mesh_boolean_union": lambda s, d: simplify.mesh_boolean(_boxes(s, 0, 2), _boxes(s, 1, 3), "union"),
    "mesh_boolean_difference": lambda s, d: simplify.mesh_boolean(_boxes(s, 0, 2), _boxes(s, 1, 3), "difference"),
    "compare_meshes": lambda s, d: mesh.compare_meshes(grid_vertices(s), grid_vertices(s).withColumn("z", F.when(F.col("vid") % 50 == 0, F.col("z") + 0.1).otherwise(F.col("z")))),
    "ndt_voxels": lambda s, d: rounded(registration.ndt_voxels(scans(s, d), 1.0, 5), *(f"mean_{c}" for c in XYZ), "cxx", "cxy", "cxz", "cyy", "cyz", "czz", places=10),
    "gicp_covariances": lambda s, d: rounded(normals.registration_covariances(embeddings(s, d), 12), "cxx", "cxy", "cxz", "cyy", "cyz", "czz"),
    "icp_cross_covariance": lambda s, d: _covariance(s, d),
    "icp_point_to_point": _registered(lambda s, d: registration.icp_point_to_point(*_pair(s, d), max_iterations=10)),
    "icp_point_to_plane": _registered(lambda s, d: registration.icp_point_to_plane(embeddings(s, d), _oriented_image(s, d), max_iterations=6)),
    "multiscale_icp": _registered(lambda s, d: registration.multiscale_icp(*_pair(s, d))),
    "gicp": _registered(lambda s, d: registration.gicp(*_pair(s, d), max_iterations=5)),
    "kiss_icp": _registered(lambda s, d: registration.kiss_icp(*_pair(s, d), voxel_size=0.05, min_range=0.0, max_iterations=8)),
    "ndt_registration": _registered(lambda s, d: registration.ndt_registration(*_pair(s, d), resolution=0.3, max_iterations=8)),
    "global_registration": _registered(lambda s, d: registration.global_registration(*_pair(s, d), ransac_iterations=2000, icp_iterations=5)),
}


def _covariance(s: SparkSession, d: str) -> DataFrame:
    sums = registration.cross_covariance(registration.correspondences(*(c.withColumn("cloud_id", F.lit("pair")) for c in _pair(s, d)), None, 0.1))
    return rounded(sums, *(n for n in sums.columns if n != "n"))


_CORR = f"""(SELECT a.*, b.x AS tx, b.y AS ty, b.z AS tz, row_number() OVER (PARTITION BY a.pid ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), b.pid) AS k,
(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM {EMBEDDINGS} a CROSS JOIN {moved(EMBEDDINGS, POSE)} b)"""
_COV = {"cxx": "xx", "cxy": "xy", "cxz": "xz", "cyy": "yy", "cyz": "yz", "czz": "zz"}

SQL = {
    "depth_to_cloud": f"SELECT row, col, {r6(f'CASE WHEN d > 0 THEN (col - {CAMERA.cx}::DOUBLE) * (d * 0.001::DOUBLE) / {CAMERA.fx}::DOUBLE END', 'x')}, {r6(f'CASE WHEN d > 0 THEN (row - {CAMERA.cy}::DOUBLE) * (d * 0.001::DOUBLE) / {CAMERA.fy}::DOUBLE END', 'y')}, {r6('CASE WHEN d > 0 THEN d * 0.001::DOUBLE END', 'z')} FROM {DEPTH}",
    "organized_density": f"SELECT count(*) AS cells, count(*) FILTER (d > 0) AS valid, count(*) = count(*) FILTER (d > 0) AS is_dense FROM {DEPTH}",
    "colorize": _colorize_sql(),
    "tsdf_integrate": f"SELECT i, j, k, {r6('tsdf', 'tsdf')}, weight, r, g, b FROM {_tsdf_sql()}",
    "tsdf_surface": _tsdf_surface_sql(),
    "sphere_volume": f"SELECT i, j, k, {r6('sqrt(x * x + y * y + z * z) - 0.7::DOUBLE', 'value')} FROM {_nodes(SPHERE)}",
    "cube_volume": f"SELECT i, j, k, {r6('sqrt(pow(greatest(abs(x) - 0.6::DOUBLE, 0), 2) + pow(greatest(abs(y) - 0.6::DOUBLE, 0), 2) + pow(greatest(abs(z) - 0.6::DOUBLE, 0), 2)) + least(greatest(abs(x), abs(y), abs(z)) - 0.6::DOUBLE, 0)', 'value')} FROM {_nodes(SPHERE)}",
    "cube_indices": _cube_sql(),
    "alpha_triangles": _alpha_sql(),
    "alpha_boundary": _alpha_sql("boundary"),
    "alpha_adaptive": _alpha_sql("adaptive"),
    "distance_grid": _distance_sql(),
    "marching_cubes_sphere": _cubes_sql(),
    "icp_plane_system": _plane_system_sql(),
    "scan_mls_constant": _weighted_sql(),
    "compare_meshes": f"SELECT 'grid' AS mesh_id, id AS vid, 'z' AS difference FROM range({SIDE * SIDE}) r(id) WHERE id % 50 = 0",
    "colorize_from_images": f"""SELECT c.cloud_id, c.pid, {', '.join(f'CASE WHEN a.is_colored THEN a.{n} WHEN b.is_colored THEN b.{n} ELSE 128 END AS {n}' for n in 'rgb')}, a.is_colored OR b.is_colored AS is_colored
FROM {EMBEDDINGS} c JOIN ({_colorize_sql(_EYES[0])}) a ON c.pid = a.pid JOIN ({_colorize_sql(_EYES[1])}) b ON c.pid = b.pid""",
    "ndt_voxels": f"SELECT cloud_id, vx, vy, vz, count(*) AS n, {', '.join(r6(f'avg({c})', f'mean_{c}', 10) for c in XYZ)}, {', '.join(r6(f'covar_pop({ab[1]}, {ab[0]}) + {0.0001 if ab[0] == ab[1] else 0}::DOUBLE', c, 10) for c, ab in _COV.items())} FROM (SELECT *, CAST(floor(x) AS BIGINT) AS vx, CAST(floor(y) AS BIGINT) AS vy, CAST(floor(z) AS BIGINT) AS vz FROM (SELECT DISTINCT cloud_id, pid, x, y, z FROM cloud_normal WHERE isfinite(x) AND isfinite(y) AND isfinite(z))) GROUP BY cloud_id, vx, vy, vz HAVING count(*) >= 5",
    "gicp_covariances": f"SELECT cloud_id, pid, {', '.join(r6(f'covar_samp(p{ab[1]}, p{ab[0]}) + {0.0001 if ab[0] == ab[1] else 0}::DOUBLE', c) for c, ab in _COV.items())} FROM (SELECT a.cloud_id, a.pid, b.x AS px, b.y AS py, b.z AS pz, row_number() OVER (PARTITION BY a.pid ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), b.pid) AS k FROM {EMBEDDINGS} a CROSS JOIN {EMBEDDINGS} b) WHERE k <= 12 GROUP BY cloud_id, pid",
    "icp_cross_covariance": f"SELECT count(*) AS n, {', '.join(r6(f'sum({a})', f's{a}') for a in XYZ)}, {', '.join(r6(f'sum(t{a})', f't{a}') for a in XYZ)}, {', '.join(r6(f'sum({a} * t{b})', f'h{a}{b}') for a in XYZ for b in XYZ)}, {r6('sum(d2)', 'd2')} FROM {_CORR} WHERE k = 1 AND d2 <= 0.01::DOUBLE",
}
