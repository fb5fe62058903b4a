"""Queries on meshes: topology, attributes, smoothing, simplification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.catalog.clouds import SCANS, r6, rounded, scans
from pointlake.operators import mesh
from pointlake.plans.ranks import ranked

SIDE = 24
XYZ = ("x", "y", "z")


def grid_vertices(spark: SparkSession, side: int = SIDE, mesh_id: str = "grid") -> DataFrame:
    """A wavy sheet of side x side vertices."""
    i, j = F.floor(F.col("id") / side), F.col("id") % side
    return spark.range(side * side).select(F.lit(mesh_id).alias("mesh_id"), F.col("id").alias("vid"), i.cast("double").alias("x"), j.cast("double").alias("y"), (F.sin(i / 5) * F.cos(j / 5)).alias("z"))


def grid_faces(spark: SparkSession, side: int = SIDE, mesh_id: str = "grid") -> DataFrame:
    """Two triangles for each square of the sheet."""
    n = side - 1
    v = F.floor(F.col("id") / n) * side + F.col("id") % n
    two = F.array(F.struct((F.col("id") * 2).alias("fid"), v.alias("a"), (v + side).alias("b"), (v + 1).alias("c")), F.struct((F.col("id") * 2 + 1).alias("fid"), (v + 1).alias("a"), (v + side).alias("b"), (v + side + 1).alias("c")))
    return spark.range(n * n).select(F.lit(mesh_id).alias("mesh_id"), F.explode(two).alias("f")).select("mesh_id", "f.*")


def _mesh(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    return grid_vertices(s), grid_faces(s)


def strips(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A mesh of each recorded cloud: its points in pid order, every three that follow each other a triangle of a strip."""
    points = ranked(scans(s, d), ["cloud_id", "pid"])
    first = points.groupBy("cloud_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    numbered = points.join(first, "cloud_id").select(F.col("cloud_id").alias("mesh_id"), (F.col("rank") - F.col("first")).alias("vid"), *XYZ, "n")
    vid = F.col("vid")
    corners = F.when(vid % 2 == 0, F.struct(vid.alias("a"), (vid + 1).alias("b"), (vid + 2).alias("c"))).otherwise(F.struct((vid + 1).alias("a"), vid.alias("b"), (vid + 2).alias("c")))
    faces = numbered.where(vid + 2 < F.col("n")).select("mesh_id", vid.alias("fid"), corners.alias("t")).select("mesh_id", "fid", "t.*")
    return numbered.drop("n"), faces


VERTICES = f"(SELECT 'grid' AS mesh_id, id AS vid, CAST(id // {SIDE} AS DOUBLE) AS x, CAST(id % {SIDE} AS DOUBLE) AS y, sin((id // {SIDE}) / 5.0::DOUBLE) * cos((id % {SIDE}) / 5.0::DOUBLE) AS z FROM range({SIDE * SIDE}) r(id))"
_N = SIDE - 1
FACES = f"""(SELECT 'grid' AS mesh_id, f.fid AS fid, f.a AS a, f.b AS b, f.c AS c FROM (SELECT unnest([
  {{'fid': id * 2, 'a': (id // {_N}) * {SIDE} + id % {_N}, 'b': (id // {_N}) * {SIDE} + id % {_N} + {SIDE}, 'c': (id // {_N}) * {SIDE} + id % {_N} + 1}},
  {{'fid': id * 2 + 1, 'a': (id // {_N}) * {SIDE} + id % {_N} + 1, 'b': (id // {_N}) * {SIDE} + id % {_N} + {SIDE}, 'c': (id // {_N}) * {SIDE} + id % {_N} + {SIDE} + 1}}]) AS f FROM range({_N * _N}) r(id)))"""
_FLAT = f"""(SELECT f.mesh_id, f.fid, f.a, f.b, f.c, p.x AS ax, p.y AS ay, p.z AS az, q.x - p.x AS ux, q.y - p.y AS uy, q.z - p.z AS uz, r.x - p.x AS wx, r.y - p.y AS wy, r.z - p.z AS wz
FROM {FACES} f JOIN {VERTICES} p ON f.a = p.vid JOIN {VERTICES} q ON f.b = q.vid JOIN {VERTICES} r ON f.c = r.vid)"""
_AREA = f"(SELECT *, uy * wz - uz * wy AS rx, uz * wx - ux * wz AS ry, ux * wy - uy * wx AS rz FROM {_FLAT})"
_UNIT = f"(SELECT *, rx / sqrt(rx * rx + ry * ry + rz * rz) AS nx, ry / sqrt(rx * rx + ry * ry + rz * rz) AS ny, rz / sqrt(rx * rx + ry * ry + rz * rz) AS nz FROM {_AREA})"
_EDGES = f"(SELECT mesh_id, fid, e[1] AS u, e[2] AS v FROM (SELECT mesh_id, fid, unnest([[a, b], [b, c], [c, a]]) AS e FROM {FACES}))"
_LINKS = f"(SELECT DISTINCT mesh_id, u AS vid, v AS neighbor FROM (SELECT mesh_id, u, v FROM {_EDGES} UNION ALL SELECT mesh_id, v, u FROM {_EDGES}))"


def _step(source: str, factor: float) -> str:
    mean = f"(SELECT l.vid, {', '.join(f'avg(v.{c}) AS m{c}' for c in XYZ)} FROM {_LINKS} l JOIN {source} v ON l.neighbor = v.vid GROUP BY l.vid)"
    return f"(SELECT v.mesh_id, v.vid, {', '.join(f'v.{c} + (m.m{c} - v.{c}) * ({factor}::DOUBLE) AS {c}' for c in XYZ)} FROM {source} v JOIN {mean} m ON v.vid = m.vid)"


def _out(source: str) -> str:
    return f"SELECT mesh_id, vid, {', '.join(r6(c, c) for c in XYZ)} FROM {source}"


def _hc() -> str:
    mean = f"(SELECT l.vid, {', '.join(f'avg(v.{c}) AS m{c}' for c in XYZ)} FROM {_LINKS} l JOIN {VERTICES} v ON l.neighbor = v.vid GROUP BY l.vid)"
    b = f"(SELECT v.mesh_id, v.vid, {', '.join(f'm.m{c} AS q{c}, m.m{c} - v.{c} AS b{c}' for c in XYZ)} FROM {VERTICES} v JOIN {mean} m ON v.vid = m.vid)"
    avg = f"(SELECT l.vid, {', '.join(f'avg(b.b{c}) AS n{c}' for c in XYZ)} FROM {_LINKS} l JOIN {b} b ON l.neighbor = b.vid GROUP BY l.vid)"
    return f"(SELECT b.mesh_id, b.vid, {', '.join(f'b.q{c} - (b.b{c} * 0.5::DOUBLE + n.n{c} * 0.5::DOUBLE) AS {c}' for c in XYZ)} FROM {b} b JOIN {avg} n ON b.vid = n.vid)"


_RIM = f"(SELECT DISTINCT unnest([u, v]) AS vid FROM (SELECT least(u, v) AS u, greatest(u, v) AS v, count(*) AS n FROM {_EDGES} GROUP BY 1, 2) WHERE n = 1)"
_CREASE = f"""(SELECT DISTINCT unnest([u, v]) AS vid FROM (SELECT least(e.u, e.v) AS u, greatest(e.u, e.v) AS v, list({{'x': n.nx, 'y': n.ny, 'z': n.nz}}) AS ns
FROM {_EDGES} e JOIN {_UNIT} n ON e.fid = n.fid GROUP BY 1, 2) WHERE len(ns) = 2 AND ns[1].x * ns[2].x + ns[1].y * ns[2].y + ns[1].z * ns[2].z < cos(0.03::DOUBLE))"""


def _clustering() -> str:
    side = float(SIDE - 1)
    box = f"(SELECT min(z) AS lz, max(z) - min(z) AS ez FROM {VERTICES})"
    return f"""(WITH g AS (SELECT v.*, CASE WHEN v.vid IN (SELECT vid FROM {_RIM}) THEN 1 WHEN v.vid IN (SELECT vid FROM {_CREASE.replace("0.03", "0.7853981633974483")}) THEN 2 ELSE 0 END AS class,
  pow({side}::DOUBLE * {side}::DOUBLE * b.ez / (count(*) OVER () * 0.3::DOUBLE), 1.0::DOUBLE / 3) AS edge, b.lz FROM {VERTICES} v CROSS JOIN {box} b),
k AS (SELECT *, min(vid) OVER (PARTITION BY floor(x / edge), floor(y / edge), floor((z - lz) / edge), class) AS cluster FROM g),
f AS (SELECT fid, p.cluster AS a, q.cluster AS b, r.cluster AS c FROM {FACES} f JOIN k p ON f.a = p.vid JOIN k q ON f.b = q.vid JOIN k r ON f.c = r.vid),
d AS (SELECT min(fid) AS fid, arg_min({{'a': a, 'b': b, 'c': c}}, fid) AS t FROM f WHERE a <> b AND b <> c AND a <> c GROUP BY list_sort([a, b, c]))
SELECT k.cluster AS vid, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM k WHERE cluster IN (SELECT unnest([t.a, t.b, t.c]) FROM d) GROUP BY k.cluster)"""


QUERIES = {
    "face_normals": lambda s, d: rounded(mesh.face_normals(*_mesh(s)), "nx", "ny", "nz"),
    "vertex_normals": lambda s, d: rounded(mesh.vertex_normals(*_mesh(s)), "nx", "ny", "nz"),
    "vertex_normals_flat": lambda s, d: rounded(mesh.vertex_normals(*_mesh(s), smooth=False), "nx", "ny", "nz"),
    "mesh_adjacency": lambda s, d: mesh.adjacency(grid_faces(s)),
    "half_edge_twins": lambda s, d: mesh.twins(grid_faces(s)),
    "boundary_edges": lambda s, d: mesh.boundary_edges(grid_faces(s)),
    "feature_vertices": lambda s, d: mesh.feature_vertices(*_mesh(s), angle=0.03),
    "vertex_valence": lambda s, d: mesh.valence(grid_faces(s)),
    "vertex_quadrics": lambda s, d: rounded(mesh.vertex_quadrics(*_mesh(s)), *mesh.QUADRIC),
    "smooth_laplacian": lambda s, d: rounded(mesh.smooth_laplacian(*_mesh(s), 2, 0.5), *XYZ),
    "smooth_taubin": lambda s, d: rounded(mesh.smooth_taubin(*_mesh(s), 1), *XYZ),
    "smooth_hc": lambda s, d: rounded(mesh.smooth_hc(*_mesh(s), 1), *XYZ),
    "simplify_clustering": lambda s, d: rounded(mesh.simplify_clustering(*_mesh(s), 0.7)[0], *XYZ),
    "simplify_clustering_error": lambda s, d: mesh.simplify_clustering(*_mesh(s), 0.7, representative="error")[0],
    "simplify_octree": lambda s, d: mesh.simplify_clustering(*_mesh(s), 0.7, clusters=mesh.octree_clusters(*_mesh(s), max_depth=4, error_threshold=0.05))[0],
    "default_uvs": lambda s, d: rounded(mesh.default_uvs(grid_vertices(s)), "z"),
    "mesh_tangents": lambda s, d: mesh.tangents(mesh.default_uvs(grid_vertices(s)), grid_faces(s), mesh.vertex_normals(*_mesh(s))),
    "mesh_completeness": lambda s, d: mesh.completeness(mesh.default_uvs(grid_vertices(s))),
    # the same on meshes of all recorded clouds
    "scan_face_normals": lambda s, d: rounded(mesh.face_normals(*strips(s, d)), "nx", "ny", "nz"),
    "scan_vertex_normals": lambda s, d: rounded(mesh.vertex_normals(*strips(s, d), normalize=False), "nx", "ny", "nz", places=9),
    "scan_vertex_valence": lambda s, d: mesh.valence(strips(s, d)[1]),
    "scan_boundary_edges": lambda s, d: mesh.boundary_edges(strips(s, d)[1]),
    "scan_smooth_laplacian": lambda s, d: rounded(mesh.smooth_laplacian(*strips(s, d), 2, 0.5), *XYZ, places=9),
    "scan_simplify_clustering": lambda s, d: mesh.simplify_clustering(*strips(s, d), 0.5)[0],
}

_SV = f"(SELECT cloud_id AS mesh_id, row_number() OVER (PARTITION BY cloud_id ORDER BY pid) - 1 AS vid, x, y, z, count(*) OVER (PARTITION BY cloud_id) AS n FROM {SCANS})"
_SF = f"(SELECT mesh_id, vid AS fid, CASE WHEN vid % 2 = 0 THEN vid ELSE vid + 1 END AS a, CASE WHEN vid % 2 = 0 THEN vid + 1 ELSE vid END AS b, vid + 2 AS c FROM {_SV} WHERE vid + 2 < n)"
_SQ = f"(SELECT *, {', '.join(f'lead({c}, {n}) OVER (PARTITION BY mesh_id ORDER BY vid) AS {c}{n}' for n in (1, 2) for c in XYZ)} FROM {_SV})"
_SP = f"(SELECT mesh_id, vid AS fid, CASE WHEN vid % 2 = 0 THEN vid ELSE vid + 1 END AS a, CASE WHEN vid % 2 = 0 THEN vid + 1 ELSE vid END AS b, vid + 2 AS c, {', '.join(f'CASE WHEN vid % 2 = 0 THEN {c} ELSE {c}1 END AS p{c}, CASE WHEN vid % 2 = 0 THEN {c}1 ELSE {c} END AS q{c}, {c}2 AS r{c}' for c in XYZ)} FROM {_SQ} WHERE vid + 2 < n)"
_SA = f"(SELECT mesh_id, fid, a, b, c, (qy - py) * (rz - pz) - (qz - pz) * (ry - py) AS rx, (qz - pz) * (rx - px) - (qx - px) * (rz - pz) AS ry, (qx - px) * (ry - py) - (qy - py) * (rx - px) AS rz FROM {_SP})"
_SE = f"(SELECT mesh_id, fid, e[1] AS u, e[2] AS v FROM (SELECT mesh_id, fid, unnest([[a, b], [b, c], [c, a]]) AS e FROM {_SF}))"
_SL = f"(SELECT DISTINCT mesh_id, u AS vid, v AS neighbor FROM (SELECT mesh_id, u, v FROM {_SE} UNION ALL SELECT mesh_id, v, u FROM {_SE}))"


def _smoothed(source: str) -> str:
    mean = f"(SELECT l.mesh_id, l.vid, {', '.join(f'avg(v.{c}) AS m{c}' for c in XYZ)} FROM {_SL} l JOIN {source} v ON l.mesh_id = v.mesh_id AND l.neighbor = v.vid GROUP BY l.mesh_id, l.vid)"
    return f"(SELECT v.mesh_id, v.vid, {', '.join(f'CASE WHEN m.vid IS NULL THEN v.{c} ELSE v.{c} + (m.m{c} - v.{c}) * 0.5::DOUBLE END AS {c}' for c in XYZ)} FROM {source} v LEFT JOIN {mean} m ON v.mesh_id = m.mesh_id AND v.vid = m.vid)"


SQL = {
    "face_normals": f"SELECT mesh_id, fid, {', '.join(r6(f'n{c}', f'n{c}') for c in XYZ)} FROM {_UNIT}",
    "vertex_normals": f"SELECT mesh_id, vid, {', '.join(r6(f'r{c} / len', f'n{c}') for c in XYZ)} FROM (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) AS len FROM (SELECT mesh_id, vid, sum(rx) AS rx, sum(ry) AS ry, sum(rz) AS rz FROM (SELECT mesh_id, unnest([a, b, c]) AS vid, rx, ry, rz FROM {_AREA}) GROUP BY mesh_id, vid))",
    "vertex_normals_flat": f"SELECT mesh_id, vid, {', '.join(r6(f'arg_max(n{c}, fid)', f'n{c}') for c in XYZ)} FROM (SELECT mesh_id, fid, unnest([a, b, c]) AS vid, nx, ny, nz FROM {_UNIT}) GROUP BY mesh_id, vid",
    "mesh_adjacency": f"SELECT * FROM {_LINKS}",
    "half_edge_twins": f"SELECT e.mesh_id, e.fid, e.u, e.v, t.fid AS twin FROM {_EDGES} e LEFT JOIN {_EDGES} t ON e.u = t.v AND e.v = t.u",
    "boundary_edges": f"SELECT mesh_id, least(u, v) AS u, greatest(u, v) AS v FROM {_EDGES} GROUP BY mesh_id, least(u, v), greatest(u, v) HAVING count(*) = 1",
    "feature_vertices": f"SELECT 'grid' AS mesh_id, vid FROM {_CREASE}",
    "vertex_valence": f"SELECT mesh_id, vid, count(*) AS valence FROM (SELECT mesh_id, unnest([a, b, c]) AS vid FROM {FACES}) GROUP BY mesh_id, vid",
    "vertex_quadrics": "SELECT mesh_id, vid, " + ", ".join(r6(f"sum(p{q[1]} * p{q[2]})", q) for q in mesh.QUADRIC) + f" FROM (SELECT mesh_id, unnest([a, b, c]) AS vid, nx AS pa, ny AS pb, nz AS pc, -(nx * ax + ny * ay + nz * az) AS pd FROM {_UNIT}) GROUP BY mesh_id, vid",
    "smooth_laplacian": _out(_step(_step(VERTICES, 0.5), 0.5)),
    "smooth_taubin": _out(_step(_step(VERTICES, 0.5), -0.53)),
    "smooth_hc": _out(_hc()),
    "simplify_clustering": f"SELECT 'grid' AS mesh_id, vid, {', '.join(r6(c, c) for c in XYZ)} FROM {_clustering()}",
    "default_uvs": f"SELECT mesh_id, vid, x, y, {r6('z', 'z')}, x / {SIDE - 1}.0::DOUBLE AS u, y / {SIDE - 1}.0::DOUBLE AS v FROM {VERTICES}",
    "mesh_completeness": f"SELECT mesh_id, count(*) AS vertices, CAST(0 AS BIGINT) AS with_normals, count(*) AS with_uvs, CAST(0 AS BIGINT) AS with_tangents, CAST(0 AS BIGINT) AS with_colors, CAST(0.25 AS DOUBLE) AS score FROM {VERTICES} GROUP BY mesh_id",
}
SQL |= {
    "scan_face_normals": f"SELECT mesh_id, fid, {', '.join(r6(f'CASE WHEN len > 0 THEN r{c} / len END', f'n{c}') for c in XYZ)} FROM (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) AS len FROM {_SA})",
    "scan_vertex_normals": f"SELECT v.mesh_id, v.vid, {', '.join(r6(f'coalesce(sum(r{c}), 0)', f'n{c}', 9) for c in XYZ)} FROM {_SV} v LEFT JOIN (SELECT mesh_id, unnest([a, b, c]) AS vid, rx, ry, rz FROM {_SA}) f ON v.mesh_id = f.mesh_id AND v.vid = f.vid GROUP BY v.mesh_id, v.vid",
    "scan_vertex_valence": f"SELECT mesh_id, vid, count(*) AS valence FROM (SELECT mesh_id, unnest([a, b, c]) AS vid FROM {_SF}) GROUP BY mesh_id, vid",
    "scan_boundary_edges": f"SELECT mesh_id, least(u, v) AS u, greatest(u, v) AS v FROM {_SE} GROUP BY mesh_id, least(u, v), greatest(u, v) HAVING count(*) = 1",
    "scan_smooth_laplacian": f"SELECT mesh_id, vid, {', '.join(r6(c, c, 9) for c in XYZ)} FROM {_smoothed(_smoothed(_SV))}",
}
