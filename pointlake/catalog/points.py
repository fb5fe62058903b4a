"""Queries on points: sampling, neighbours, outliers, normals, descriptors, planes, clusters, ground."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointlake.catalog.clouds import EMBEDDINGS, POSE, SCANS, embeddings, image, moved, oriented, r6, rounded, scans
from pointlake.catalog.sql_geometry import EIGENVALUES, SMALLEST_VECTOR, staged_sql
from pointlake.operators import features, filters, ground, neighbors, normals, segmentation, transforms, voxel
from pointlake.plans.tables import table

XYZ = ("x", "y", "z")
TURN = transforms.compose(transforms.translation(1.5, -2.0, 0.25), transforms.rotation((1, 2, 3), 0.7))


def _line_cloud(s, d):
    c = F.col
    return table(s, d, "lineitem").select(F.lit("lineitem").alias("cloud_id"), (c("l_quantity").cast("double") / 50).alias("x"), (c("l_extendedprice").cast("double") / 105000).alias("y"), (c("l_discount").cast("double") / 0.1).alias("z"))


LINE = "(SELECT 'lineitem' AS cloud_id, CAST(l_quantity AS DOUBLE) / 50 AS x, CAST(l_extendedprice AS DOUBLE) / 105000 AS y, CAST(l_discount AS DOUBLE) / 0.1::DOUBLE AS z FROM lineitem)"


def _voxels(source: str, size: float, anchor: str) -> str:
    low = ", ".join(f"min({a}) OVER (PARTITION BY cloud_id) AS m{a}" for a in XYZ) if anchor == "minimum" else ", ".join(f"0.0::DOUBLE AS m{a}" for a in XYZ)
    cells = ", ".join(f"CAST(floor(({a} - m{a}) / {size}::DOUBLE) AS BIGINT) AS v{a}" for a in XYZ)
    return f"""SELECT cloud_id, vx, vy, vz, {", ".join(r6(f"avg({a})", a, 9) for a in XYZ)}, count(*) AS n
FROM (SELECT cloud_id, x, y, z, {cells} FROM (SELECT *, {low} FROM {source})) GROUP BY cloud_id, vx, vy, vz"""


def _pairs(left: str, right: str, where: str) -> str:
    return f"""SELECT a.cloud_id, a.pid, b.pid AS neighbor, b.x AS bx, b.y AS by_, b.z AS bz,
  (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2
FROM {left} a JOIN {right} b ON a.cloud_id = b.cloud_id WHERE {where}"""


def _knn(left: str, right: str, k: int, where: str = "a.pid <> b.pid") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id, pid ORDER BY d2, neighbor) AS rank FROM ({_pairs(left, right, where)})) WHERE rank <= {k})"


def _mean_distance(k: int) -> str:
    near = _knn(SCANS, SCANS, k + 1, "TRUE")
    return f"(SELECT c.cloud_id, c.pid, coalesce(m.mean, 0) AS mean FROM {SCANS} c LEFT JOIN (SELECT cloud_id, pid, avg(sqrt(d2)) AS mean FROM {near} WHERE d2 > 0 GROUP BY cloud_id, pid) m ON c.cloud_id = m.cloud_id AND c.pid = m.pid)"


def _covariance(near: str, own: str, function: str = "covar_pop") -> str:
    cov = ", ".join(f"{function}({b}, {a}) AS c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
    return f"(SELECT cloud_id, pid, count(*) AS n, {cov} FROM (SELECT cloud_id, pid, bx AS x, by_ AS y, bz AS z FROM {near} UNION ALL SELECT cloud_id, pid, x, y, z FROM {own}) GROUP BY cloud_id, pid)"


def _normals_sql(near: str, extra: str = "") -> str:
    shape = staged_sql(_covariance(near, EMBEDDINGS), EIGENVALUES, SMALLEST_VECTOR)
    eye = f"(SELECT (min(x) + max(x)) / 2 AS ex, (min(y) + max(y)) / 2 AS ey, (min(z) + max(z)) / 2 + sqrt((max(x) - min(x)) * (max(x) - min(x)) + (max(y) - min(y)) * (max(y) - min(y)) + (max(z) - min(z)) * (max(z) - min(z))) AS ez FROM {EMBEDDINGS})"
    flip = "CASE WHEN s.vx * (e.ex - c.x) + s.vy * (e.ey - c.y) + s.vz * (e.ez - c.z) < 0 THEN -1.0 ELSE 1.0 END"
    return f"""SELECT c.cloud_id, c.pid, {", ".join(r6(f"({flip}) * s.v{a}", f"n{a}") for a in XYZ)}{extra}
FROM {EMBEDDINGS} c JOIN {shape} s ON c.cloud_id = s.cloud_id AND c.pid = s.pid CROSS JOIN {eye} e"""


_RADIUS_NEAR = f"""(WITH w AS ({_pairs(EMBEDDINGS, EMBEDDINGS, "a.pid <> b.pid")}), r AS (SELECT * FROM w WHERE d2 <= 0.04::DOUBLE),
f AS (SELECT pid FROM r GROUP BY pid HAVING count(*) >= 10)
SELECT cloud_id, pid, neighbor, bx, by_, bz FROM r WHERE pid IN (SELECT pid FROM f)
UNION ALL SELECT cloud_id, pid, neighbor, bx, by_, bz FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d2, neighbor) AS k FROM w) WHERE k <= 10 AND pid NOT IN (SELECT pid FROM f))"""

_TRIPLES = 60


def _planes_sql() -> str:
    n = f"(SELECT count(*) FROM {EMBEDDINGS})"
    ranked = f"(SELECT row_number() OVER (ORDER BY pid) - 1 AS i, x, y, z FROM {EMBEDDINGS})"
    return f"""WITH p AS (SELECT * FROM {ranked}), t AS (SELECT i AS candidate, i % {n} AS a, (37 * i + 1) % {n} AS b, (101 * i + 2) % {n} AS c FROM range({_TRIPLES}) r(i)),
k AS (SELECT candidate, a.x AS ax, a.y AS ay, a.z AS az, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - a.x AS vx, c.y - a.y AS vy, c.z - a.z AS vz
  FROM t JOIN p a ON t.a = a.i JOIN p b ON t.b = b.i JOIN p c ON t.c = c.i WHERE t.a <> t.b AND t.b <> t.c AND t.a <> t.c),
m AS (SELECT candidate, ax, ay, az, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM k),
u AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS len FROM m),
q AS (SELECT candidate, nx / len AS a, ny / len AS b, nz / len AS c, -(nx * ax + ny * ay + nz * az) / len AS d FROM u WHERE len >= 1e-8),
h AS (SELECT candidate, a, b, c, d, (SELECT count(*) FROM p WHERE abs(q.a * p.x + q.b * p.y + q.c * p.z + q.d) <= 0.05) AS inliers FROM q)
SELECT candidate, {", ".join(r6(v, v) for v in "abcd")}, inliers FROM h ORDER BY inliers DESC, candidate LIMIT 1"""


def _clusters_sql() -> str:
    return f"""WITH RECURSIVE e AS (SELECT pid AS u, neighbor AS v FROM ({_pairs(EMBEDDINGS, EMBEDDINGS, "TRUE")}) WHERE d2 <= 0.0025::DOUBLE),
r(u, root) AS (SELECT pid, pid FROM {EMBEDDINGS} UNION SELECT e.v, r.root FROM r JOIN e ON r.u = e.u),
l AS (SELECT u AS pid, min(root) AS root FROM r GROUP BY u),
s AS (SELECT root, count(*) AS size FROM l GROUP BY root HAVING count(*) >= 3),
n AS (SELECT root, size, row_number() OVER (ORDER BY size DESC, root) - 1 AS cluster_id FROM s)
SELECT 'embeddings' AS cloud_id, l.pid, CAST(n.cluster_id AS INT) AS cluster_id, n.size FROM l JOIN n ON l.root = n.root"""


def _zones_sql() -> str:
    g = ground.GroundConfig()
    rings, sectors, zones = [], [], []
    for i, (a, b) in enumerate(zip(g.radii, g.radii[1:])):
        inside = f"r >= {a}::DOUBLE AND r < {b}::DOUBLE"
        zones.append(f"WHEN {inside} THEN {i}")
        rings.append(f"WHEN {inside} THEN least(floor((r - {a}::DOUBLE) / {(b - a) / g.rings[i]!r}::DOUBLE), {g.rings[i] - 1})")
        sectors.append(f"WHEN {inside} THEN least(floor(t / {2 * 3.141592653589793 / g.sectors[i]!r}::DOUBLE), {g.sectors[i] - 1})")
    return f"""SELECT cloud_id, pid, CAST(CASE {" ".join(zones)} END AS INT) AS zone, CAST(CASE {" ".join(rings)} END AS INT) AS ring, CAST(CASE {" ".join(sectors)} END AS INT) AS sector
FROM (SELECT cloud_id, pid, sqrt(x * x + y * y) AS r, CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 6.283185307179586::DOUBLE ELSE atan2(y, x) END AS t FROM {SCANS})"""


def _normals(s, d, radius=None):
    return rounded(normals.estimate_normals(embeddings(s, d), 10, radius), "nx", "ny", "nz").select("cloud_id", "pid", "nx", "ny", "nz")


def _scan_normals(s, d, radius=None):
    """Positions with normals and curvature, estimated in every recorded cloud."""
    return normals.estimate_normals(scans(s, d), 10, radius)


def _described(s, d):
    return normals.estimate_normals(embeddings(s, d), 10)


def _halves(s, d):
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("pid"), F.col("embedding").alias("feature"))
    return rows.where(F.col("pid") % 2 == 0), rows.where(F.col("pid") % 2 == 1)


def _ids(df):
    return df.select("cloud_id", "pid")


QUERIES = {
    "voxel_downsample": lambda s, d: rounded(voxel.voxel_downsample(scans(s, d), 0.5), *XYZ, places=9),
    "voxel_downsample_zero_anchor": lambda s, d: rounded(voxel.voxel_downsample(scans(s, d), 0.5, anchor="zero"), *XYZ, places=9),
    "voxel_first_point": lambda s, d: voxel.voxel_downsample(scans(s, d), 0.5, keep="first"),
    "voxel_lineitem": lambda s, d: rounded(voxel.voxel_downsample(_line_cloud(s, d), 0.05), *XYZ, places=9),
    "cloud_stats": lambda s, d: rounded(voxel.statistics(scans(s, d)), "mean_x", "mean_y", "mean_z", places=9),
    "bounding_box_center": lambda s, d: voxel.bounds(scans(s, d)).select("cloud_id", "center_x", "center_y", "center_z"),
    "concatenate": lambda s, d: voxel.concatenate(embeddings(s, d), scans(s, d)),
    "range_filter": lambda s, d: _ids(transforms.range_filter(scans(s, d), 5.0, 50.0)),
    "rigid_transform": lambda s, d: rounded(transforms.transform_points(scans(s, d), TURN), *XYZ),
    "transform_vector": lambda s, d: rounded(transforms.transform_vectors(oriented(s, d), TURN), "nx", "ny", "nz").select("cloud_id", "pid", "nx", "ny", "nz"),
    "knn_self_join": lambda s, d: rounded(neighbors.knn(scans(s, d), scans(s, d), 5, exclude_self=True), "distance"),
    "knn_query": lambda s, d: rounded(neighbors.knn(scans(s, d).where(F.col("pid") % 100 == 0), scans(s, d), 8), "distance"),
    "radius_neighbors": lambda s, d: rounded(neighbors.radius_neighbors(scans(s, d), scans(s, d), 0.2004, exclude_self=True), "distance"),
    "radius_outlier_removal": lambda s, d: _ids(filters.radius_outlier_removal(scans(s, d), 0.3005, 4)),
    "statistical_outlier_removal": lambda s, d: _ids(filters.statistical_outlier_removal(scans(s, d), 8, 1.0)),
    "statistical_outlier_threshold": lambda s, d: _ids(filters.statistical_outlier_threshold(scans(s, d), 8, 0.31)),
    "relative_mean_outlier_removal": lambda s, d: _ids(filters.relative_mean_outlier_removal(scans(s, d), 8, 0.8)),
    "plane_inliers": lambda s, d: _ids(segmentation.plane_inliers(scans(s, d), (0.0, 0.1, 1.0, -1.7), 0.2)),
    "ransac_plane": lambda s, d: rounded(segmentation.ransac_plane(embeddings(s, d), 0.05, _TRIPLES), *"abcd").drop("cloud_id"),
    "euclidean_clusters": lambda s, d: segmentation.euclidean_clusters(embeddings(s, d), 0.05, 3, 10**9),
    "czm_buckets": lambda s, d: ground.zone_buckets(scans(s, d)).select("cloud_id", "pid", "zone", "ring", "sector"),
    "ground_segmentation": lambda s, d: _ids(ground.segment_ground(scans(s, d), ground.GroundConfig(sensor_height=-1.8)).where("is_ground")),
    "normals_knn": _normals,
    "normals_radius": lambda s, d: _normals(s, d, 0.2),
    "surface_variation": lambda s, d: rounded(_described(s, d), "curvature").select("cloud_id", "pid", "curvature"),
    "spfh": lambda s, d: rounded(features.spfh(oriented(s, d), 0.3005, 5), "value"),
    "fpfh": lambda s, d: features.fpfh(oriented(s, d), 0.3005, 5),
    "shot": lambda s, d: features.shot(_described(s, d), 0.2, 10),
    "unique_shape_context": lambda s, d: features.unique_shape_context(_described(s, d), 0.2, 10),
    "feature_match": lambda s, d: rounded(neighbors.feature_matches(*_halves(s, d)), "distance", places=4),
    "nearest_correspondence": lambda s, d: rounded(neighbors.nearest(embeddings(s, d), image(s, d), 0.1), "distance"),
    # over all recorded clouds; those above over the embeddings' cloud have SQL
    "scan_euclidean_clusters": lambda s, d: segmentation.euclidean_clusters(scans(s, d), 0.3005, 3, 10**9),
    "scan_planes": lambda s, d: rounded(segmentation.ransac_plane(scans(s, d), 0.05, seed=0), *"abcd"),
    "scan_normals_knn": lambda s, d: rounded(_scan_normals(s, d), "nx", "ny", "nz").select("cloud_id", "pid", "nx", "ny", "nz"),
    "scan_normals_radius": lambda s, d: rounded(_scan_normals(s, d, 0.3005), "nx", "ny", "nz").select("cloud_id", "pid", "nx", "ny", "nz"),
    "scan_surface_variation": lambda s, d: rounded(_scan_normals(s, d), "curvature").select("cloud_id", "pid", "curvature"),
    "scan_gicp_covariances": lambda s, d: rounded(normals.registration_covariances(scans(s, d), 12), "cxx", "cxy", "cxz", "cyy", "cyz", "czz", places=9),
    "scan_nearest_correspondence": lambda s, d: rounded(neighbors.nearest(scans(s, d), transforms.transform_points(scans(s, d), POSE), 0.1), "distance"),
    "scan_shot": lambda s, d: features.shot(oriented(s, d), 0.3005, 10),
    "scan_unique_shape_context": lambda s, d: features.unique_shape_context(oriented(s, d), 0.3005, 10),
}

_ORIENTED = "(SELECT cloud_id, pid, x, y, z, nx / len AS nx, ny / len AS ny, nz / len AS nz FROM (SELECT DISTINCT cloud_id, pid, x, y, z, nx, ny, nz, sqrt(nx * nx + ny * ny + nz * nz) AS len FROM cloud_normal WHERE isfinite(x) AND isfinite(y) AND isfinite(z)) WHERE len > 1e-6 AND len < 1e6)"


def _spfh_sql() -> str:
    bin_ = lambda v, low, span, shift: f"{shift} + CAST(greatest(least(floor(({v} - ({low}::DOUBLE)) / {span}::DOUBLE * 11), 10), 0) AS INT)"
    return f"""WITH o AS (SELECT * FROM {_ORIENTED}),
w AS (SELECT a.cloud_id, a.pid, b.pid AS nb, a.nx AS sx, a.ny AS sy, a.nz AS sz, b.nx AS tx, b.ny AS ty, b.nz AS tz, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz,
  (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM o a JOIN o b ON a.cloud_id = b.cloud_id AND a.pid <> b.pid),
r AS (SELECT *, count(*) FILTER (d2 <= 0.3005::DOUBLE * 0.3005::DOUBLE) OVER (PARTITION BY cloud_id, pid) AS near, row_number() OVER (PARTITION BY cloud_id, pid ORDER BY d2, nb) AS k FROM w),
n AS (SELECT *, sqrt(d2) AS len FROM r WHERE (near >= 5 AND d2 <= 0.3005::DOUBLE * 0.3005::DOUBLE) OR (near < 5 AND k <= 5)),
d AS (SELECT *, dx / len AS ex, dy / len AS ey, dz / len AS ez FROM n WHERE len >= 1e-10),
c AS (SELECT *, sy * ez - sz * ey AS cx, sz * ex - sx * ez AS cy, sx * ey - sy * ex AS cz FROM d),
m AS (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS cl FROM c),
v AS (SELECT *, cx * (1 / cl) AS vx, cy * (1 / cl) AS vy, cz * (1 / cl) AS vz FROM m WHERE cl >= 1e-10),
q AS (SELECT *, sy * vz - sz * vy AS wx, sz * vx - sx * vz AS wy, sx * vy - sy * vx AS wz FROM v),
b AS (SELECT cloud_id, pid, unnest([{bin_("(vx * tx + vy * ty + vz * tz)", -1, 2, 0)}, {bin_("(sx * ex + sy * ey + sz * ez)", -1, 2, 11)},
  {bin_("atan2(wx * tx + wy * ty + wz * tz, sx * tx + sy * ty + sz * tz)", "-3.141592653589793", "6.283185307179586", 22)}]) AS bin FROM q),
s AS (SELECT cloud_id, pid, bin, count(*) AS c FROM b GROUP BY cloud_id, pid, bin)
SELECT cloud_id, pid, bin, {r6("c / (sum(c) OVER (PARTITION BY cloud_id, pid) / 3)", "value")} FROM s"""


SQL = {
    "voxel_downsample": _voxels(SCANS, 0.5, "minimum"),
    "voxel_downsample_zero_anchor": _voxels(SCANS, 0.5, "zero"),
    "voxel_first_point": f"""SELECT cloud_id, vx, vy, vz, arg_min(x, pid) AS x, arg_min(y, pid) AS y, arg_min(z, pid) AS z, count(*) AS n FROM
(SELECT cloud_id, pid, x, y, z, {", ".join(f"CAST(floor(({a} - m{a}) / 0.5::DOUBLE) AS BIGINT) AS v{a}" for a in XYZ)} FROM (SELECT *, {", ".join(f"min({a}) OVER (PARTITION BY cloud_id) AS m{a}" for a in XYZ)} FROM {SCANS})) GROUP BY cloud_id, vx, vy, vz""",
    "voxel_lineitem": _voxels(LINE, 0.05, "minimum"),
    "cloud_stats": f"SELECT cloud_id, count(*) AS n, {', '.join(f'{f}({a}) AS {f}_{a}' for f in ('min', 'max') for a in XYZ)}, {', '.join(r6(f'avg({a})', f'mean_{a}', 9) for a in XYZ)} FROM {SCANS} GROUP BY cloud_id",
    "bounding_box_center": f"SELECT cloud_id, {', '.join(f'(min({a}) + max({a})) / 2 AS center_{a}' for a in XYZ)} FROM {SCANS} GROUP BY cloud_id",
    "concatenate": f"SELECT * FROM {EMBEDDINGS} UNION ALL SELECT * FROM {SCANS}",
    "range_filter": f"SELECT cloud_id, pid FROM {SCANS} WHERE x * x + y * y + z * z BETWEEN 25 AND 2500",
    "rigid_transform": f"SELECT cloud_id, pid, {', '.join(r6(a, a) for a in XYZ)} FROM {moved(SCANS, TURN)}",
    "transform_vector": "SELECT cloud_id, pid, " + ", ".join(r6(" + ".join(f"{float(TURN[i, j])!r}::DOUBLE * n{b}" for j, b in enumerate(XYZ)), f"n{a}") for i, a in enumerate(XYZ)) + f" FROM {_ORIENTED}",
    "knn_self_join": f"SELECT cloud_id, pid, neighbor, {r6('sqrt(d2)', 'distance')}, CAST(rank AS INT) AS rank FROM {_knn(SCANS, SCANS, 5)}",
    "knn_query": f"SELECT cloud_id, pid, neighbor, {r6('sqrt(d2)', 'distance')}, CAST(rank AS INT) AS rank FROM {_knn(f'(SELECT * FROM {SCANS} WHERE pid % 100 = 0)', SCANS, 8, 'TRUE')}",
    "radius_neighbors": f"SELECT cloud_id, pid, neighbor, {r6('sqrt(d2)', 'distance')} FROM ({_pairs(SCANS, SCANS, 'a.pid <> b.pid')}) WHERE d2 <= 0.2004::DOUBLE * 0.2004::DOUBLE",
    "radius_outlier_removal": f"SELECT cloud_id, pid FROM ({_pairs(SCANS, SCANS, 'TRUE')}) WHERE d2 <= 0.3005::DOUBLE * 0.3005::DOUBLE GROUP BY cloud_id, pid HAVING count(*) - 1 >= 4",
    "statistical_outlier_removal": f"SELECT cloud_id, pid FROM (SELECT *, avg(mean) OVER (PARTITION BY cloud_id) + 1.0 * stddev_pop(mean) OVER (PARTITION BY cloud_id) AS lim FROM {_mean_distance(8)}) WHERE mean <= lim",
    "statistical_outlier_threshold": f"SELECT cloud_id, pid FROM {_mean_distance(8)} WHERE mean <= 0.31::DOUBLE",
    "relative_mean_outlier_removal": f"SELECT cloud_id, pid FROM (SELECT *, avg(mean) OVER (PARTITION BY cloud_id) AS whole FROM (SELECT cloud_id, pid, avg(sqrt(d2)) AS mean FROM {_knn(SCANS, SCANS, 8)} GROUP BY cloud_id, pid)) WHERE abs(mean - whole) <= whole * 0.8::DOUBLE",
    "plane_inliers": f"SELECT cloud_id, pid FROM {SCANS} WHERE abs(0.1::DOUBLE * y + z - 1.7::DOUBLE) / sqrt(1.01::DOUBLE) <= 0.2::DOUBLE",
    "ransac_plane": _planes_sql(),
    "euclidean_clusters": _clusters_sql(),
    "czm_buckets": _zones_sql(),
    "normals_knn": _normals_sql(_knn(EMBEDDINGS, EMBEDDINGS, 10)),
    "normals_radius": _normals_sql(_RADIUS_NEAR),
    "surface_variation": f"SELECT cloud_id, pid, {r6('greatest(e_min, 0) / (e_min + e_mid + e_max)', 'curvature')} FROM {staged_sql(_covariance(_knn(EMBEDDINGS, EMBEDDINGS, 10), EMBEDDINGS), EIGENVALUES)}",
    "spfh": _spfh_sql(),
    "feature_match": f"""WITH e AS (SELECT vec_id AS pid, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS f FROM embeddings),
p AS (SELECT a.pid AS source, b.pid AS target, list_sum(list_transform(list_zip(a.f, b.f), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM e a JOIN e b ON a.pid % 2 = 0 AND b.pid % 2 = 1)
SELECT source, target, round(sqrt(d2), 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY d2, target) AS k FROM p) WHERE k = 1""",
}
SQL["nearest_correspondence"] = f"SELECT cloud_id, pid, neighbor, {r6('sqrt(d2)', 'distance')} FROM {_knn(EMBEDDINGS, moved(EMBEDDINGS, POSE), 1, 'TRUE')} WHERE d2 <= 0.1::DOUBLE * 0.1::DOUBLE"
_SCAN_COV = {"cxx": "xx", "cxy": "xy", "cxz": "xz", "cyy": "yy", "cyz": "yz", "czz": "zz"}
SQL["scan_nearest_correspondence"] = f"SELECT cloud_id, pid, neighbor, {r6('sqrt(d2)', 'distance')} FROM {_knn(SCANS, moved(SCANS, POSE), 1, 'abs(a.x - b.x) <= 0.1::DOUBLE')} WHERE d2 <= 0.1::DOUBLE * 0.1::DOUBLE"
SQL["scan_gicp_covariances"] = f"SELECT cloud_id, pid, {', '.join(r6(f'covar_samp({ab[1]}, {ab[0]}) + {0.0001 if ab[0] == ab[1] else 0}::DOUBLE', c, 9) for c, ab in _SCAN_COV.items())} FROM (SELECT cloud_id, pid, bx AS x, by_ AS y, bz AS z FROM {_knn(SCANS, SCANS, 12, 'TRUE')}) GROUP BY cloud_id, pid"
SQL["scan_surface_variation"] = f"SELECT cloud_id, pid, {r6('CASE WHEN e_min + e_mid + e_max > 0 THEN greatest(e_min, 0) / (e_min + e_mid + e_max) ELSE 0 END', 'curvature')} FROM {staged_sql(_covariance(_knn(SCANS, SCANS, 10), SCANS), EIGENVALUES)}"
SQL["scan_euclidean_clusters"] = f"""WITH RECURSIVE c AS (
  SELECT cloud_id, pid, x, y, z, CAST(floor(x / 0.3005) AS INT) AS cx, CAST(floor(y / 0.3005) AS INT) AS cy FROM {SCANS}),
n AS (SELECT cloud_id, pid, x, y, z, cx + i AS cx, cy + j AS cy FROM c, range(-1, 2) a(i), range(-1, 2) b(j)),
e AS (
  SELECT c.cloud_id, c.pid AS u, n.pid AS v FROM c JOIN n ON c.cloud_id = n.cloud_id AND c.cx = n.cx AND c.cy = n.cy
  WHERE c.pid <> n.pid AND (c.x - n.x) * (c.x - n.x) + (c.y - n.y) * (c.y - n.y) + (c.z - n.z) * (c.z - n.z) <= 0.3005 * 0.3005),
r(cloud_id, u, root) AS (
  SELECT cloud_id, pid, pid FROM c UNION SELECT e.cloud_id, e.v, r.root FROM r JOIN e ON r.cloud_id = e.cloud_id AND r.u = e.u WHERE e.v > r.root),
l AS (SELECT cloud_id, u AS pid, min(root) AS root FROM r GROUP BY cloud_id, u),
s AS (SELECT cloud_id, root, count(*) AS size FROM l GROUP BY cloud_id, root HAVING count(*) >= 3),
k AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY size DESC, root) - 1 AS cluster_id FROM s)
SELECT l.cloud_id, l.pid, CAST(k.cluster_id AS INT) AS cluster_id, k.size FROM l JOIN k ON l.cloud_id = k.cloud_id AND l.root = k.root"""
