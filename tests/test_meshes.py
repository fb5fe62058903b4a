from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointlake.catalog.meshes import grid_faces, grid_vertices
from pointlake.catalog.surfaces import _boxes
from pointlake.operators import mesh, simplify, surfaces, volumes

V = "mesh_id string, vid bigint, x double, y double, z double"
FACE = "mesh_id string, fid bigint, a bigint, b bigint, c bigint"


@pytest.fixture(scope="module")
def tetrahedron(spark):
    v = spark.createDataFrame([("t", i, *map(float, p)) for i, p in enumerate([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)])], V)
    return v, spark.createDataFrame([("t", i, *f) for i, f in enumerate([(0, 2, 1), (0, 1, 3), (1, 2, 3), (0, 3, 2)])], FACE)


@pytest.fixture(scope="module")
def sheet(spark):
    return grid_vertices(spark, 9), grid_faces(spark, 9)


def sphere(spark, n=14):
    lattice = volumes.Lattice.around((-1, -1, -1), (1, 1, 1), (n, n, n))
    return volumes.triangle_mesh(volumes.isosurface(volumes.sphere_volume(spark, (0, 0, 0), 0.7, lattice), lattice), "s")


def test_topology_of_a_tetrahedron(tetrahedron):
    _, f = tetrahedron
    assert mesh.boundary_edges(f).count() == 0 and mesh.adjacency(f).count() == 12
    assert {r.valence for r in mesh.valence(f).collect()} == {3}
    assert mesh.twins(f).where("twin IS NULL").count() == 0
    assert mesh.feature_vertices(*tetrahedron, angle=0.5).count() == 4


def test_normals_point_outwards(tetrahedron):
    n = mesh.face_normals(*tetrahedron).toPandas().set_index("fid")
    assert np.allclose(n.loc[0, ["nx", "ny", "nz"]].astype(float), [0, 0, -1])
    assert np.allclose(np.linalg.norm(mesh.vertex_normals(*tetrahedron).toPandas()[["nx", "ny", "nz"]], axis=1), 1)


def test_degenerate_and_missing_faces(spark):
    v = spark.createDataFrame([("m", 0, 0.0, 0.0, 0.0), ("m", 1, 1.0, 0.0, 0.0), ("m", 2, 2.0, 0.0, 0.0)], V)
    f = spark.createDataFrame([("m", 0, 0, 1, 2), ("m", 1, 0, 1, 1), ("m", 2, 0, 1, 9)], FACE)
    assert mesh.face_normals(v, f.limit(1)).first().nx is None
    assert {(r.fid, r.problem) for r in mesh.invalid_faces(v, f).collect()} == {(1, "repeated"), (2, "missing")}


def test_smoothing_keeps_flat_meshes_flat_and_checks_parameters(spark, sheet):
    v, f = sheet
    flat = v.withColumn("z", F.lit(0.0))
    for smooth in (mesh.smooth_laplacian, mesh.smooth_taubin, mesh.smooth_hc):
        out = smooth(flat, f, 2).toPandas()
        assert len(out) == 81 and np.allclose(out.z, 0)
        assert smooth(flat, f, 0).count() == 81
    with pytest.raises(ValueError):
        mesh.smooth_laplacian(v, f, 1, 0.0)
    with pytest.raises(ValueError):
        mesh.smooth_taubin(v, f, 1, 0.5, -0.1)
    lone = v.unionByName(spark.createDataFrame([("grid", 999, 5.0, 5.0, 5.0)], V))
    assert mesh.smooth_laplacian(lone, f, 1).where("vid = 999").first().x == 5.0


@pytest.mark.parametrize("kind", ["centroid", "valence", "error"])
def test_clustering_shrinks_the_mesh(sheet, kind):
    v, f = mesh.simplify_clustering(*sheet, 0.6, kind)
    assert 0 < v.count() < 81 and 0 < f.count() < 128
    assert mesh.invalid_faces(v, f).count() == 0


def test_clustering_edges(sheet):
    v, f = mesh.simplify_clustering(*sheet, 0.0)
    assert v.count() == 81 and f.count() == 128
    with pytest.raises(ValueError):
        mesh.simplify_clustering(*sheet, 1.5)


@pytest.mark.parametrize("simple", [simplify.simplify_quadric, simplify.simplify_edge_collapse])
def test_collapsing_reaches_its_target_and_stays_closed(spark, simple):
    v, f = sphere(spark)
    n = f.count()
    sv, sf = simple(v, f, 0.5)
    assert sf.count() <= n / 2 + 1 and mesh.boundary_edges(sf).count() == 0 and mesh.invalid_faces(sv, sf).count() == 0
    with pytest.raises(ValueError):
        simple(v, f, 2.0)


def test_progressive_mesh_restores_the_mesh(spark, sheet):
    v, f = sheet
    p = simplify.ProgressiveMesh.of(v, f, 0.2)
    points, faces = p.at_level(p.levels)
    assert {i: tuple(t) for i, t in faces.items()} == {r.fid: (r.a, r.b, r.c) for r in f.collect()}
    assert all(np.allclose(points[r.vid], [r.x, r.y, r.z]) for r in v.collect())
    again = simplify.ProgressiveMesh.from_bytes(p.to_bytes())
    assert again.at_ratio(0.5) == p.at_ratio(0.5) and len(p.detail_chain(3)) == 3 and len(p.detail_chain(3)[2][1]) == len(p.faces)


def volume(t):
    return float(np.einsum("ni,ni->n", t[:, 0], np.cross(t[:, 1], t[:, 2])).sum() / 6)


@pytest.mark.parametrize("low,high,want", [((1, 1, 1), (3, 3, 3), (15, 1, 7)), ((0, 0, 2), (2, 2, 3), (12, 0, 8)), ((0.5, 0.5, 0), (1.5, 1.5, 2), (8, 2, 6)), ((5, 5, 5), (6, 6, 6), (9, 0, 8)), ((0, 0, 0), (2, 2, 2), (8, 8, 0))])
def test_boolean_volumes(low, high, want):
    def box(a, b):
        p = np.array([[x, y, z] for x in (a[0], b[0]) for y in (a[1], b[1]) for z in (a[2], b[2])], float)
        return p, np.array([[0, 1, 3], [0, 3, 2], [4, 6, 7], [4, 7, 5], [0, 4, 5], [0, 5, 1], [2, 3, 7], [2, 7, 6], [0, 2, 6], [0, 6, 4], [1, 5, 7], [1, 7, 3]])

    got = [volume(simplify.boolean_triangles(box((0, 0, 0), (2, 2, 2)), box(low, high), k)) for k in ("union", "intersection", "difference")]
    assert got == pytest.approx(want)


def test_boolean_of_tables(spark):
    t = simplify.mesh_boolean(_boxes(spark, 0, 2), _boxes(spark, 1, 3), "intersection").collect()
    assert volume(np.array([[list(r[c]) for c in "abc"] for r in t])) == pytest.approx(1)


def test_isosurface_is_closed_for_any_values(spark):
    g = np.random.default_rng(5).normal(size=(7, 7, 7))
    for axis in range(3):
        np.moveaxis(g, axis, 0)[[0, -1]] = 1
    i, j, k = (x.ravel().astype("int32") for x in np.indices(g.shape))
    grid = spark.createDataFrame(pd.DataFrame({"i": i, "j": j, "k": k, "value": g.ravel()}))
    lattice = volumes.Lattice((0, 0, 0), (1, 1, 1), g.shape)
    _, faces = volumes.triangle_mesh(volumes.isosurface(grid, lattice))
    assert faces.count() > 50 and mesh.twins(faces).where("twin IS NULL").count() == 0


def test_volume_of_a_sphere(spark):
    lattice = volumes.Lattice.around((-1, -1, -1), (1, 1, 1), (24, 24, 24))
    t = volumes.isosurface(volumes.sphere_volume(spark, (0, 0, 0), 0.7, lattice), lattice).toPandas()
    corners = np.array([[list(r) for r in row] for row in t[["a", "b", "c"]].itertuples(index=False)])
    assert volume(corners) == pytest.approx(4 / 3 * np.pi * 0.343, rel=0.03)
    assert volumes.isosurface(volumes.sphere_volume(spark, (0, 0, 0), 5.0, lattice), lattice).count() == 0


def test_unsigned_distance_needs_a_positive_level(spark):
    c = spark.createDataFrame([("c", 0, 0.0, 0.0, 0.0), ("c", 1, 1.0, 0.0, 0.0)], "cloud_id string, pid bigint, x double, y double, z double")
    grid, lattice = volumes.distance_grid(c, (8, 8, 8), 0.5)
    assert volumes.isosurface(grid, lattice, 0.0).count() == 0 and volumes.isosurface(grid, lattice, 0.3).count() > 0
    with pytest.raises(ValueError):
        volumes.mls_surface(c)


def test_depth_images(spark):
    d = spark.createDataFrame([(0, 0, 1000), (0, 1, 0), (1, 0, None)], "row int, col int, d int")
    camera = volumes.Camera(100, 100, 0.5, 0.5, 2, 2)
    rows = {(r.row, r.col): r for r in volumes.depth_to_cloud(d, camera).collect()}
    assert rows[0, 0].z == 1.0 and rows[0, 0].x == -0.005 and rows[0, 1].x is None and rows[1, 0].z is None
    assert volumes.valid_points(volumes.depth_to_cloud(d, camera)).count() == 1 and not volumes.is_dense(volumes.depth_to_cloud(d, camera)).first().is_dense


def test_delaunay_circles_are_empty():
    p = np.random.default_rng(6).uniform(0, 1, (60, 2))
    p = np.r_[p, p[:3]]
    t = surfaces.delaunay_indices(p)
    a, b, c = (p[t[:, i]] for i in range(3))
    u, v = b - a, c - a
    assert ((u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]) > 0).all()
    d = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    o = np.stack([(v[:, 1] * (u**2).sum(1) - u[:, 1] * (v**2).sum(1)) / d, (u[:, 0] * (v**2).sum(1) - v[:, 0] * (u**2).sum(1)) / d], 1)
    for center, r2 in zip(a + o, (o**2).sum(1)):
        assert (((p - center) ** 2).sum(1) >= r2 * (1 - 1e-9)).all()
    assert len(surfaces.delaunay_indices(p[:2])) == 0


def test_surfaces_of_points(spark):
    t = np.arange(400)
    h = 1 - 2 * (t + 0.5) / 400
    r, a = np.sqrt(1 - h * h), t * 2.399963229728653
    p = pd.DataFrame({"cloud_id": "s", "pid": t, "x": r * np.cos(a), "y": r * np.sin(a), "z": h})
    c = spark.createDataFrame(p)
    grown = surfaces.ball_pivoting(c, (0.2, 0.3)).toPandas()
    edges = pd.concat([grown[[u, v]].set_axis(["u", "v"], axis=1) for u, v in ("ab", "bc", "ca")])
    assert len(grown) > 100 and edges.apply(sorted, axis=1).map(tuple).value_counts().max() <= 2
    assert surfaces.alpha_triangles(c, 0.3, "full").count() > 400
    oriented = c.withColumns({"nx": F.col("x"), "ny": F.col("y"), "nz": F.col("z")})
    v, f = surfaces.poisson(oriented, 5)
    distance = v.toPandas()[["x", "y", "z"]].pow(2).sum(axis=1).pow(0.5)
    assert abs(distance.mean() - 1) < 0.05 and mesh.boundary_edges(f).count() == 0
    name, _, faces = surfaces.reconstruct(c, preferred="delaunay")
    assert name == "delaunay" and faces.count() > 0
    with pytest.raises(ValueError):
        surfaces.poisson(c)


def test_choice_of_an_algorithm():
    few = surfaces.Character(50, False, 0.5, 0.5, 0.1, 0.05)
    assert surfaces.choose(few, "fast") == "delaunay"
    assert surfaces.choose(surfaces.Character(5000, True, 0.9, 0.01, 0.1, 0.9), "high") == "poisson"


def test_fusion_saturates_and_ignores_black(spark):
    lattice = volumes.Lattice((0, 0, 0.9), (0.1, 0.1, 0.1), (1, 1, 3))
    camera = volumes.Camera(10, 10, 0, 0, 1, 1)
    depth = spark.createDataFrame([(0, 0, 1.0)], "row int, col int, d double")
    black = spark.createDataFrame([(0, 0, 0, 0, 0)], "row int, col int, r int, g int, b int")
    red = spark.createDataFrame([(0, 0, 200, 0, 0)], "row int, col int, r int, g int, b int")
    v = volumes.tsdf_volume(spark, lattice)
    for color in (red, black, black):
        v = volumes.tsdf_integrate(v, lattice, depth, camera, np.eye(4), 0.15, max_weight=2, color=color)
    rows = {r.k: r for r in v.collect()}
    assert rows[0].weight == 2 and rows[0].tsdf == pytest.approx(0.1) and rows[2].tsdf == pytest.approx(-0.1) and rows[0].r == 200


def test_reconstruct_leaves_mls_its_defaults(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(surfaces.volumes, "mls_surface", lambda *a, **k: asked.append((a[2:], k)) or (cloud, spark.createDataFrame([("m", 0, 1, 2, 3)], "mesh_id string, fid bigint, a bigint, b bigint, c bigint")))
    cloud = spark.createDataFrame([("c", i, float(i % 3), float(i // 3), 0.0, 0.0, 0.0, 1.0) for i in range(9)], "cloud_id string, pid bigint, x double, y double, z double, nx double, ny double, nz double")
    assert [surfaces.reconstruct(cloud, preferred=name)[0] for name in ("mls", "marching_cubes")] == ["mls", "marching_cubes"]
    assert asked == [((), {})] * 2


def test_the_character_of_clouds(spark):
    rng = np.random.default_rng(3)
    u = rng.normal(0, 1, (300, 3))
    ball = u / np.linalg.norm(u, axis=1)[:, None]
    tube = np.column_stack([np.cos(rng.uniform(0, 6.28, 300)), np.sin(rng.uniform(0, 6.28, 300)), rng.uniform(-4, 4, 300)])
    tube[:, :2] /= np.linalg.norm(tube[:, :2], axis=1)[:, None]
    flat = np.column_stack([rng.uniform(0, 1, (300, 2)), np.zeros(300)])
    about = {}
    for name, p in (("spherical", ball), ("cylindrical", tube), ("planar", flat), ("arbitrary", rng.uniform(0, 1, (300, 3)))):
        about[name] = surfaces.analyze(spark.createDataFrame([(name, i, *map(float, q)) for i, q in enumerate(p)], "cloud_id string, pid bigint, x double, y double, z double"))
        assert about[name].distribution == name
    assert about["spherical"].closed and not about["planar"].closed
    assert about["planar"].complexity < 1e-6 < about["spherical"].complexity < about["arbitrary"].complexity
    assert surfaces.choose(about["planar"], "fast") in ("delaunay", "ball_pivoting")
    two = spark.createDataFrame([("a", 0, 0.0, 0.0, 0.0), ("b", 0, 1.0, 0.0, 0.0)], "cloud_id string, pid bigint, x double, y double, z double")
    for call in (surfaces.analyze, surfaces.poisson_grid):
        with pytest.raises(ValueError):
            call(two.withColumns({f"n{c}": F.lit(1.0) for c in "xyz"}))
    with pytest.raises(ValueError):
        surfaces.poisson_grid(two, 9)


def test_normals_of_an_isosurface_and_slopes_of_a_field(spark):
    lattice = volumes.Lattice.around((-1, -1, -1), (1, 1, 1), (14, 14, 14))
    rows = volumes.isosurface(volumes.sphere_volume(spark, (0, 0, 0), 0.7, lattice), lattice, normals=True).collect()
    at = np.array([[r.a.x, r.a.y, r.a.z, r.a.nx, r.a.ny, r.a.nz] for r in rows])
    assert np.allclose((at[:, 3:] * at[:, :3] / np.linalg.norm(at[:, :3], axis=1)[:, None]).sum(axis=1), 1, atol=0.02)
    vertices, faces = volumes.triangle_mesh(volumes.isosurface(volumes.sphere_volume(spark, (0, 0, 0), 0.7, lattice), lattice, normals=True))
    n, m = vertices.count(), faces.count()
    assert {"nx", "ny", "nz"} <= set(vertices.columns) and n - m // 2 == 2  # a closed surface
    flat = spark.createDataFrame([("c", 10 * i + j, i / 10, j / 10, 0.0, 0.0, 0.0, 1.0) for i in range(10) for j in range(10)], V.replace("mesh_id", "cloud_id").replace("vid", "pid") + ", nx double, ny double, nz double")
    ask = spark.createDataFrame([("c", 0, 0.5, 0.5, 0.05), ("c", 1, 9.0, 9.0, 9.0)], V.replace("mesh_id", "cloud_id").replace("vid", "pid"))
    got = {r.pid: r for r in volumes.mls_field(ask, flat, 0.4, "linear", gradient=True).collect()}
    assert abs(abs(got[0].value) - 0.05) < 1e-3 and (got[1].value, got[1].gx, got[1].gz) == (0.0, 0.0, 0.0)


def test_balls_of_the_clouds_own_size_and_the_fallback(spark):
    points = [("wide", 10 * i + j, 5.0 * i, 5.0 * j, 0.0) for i in range(6) for j in range(6)] + [("fine", 10 * i + j, 0.01 * i, 0.01 * j, 0.0) for i in range(6) for j in range(6)]
    c = spark.createDataFrame(points, V.replace("mesh_id", "cloud_id").replace("vid", "pid"))
    assert {r.cloud_id for r in surfaces.ball_pivoting(c, None).select("cloud_id").distinct().collect()} == {"wide", "fine"}
    assert surfaces.ball_pivoting(c, (0.02,)).where("cloud_id = 'wide'").count() == 0
    assert surfaces.ball_pivoting(c, (0.02,), fallback=True).where("cloud_id = 'wide'").count() == 50
