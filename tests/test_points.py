from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from pointlake import schema
from pointlake.operators import features, filters, ground, neighbors, normals, segmentation, transforms, voxel
from pointlake.operators.chains import chain_clusters
from pointlake.plans import components as graph

CLOUD = "cloud_id string, pid bigint, x double, y double, z double"


def cloud(spark, points, cloud_id="c"):
    return spark.createDataFrame([(cloud_id, i, *map(float, p)) for i, p in enumerate(points)], CLOUD)


@pytest.fixture(scope="module")
def random100(spark):
    points = np.random.default_rng(1).uniform(-10, 10, (100, 3))
    return points, cloud(spark, points)


def test_voxel_of_two_points_is_their_mean(spark):
    row = voxel.voxel_downsample(cloud(spark, [(0.1, 0, 0), (0.3, 0, 0)]), 1.0).first()
    assert row.x == pytest.approx(0.2) and row.n == 2


def test_voxel_anchors_differ(spark):
    c = cloud(spark, [(0.6, 0, 0), (1.2, 0, 0)])
    assert voxel.voxel_downsample(c, 1.0).count() == 1
    assert voxel.voxel_downsample(c, 1.0, anchor="zero").count() == 2


@pytest.mark.parametrize("size", [0, -1])
def test_bad_voxel_size(spark, size):
    with pytest.raises(ValueError):
        voxel.voxel_downsample(cloud(spark, []), size)


def test_empty_and_single_clouds(spark):
    empty, one = cloud(spark, []), cloud(spark, [(1, 2, 3)])
    assert voxel.voxel_downsample(empty, 1.0).count() == 0 and voxel.voxel_downsample(one, 1.0).count() == 1
    assert voxel.bounds(empty).count() == 0
    assert neighbors.knn(empty, empty, 3).count() == 0
    assert neighbors.knn(one, one, 3, exclude_self=True).count() == 0
    assert filters.statistical_outlier_removal(one, 5, 1.0).count() == 1
    assert chain_clusters(empty, 1.0).count() == 0


def test_ingestion_drops_unusable_rows_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("c", 1, 1.0, 1.0, 1.0), ("c", 1, 1.0, 1.0, 1.0), ("c", 2, nan, 1.0, 1.0), ("c", 3, None, 1.0, 1.0), ("c", None, 1.0, 1.0, 1.0), ("c", 4, inf, 1.0, 1.0)]
    tidy = schema.cloud(spark.createDataFrame(rows, CLOUD), "pid", "cloud_id")
    assert [r.pid for r in tidy.collect()] == [1]


@pytest.mark.parametrize("k", [1, 5, 99, 150])
def test_knn_equals_brute_force(random100, k):
    points, c = random100
    got = neighbors.knn(c, c, k, exclude_self=True).toPandas().sort_values(["pid", "rank"])
    d = np.linalg.norm(points[:, None] - points, axis=2)
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, : min(k, 99)]
    assert np.allclose(got.distance.to_numpy().reshape(want.shape), want)


def test_knn_of_a_straggler_and_ties(spark):
    c = cloud(spark, [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (1000, 0, 0)])
    got = neighbors.knn(c, c, 1, exclude_self=True).toPandas().set_index("pid").neighbor.to_dict()
    assert got == {0: 1, 1: 0, 2: 0, 3: 1}


def test_k_of_zero_and_negative_k(random100):
    assert neighbors.knn(random100[1], random100[1], 0).count() == 0
    with pytest.raises(ValueError):
        neighbors.knn(random100[1], random100[1], -1)


@pytest.mark.parametrize("radius", [2.0, 5.0, 0.0, -1.0])
def test_radius_equals_brute_force(random100, radius):
    points, c = random100
    d = np.linalg.norm(points[:, None] - points, axis=2)
    assert neighbors.radius_neighbors(c, c, radius).count() == ((d <= radius).sum() if radius > 0 else 0)


def test_neighbours_stay_within_their_cloud(spark):
    both = cloud(spark, [(0, 0, 0), (1, 0, 0)], "a").unionByName(cloud(spark, [(0, 0, 0), (1, 0, 0)], "b"))
    assert neighbors.knn(both, both, 5, exclude_self=True).count() == 4


def test_statistical_removal_drops_far_points(spark):
    lattice = np.array([(i, j, k) for i in range(6) for j in range(6) for k in range(6)]) * 0.1
    c = cloud(spark, [*lattice, (10, 10, 10), (-10, -10, -10)])
    kept = {r.pid for r in filters.statistical_outlier_removal(c, 5, 1.0).collect()}
    assert 216 not in kept and 217 not in kept and len(kept) > 150


@pytest.mark.parametrize("call", [lambda c: filters.radius_outlier_removal(c, 0, 1), lambda c: filters.radius_outlier_removal(c, 1, 0), lambda c: filters.statistical_outlier_removal(c, 0, 1), lambda c: filters.statistical_outlier_removal(c, 1, 0), lambda c: normals.estimate_normals(c, 2), lambda c: segmentation.ransac_plane(c, 0, 1), lambda c: segmentation.euclidean_clusters(c, 0), lambda c: features.spfh(c, 0)])
def test_bad_parameters(spark, call):
    with pytest.raises(ValueError):
        call(cloud(spark, [(0, 0, 0)]))


def test_normals_of_a_plane_face_the_viewpoint(spark):
    c = cloud(spark, [(i, j, 0) for i in range(5) for j in range(5)])
    n = normals.estimate_normals(c, 6).toPandas()
    assert np.allclose(n[["nx", "ny", "nz"]], [0, 0, 1]) and np.allclose(n.curvature, 0)
    down = normals.estimate_normals(c, 6, viewpoint=(0, 0, -5)).toPandas()
    assert np.allclose(down.nz, -1)


def test_descriptors_have_their_sizes_and_norms(spark):
    rng = np.random.default_rng(0)
    rows = [("c", i, *map(float, p), 0.0, 0.0, 1.0) for i, p in enumerate(rng.uniform(0, 1, (40, 3)))]
    c = spark.createDataFrame(rows, CLOUD + ", nx double, ny double, nz double")
    f = np.array(features.fpfh(c, 0.3, 5).toPandas().feature.tolist())
    assert f.shape == (40, 33) and np.allclose(f.reshape(40, 3, 11).sum(axis=2), 1)
    for shape, size in ((features.shot, 352), (features.unique_shape_context, 128)):
        d = np.array(shape(c, 0.4, 5).toPandas().feature.tolist())
        assert d.shape == (40, size) and np.allclose(np.linalg.norm(d, axis=1), 1)


@pytest.fixture
def most_rows(monkeypatch):
    """The numbers of rows of the scratch tables that are written."""
    from pointlake.plans import scratch

    seen, written = [], scratch.written

    def counted(*a, **k):
        out = written(*a, **k)
        seen.append(out.count())
        return out

    monkeypatch.setattr(scratch, "written", counted)
    return seen


def _crowd_and_rest():
    """A crowd, points with few others around, points far from all, and a cloud of few points."""
    rng = np.random.default_rng(6)
    a = np.r_[rng.normal(0, 0.05, (300, 3)), rng.uniform(-6, 6, (60, 3)), rng.uniform(-90, 90, (15, 3))].round(3)
    return [("a", a), ("b", rng.uniform(0, 50, (4, 3)).round(3))]


def _near(points: np.ndarray, i: int, k: int, radius: float) -> np.ndarray:
    d = np.linalg.norm(points - points[i], axis=1)
    d[i] = np.inf
    within = np.flatnonzero(d <= radius)
    return within if len(within) >= k else np.argsort(d, kind="stable")[: min(k, len(points) - 1)]


def test_normals_within_a_radius_write_no_pairs(spark, most_rows):
    clouds = _crowd_and_rest()
    rows = [(n, i, *map(float, p)) for n, points in clouds for i, p in enumerate(points)]
    c = spark.createDataFrame(rows, CLOUD).selectExpr("*", "pid * 2 as width", "'t' as left")
    got = {(r.cloud_id, r.pid): r for r in normals.estimate_normals(c, 5, 0.4).collect()}
    assert len(got) == len(rows) and max(most_rows) <= 2 * len(rows)
    for n, points in clouds:
        for i in range(len(points)):
            r, near = got[n, i], points[[*_near(points, i, 5, 0.4), i]]
            values, vectors = np.linalg.eigh(np.cov(near.T, bias=True))
            assert abs(abs(vectors[:, 0] @ (r.nx, r.ny, r.nz)) - 1) < 1e-6 and r.width == 2 * i and r.left == "t"
            assert r.curvature == pytest.approx(max(values[0], 0) / values.sum(), abs=1e-9)


def test_spfh_writes_no_pairs(spark, most_rows):
    rng = np.random.default_rng(7)
    rows = []
    for n, points in _crowd_and_rest():
        normal = rng.normal(size=points.shape)
        normal /= np.linalg.norm(normal, axis=1, keepdims=True)
        rows += [(n, i, *map(float, p), *map(float, v)) for i, (p, v) in enumerate(zip(points, normal))]
    rows[7] = (*rows[7][:5], None, None, None)
    c = spark.createDataFrame(rows, CLOUD + ", nx double, ny double, nz double")
    got = {(r.cloud_id, r.pid, r.bin): r.value for r in features.spfh(c, 0.4, 5).collect()}
    assert max(most_rows) <= 2 * len(rows)
    carry = ("x", "y", "z", "nx", "ny", "nz")
    near = neighbors.neighborhoods(c, 5, 0.4, carry).join(c.selectExpr("cloud_id", "pid", f"struct({', '.join(carry)}) as own"), ["cloud_id", "pid"])
    want = {(r.cloud_id, r.pid, r.bin): r.value for r in features._spfh(near).collect()}
    assert got == want and len({k[:2] for k in want}) == len(rows) - 1


def test_ransac_finds_the_plane(spark):
    rng = np.random.default_rng(2)
    flat = np.c_[rng.uniform(0, 1, (80, 2)), np.zeros(80)]
    inliers, plane = segmentation.segment_plane(cloud(spark, [*flat, *rng.uniform(1, 2, (20, 3))]), 0.01, 50)
    assert inliers.count() == 80 and abs(abs(plane[2]) - 1) < 1e-9
    with pytest.raises(ValueError):
        segmentation.ransac_plane(cloud(spark, [(0, 0, 0)]), 0.1, 5)


def test_ransac_sends_no_candidates_to_all_tasks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"c{i % 150}", i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 1, (1500, 3)).round(3))]
    c = spark.createDataFrame(rows, CLOUD)
    monkeypatch.setattr(segmentation, "CHUNK", 400)
    spark.conf.set("spark.sql.maxBroadcastTableSize", "48m")
    try:
        got = {r.cloud_id: r for r in segmentation.ransac_plane(c, 0.1, 2000, seed=0).collect()}
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert len(got) == 150
    for name, r in got.items():
        own = [p for n, _, *p in rows if n == name]
        assert sum(abs(r.a * x + r.b * y + r.c * z + r.d) <= 0.1 for x, y, z in own) == r.inliers >= 3


def test_chain_clusters_equal_brute_force_also_when_blocks_are_cut(spark, monkeypatch):
    import pointlake.operators.chains as chains

    rng = np.random.default_rng(3)
    points = np.round(np.r_[rng.uniform(0, 6, (300, 3)), rng.normal(3, 0.2, (150, 3))], 3)
    rows = [("c", int(i * 7 + 3), *map(float, p)) for i, p in enumerate(points)]
    c = spark.createDataFrame([*rows, *rows[:40], ("c", 5000, 1.0, None, 1.0), ("c", 5001, float("nan"), 1.0, 1.0)], CLOUD)
    d = np.linalg.norm(points[:, None] - points, axis=2)
    a, b = np.nonzero(d <= 0.5)
    own = graph.labels(len(points), a, b)
    want = {(i * 7 + 3, int(own[i]) * 7 + 3) for i in range(len(points)) if (own == own[i]).sum() >= 4}
    for most in (200_000, 30):
        monkeypatch.setattr(chains, "BLOCK_ROWS", most)
        assert {(r.pid, r.cluster_pid) for r in chain_clusters(c, 0.5, smallest=4).collect()} == want


def test_points_at_one_place_are_one_cluster(spark):
    c = cloud(spark, [(1, 1, 1)] * 12)
    assert {(r.pid, r.cluster_pid) for r in chain_clusters(c, 0.1, smallest=10).collect()} == {(i, 0) for i in range(12)}


def test_components_by_contraction(spark, monkeypatch):
    monkeypatch.setattr(graph, "LOCAL_EDGES", 3)
    path = [("g", i, i + 1) for i in range(40)] + [("g", 100, 101), ("h", 1, 2), ("h", None, 5), ("h", 7, 7)]
    got = {(r.k, r.node): r.root for r in graph.components(spark.createDataFrame(path, "k string, u bigint, v bigint"), ["k"]).collect()}
    assert got == {**{("g", i): 0 for i in range(41)}, ("g", 100): 100, ("g", 101): 100, ("h", 1): 1, ("h", 2): 1}


def test_clusters_are_numbered_by_size(spark):
    c = cloud(spark, [(0, 0, 0), (0.1, 0, 0), (5, 0, 0), (5.1, 0, 0), (5.2, 0, 0), (9, 9, 9)])
    got = {r.pid: r.cluster_id for r in segmentation.euclidean_clusters(c, 0.15, 2, 10).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0}


def test_ground_is_found_below_the_sensor(spark):
    rng = np.random.default_rng(4)
    floor = np.c_[rng.uniform(-8, 8, (6000, 2)), rng.normal(-1.723, 0.01, 6000)]
    high = np.c_[rng.uniform(-8, 8, (60, 2)), rng.uniform(0, 1, 60)]
    got = ground.segment_ground(cloud(spark, [*floor, *high])).toPandas().set_index("pid").is_ground
    assert got[:6000].mean() > 0.7 and not got[6000:].any()
    with pytest.raises(ValueError):
        ground.GroundConfig(radii=(0.0, 2.0))


def test_transforms(spark):
    m = transforms.compose(transforms.translation(1, 2, 3), transforms.rotation((0, 0, 1), np.pi / 2))
    assert transforms.is_identity(m @ transforms.inverse(m)) and transforms.inverse(np.zeros((4, 4))) is None
    row = transforms.transform_points(cloud(spark, [(1, 0, 0)]), m).first()
    assert (row.x, row.y, row.z) == pytest.approx((1, 3, 3))
    flat = np.eye(4)
    flat[3] = [1, 0, 0, 0]
    assert [r.x for r in transforms.transform_points(cloud(spark, [(0, 5, 0), (2, 4, 0)]), flat).orderBy("pid").collect()] == [0.0, 1.0]
    assert transforms.range_filter(cloud(spark, [(1, 0, 0), (2, 0, 0), (3, 0, 0)]), 1, 2).count() == 2


def test_extra_columns_do_not_disturb(spark):
    c = cloud(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0)])
    odd = c.selectExpr("*", "1 as n", "'a' as neighbor", "2.5 as distance", "3 as rank", "4 as d2", "5 as label", "6 as home", "7 as count")
    assert neighbors.knn(odd, odd, 1, exclude_self=True).count() == 3
    assert chain_clusters(odd, 1.5).count() == 3
    assert filters.radius_outlier_removal(odd, 1.5, 1).count() == 3
    assert voxel.voxel_downsample(odd, 10).first().n == 3


def test_matches_of_descriptors(spark):
    s = spark.createDataFrame(pd.DataFrame({"pid": [1, 2, 3], "feature": [[0.0, 0.0], [1.0, 1.0], None]}), "pid bigint, feature array<double>")
    t = spark.createDataFrame([(10, [0.1, 0.0]), (11, [0.9, 1.0]), (12, [0.1, 0.0])], "pid bigint, feature array<double>")
    assert {(r.source, r.target) for r in neighbors.feature_matches(s, t).collect()} == {(1, 10), (2, 11)}
