from __future__ import annotations

import numpy as np
import pytest

from pointlake.functions.grid import Grid
from pointlake.operators import filters, neighbors
from pointlake.plans import blocks

CLOUD = "cloud_id string, pid bigint, x double, y double, z double, tag string"


def brute(members, queries, k, exclude_self=False, exclude_place=False, limit=np.inf):
    out = set()
    for cid, pid, *xyz, _ in queries:
        near = []
        for other, p, *at, _ in members:
            d2 = sum((a - b) * (a - b) for a, b in zip(at, xyz))
            if other == cid and not (exclude_self and p == pid) and not (exclude_place and d2 == 0) and d2 <= limit * limit:
                near.append((d2, p))
        out |= {(cid, pid, p, round(d2**0.5, 9), n + 1) for n, (d2, p) in enumerate(sorted(near)[:k])}
    return out


def rows(seed=0):
    rng = np.random.default_rng(seed)
    out = [("dense", i, *np.round(rng.normal(0, 0.3, 3), 3).tolist(), f"t{i}") for i in range(260)]
    out += [("dense", 300 + i, *np.round(rng.uniform(-40, 40, 3), 3).tolist(), None) for i in range(12)]
    out += [("place", i, 1.0, 2.0, 3.0, None) for i in range(60)] + [("place", 60 + i, 1.0 + i, 2.0, 3.0, None) for i in range(4)]
    return out + [("lone", 1, 0.0, 0.0, 0.0, None), ("two", 1, 0.0, 0.0, 0.0, None), ("two", 2, 1e9, 0.0, 0.0, None)]


def got(df):
    return {(r.cloud_id, r.pid, r.neighbor, round(r.distance, 9), r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("way", ["held", "blocks", "cut", "rounds"])
def test_k_nearest_by_every_way(spark, monkeypatch, way):
    if way != "held":
        monkeypatch.setattr(neighbors, "SMALL", 0)
    if way == "cut":
        monkeypatch.setattr(neighbors, "BLOCK_ROWS", 20)
    if way == "rounds":
        monkeypatch.setattr(neighbors, "FEW", 0)
        monkeypatch.setattr(neighbors, "SPAN", 2)
    cloud = spark.createDataFrame(rows(), CLOUD)
    assert got(neighbors.knn(cloud, cloud, 3, exclude_self=True)) == brute(rows(), rows(), 3, True)
    some = [r for r in rows() if r[1] % 5 == 0] + [("none", 1, 0.0, 0.0, 0.0, None)]
    asked = spark.createDataFrame(some, CLOUD)
    assert got(neighbors.knn(asked, cloud, 4, exclude_place=True, max_distance=0.5)) == brute(rows(), some, 4, False, True, 0.5)
    carried = neighbors.knn(asked, cloud, 1, carry=("tag", "x")).where("cloud_id = 'dense' AND pid < 260").collect()
    assert carried and all(r.to.tag == f"t{r.neighbor}" for r in carried)
    assert neighbors.knn(cloud.limit(0), cloud, 2).count() == 0 == neighbors.knn(cloud, cloud.limit(0), 2).count() == neighbors.knn(cloud, cloud, 0).count()


def test_counts_within_a_radius(spark, monkeypatch):
    cloud = spark.createDataFrame(rows(), CLOUD)
    want = {(c, p): sum(o == c and sum((a - b) ** 2 for a, b in zip(at, xyz)) <= 0.25 * 0.25 for o, _, *at, _ in rows()) for c, p, *xyz, _ in rows()}
    for most in (100_000, 20):
        monkeypatch.setattr(blocks, "BLOCK_ROWS", most)
        assert {(r.cloud_id, r.pid): r.n for r in filters.radius_counts(cloud, 0.25).collect()} == want


def test_grid_of_far_and_crowded_points():
    rng = np.random.default_rng(1)
    xyz = np.concatenate([rng.normal(0, 1e-6, (200, 3)), rng.normal(0, 1, (50, 3)), [[1e7, 0, 0]]])
    pid = np.arange(len(xyz))
    q, m, d2, done = Grid(np.zeros(len(xyz), int), xyz, pid, np.array([1.0])).nearest(np.zeros(len(xyz), int), xyz, 4, pid)
    assert done.all()
    for i in range(len(xyz)):
        all_d2 = ((xyz - xyz[i]) ** 2).sum(axis=1)
        best = [j for j in np.lexsort((pid, all_d2)) if j != i][:4]
        assert np.allclose(np.sort(d2[q == i]), all_d2[best], rtol=1e-9)
