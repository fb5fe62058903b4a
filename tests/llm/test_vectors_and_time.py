from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointlake.llm import clusters, similar_vectors
from pointlake.llm.nearest_time import nearest_in_time, topic_key

AXES = ["a", "b", "c", "d"]


def vectors(spark, rows, cloud="k"):
    p = pd.DataFrame(rows, columns=AXES).astype(float)
    p.insert(0, "pid", np.arange(len(p)))
    p.insert(0, "cloud_id", cloud)
    return spark.createDataFrame(p, "cloud_id string, pid bigint, a double, b double, c double, d double")


def brute(points, queries, k):
    d = np.linalg.norm(points[queries][:, None] - points, axis=2)
    d[np.arange(len(queries)), queries] = np.inf
    return {(int(q), int(n)) for q, row in zip(queries, d) for n in np.lexsort((np.arange(len(points)), row))[:k] if np.isfinite(row[n])}


@pytest.mark.parametrize("tables,probes", [(1, 4), (2, 4), (2, 3)])
def test_recall(spark, tables, probes):
    points = np.random.default_rng(0).normal(0, [20, 20, 1, 1], (3000, 4))
    base = vectors(spark, points)
    got = similar_vectors.nearest_vectors(base, base.where("pid % 20 = 0"), AXES, 10, tables=tables, probes=probes, bucket_rows=150).collect()
    want = brute(points, np.arange(0, 3000, 20), 10)
    hit = {(r.pid, r.neighbour) for r in got} & want
    assert len(got) == len(want) and len(hit) / len(want) >= (0.98 if probes == 4 else 0.9)
    assert {r.rank for r in got} == set(range(1, 11))


def test_hot_buckets_are_cut_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(similar_vectors, "BUCKET_MOST", 50)
    points = np.random.default_rng(1).normal(0, 1, (400, 4))
    base = vectors(spark, points)
    got = {(r.pid, r.neighbour) for r in similar_vectors.nearest_vectors(base, base, AXES, 5, bucket_rows=1000).collect()}
    assert got == brute(points, np.arange(400), 5)


def test_equal_vectors_ties_and_copies(spark):
    base = vectors(spark, [(1, 1, 1, 1)] * 4 + [(9, 9, 9, 9)])
    got = similar_vectors.nearest_vectors(base.unionAll(base), base.unionAll(base), AXES, 2).collect()
    near = {}
    for r in got:
        near.setdefault(r.pid, []).append(r.neighbour)
    assert {k: sorted(v) for k, v in near.items()} == {0: [1, 2], 1: [0, 2], 2: [0, 1], 3: [0, 1], 4: [0, 1]}


def test_nulls_small_keys_and_clashing_columns(spark):
    rows = [("k", 1, 0.0, 0.0, 0.0, 0.0), ("k", 2, 1.0, None, 0.0, 0.0), ("k", 3, float("nan"), 0.0, 0.0, 0.0), ("k", 4, 2.0, 0.0, 0.0, 0.0), ("m", 1, 0.0, 0.0, 0.0, 0.0), (None, 7, 0.0, 0.0, 0.0, 0.0)]
    base = spark.createDataFrame(rows, "cloud_id string, pid bigint, a double, b double, c double, d double").selectExpr("*", "1 as id", "2 as table", "3 as v0", "4 as n", "5 as rank", "6 as neighbour")
    got = {(r.cloud_id, r.pid, r.neighbour) for r in similar_vectors.nearest_vectors(base, base, AXES, 3).collect()}
    assert got == {("k", 1, 4), ("k", 4, 1)}
    empty = base.limit(0)
    assert similar_vectors.nearest_vectors(empty, empty, AXES, 3).count() == 0
    with pytest.raises(ValueError):
        similar_vectors.nearest_vectors(base, base, AXES, 0)


def test_kmeans_finds_separate_groups(spark):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(m, 0.1, (60, 4)) for m in (0, 10, 20, 30)])
    records = vectors(spark, points).selectExpr("*", "1 as cluster", "2 as f")
    members, found = clusters.similarity_clusters(records.unionAll(records.limit(10)), ["cloud_id", "pid"], dict.fromkeys(AXES, 1.0), k=4, rounds=4)
    label = members.toPandas().set_index("pid").cluster
    assert len(label) == 240 and all(label[i * 60 : i * 60 + 59].nunique() == 1 for i in range(4)) and label.nunique() == 4
    rows = found.collect()
    assert sum(r.size for r in rows) == 240 and all(len(r.typical) == 3 and r.typical[0].distance <= r.typical[2].distance for r in rows)


def test_kmeans_of_nothing_and_of_equal_records(spark):
    empty = vectors(spark, np.empty((0, 4)))
    assert all(t.count() == 0 for t in clusters.similarity_clusters(empty, ["pid"], {"a": 1.0}, k=3))
    same = vectors(spark, [(1, 1, 1, 1)] * 9 + [(None,) * 4])
    sizes = [r.size for r in clusters.similarity_clusters(same, ["pid"], {"a": 1.0}, k=5)[1].collect()]
    assert sorted(sizes) == [1, 9]


def test_clusters_keep_to_clouds(spark, tmp_path):
    from pointlake.llm import catalog

    rng = np.random.default_rng(4)
    rows = [(f"c{c}", int(p), *map(float, rng.normal(0, 1, 3))) for c in range(40) for p in range(60 if c else 900)]
    df = spark.createDataFrame(rows, "cloud_id string, pid bigint, x double, y double, z double")
    df.unionAll(df.limit(9)).write.parquet(str(tmp_path / "cloud_normal.parquet"))
    found = catalog.p3_clusters(spark, str(tmp_path)).collect()
    assert all(t.cloud_id == r.cloud_id for r in found for t in r.typical)
    sizes = {}
    for r in found:
        sizes.setdefault(r.cloud_id, []).append(r["size"])
    assert {k: sum(v) for k, v in sizes.items()} == {f"c{c}": 60 if c else 900 for c in range(40)}
    assert {k: len(v) for k, v in sizes.items()} == {f"c{c}": 2 if c else 8 for c in range(40)}


def test_bodies_and_members_come_out(spark, tmp_path):
    from pointlake.llm import catalog

    rows = [(c, p, 0.1 * p + gap, 0.0, 0.0) for c in ("a", "b") for p, gap in [*((p, 0.0) for p in range(11)), *((p, 50.0) for p in range(11, 24)), (24, 900.0)]]
    df = spark.createDataFrame(rows, "cloud_id string, pid bigint, x double, y double, z double")
    df.unionAll(df.limit(9)).write.parquet(str(tmp_path / "cloud_normal.parquet"))
    queries = catalog.queries()
    bodies = {(r.cloud_id, r.cluster_pid): (r["size"], [t.pid for t in r.typical]) for r in queries["p3_bodies"](spark, str(tmp_path)).collect()}
    assert bodies.keys() == {(c, p) for c in "ab" for p in (0, 11)}
    assert all(n == (13 if p else 11) and t[0] == (17 if p else 5) and set(t) == ({16, 17, 18} if p else {4, 5, 6}) for (_, p), (n, t) in bodies.items())
    members = queries["p3_members"](spark, str(tmp_path)).collect()
    assert sorted((r.cloud_id, r.pid) for r in members) == sorted((c, p) for c in "ab" for p in range(25))
    sizes = {(r.cloud_id, r.cluster): r["size"] for r in queries["p3_clusters"](spark, str(tmp_path)).collect()}
    assert sizes == {k: sum((r.cloud_id, r.cluster) == k for r in members) for k in sizes} and sum(sizes.values()) == 50


BAG = "msg_id bigint, topic string, ts_ns bigint"
REF = "ref_id bigint, topic string, ts_ns bigint"


def matched(spark, left, right, tolerance=40, **kw):
    key = topic_key(F.col("topic"))
    return {(r.msg_id, r.ref_id) for r in nearest_in_time(spark.createDataFrame(left, BAG), spark.createDataFrame(right, REF), "msg_id", "ref_id", key, key, "ts_ns", tolerance, **kw).collect()}


@pytest.mark.parametrize("span", [2, 3, 512])
def test_nearest_time_equals_brute_force(spark, span):
    rng = np.random.default_rng(3)
    left = [(i, f"t{i % 3}", int(t)) for i, t in enumerate(rng.integers(-5000, 5000, 400))]
    right = [(i, f"T{i % 3} ", int(t)) for i, t in enumerate(rng.integers(-5000, 5000, 300))]
    want = set()
    for m, topic, t in left:
        near = sorted((abs(t - u), u, r) for r, k, u in right if k.strip().lower() == topic and abs(t - u) <= 40)
        if near:
            want.add((m, near[0][2]))
    assert matched(spark, left, right, span=span) == want


def test_ties_topics_nulls_and_limits(spark):
    right = [(1, "/A/b", 100), (2, "a/b/", 120), (3, None, 110), (4, "a/b", None), (1, "/A/b", 100), (5, " a/B", 200), (6, "/a/b", 200)]
    left = [(10, "a/b", 110), (10, "a/b", 110), (11, "/a/b/", 160), (12, "a/b", 161), (13, None, 100), (14, "a/b", None), (15, "a/b", 241), (16, "a/b", 2**63 - 1), (17, "other", 100)]
    assert matched(spark, left, right) == {(10, 1), (11, 2), (12, 5)}
    assert matched(spark, [], right) == set() and matched(spark, left, []) == set()
    assert matched(spark, left, right, tolerance=0) == set()


def test_seeding_and_rounds_come_near_to_full_k_means(spark):
    rng = np.random.default_rng(4)
    middle = rng.uniform(-50, 50, (12, 3))
    points = np.concatenate([m + rng.normal(0, 0.5, (40 + 10 * i, 3)) for i, m in enumerate(middle)])

    def lloyd(c):
        for _ in range(30):
            own = ((points[:, None] - c) ** 2).sum(2).argmin(1)
            c = np.array([points[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        return ((points[:, None] - c) ** 2).sum(2).min(1).sum()

    def plus():
        c = [points[rng.integers(len(points))]]
        while len(c) < 12:
            d2 = ((points[:, None] - np.array(c)) ** 2).sum(2).min(1)
            c.append(points[rng.choice(len(points), p=d2 / d2.sum())])
        return np.array(c)

    best = min(lloyd(plus()) for _ in range(8))
    random_ = np.mean([lloyd(points[rng.choice(len(points), 12, replace=False)]) for _ in range(8)])
    records = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "pid bigint, x double, y double, z double")
    members, found = clusters.similarity_clusters(records, ["pid"], dict.fromkeys("xyz", 1.0), k=12, dims=6)
    cost = sum(r.distance**2 for r in members.collect())
    rows = found.collect()
    assert cost <= 1.3 * best and cost < random_
    assert abs(sum(r["size"] * r.spread**2 for r in rows) - cost) < 1e-6 * cost and sum(r["size"] for r in rows) == len(points)


def test_far_values_take_part(spark):
    rows = [("c", i, float(10 ** (10 * i)), 0.0) for i in range(31)]
    df = spark.createDataFrame([*rows, ("c", 99, float("inf"), 0.0)], "cloud_id string, pid bigint, a double, b double")
    got = {(r.pid, r.neighbour) for r in similar_vectors.nearest_vectors(df, df, ["a", "b"], 1).collect()}
    assert {p for p, _ in got} == set(range(31)) and all(n == max(0, p - 1) or p == 0 for p, n in got)
    members, found = clusters.similarity_clusters(df.where("pid < 5"), ["pid"], {"a": 1.0}, k=5, dims=4)
    assert members.count() == 5 and sum(r["size"] for r in found.collect()) == 5


def test_an_id_with_two_times_gets_its_nearest_match(spark):
    left = spark.createDataFrame([(1, "t", 100), (1, "t", 205), (2, "t", 2**62 + 7)], "l bigint, k string, ts bigint")
    right = spark.createDataFrame([(7, "t", 110), (8, "t", 200), (9, "t", 2**62 + 1)], "r bigint, k string, ts bigint")
    got = {tuple(r) for r in nearest_in_time(left, right, "l", "r", F.col("k"), F.col("k"), "ts", 20).collect()}
    assert got == {(1, 8), (2, 9)}


def test_recall_in_sixty_four_dimensions(spark):
    # vectors in groups, as descriptors are; every bucket of every table may be probed
    rng = np.random.default_rng(5)
    middle = rng.normal(0, 3, (40, 64))
    v = middle[rng.integers(0, 40, 2000)] + rng.normal(0, 0.5, (2000, 64))
    names = [f"e{i}" for i in range(64)]
    df = spark.createDataFrame([("c", i, *map(float, x)) for i, x in enumerate(v)], "cloud_id string, pid bigint, " + ", ".join(f"{n} double" for n in names))
    asked = df.where("pid % 100 = 0")
    got = {(r.pid, r.neighbour) for r in similar_vectors.nearest_vectors(df, asked, names, 10, tables=4, probes=9).collect()}
    d2 = ((v[::100, None] - v) ** 2).sum(2)
    d2[np.arange(20), np.arange(0, 2000, 100)] = np.inf
    true = {(100 * i, int(j)) for i in range(20) for j in np.argsort(d2[i])[:10]}
    assert len(true & got) / len(true) >= 0.9
