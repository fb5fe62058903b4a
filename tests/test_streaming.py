from __future__ import annotations

import pytest

from pointlake.plans import scratch
from pointlake.sources import parsing, registry
from pointlake.streaming import pipelines

SCHEMA = "x double, y double, z double"


@pytest.fixture
def folder(spark, tmp_path):
    for n, rows in enumerate([[(0.1, 0.0, 0.0)], [(0.9, 0.0, 0.0)], [(5.0, 0.0, 0.0), (5.5, 0.0, 0.0)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "points.parquet"))
    return str(tmp_path)


def test_voxels_across_batches(spark, folder):
    seen = []
    out = pipelines.finish(pipelines.voxel_stream(pipelines.parquet_stream(spark, folder, "points"), 1.0), each=lambda b, n: seen.append(n))
    assert {(r.vx, round(r.x, 6), r.n) for r in out.collect()} == {(0, 0.5, 2), (5, 5.25, 2)} and len(seen) >= 3


def test_statistics_and_collection(spark, folder):
    row = pipelines.finish(pipelines.statistics_stream(pipelines.parquet_stream(spark, folder, "points"))).first()
    assert (row.n, row.min_x, row.max_x) == (4, 0.1, 5.5) and row.mean_x == pytest.approx(2.875)
    assert pipelines.finish(pipelines.parquet_stream(spark, folder, "points")).count() == 4


def test_text_streams_and_bad_parameters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x,y,z\n1,2,3\nbad,2,3\n")
    stream = registry.stream_xyz(spark, str(tmp_path / "in"), parsing.XyzSchema(("x", "y", "z"), ",", True))
    assert sorted((r.x is None, r.y) for r in pipelines.finish(stream).collect()) == [(False, 2.0), (True, 2.0)]
    with pytest.raises(ValueError):
        pipelines.voxel_stream(stream, 0)
    with pytest.raises(ValueError):
        pipelines.parquet_stream(spark, str(tmp_path), "x", 0)


def test_windows_leave_late_points_out(spark, tmp_path):
    from datetime import datetime, timedelta

    t = datetime(2025, 1, 1)
    for n, minutes in enumerate((0, 60, 1)):
        spark.createDataFrame([(t + timedelta(minutes=minutes), 0.5, 0.5, 0.5)], "at timestamp, x double, y double, z double").coalesce(1).write.mode("append").parquet(str(tmp_path / "p.parquet"))
    out = pipelines.finish(pipelines.windowed_voxels(pipelines.parquet_stream(spark, str(tmp_path), "p", 3), 1.0, "at", "10 minutes", "5 minutes"), "complete")
    assert sum(r.n for r in out.collect()) == 3


def test_metrics_of_a_running_query(spark, folder, tmp_path):
    q = pipelines.start(pipelines.parquet_stream(spark, folder, "points"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.processAllAvailable()
    assert pipelines.metrics(q).rows == 4
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_shared_folder_is_read_from_the_session(spark, tmp_path):
    df = scratch.written(spark.range(5), "x")
    assert df.count() == 5 and scratch.shared_dir(spark) in df._pointlake_path
    scratch.drop(df)


def test_streams_keep_clouds_apart_and_skip_failing_batches(spark, tmp_path):
    points = [("a", 0.1, 0.1, 0.1), ("b", 0.2, 0.2, 0.2), ("a", 0.3, 0.3, 0.3)]
    for n, p in enumerate(points):
        spark.createDataFrame([p], "cloud_id string, x double, y double, z double").coalesce(1).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    stream = lambda: pipelines.parquet_stream(spark, str(tmp_path), "t")
    assert {(r.cloud_id, r.n) for r in pipelines.finish(pipelines.voxel_stream(stream(), 1.0)).collect()} == {("a", 2), ("b", 1)}
    assert {(r.cloud_id, r.n) for r in pipelines.finish(pipelines.statistics_stream(stream())).collect()} == {("a", 2), ("b", 1)}
    skipped = []

    def picky(batch, _):
        if batch.where("cloud_id = 'b'").count():
            raise ValueError("no b")

    assert {r.cloud_id for r in pipelines.finish(stream(), each=picky, skipped=skipped).collect()} == {"a"} and len(skipped) == 1


def test_a_feed_waits_drops_and_finishes(spark):
    feed = pipelines.Feed(spark, "x double, y double, z double", lambda s: pipelines.statistics_stream(s), capacity=2)
    for i in range(3):
        feed.send([(float(i), 0.0, 0.0), (float(i), 1.0, 1.0)])
    feed.capacity = 0  # no room at all
    assert not feed.try_send([(9.0, 9.0, 9.0)])
    row = feed.finish().first()
    assert (row.n, row.max_x) == (6, 2.0) and feed.metrics().dropped == 1 and feed.sent == 3
