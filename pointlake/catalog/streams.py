"""Queries that run streams to their end, and decode recorded messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.catalog.clouds import r6, rounded
from pointlake.plans.tables import table
from pointlake.sources import registry
from pointlake.streaming import pipelines


def _events(s: SparkSession, d: str) -> DataFrame:
    stream = pipelines.parquet_stream(s, d, "events")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200
    return stream.select(F.col("value").cast("double").alias("x"), F.col("user_id").cast("double").alias("y"), seconds.cast("double").alias("z"), "ts")


def _messages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "bag").where("message_type LIKE '%PointCloud2'").select("msg_id", "data").dropDuplicates(["msg_id"])


EVENTS = "(SELECT CAST(value AS DOUBLE) AS x, CAST(user_id AS DOUBLE) AS y, CAST(floor(epoch(ts)) - 1704067200 AS DOUBLE) AS z, ts FROM events)"
_CELL = "CAST(floor(x / 25.0::DOUBLE) AS BIGINT) AS vx, CAST(floor(y / 25.0::DOUBLE) AS BIGINT) AS vy, CAST(floor(z / 25.0::DOUBLE) AS BIGINT) AS vz"

QUERIES = {
    "streaming_voxel": lambda s, d: rounded(pipelines.finish(pipelines.voxel_stream(_events(s, d), 25.0)), "x", "y", "z"),
    "streaming_stats": lambda s, d: rounded(pipelines.finish(pipelines.statistics_stream(_events(s, d))), "mean_x", "mean_y", "mean_z"),
    "streaming_collect": lambda s, d: pipelines.finish(_events(s, d).select("x", "y", "z")),
    "bag_topics": lambda s, d: registry.bag_topics(table(s, d, "bag").where("topic IS NOT NULL")).select("topic"),
    "bag_pointcloud2": lambda s, d: registry.decode_clouds(_messages(s, d)),
}

SQL = {
    "streaming_voxel": f"SELECT vx, vy, vz, {', '.join(r6(f'avg({c})', c) for c in 'xyz')}, count(*) AS n FROM (SELECT *, {_CELL} FROM {EVENTS}) GROUP BY vx, vy, vz",
    "streaming_stats": f"SELECT count(*) AS n, {', '.join(f'{f}({c}) AS {f}_{c}' for f in ('min', 'max') for c in 'xyz')}, {', '.join(r6(f'avg({c})', f'mean_{c}') for c in 'xyz')} FROM {EVENTS}",
    "streaming_collect": f"SELECT x, y, z FROM {EVENTS}",
    "bag_topics": "SELECT DISTINCT topic FROM bag WHERE topic IS NOT NULL",
}
