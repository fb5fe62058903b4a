"""Registered queries of the subpackage, and SQL for those that SQL can state."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.plans.tables import table


VECTOR = ["x", "y", "z", "nx", "ny", "nz"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from pointlake.llm.similar_vectors import nearest_vectors

    cloud = table(spark, d, "cloud_normal").select("cloud_id", "pid", *VECTOR)
    probes = cloud.join(table(spark, d, "knn_probe").select("cloud_id", "pid").distinct(), ["cloud_id", "pid"], "left_semi")
    near = nearest_vectors(cloud, probes, VECTOR, 10)
    return near.select("cloud_id", F.least("pid", "neighbour").alias("pid_a"), F.greatest("pid", "neighbour").alias("pid_b")).distinct()


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ranked neighbours of every vector whose pid is divisible by 100, searched in all vectors."""
    from pointlake.llm.similar_vectors import nearest_vectors

    cloud = table(spark, d, "cloud_normal").select("cloud_id", "pid", *VECTOR)
    return nearest_vectors(cloud, cloud.where(F.col("pid") % 100 == 0), VECTOR, 10)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from pointlake.operators.chains import chain_clusters

    return chain_clusters(table(spark, d, "cloud_normal"), 0.3005, smallest=10)


def _by_place(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Members and clusters of the positions by k-means within each cloud, k a quarter of the root of the cloud's rows."""
    from pointlake.llm.clusters import similarity_clusters

    cloud = table(spark, d, "cloud_normal").where(" AND ".join(f"abs({c}) < double('infinity')" for c in "xyz"))
    return similarity_clusters(cloud, ["cloud_id", "pid"], {"x": 1.0, "y": 1.0, "z": 1.0}, k=lambda n: math.ceil(math.sqrt(n) / 4), dims=6, within="cloud_id")


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    """The members of the clusters of p3_clusters, with the distance to their centre."""
    return _by_place(spark, d)[0]


def p3_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The clusters of p3_found with their sizes and the three members nearest the mean position, ties to the smaller pid."""
    from pointlake.llm.clusters import typical_members

    return typical_members(table(spark, d, "cloud_normal"), p3_found(spark, d), ["cloud_id", "cluster_pid"], ["cloud_id", "pid"], list("xyz"))


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The clusters of each cloud by k-means, with their sizes and the members nearest each centre."""
    return _by_place(spark, d)[1]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from pointlake.llm.nearest_time import nearest_in_time, topic_key

    return nearest_in_time(table(spark, d, "bag"), table(spark, d, "bag_ref"), "msg_id", "ref_id", topic_key(F.col("topic")), topic_key(F.col("topic")), "ts_ns", 40_000_000)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    from pointlake.llm.tokens import token_ids

    return token_ids(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from pointlake.llm.leakage import leaked

    return leaked(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    from pointlake.llm.leakage import leak_report

    return leak_report(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from pointlake.llm.sentences import sentences

    return sentences(table(spark, d, "documents"))


P2_FOUND = """
WITH c AS (
  SELECT DISTINCT cloud_id, pid, x, y, z, nx, ny, nz FROM cloud_normal
  WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND isfinite(nx) AND isfinite(ny) AND isfinite(nz)),
q AS (SELECT c.* FROM c WHERE (cloud_id, pid) IN (SELECT (cloud_id, pid) FROM knn_probe)),
d AS (
  SELECT q.cloud_id, q.pid, c.pid AS other, row_number() OVER (PARTITION BY q.cloud_id, q.pid ORDER BY
    (q.x - c.x) * (q.x - c.x) + (q.y - c.y) * (q.y - c.y) + (q.z - c.z) * (q.z - c.z)
    + (q.nx - c.nx) * (q.nx - c.nx) + (q.ny - c.ny) * (q.ny - c.ny) + (q.nz - c.nz) * (q.nz - c.nz), c.pid) AS n
  FROM q JOIN c ON q.cloud_id = c.cloud_id AND q.pid <> c.pid)
SELECT DISTINCT cloud_id, least(pid, other) AS pid_a, greatest(pid, other) AS pid_b FROM d WHERE n <= 10
"""

P3_FOUND = """
WITH RECURSIVE c AS (
  SELECT DISTINCT cloud_id, pid, x, y, z, CAST(floor(x / 0.3005) AS INT) AS cx, CAST(floor(y / 0.3005) AS INT) AS cy FROM cloud_normal
  WHERE isfinite(x) AND isfinite(y) AND isfinite(z)),
n AS (SELECT cloud_id, pid, x, y, z, cx + i AS cx, cy + j AS cy FROM c, range(-1, 2) a(i), range(-1, 2) b(j)),
e AS (
  SELECT c.cloud_id, c.pid AS u, n.pid AS v FROM c JOIN n ON c.cloud_id = n.cloud_id AND c.cx = n.cx AND c.cy = n.cy
  WHERE c.pid <> n.pid AND (c.x - n.x) * (c.x - n.x) + (c.y - n.y) * (c.y - n.y) + (c.z - n.z) * (c.z - n.z) <= 0.3005 * 0.3005),
r(cloud_id, u, root) AS (
  SELECT cloud_id, pid, pid FROM c UNION SELECT e.cloud_id, e.v, r.root FROM r JOIN e ON r.cloud_id = e.cloud_id AND r.u = e.u WHERE e.v > r.root),
l AS (SELECT cloud_id, u AS pid, min(root) AS cluster_pid FROM r GROUP BY cloud_id, u)
SELECT cloud_id, pid, cluster_pid FROM l WHERE (cloud_id, cluster_pid) IN (SELECT (cloud_id, cluster_pid) FROM l GROUP BY cloud_id, cluster_pid HAVING count(*) >= 10)
"""

P5_FOUND = r"""
WITH l AS (
  SELECT DISTINCT msg_id, lower(regexp_replace(topic, '^[ \t/]+|[ \t/]+$', '', 'g')) AS k, ts_ns AS t FROM bag
  WHERE topic IS NOT NULL AND ts_ns IS NOT NULL),
r AS (
  SELECT DISTINCT ref_id, lower(regexp_replace(topic, '^[ \t/]+|[ \t/]+$', '', 'g')) AS k, ts_ns AS t FROM bag_ref
  WHERE topic IS NOT NULL AND ts_ns IS NOT NULL)
SELECT msg_id, ref_id FROM (
  SELECT l.msg_id, r.ref_id, row_number() OVER (PARTITION BY l.msg_id ORDER BY abs(l.t - r.t), r.t, r.ref_id) AS n
  FROM l JOIN r ON l.k = r.k AND r.t BETWEEN l.t - 40000000 AND l.t + 40000000)
WHERE n = 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p2_neighbours": p2_neighbours, "p3_found": p3_found, "p3_clusters": p3_clusters, "p3_members": p3_members, "p3_bodies": p3_bodies, "p5_found": p5_found, "p6_ids": p6_ids, "p7_found": p7_found, "p7_report": p7_report, "p8_found": p8_found}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND, "p3_found": P3_FOUND, "p5_found": P5_FOUND}
