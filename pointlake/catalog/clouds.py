"""Tables of a directory as clouds and meshes, for queries and as SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake import schema
from pointlake.operators import transforms
from pointlake.plans.tables import table

#: Pose that takes the embeddings' cloud to its image.
POSE = transforms.compose(transforms.translation(0.05, -0.02, 0.01), transforms.rotation((0, 0, 1), 0.02))


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The first three values of each embedding as a point."""
    e = F.col("embedding")
    return schema.cloud(table(spark, d, "embeddings"), "vec_id", F.lit("embeddings"), e[0], e[1], e[2])


def image(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings' cloud moved by the pose."""
    return transforms.transform_points(embeddings(spark, d), POSE)


def scans(spark: SparkSession, d: str) -> DataFrame:
    """The clouds of the recorded scans."""
    return schema.cloud(table(spark, d, "cloud_normal"), "pid", "cloud_id")


def oriented(spark: SparkSession, d: str) -> DataFrame:
    """The recorded points whose normals are usable, at length 1."""
    c = schema.cloud(table(spark, d, "cloud_normal"), "pid", "cloud_id", "x", "y", "z", "nx", "ny", "nz")
    length = F.sqrt(sum((F.col(f"n{a}") ** 2 for a in "xyz"), F.lit(0.0)))
    return c.where((length > 1e-6) & (length < 1e6)).withColumns({f"n{a}": F.col(f"n{a}") / length for a in "xyz"})


EMBEDDINGS = "(SELECT 'embeddings' AS cloud_id, CAST(vec_id AS BIGINT) AS pid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
SCANS = "(SELECT DISTINCT cloud_id, pid, x, y, z FROM cloud_normal WHERE isfinite(x) AND isfinite(y) AND isfinite(z))"


def moved(source: str, matrix: np.ndarray) -> str:
    """SQL of a cloud through an affine matrix."""
    row = lambda i: " + ".join([*(f"{float(matrix[i, j])!r}::DOUBLE * {a}" for j, a in enumerate("xyz")), f"{float(matrix[i, 3])!r}::DOUBLE"])
    return f"(SELECT cloud_id, pid, {', '.join(f'{row(i)} AS {a}' for i, a in enumerate('xyz'))} FROM {source})"


def r6(expression: str, name: str, places: int = 6) -> str:
    """SQL of a value rounded to six places, without negative zero."""
    return f"CASE WHEN abs({expression}) < {0.5 * 10**-places:.{places + 1}f} THEN CAST(0 AS DOUBLE) ELSE round({expression}, {places}) END AS {name}"


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """The table with columns rounded."""
    return df.withColumns({n: F.round(n, places) for n in names})
