"""Clouds and meshes as DataFrames: canonical columns, validation, and tidying at ingestion.

A cloud is ``(cloud_id STRING, pid BIGINT, x, y, z DOUBLE, ...)``, a mesh two tables, vertices ``(mesh_id STRING, vid BIGINT,
x, y, z DOUBLE, ...)`` and faces ``(mesh_id STRING, fid BIGINT, a, b, c BIGINT)``. Coordinates are DOUBLE throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointlake.functions.geometry import usable

_XYZ = [T.StructField(c, T.DoubleType()) for c in "xyz"]
CLOUD = T.StructType([T.StructField("cloud_id", T.StringType()), T.StructField("pid", T.LongType()), *_XYZ])
VERTICES = T.StructType([T.StructField("mesh_id", T.StringType()), T.StructField("vid", T.LongType()), *_XYZ])
FACES = T.StructType([T.StructField("mesh_id", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("fid", "a", "b", "c"))])


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The table, if it has all columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def positive(**values: float) -> None:
    """Raise unless every named parameter is above 0."""
    for name, value in values.items():
        if not value > 0:
            raise ValueError(f"{name} must be positive, not {value}")


def one_cloud(df: DataFrame) -> None:
    """Raise if a table holds more than one cloud, for operators whose result is one grid, volume or pose."""
    seen = df.agg(F.min("cloud_id").alias("a"), F.max("cloud_id").alias("b")).first()
    if seen["a"] != seen["b"]:
        raise ValueError(f"one cloud at a time: the table holds {seen['a']} and {seen['b']}; filter by cloud_id")


def cloud(df: DataFrame, pid: Column | str = "pid", cloud_id: Column | str | None = None, x: Column | str = "x", y: Column | str = "y", z: Column | str = "z", *extra: str) -> DataFrame:
    """A tidy cloud: canonical names, coordinates as DOUBLE, rows with unusable coordinates or ids left out, copies once."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    cid = F.lit("cloud") if cloud_id is None else as_column(cloud_id)
    out = df.select(cid.cast("string").alias("cloud_id"), as_column(pid).cast("bigint").alias("pid"), *(as_column(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))), *extra)
    return out.where(usable("x", "y", "z") & F.col("pid").isNotNull()).dropDuplicates(["cloud_id", "pid"])
