"""Outlier removal: neighbours in blocks, followed by aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.operators.neighbors import knn
from pointlake.plans.blocks import Blocks, in_blocks
from pointlake.schema import positive

KEY = "cloud_id"


def radius_outlier_removal(cloud: DataFrame, radius: float, min_neighbors: int) -> DataFrame:
    """Points with at least ``min_neighbors`` others within ``radius`` (inclusive); points at the same place count."""
    positive(radius=radius, min_neighbors=min_neighbors)
    near = radius_counts(cloud, radius)
    return cloud.join(near.where(F.col("n") - 1 >= min_neighbors).select(KEY, "pid"), [KEY, "pid"], "left_semi")


def radius_counts(cloud: DataFrame, radius: float) -> DataFrame:
    """``(cloud_id, pid, n)``: how many points, itself among them, lie within ``radius`` of each.

    Counted in blocks with a rim; points at one place are counted as one with a weight, so a place may hold any share of them.
    """
    positive(radius=radius)
    kind = cloud.schema[KEY].dataType.simpleString()

    def count(b: Blocks) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((*b.xyz.T, b.block))
        new = np.r_[True, (b.block[order][1:] != b.block[order][:-1]) | (b.xyz[order][1:] != b.xyz[order][:-1]).any(axis=1)]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        first = order[new]
        weight = np.bincount(place)
        wanted = np.unique(place[b.home])
        n = np.zeros(len(first), dtype=np.int64)
        for q, m, _ in b.grid(first).within(b.block[first[wanted]], b.xyz[first[wanted]], radius):
            n += np.bincount(wanted[q], weights=weight[m], minlength=len(n)).astype(np.int64)
        rows = pa.array(np.flatnonzero(b.home))
        yield pa.RecordBatch.from_arrays([b.table[KEY].combine_chunks().take(rows), b.table["pid"].combine_chunks().take(rows), pa.array(n[place[b.home]])], names=[KEY, "pid", "n"])

    return in_blocks(cloud.select(KEY, F.col("pid").cast("bigint").alias("pid"), *(F.col(c).cast("double").alias(c) for c in "xyz")), radius, count, f"{KEY} {kind}, pid bigint, n bigint")


def mean_distances(cloud: DataFrame, k: int) -> DataFrame:
    """``(cloud_id, pid, mean)``: mean distance to the k+1 nearest points less those at the point's own place; 0 if none is left."""
    ids = cloud.select(KEY, "pid", "x", "y", "z")
    found = knn(ids, ids, k + 1).where(F.col("distance") > 0)
    mean = found.groupBy(KEY, "pid").agg(F.avg("distance").alias("mean"))
    return ids.select(KEY, "pid").join(mean, [KEY, "pid"], "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))


def statistical_outlier_removal(cloud: DataFrame, k_neighbors: int = 20, std_multiplier: float = 2.0) -> DataFrame:
    """Points whose mean neighbour distance is at most mean + multiplier x population deviation over their cloud."""
    positive(k_neighbors=k_neighbors, std_multiplier=std_multiplier)
    mean = mean_distances(cloud, k_neighbors)
    limits = mean.groupBy(KEY).agg((F.avg("mean") + std_multiplier * F.stddev_pop("mean")).alias("limit"))
    kept = mean.join(limits, KEY).where(F.col("mean") <= F.col("limit")).select(KEY, "pid")
    return cloud.join(kept, [KEY, "pid"], "left_semi")


def statistical_outlier_threshold(cloud: DataFrame, k_neighbors: int, threshold: float) -> DataFrame:
    """Points whose mean neighbour distance is at most ``threshold``."""
    positive(k_neighbors=k_neighbors, threshold=threshold)
    kept = mean_distances(cloud, k_neighbors).where(F.col("mean") <= threshold).select(KEY, "pid")
    return cloud.join(kept, [KEY, "pid"], "left_semi")


def relative_mean_outlier_removal(cloud: DataFrame, k_neighbors: int, multiplier: float) -> DataFrame:
    """Points whose mean neighbour distance differs from the cloud's by at most ``multiplier`` times the cloud's (two-sided)."""
    positive(k_neighbors=k_neighbors, multiplier=multiplier)
    ids = cloud.select(KEY, "pid", "x", "y", "z")
    mean = knn(ids, ids, k_neighbors, exclude_self=True).groupBy(KEY, "pid").agg(F.avg("distance").alias("mean"))
    whole = mean.groupBy(KEY).agg(F.avg("mean").alias("all"))
    kept = mean.join(whole, KEY).where(F.abs(F.col("mean") - F.col("all")) <= F.col("all") * multiplier).select(KEY, "pid")
    return cloud.join(kept, [KEY, "pid"], "left_semi")
