"""Voxel downsampling, bounding boxes and statistics of clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.functions.geometry import XYZ
from pointlake.schema import positive

KEY = "cloud_id"


def bounds(cloud: DataFrame) -> DataFrame:
    """``(cloud_id, n, min_x .. max_z, center_x .. center_z)`` of each cloud; clouds without points have no row."""
    box = [f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in XYZ]
    out = cloud.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), *box)
    return out.withColumns({f"center_{c}": (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 for c in XYZ})


def statistics(cloud: DataFrame) -> DataFrame:
    """``(cloud_id, n, min, max and mean of x, y, z)`` of each cloud in one aggregation."""
    parts = [f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg)) for c in XYZ]
    return cloud.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), *parts)


def voxel_downsample(cloud: DataFrame, voxel_size: float, anchor: str = "minimum", keep: str = "centroid") -> DataFrame:
    """``(cloud_id, vx, vy, vz, x, y, z, n)``: one point per occupied cube of edge ``voxel_size``.

    ``anchor`` is ``minimum`` (the cloud's least corner, as in batch) or ``zero`` (as in streams); ``keep`` is ``centroid`` or
    ``first``, the point of smallest pid. One aggregation with map-side combination; the minimum of each cloud comes from one
    more over the same scan and is joined by cloud, broadcast only where the optimiser knows it to be small.
    """
    positive(voxel_size=voxel_size)
    if anchor not in ("minimum", "zero") or keep not in ("centroid", "first"):
        raise ValueError("anchor must be minimum or zero, keep centroid or first")
    points = cloud.select(KEY, *XYZ, *(["pid"] if keep == "first" else []))
    if anchor == "minimum":
        low = points.groupBy(KEY).agg(*(F.min(c).alias(f"m{c}") for c in XYZ))
        points = points.join(low, KEY)
        cells = {f"v{c}": F.floor((F.col(c) - F.col(f"m{c}")) / voxel_size) for c in XYZ}
    else:
        cells = {f"v{c}": F.floor(F.col(c) / voxel_size) for c in XYZ}
    grid = points.withColumns(cells).groupBy(KEY, "vx", "vy", "vz")
    if keep == "first":
        first = grid.agg(F.min_by(F.struct(*XYZ), "pid").alias("p"), F.count(F.lit(1)).alias("n"))
        return first.select(KEY, "vx", "vy", "vz", "p.x", "p.y", "p.z", "n")
    return grid.agg(*(F.avg(c).alias(c) for c in XYZ), F.count(F.lit(1)).alias("n"))


def concatenate(*clouds: DataFrame) -> DataFrame:
    """All rows of the clouds; columns by name, missing ones null."""
    if not clouds:
        raise ValueError("no cloud given")
    out = clouds[0]
    for c in clouds[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out
