"""Surface normals and covariances from neighbourhoods."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.functions.geometry import XYZ
from pointlake.functions.linear import eigen, with_eigen
from pointlake.operators.neighbors import KEY, folded, knn, neighborhoods
from pointlake.operators.voxel import bounds
from pointlake.plans import scratch
from pointlake.plans.blocks import Blocks

COVARIANCE = {"cxx": "xx", "cxy": "xy", "cxz": "xz", "cyy": "yy", "cyz": "yz", "czz": "zz"}


#: Rows of a table of clouds that is sent to all tasks.
CLOUDS = 100_000


def covariances(cloud: DataFrame, k: int, radius: float | None = None, sample: bool = False) -> DataFrame:
    """``(cloud_id, pid, n, cxx .. czz)``: covariance of each point's neighbourhood, the point itself included."""
    return _covariances(neighborhoods(cloud, k, radius).select(KEY, "pid", "to"), cloud, sample)


def _covariances(near: DataFrame, cloud: DataFrame, sample: bool = False) -> DataFrame:
    near = near.select(KEY, "pid", "to").unionByName(cloud.select(KEY, "pid", F.struct(*XYZ).alias("to")))
    cov = F.covar_samp if sample else F.covar_pop
    return near.groupBy(KEY, "pid").agg(F.count(F.lit(1)).alias("n"), *(cov(f"to.{ab[0]}", f"to.{ab[1]}").alias(c) for c, ab in COVARIANCE.items()))


def _fold(sums: np.ndarray, b: Blocks, rows: np.ndarray, q: np.ndarray, m: np.ndarray, d2: np.ndarray) -> None:
    """Sums of the neighbours' offsets from their point, and of the products of these."""
    delta = dict(zip(XYZ, (b.xyz[m] - b.xyz[rows[q]]).T))
    for i, weights in enumerate([*delta.values(), *(delta[u] * delta[v] for u, v in COVARIANCE.values())]):
        sums[:, i] += np.bincount(q, weights=weights, minlength=len(sums))


def _finish(sums: np.ndarray, count: np.ndarray) -> list[pa.Array]:
    mean = sums / (count + 1)[:, None]  # the point itself is at offset 0
    at = dict(zip(XYZ, mean.T))
    shape = eigen(*(mean[:, 3 + i] - at[u] * at[v] for i, (u, v) in enumerate(COVARIANCE.values())))
    low, total = shape["e_min"].to_numpy(dtype=float), (shape["e_min"] + shape["e_mid"] + shape["e_max"]).to_numpy(dtype=float)
    curvature = np.divide(np.maximum(low, 0), total, out=np.zeros(len(total)), where=total > 0)
    return [*(pa.array(shape[c].to_numpy(dtype=float)) for c in ("vx", "vy", "vz")), pa.array(curvature)]


_MADE = ("vx", "vy", "vz", "curvature")


def _shapes(covariance: DataFrame) -> DataFrame:
    """``(cloud_id, pid, vx, vy, vz, curvature)`` of covariances."""
    shape = with_eigen(covariance)
    total = F.col("e_min") + F.col("e_mid") + F.col("e_max")
    return shape.select(KEY, "pid", "vx", "vy", "vz", F.when(total > 0, F.greatest("e_min", F.lit(0.0)) / total).otherwise(0.0).alias("curvature"))


def _shaped_within(cloud: DataFrame, k: int, radius: float) -> DataFrame:
    """The cloud with the ``_shapes`` of neighbourhoods within a radius, summed up in blocks of space."""
    more = {f"c_{i}": c for i, c in enumerate(c for c in cloud.columns if c not in (KEY, "pid", *XYZ))}
    points = cloud.where(F.col(KEY).isNotNull() & F.col("pid").isNotNull()).select(KEY, "pid", *XYZ, *(F.col(f"`{c}`").alias(n) for n, c in more.items()))
    points = scratch.written(points, "points")
    scratch.release(cloud.sparkSession)
    first, near = folded(points, k, radius, 9, _fold, _finish, dict.fromkeys(_MADE, "double"), tuple(points.columns))
    out = first.where("left IS NULL").drop("left")
    if near is not None:
        rest = first.where("left IS NOT NULL").select(*points.columns)
        out = out.unionByName(rest.join(_shapes(_covariances(near, rest)), [KEY, "pid"]))
    # what has no place has no neighbours
    odd = points.where(F.expr(" OR ".join(f"NOT coalesce(abs({c}) < double('infinity'), false)" for c in XYZ))).withColumns({"vx": F.lit(0.0), "vy": F.lit(0.0), "vz": F.lit(1.0), "curvature": F.lit(0.0)})
    out, named = out.unionByName(odd), {c: n for n, c in more.items()}
    return out.select(KEY, "pid", *(c if c in XYZ else F.col(named[c]).alias(c) for c in cloud.columns if c not in (KEY, "pid")), *_MADE)


def estimate_normals(cloud: DataFrame, k: int = 10, radius: float | None = None, consistent_orientation: bool = True, viewpoint: tuple[float, float, float] | None = None) -> DataFrame:
    """The cloud with unit normals ``nx, ny, nz`` and ``curvature`` (share of the least eigenvalue).

    Principal components of the k nearest points (or, given a radius, of all within it where they are at least k) and the point
    itself. With ``consistent_orientation`` normals face the viewpoint, by default the centre of the cloud's box raised by the
    box's diagonal. k below 3 is an error; an empty cloud gives an empty one.
    """
    if k < 3:
        raise ValueError("k must be at least 3")
    plain = cloud.select(*(c for c in cloud.columns if c not in ("nx", "ny", "nz", "curvature")))
    if radius is None:
        out = plain.join(_shapes(covariances(cloud, k)), [KEY, "pid"])
    else:
        out = _shaped_within(plain, k, radius)
    flip = F.lit(1.0)
    if consistent_orientation:
        if viewpoint is None:
            box = bounds(cloud if radius is None else out)
            diagonal = F.sqrt(sum(((F.col(f"max_{c}") - F.col(f"min_{c}")) ** 2 for c in XYZ), F.lit(0.0)))
            eye = box.select(KEY, "center_x", "center_y", (F.col("center_z") + diagonal).alias("center_z"))
            if radius is not None:
                # one row a cloud: few of them go to all tasks, so that the points need not be shuffled by cloud
                eye = scratch.written(eye, "eyes")
                eye = F.broadcast(eye) if eye.count() <= CLOUDS else eye
            out = out.join(eye, KEY)
            to_eye = [F.col(f"center_{c}") - F.col(c) for c in XYZ]
        else:
            to_eye = [F.lit(float(v)) - F.col(c) for v, c in zip(viewpoint, XYZ)]
        facing = sum((F.col(f"v{c}") * d for c, d in zip(XYZ, to_eye)), F.lit(0.0))
        flip = F.when(facing < 0, -1.0).otherwise(1.0)
    return out.withColumns({f"n{c}": F.col(f"v{c}") * flip for c in XYZ}).drop("vx", "vy", "vz", "center_x", "center_y", "center_z")


def registration_covariances(cloud: DataFrame, k: int = 20) -> DataFrame:
    """``(cloud_id, pid, cxx .. czz)`` for plane-to-plane registration: of the k nearest points with the point among them.

    Sample covariance plus 1e-4 on the diagonal; fewer than 3 points give 1e-3 on the diagonal. k below 4 is an error.
    """
    if k < 4:
        raise ValueError("k must be at least 4")
    ids = cloud.select(KEY, "pid", *XYZ)
    near = knn(ids, ids, k, carry=XYZ)
    cov = near.groupBy(KEY, "pid").agg(F.count(F.lit(1)).alias("n"), *(F.covar_samp(f"to.{ab[0]}", f"to.{ab[1]}").alias(c) for c, ab in COVARIANCE.items()))
    diagonal = ("cxx", "cyy", "czz")
    return cov.select(KEY, "pid", *(F.when(F.col("n") < 3, 1e-3 if c in diagonal else 0.0).otherwise(F.col(c) + (1e-4 if c in diagonal else 0.0)).alias(c) for c in COVARIANCE))
