"""Rigid and general transforms: matrices on the driver, points by literal-folded projections."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.functions.geometry import XYZ
from pointlake.schema import positive


def identity() -> np.ndarray:
    return np.eye(4)


def translation(x: float, y: float, z: float) -> np.ndarray:
    out = np.eye(4)
    out[:3, 3] = x, y, z
    return out


def rotation(axis: tuple[float, float, float], angle: float) -> np.ndarray:
    """Rotation by ``angle`` radians about an axis through the origin."""
    a = np.asarray(axis, dtype=float)
    length = np.linalg.norm(a)
    if length == 0:
        raise ValueError("axis must not be zero")
    x, y, z = a / length
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    out = np.eye(4)
    out[:3, :3] += np.sin(angle) * k + (1 - np.cos(angle)) * k @ k
    return out


def scaling(x: float, y: float | None = None, z: float | None = None) -> np.ndarray:
    return np.diag([x, x if y is None else y, x if z is None else z, 1.0])


def compose(*matrices: np.ndarray) -> np.ndarray:
    """Product of matrices: the last is applied first."""
    out = np.eye(4)
    for m in matrices:
        out = out @ m
    return out


def inverse(matrix: np.ndarray) -> np.ndarray | None:
    """The inverse, None where the matrix is singular."""
    try:
        return np.linalg.inv(matrix)
    except np.linalg.LinAlgError:
        return None


def is_identity(matrix: np.ndarray, epsilon: float = 1e-6) -> bool:
    """Whether the Frobenius distance to the identity is below ``epsilon``."""
    return bool(np.linalg.norm(matrix - np.eye(4)) < epsilon)


def transform_points(cloud: DataFrame, matrix: np.ndarray, names: tuple[str, str, str] = XYZ) -> DataFrame:
    """Points through a 4x4 matrix with homogeneous division; a point whose weight becomes 0 stays as it was."""
    m = np.asarray(matrix, dtype=float)
    p = [F.col(n) for n in names]
    row = lambda i: sum((float(m[i, j]) * p[j] for j in range(3)), F.lit(float(m[i, 3])))
    if np.allclose(m[3], [0, 0, 0, 1], atol=0):
        return cloud.withColumns({n: row(i) for i, n in enumerate(names)})
    w = row(3)
    return cloud.withColumns({n: F.when(w != 0, F.try_divide(row(i), w)).otherwise(p[i]) for i, n in enumerate(names)})


def transform_vectors(cloud: DataFrame, matrix: np.ndarray, names: tuple[str, str, str] = ("nx", "ny", "nz")) -> DataFrame:
    """Directions through the upper 3x3 part only."""
    m = np.asarray(matrix, dtype=float)
    p = [F.col(n) for n in names]
    return cloud.withColumns({n: sum((float(m[i, j]) * p[j] for j in range(3)), F.lit(0.0)) for i, n in enumerate(names)})


def range_filter(cloud: DataFrame, least: float, most: float) -> DataFrame:
    """Points whose distance from the origin lies between the two, both inclusive."""
    positive(most=most)
    r2 = sum((F.col(c) * F.col(c) for c in XYZ), F.lit(0.0))
    return cloud.where(r2.between(float(least) ** 2, float(most) ** 2))
