"""Small symmetric matrices in bulk: Arrow batches through LAPACK, one call a batch.

The closed form as Columns outgrows a generated method, so this is one of the few places where rows leave the JVM.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMMETRIC = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")


def matrices(*parts: pd.Series) -> np.ndarray:
    """Symmetric 3x3 matrices of the six parts; nulls count as 0."""
    xx, xy, xz, yy, yz, zz = (np.nan_to_num(np.asarray(p, dtype=float)) for p in parts)
    return np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2)


def eigen(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
    """Values e_min to e_max and the vector of the least for many matrices at once."""
    if not len(xx):
        return pd.DataFrame({n: pd.Series(dtype=float) for n in ("e_min", "e_mid", "e_max", "vx", "vy", "vz")})
    values, vectors = np.linalg.eigh(matrices(xx, xy, xz, yy, yz, zz))
    least = np.where((abs(values[:, 2]) > 0)[:, None], vectors[:, :, 0], np.array([0.0, 0.0, 1.0]))
    return pd.DataFrame({"e_min": values[:, 0], "e_mid": values[:, 1], "e_max": values[:, 2], **{f"v{c}": least[:, i] for i, c in enumerate("xyz")}})


def with_eigen(df: DataFrame) -> DataFrame:
    """Rows of columns cxx .. czz with ``e_min <= e_mid <= e_max`` and the unit vector ``vx, vy, vz`` of the least.

    The sign of the vector is open; of a zero matrix it is (0, 0, 1).
    """
    solve = F.pandas_udf(eigen, "e_min double, e_mid double, e_max double, vx double, vy double, vz double").asNondeterministic()
    return df.withColumn("eigen_", solve(*SYMMETRIC)).select(*df.columns, "eigen_.*")
