"""SQL text of closed-form 3x3 algebra for oracles: eigenvalues by the trigonometric solution, vectors by cross products."""

from __future__ import annotations

from pointlake.functions.geometry import XYZ

#: Eigenvalues of the symmetric 3x3 matrix in columns cxx, cxy, cxz, cyy, cyz, czz: e_min <= e_mid <= e_max.
EIGENVALUES = [
    [
        ("q_", "(cxx + cyy + czz) / 3.0"),
        ("o_", "cxy * cxy + cxz * cxz + cyz * cyz"),
    ],
    [
        ("p_", "sqrt(((cxx - q_) * (cxx - q_) + (cyy - q_) * (cyy - q_) + (czz - q_) * (czz - q_) + 2.0 * o_) / 6.0)"),
    ],
    [
        ("r_", "CASE WHEN p_ > 0 THEN greatest(-1.0, least(1.0, ((cxx - q_) * ((cyy - q_) * (czz - q_) - cyz * cyz) - cxy * (cxy * (czz - q_) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q_) * cxz)) / (2.0 * p_ * p_ * p_))) ELSE 0.0 END"),
    ],
    [
        ("e_max", "q_ + 2.0 * p_ * cos(acos(r_) / 3.0)"),
        ("e_min", "q_ + 2.0 * p_ * cos(acos(r_) / 3.0 + 2.0943951023931953)"),
    ],
    [("e_mid", "3.0 * q_ - e_max - e_min")],
]

#: Unit eigenvector (vx, vy, vz) of the least eigenvalue: the longest cross product of two rows of C - e_min I; (0, 0, 1)
#: where all of them vanish.
SMALLEST_VECTOR = [
    [
        ("ax_", "cxy * cyz - cxz * (cyy - e_min)"), ("ay_", "cxz * cxy - (cxx - e_min) * cyz"), ("az_", "(cxx - e_min) * (cyy - e_min) - cxy * cxy"),
        ("bx_", "cxy * (czz - e_min) - cxz * cyz"), ("by_", "cxz * cxz - (cxx - e_min) * (czz - e_min)"), ("bz_", "(cxx - e_min) * cyz - cxy * cxz"),
        ("dx_", "(cyy - e_min) * (czz - e_min) - cyz * cyz"), ("dy_", "cyz * cxz - cxy * (czz - e_min)"), ("dz_", "cxy * cyz - (cyy - e_min) * cxz"),
    ],
    [("na_", "ax_ * ax_ + ay_ * ay_ + az_ * az_"), ("nb_", "bx_ * bx_ + by_ * by_ + bz_ * bz_"), ("nd_", "dx_ * dx_ + dy_ * dy_ + dz_ * dz_")],
    [("best_", "greatest(na_, nb_, nd_)")],
    [
        (f"v{c}", f"CASE WHEN best_ <= 0 THEN {'1.0' if c == 'z' else '0.0'} WHEN na_ >= nb_ AND na_ >= nd_ THEN a{c}_ / sqrt(na_) WHEN nb_ >= nd_ THEN b{c}_ / sqrt(nb_) ELSE d{c}_ / sqrt(nd_) END")
        for c in XYZ
    ],
]


def staged_sql(source: str, *groups: list[list[tuple[str, str]]]) -> str:
    """Stages as nested SELECTs over a table name or a parenthesised query."""
    for group in groups:
        for stage in group:
            source = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage)} FROM {source})"
    return source
