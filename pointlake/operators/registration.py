"""Registration of one cloud onto another: driver loops of join, aggregate and a small solve.

An iteration folds the pose into the source's projection as literals, joins each point to its nearest target point and sends
sums to the driver, never points. The plan does not grow with iterations because every one starts from the original source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.functions.geometry import XYZ
from pointlake.functions.linear import SYMMETRIC, matrices
from pointlake.operators import features, transforms
from pointlake.operators.neighbors import KEY, Prepared, cell, feature_matches, moved_nearest, nearest
from pointlake.operators.normals import COVARIANCE, estimate_normals, registration_covariances
from pointlake.operators.voxel import voxel_downsample
from pointlake.plans import scratch
from pointlake.plans.ranks import ranked
from pointlake.schema import positive


@dataclass
class Registration:
    """A pose (4x4) with its mean squared error, number of iterations and whether it converged."""

    transformation: np.ndarray
    mse: float
    iterations: int
    converged: bool
    details: dict = field(default_factory=dict)

    def frame(self, spark) -> DataFrame:
        """One row: the 12 upper entries as m00 .. m23, mse, iterations, converged."""
        entries = {f"m{i}{j}": float(self.transformation[i, j]) for i in range(3) for j in range(4)}
        row = {**entries, "mse": float(self.mse), "iterations": int(self.iterations), "converged": bool(self.converged)}
        kinds = ", ".join([*(f"{n} double" for n in entries), "mse double", "iterations int", "converged boolean"])
        return spark.createDataFrame([tuple(row.values())], kinds)


def _pair(source: DataFrame, target: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """Both clouds under one key, cut off from their plans as they are read in every iteration."""
    tidy = lambda df, extra: scratch.written(df.select(F.lit("pair").alias(KEY), "pid", *XYZ, *extra), "cloud")
    source, target = tidy(source.repartition(source.sparkSession.sparkContext.defaultParallelism, "pid"), ()), tidy(target, more)
    if source.isEmpty() or target.isEmpty():
        raise ValueError("source or target cloud is empty")
    return source, target


def _numbered(voxels: DataFrame) -> DataFrame:
    """Voxels as a cloud, numbered in the order of their cells."""
    return ranked(voxels.select(KEY, "vx", "vy", "vz", *XYZ), [KEY, "vx", "vy", "vz"], "pid").select(KEY, "pid", *XYZ)


def correspondences(source: DataFrame, target: DataFrame, pose: np.ndarray | None = None, max_distance: float | None = None, carry: tuple[str, ...] = XYZ, prepared: Prepared | None = None) -> DataFrame:
    """``(pid, x, y, z, neighbor, distance, to)``: moved source points with their nearest target point within the distance.

    The bound is inclusive; without one every point has a partner. Of equally near target points that of smallest pid counts.
    """
    pose = np.eye(4) if pose is None else pose
    if prepared is not None and np.array_equal(pose[3], [0, 0, 0, 1]) and (found := moved_nearest(source, prepared, max_distance, pose)) is not None:
        return found.join(source.select(KEY, "pid", *extra), [KEY, "pid"]) if (extra := [c for c in source.columns if c not in (KEY, "pid", *XYZ)]) else found
    moved = transforms.transform_points(source, pose)
    near = nearest(moved, target, max_distance, carry=carry, prepared=prepared)
    return moved.join(near, [KEY, "pid"])


def cross_covariance(pairs: DataFrame) -> DataFrame:
    """One row of sums over correspondences: n, centroids, the nine products and the squared distance."""
    names = {f"s{a}": F.sum(a) for a in XYZ} | {f"t{a}": F.sum(f"to.{a}") for a in XYZ} | {f"h{a}{b}": F.sum(F.col(a) * F.col(f"to.{b}")) for a in XYZ for b in XYZ}
    return pairs.agg(F.count(F.lit(1)).alias("n"), *(v.alias(k) for k, v in names.items()), F.sum(F.col("distance") * F.col("distance")).alias("d2"))


def kabsch(n: int, source_sum: np.ndarray, target_sum: np.ndarray, products: np.ndarray) -> np.ndarray:
    """The rigid pose of least squares from sums over point pairs; reflections are turned into rotations."""
    p, q = source_sum / n, target_sum / n
    u, _, vt = np.linalg.svd(products - n * np.outer(p, q))
    r = vt.T @ u.T
    if np.linalg.det(r) < 0:
        vt[2] = -vt[2]
        r = vt.T @ u.T
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r, q - r @ p
    return out


def _sums(row) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, float]:
    take = lambda prefix: np.array([row[f"{prefix}{a}"] for a in XYZ])
    return row["n"], take("s"), take("t"), np.array([[row[f"h{a}{b}"] for b in XYZ] for a in XYZ]), row["d2"]


def _small_rotation(x: float, y: float, z: float) -> np.ndarray:
    """Rz * Ry * Rx."""
    return transforms.rotation((0, 0, 1), z) @ transforms.rotation((0, 1, 0), y) @ transforms.rotation((1, 0, 0), x)


def _checked(max_iterations: int, threshold: float, max_distance: float | None) -> None:
    positive(max_iterations=max_iterations, convergence_threshold=threshold)
    if max_distance is not None:
        positive(max_distance=max_distance)


def icp_point_to_point(source: DataFrame, target: DataFrame, init: np.ndarray | None = None, max_iterations: int = 50, threshold: float = 1e-6, max_distance: float | None = None) -> Registration:
    """Point-to-point registration. The error of an iteration is that before its step, of an unfinished run that after the last.

    Empty clouds, fewer than 3 pairs and non-positive parameters are errors.
    """
    _checked(max_iterations, threshold, max_distance)
    source, target = _pair(source, target)
    return _icp(source, target, np.eye(4) if init is None else init, max_iterations, threshold, max_distance)


def _icp(source: DataFrame, target: DataFrame, pose: np.ndarray, max_iterations: int, threshold: float, max_distance: float | None) -> Registration:
    before, ready = np.inf, Prepared(target, 1, XYZ)
    for turn in range(max_iterations):
        n, s, t, h, d2 = _sums(cross_covariance(correspondences(source, target, pose, max_distance, prepared=ready)).first())
        if n < 3:
            raise ValueError("fewer than 3 correspondences")
        step = kabsch(n, s, t, h)
        mse = d2 / n
        last, pose = pose, step @ pose
        if abs(before - mse) < threshold:
            return Registration(pose, mse, turn + 1, True, {"pairs": n})
        before = mse
    # the last pairs under the last pose
    pairs = correspondences(source, target, last, max_distance, prepared=ready)
    gap = transforms.transform_points(pairs, step).select(sum(((F.col(a) - F.col(f"to.{a}")) ** 2 for a in XYZ), F.lit(0.0)).alias("d2"))
    return Registration(pose, gap.agg(F.avg("d2")).first()[0], max_iterations, False, {"pairs": n})


def icp(source: DataFrame, target: DataFrame, init: np.ndarray | None = None, max_iterations: int = 50) -> np.ndarray:
    """The pose only; where registration is impossible, the initial one."""
    start = np.eye(4) if init is None else init
    try:
        return icp_point_to_point(source, target, start, max_iterations).transformation
    except ValueError:
        return start


def _accumulated(rows: DataFrame, sums: Callable[[pd.DataFrame], dict[str, float]], names: list[str]) -> np.ndarray:
    """Sums computed per Arrow batch by ``sums`` and added up in the JVM; only one row reaches the driver."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame([sums(batch)], columns=names)

    total = rows.mapInPandas(partial, ", ".join(f"{n} double" for n in names)).agg(*(F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names)).first()
    return np.array([total[n] for n in names])


_H = [f"h{i}{j}" for i in range(6) for j in range(i, 6)]
_G = [f"g{i}" for i in range(6)]


def _system(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrix, right side and the rest of accumulated sums."""
    h = np.zeros((6, 6))
    h[np.triu_indices(6)] = values[:21]
    return h + np.triu(h, 1).T, values[21:27], values[27:]


def _rows(h: np.ndarray, g: np.ndarray, *more: float) -> dict[str, float]:
    return dict(zip(_H, h[np.triu_indices(6)])) | dict(zip(_G, g)) | {f"r{i}": v for i, v in enumerate(more)}


def _solve(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(h, g)
    except np.linalg.LinAlgError as e:
        raise ValueError("the system is ill-conditioned") from e


def plane_system(pairs: DataFrame) -> DataFrame:
    """One row of sums over correspondences whose ``to`` has normals: n, squared gaps e, and the 6 x 6 normal equations h, g."""
    s, t, n = [F.col(a) for a in XYZ], [F.col(f"to.{a}") for a in XYZ], [F.col(f"to.n{a}") for a in XYZ]
    row = [s[1] * n[2] - s[2] * n[1], s[2] * n[0] - s[0] * n[2], s[0] * n[1] - s[1] * n[0], *n]
    gap = sum(((b - a) * c for a, b, c in zip(s, t, n)), F.lit(0.0))
    lined = pairs.select(*(c.alias(f"a{i}") for i, c in enumerate(row)), gap.alias("b"))
    sums = [F.sum(F.col(f"a{i}") * F.col(f"a{j}")).alias(f"h{i}{j}") for i in range(6) for j in range(i, 6)] + [F.sum(F.col(f"a{i}") * F.col("b")).alias(f"g{i}") for i in range(6)]
    return lined.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("b") * F.col("b")).alias("e"), *sums)


def icp_point_to_plane(source: DataFrame, target: DataFrame, init: np.ndarray | None = None, max_iterations: int = 50, threshold: float = 1e-6, max_distance: float | None = None) -> Registration:
    """Point-to-plane registration; the target has normals ``nx, ny, nz``. Fewer than 6 pairs are an error."""
    _checked(max_iterations, threshold, max_distance)
    source, target = _pair(source, target, "nx", "ny", "nz")
    pose, before = np.eye(4) if init is None else init, np.inf
    ready = Prepared(target, 1, (*XYZ, "nx", "ny", "nz"))
    for turn in range(max_iterations):
        pairs = correspondences(source, target, pose, max_distance, carry=(*XYZ, "nx", "ny", "nz"), prepared=ready)
        got = plane_system(pairs).first()
        if got["n"] < 6:
            raise ValueError("fewer than 6 correspondences")
        h, g, _ = _system(np.array([got[k] for k in (*_H, *_G)]))
        x = _solve(h, g)
        step = transforms.translation(*x[3:]) @ _small_rotation(*x[:3])
        pose, mse = step @ pose, got["e"] / got["n"]
        if abs(before - mse) < threshold:
            return Registration(pose, mse, turn + 1, True, {"pairs": got["n"]})
        before = mse
    return Registration(pose, before, max_iterations, False, {"pairs": got["n"]})


#: Scales as (voxel, iterations, distance), and the final refinement.
SCALES = ((0.20, 10, 0.50), (0.10, 10, 0.25), (0.05, 15, 0.15))


def multiscale_icp(source: DataFrame, target: DataFrame, init: np.ndarray | None = None, scales=SCALES, final_iterations: int = 10, final_distance: float | None = 0.10, threshold: float = 1e-5) -> Registration:
    """Point-to-point from coarse to fine voxels, then on all points. Scales with fewer than 3 voxels are skipped."""
    if not scales:
        raise ValueError("at least one scale is needed")
    positive(convergence_threshold=threshold, final_iterations=final_iterations)
    source, target = _pair(source, target)
    pose, turns, seen = np.eye(4) if init is None else init, 0, False

    def coarse(cloud: DataFrame, voxel: float) -> DataFrame:
        return _numbered(voxel_downsample(cloud, voxel))

    for voxel, iterations, distance in scales:
        positive(voxel_size=voxel, max_iterations=iterations)
        a, b = coarse(source, voxel), coarse(target, voxel)
        if a.count() < 3 or b.count() < 3:
            continue
        got = _icp(a, b, pose, iterations, threshold, distance)
        pose, turns, seen = got.transformation, turns + got.iterations, True
    if not seen:
        raise ValueError("no scale has enough voxels")
    got = _icp(source, target, pose, final_iterations, threshold, final_distance)
    return Registration(got.transformation, got.mse, turns + got.iterations, got.converged, got.details)


def gicp(source: DataFrame, target: DataFrame, init: np.ndarray | None = None, max_iterations: int = 50, max_distance: float = 1.0, threshold: float = 1e-6, k: int = 20) -> Registration:
    """Plane-to-plane registration by Gauss-Newton steps over per-point covariances of both clouds.

    Fewer points than max(k, 4), clouds flatter than 1e-4, and fewer than 6 pairs are errors.
    """
    _checked(max_iterations, threshold, max_distance)
    source, target = _pair(source, target)
    for cloud in (source, target):
        extent = cloud.agg(F.count(F.lit(1)).alias("n"), F.least(*(F.max(a) - F.min(a) for a in XYZ)).alias("e")).first()
        if extent["n"] < max(k, 4):
            raise ValueError("too few points for covariances")
        if extent["e"] < 1e-4:
            raise ValueError("the cloud is flat")
    parts = tuple(SYMMETRIC)
    source = scratch.written(source.join(registration_covariances(source, k), [KEY, "pid"]), "covariances")
    target = scratch.written(target.join(registration_covariances(target, k), [KEY, "pid"]), "covariances")
    pose, before = np.eye(4) if init is None else init, np.inf
    ready = Prepared(target, 1, (*XYZ, *parts))
    for turn in range(max_iterations):
        pairs = correspondences(source, target, pose, max_distance, carry=(*XYZ, *parts), prepared=ready)
        flat = pairs.select(*XYZ, *parts, "distance", *(F.col(f"to.{c}").alias(f"t_{c}") for c in (*XYZ, *parts)))
        r = pose[:3, :3]

        def sums(b: pd.DataFrame, r=r) -> dict[str, float]:
            m = matrices(*(b[f"t_{c}"] for c in parts)) + r @ matrices(*(b[c] for c in parts)) @ r.T
            inv = np.linalg.inv(m)
            s = b[list(XYZ)].to_numpy()
            residual = b[[f"t_{a}" for a in XYZ]].to_numpy() - s
            zero = np.zeros(len(b))
            skew = np.stack([np.stack([zero, s[:, 2], -s[:, 1]], -1), np.stack([-s[:, 2], zero, s[:, 0]], -1), np.stack([s[:, 1], -s[:, 0], zero], -1)], -2)
            jac = np.concatenate([skew, np.broadcast_to(np.eye(3), skew.shape)], axis=2)
            weighted = np.einsum("nij,njk->nik", inv, jac)
            h = np.einsum("nki,nkj->ij", jac, weighted)
            g = np.einsum("nki,nk->i", weighted, residual)
            return _rows(h, g, len(b), float((b["distance"] ** 2).sum()))

        h, g, (n, d2) = _system(_accumulated(flat, sums, [*_H, *_G, "r0", "r1"]))
        if n < 6:
            raise ValueError("fewer than 6 correspondences")
        x = _solve(h, g)
        mse = d2 / n
        pose = transforms.translation(*x[3:]) @ _small_rotation(*x[:3]) @ pose
        if abs(before - mse) < threshold:
            return Registration(pose, mse, turn + 1, True, {"pairs": int(n)})
        before = mse
    return Registration(pose, before, max_iterations, False, {"pairs": int(n)})


def adaptive_threshold(init: np.ndarray, voxel_size: float) -> float:
    """Three times the expected motion, between 3 and 10 voxels."""
    angle = np.arccos(np.clip((np.trace(init[:3, :3]) - 1) / 2, -1, 1))
    motion = np.linalg.norm(init[:3, 3]) + 2 * abs(np.sin(angle / 2)) * voxel_size
    return float(min(max(3 * motion, 3 * voxel_size), 10 * voxel_size))


def kiss_icp(source: DataFrame, target: DataFrame, init: np.ndarray | None = None, voxel_size: float = 1.0, min_range: float = 0.5, max_range: float = 100.0, max_iterations: int = 50) -> Registration:
    """Range filter, voxel downsampling, then point-to-point within an adaptive distance. The error is that after the step."""
    positive(max_iterations=max_iterations, voxel_size=voxel_size)
    source, target = _pair(source, target)
    ranged = transforms.range_filter(source, min_range, max_range)
    down = _numbered(voxel_downsample(ranged, voxel_size))
    if down.isEmpty():
        raise ValueError("no source points within the range")
    pose = np.eye(4) if init is None else init
    sigma, before = adaptive_threshold(pose, voxel_size), np.inf
    ready = Prepared(target, 1, XYZ)
    for turn in range(max_iterations):
        row = correspondences(down, target, pose, sigma, prepared=ready)
        squares = row.agg(F.sum(sum((F.col(a) * F.col(a) + F.col(f"to.{a}") * F.col(f"to.{a}") for a in XYZ), F.lit(0.0))).alias("q"))
        got = cross_covariance(row).crossJoin(F.broadcast(squares)).first()  # one row each
        n, s, t, h, _ = _sums(got)
        if n < 3:
            raise ValueError("fewer than 3 correspondences")
        step = kabsch(n, s, t, h)
        r, v = step[:3, :3], step[:3, 3]
        # sum of |R s + v - t|^2 from the sums alone
        mse = (got["q"] + n * v @ v + 2 * v @ (r @ s) - 2 * v @ t - 2 * np.sum((r @ h) * np.eye(3))) / n
        pose = step @ pose
        if abs(before - mse) < 1e-6:
            return Registration(pose, mse, turn + 1, True, {"pairs": n, "threshold": sigma})
        before = mse
    return Registration(pose, before, max_iterations, False, {"pairs": n, "threshold": sigma})


def ndt_voxels(target: DataFrame, resolution: float = 1.0, min_points: int = 5) -> DataFrame:
    """``(cloud_id, vx, vy, vz, n, mean_x .. mean_z, cxx .. czz)``: normal distributions of zero-anchored voxels.

    Population covariance with 1e-4 added on the diagonal; voxels with fewer than ``min_points`` are left out.
    """
    positive(resolution=resolution, min_points=min_points)
    grid = target.select(KEY, *XYZ, *(c.alias(f"v{a}") for a, c in zip(XYZ, cell(resolution))))
    cov = [(F.covar_pop(*ab) + (1e-4 if ab[0] == ab[1] else 0.0)).alias(c) for c, ab in COVARIANCE.items()]
    return grid.groupBy(KEY, "vx", "vy", "vz").agg(F.count(F.lit(1)).alias("n"), *(F.avg(a).alias(f"mean_{a}") for a in XYZ), *cov).where(F.col("n") >= min_points)


def _ndt_sums(source: DataFrame, grid: DataFrame, pose: np.ndarray, resolution: float) -> np.ndarray:
    moved = transforms.transform_points(source, pose)
    hit = moved.withColumns({f"v{a}": c for a, c in zip(XYZ, cell(resolution))}).join(grid, [KEY, "vx", "vy", "vz"])
    t = pose[:3, 3]

    def sums(b: pd.DataFrame) -> dict[str, float]:
        p = b[list(XYZ)].to_numpy()
        diff = p - b[[f"mean_{a}" for a in XYZ]].to_numpy()
        inv = np.linalg.inv(matrices(*(b[c] for c in SYMMETRIC)))
        pull = np.einsum("nij,nj->ni", inv, diff)
        e = np.exp(-0.5 * np.einsum("ni,ni->n", diff, pull))
        rs = p - t
        zero = np.zeros(len(b))
        turn = np.stack([np.stack([zero, rs[:, 2], -rs[:, 1]], -1), np.stack([-rs[:, 2], zero, rs[:, 0]], -1), np.stack([rs[:, 1], -rs[:, 0], zero], -1)], -2)
        jac = np.concatenate([np.broadcast_to(np.eye(3), turn.shape), turn], axis=2)
        h = np.einsum("n,nki,nkl,nlj->ij", e, jac, inv, jac, optimize=True)
        g = np.einsum("n,nki,nk->i", e, jac, pull)
        return _rows(h, g, float(e.sum()))

    return _accumulated(hit.select(*XYZ, *(f"mean_{a}" for a in XYZ), *SYMMETRIC), sums, [*_H, *_G, "r0"])


def ndt_score(source: DataFrame, target: DataFrame, pose: np.ndarray | None = None, resolution: float = 1.0, min_points: int = 5) -> float:
    """Sum of the densities of source points in the target's voxels; points outside all voxels add nothing."""
    source, target = _pair(source, target)
    return float(_ndt_sums(source, ndt_voxels(target, resolution, min_points), np.eye(4) if pose is None else pose, resolution)[-1])


def ndt_registration(source: DataFrame, target: DataFrame, init: np.ndarray | None = None, resolution: float = 1.0, step_size: float = 0.1, max_iterations: int = 35, epsilon: float = 1e-4, min_points: int = 5) -> Registration:
    """Registration to normal distributions in voxels: Newton steps of bounded size; convergence is tested before a step.

    ``details`` holds the score; ``mse`` is NaN. A target without voxels is an error.
    """
    positive(max_iterations=max_iterations, step_size=step_size, epsilon=epsilon)
    source, target = _pair(source, target)
    grid = scratch.written(ndt_voxels(target, resolution, min_points), "grid")
    if grid.isEmpty():
        raise ValueError("no voxel has enough points")
    pose, converged, score, turn = np.eye(4) if init is None else init, False, 0.0, 0
    for turn in range(1, max_iterations + 1):
        h, g, (score,) = _system(_ndt_sums(source, grid, pose, resolution))
        x = _solve(h + 1e-6 * np.eye(6), -g)
        length = np.linalg.norm(x)
        x = x * (step_size / length) if length > step_size else x
        if np.linalg.norm(x) < epsilon:
            converged = True
            break
        pose = transforms.translation(*x[:3]) @ _small_rotation(*x[3:]) @ pose
    return Registration(pose, float("nan"), turn, converged, {"score": float(score)})


def global_registration(source: DataFrame, target: DataFrame, ransac_iterations: int = 50_000, distance: float = 0.05, inlier_ratio: float = 0.25, fpfh_radius: float = 0.25, fpfh_k: int = 10, normals_k: int = 10, refine: bool = True, icp_iterations: int = 50, icp_distance: float | None = None, seed: int = 0, block: int = 1_000) -> Registration:
    """Registration without a first guess: normals, FPFH, one-way matches, three-point consensus, refinement.

    Poses are drawn in blocks of ``block``: the drawn matches come to the driver by rank, the poses of a block go to all tasks,
    and the matches that agree with each are counted where they lie, so there may be any number of matches. The first pose
    with the share ``inlier_ratio`` ends the search. Fewer than 3 matches are an error.
    """
    source, target = _pair(source, target)
    with_normals = lambda c: scratch.written(estimate_normals(c, normals_k), "normals")
    found = feature_matches(features.fpfh(with_normals(source), fpfh_radius, fpfh_k), features.fpfh(with_normals(target), fpfh_radius, fpfh_k))
    place = lambda c, n: c.select(F.col("pid").alias(n), *(F.col(a).alias(f"{n}_{a}") for a in XYZ))
    pairs = ranked(found.join(place(source, "source"), "source").join(place(target, "target"), "target"), ["source"])
    n = pairs.count()
    if n < 3:
        raise ValueError("fewer than 3 feature matches")
    names = [f"{side}_{a}" for side in ("source", "target") for a in XYZ]
    rng = np.random.default_rng(seed)
    best, most = np.eye(4), 0
    enough = max(3, int(np.ceil(inlier_ratio * n)))
    spark = pairs.sparkSession
    for first in range(0, ransac_iterations, block):
        picks = np.array([rng.choice(n, 3, replace=False) for _ in range(min(block, ransac_iterations - first))])
        asked = spark.createDataFrame(pd.DataFrame({"rank": np.unique(picks)}))
        rows = pairs.join(asked, "rank").select("rank", *names).toPandas().set_index("rank")
        p, q = (rows[[f"{side}_{a}" for a in XYZ]] for side in ("source", "target"))
        poses = np.array([kabsch(3, p.loc[t].to_numpy().sum(axis=0), q.loc[t].to_numpy().sum(axis=0), p.loc[t].to_numpy().T @ q.loc[t].to_numpy()) for t in picks])

        def agreeing(batches: Iterator[pd.DataFrame], poses=poses) -> Iterator[pd.DataFrame]:
            hits = np.zeros(len(poses), dtype=np.int64)
            for b in batches:
                x, y = b[names[:3]].to_numpy(), b[names[3:]].to_numpy()
                for i, pose in enumerate(poses):
                    hits[i] += int((((x @ pose[:3, :3].T + pose[:3, 3] - y) ** 2).sum(axis=1) <= distance * distance).sum())
            yield pd.DataFrame({"i": np.arange(len(poses)), "hits": hits})

        counted = pairs.select(*names).mapInPandas(agreeing, "i int, hits bigint").groupBy("i").agg(F.sum("hits").alias("hits")).toPandas().sort_values("i")
        hits = counted["hits"].to_numpy()
        over = np.flatnonzero(hits >= enough)
        at = int(over[0]) if len(over) else int(np.argmax(hits))
        if hits[at] > most:
            best, most = poses[at], int(hits[at])
        if len(over):
            break
    details = {"inliers": most, "inlier_ratio": most / n}
    if not refine:
        return Registration(best, float("nan"), 0, False, details)
    got = _icp(source, target, best, icp_iterations, 1e-6, icp_distance)
    return Registration(got.transformation, got.mse, got.iterations, got.converged, {**got.details, **details})


def icp_legacy(source: DataFrame, target: DataFrame, max_iterations: int = 50, threshold: float = 1e-6) -> tuple[np.ndarray, float]:
    """Pose and mean squared error of :func:`icp_point_to_point` without a first guess."""
    got = icp_point_to_point(source, target, None, max_iterations, threshold)
    return got.transformation, got.mse


def batch_icp(jobs: list[tuple[DataFrame, DataFrame]], max_iterations: int = 50, threshold: float = 1e-6, max_distance: float | None = None, together: int = 4) -> list[Registration | None]:
    """Registrations of pairs of clouds, ``together`` of them at a time, in the order given; None where one is impossible.

    Each is distributed itself; side by side their jobs share the executors, so that the last tasks of one leave none idle.
    """

    def run(job: tuple[DataFrame, DataFrame]) -> Registration | None:
        try:
            return icp_point_to_point(*job, None, max_iterations, threshold, max_distance)
        except ValueError:
            return None

    with ThreadPoolExecutor(max(1, together)) as pool:
        return list(pool.map(run, jobs))
