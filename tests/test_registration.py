from __future__ import annotations

import numpy as np
import pytest

from pointlake.operators import normals, registration, transforms

POSE = transforms.compose(transforms.translation(0.05, -0.02, 0.01), transforms.rotation((0, 0, 1), 0.02))


@pytest.fixture(scope="module")
def pair(spark):
    p = np.random.default_rng(0).uniform(-1, 1, (150, 3))
    c = spark.createDataFrame([("a", i, *map(float, q)) for i, q in enumerate(p)], "cloud_id string, pid bigint, x double, y double, z double").cache()
    return c, transforms.transform_points(c, POSE).cache()


def close(r, tolerance=1e-6):
    return np.abs(r.transformation - POSE).max() < tolerance


def test_point_to_point(pair):
    r = registration.icp_point_to_point(*pair, max_iterations=10)
    assert close(r) and r.converged and r.mse < 1e-9
    assert registration.icp_point_to_point(*pair, max_iterations=1).converged is False


def test_point_to_plane(pair):
    r = registration.icp_point_to_plane(pair[0], normals.estimate_normals(pair[1], 10), max_iterations=6, threshold=1e-12)
    assert close(r, 1e-4)


def test_gicp_and_multiscale(pair):
    assert close(registration.gicp(*pair, max_iterations=5), 1e-4)
    assert close(registration.multiscale_icp(*pair, scales=((0.3, 5, 1.0),)), 1e-6)


def test_ndt_improves_its_score(pair):
    before = registration.ndt_score(*pair, resolution=0.8)
    r = registration.ndt_registration(*pair, resolution=0.8, max_iterations=6)
    assert r.details["score"] >= before * 0.99


def test_errors(pair, spark):
    empty = pair[0].limit(0)
    for call in (lambda: registration.icp_point_to_point(empty, pair[1]), lambda: registration.icp_point_to_point(*pair, max_iterations=0), lambda: registration.icp_point_to_point(*pair, max_distance=1e-9), lambda: registration.gicp(pair[0].limit(3), pair[1]), lambda: registration.ndt_registration(*pair, resolution=0.001)):
        with pytest.raises(ValueError):
            call()
    assert (registration.icp(empty, pair[1]) == np.eye(4)).all()


def test_kabsch_of_a_reflection_is_a_rotation():
    p = np.random.default_rng(1).normal(size=(5, 3))
    q = p * [1, 1, -1]
    m = registration.kabsch(5, p.sum(0), q.sum(0), p.T @ q)
    assert np.linalg.det(m[:3, :3]) == pytest.approx(1)


def test_adaptive_threshold():
    assert registration.adaptive_threshold(np.eye(4), 0.5) == 1.5
    assert registration.adaptive_threshold(transforms.translation(100, 0, 0), 0.5) == 5.0
