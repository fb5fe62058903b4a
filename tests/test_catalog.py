from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

from pointlake import catalog

ROOT = Path(__file__).resolve().parent.parent


def test_sql_is_text_and_belongs_to_queries():
    assert all(isinstance(v, str) for v in catalog.oracle_sql().values()) and set(catalog.oracle_sql()) <= set(catalog.queries())


def test_nothing_outside_imports_the_optional_subpackage():
    for f in (ROOT / "pointlake").rglob("*.py"):
        if "llm" not in f.parts:
            assert "pointlake.llm" not in f.read_text()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry_gives_rows(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["cloud_id", "vx", "vy", "vz", "x", "y", "z", "n"]


def test_the_repository_is_small():
    size = subprocess.run(["du", "-sm", str(ROOT)], capture_output=True, text=True).stdout.split()[0]
    assert int(size) < 30


def test_operators_run_over_every_recorded_cloud(spark, tmp_path):
    rows = [(c, 8 * i + j, 0.1 * i + shift, 0.1 * j, 0.0, 0.0, 0.0, 1.0) for c, shift in (("a", 0.0), ("b", 40.0)) for i in range(8) for j in range(8)]
    rows += [("b", 64 + i, 60.0 + 0.1 * i, 0.0, 0.0, 0.0, 0.0, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "cloud_id string, pid bigint, x double, y double, z double, nx double, ny double, nz double")
    df.unionAll(df.limit(3)).write.parquet(str(tmp_path / "cloud_normal.parquet"))
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    sizes = {(r.cloud_id, r.cluster_id, r["size"]) for r in run("scan_euclidean_clusters")}
    assert sizes == {("a", 0, 64), ("b", 0, 64), ("b", 1, 5)}
    flat = run("scan_normals_knn")
    assert len(flat) == len(rows) and all(r.nz == 1.0 for r in flat if r.pid < 64)
    assert {(r.cloud_id, r.pid) for r in run("scan_shot")} == {r[:2] for r in rows}
