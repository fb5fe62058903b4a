"""Queries that write a table in a format and read it back: the rows must be those of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.catalog.clouds import SCANS, oriented, r6, rounded, scans
from pointlake.plans import scratch
from pointlake.sources import registry

XYZ = ("x", "y", "z")


def _cloud(form: str, text: bool = False, normals: bool = False):
    def run(s: SparkSession, d: str) -> DataFrame:
        path = scratch.new_path(s, form)
        cloud = oriented(s, d) if normals else scans(s, d)
        registry.write_point_cloud(cloud, path, form=form, text=text, single=False)
        back = registry.read_point_cloud(s, path, form=form)
        return rounded(back, *XYZ, *(("nx", "ny", "nz") if normals else ()), places=3 if form == "kitti" else 6).select(*XYZ, *(("nx", "ny", "nz") if normals else ()))

    return run


def _text(s: SparkSession, d: str) -> DataFrame:
    """Four folders of text, each with a delimiter, an order of columns and a header or none of its own, read as one."""
    path = scratch.new_path(s, "text")
    cloud = scans(s, d)
    for n, (sep, order, header) in enumerate(((",", XYZ, True), (";", ("z", "y", "x"), True), ("\t", XYZ, False), (" ", ("y", "x", "z"), True))):
        registry.write_xyz(cloud.where(F.pmod("pid", F.lit(4)) == n), f"{path}/{n}", order, sep, header)
    return registry.read_xyz(s, path).select(*XYZ)


def _messages(s: SparkSession, d: str) -> DataFrame:
    """Each cloud as messages and back."""
    return registry.decode_clouds(registry.encode_clouds(scans(s, d)), "cloud_id").select("cloud_id", *(F.round(c, 3).alias(c) for c in XYZ))


QUERIES = {
    "roundtrip_ply": _cloud("ply", normals=True),
    "roundtrip_ply_text": _cloud("ply", text=True),
    "roundtrip_pcd": _cloud("pcd"),
    "roundtrip_pcd_text": _cloud("pcd", text=True),
    "roundtrip_kitti": _cloud("kitti"),
    "roundtrip_obj": _cloud("obj"),
    "roundtrip_e57": _cloud("e57"),
    "read_xyz_folder": _text,
    "roundtrip_pointcloud2": _messages,
}
_BACK = f"SELECT {', '.join(r6(c, c) for c in XYZ)} FROM {SCANS}"
SQL = {
    "roundtrip_ply": "SELECT " + ", ".join(r6(c, c) for c in (*XYZ, "nx", "ny", "nz")) + " FROM (SELECT x, y, z, nx / len AS nx, ny / len AS ny, nz / len AS nz FROM (SELECT DISTINCT cloud_id, pid, x, y, z, nx, ny, nz, sqrt(nx * nx + ny * ny + nz * nz) AS len FROM cloud_normal WHERE isfinite(x) AND isfinite(y) AND isfinite(z)) WHERE len > 1e-6 AND len < 1e6)",
    "roundtrip_ply_text": _BACK,
    "roundtrip_pcd": _BACK,
    "roundtrip_pcd_text": _BACK,
    "roundtrip_kitti": f"SELECT {', '.join(r6(c, c, 3) for c in XYZ)} FROM {SCANS}",
    "roundtrip_obj": _BACK,
    "roundtrip_e57": _BACK,
    "read_xyz_folder": f"SELECT x, y, z FROM {SCANS}",
    "roundtrip_pointcloud2": f"SELECT cloud_id, {', '.join(r6(c, c, 3) for c in XYZ)} FROM {SCANS}",
}
