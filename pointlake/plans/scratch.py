"""Tables written to the folder that all executors share.

Lineage is cut by writing a Parquet table there and reading it back: it survives the loss of executors, is columnar and
compressed, and is counted once however often it is read. The folder is the session's ``spark.checkpoint.dir``; where that
is unset a temporary folder of this process is used and set, which only a session on one machine may do.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this application, below ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pointlake-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/pointlake-{spark.sparkContext.applicationId}"
    if path not in _made:
        if not _made:
            atexit.register(_clear)
        _made[path] = spark
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Compute ``df`` once, write it to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pointlake_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished plans: Spark deletes them once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file at a path in the shared folder, by the file system that the path's address names."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(sc._jsc.hadoopConfiguration()).create(p, True)
    try:
        for at in range(0, len(data), 1 << 22):
            out.write(bytearray(data[at : at + (1 << 22)]))
    finally:
        out.close()


def make_folder(spark: SparkSession, path: str) -> None:
    """An empty folder at a path in the shared folder."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).mkdirs(p)


def is_written(df: DataFrame) -> bool:
    """Whether a table is one that :func:`written` gave back."""
    return hasattr(df, "_pointlake_path")


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that no later plan reads."""
    path = getattr(df, "_pointlake_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def _clear() -> None:
    for path, spark in _made.items():
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone, and its folder with it
            pass
