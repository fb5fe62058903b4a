"""Clouds as streams: voxel sums, statistics, collection, with what Structured Streaming adds to a chunked pipeline.

A pipeline is a streaming DataFrame, its state an aggregate; ``finish`` runs what is there to the end and returns the result,
``start`` keeps running under a processing-time trigger. Back-pressure is the source's rate limit: sources are pulled, so
nothing is dropped.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pointlake.functions.geometry import XYZ
from pointlake.plans import scratch
from pointlake.schema import positive


def parquet_stream(spark: SparkSession, directory: str, table: str, files_per_trigger: int = 1) -> DataFrame:
    """A table of a directory, a Parquet file or a folder of them, as a stream."""
    positive(files_per_trigger=files_per_trigger)
    path = f"{directory}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if os.path.isdir(path.removeprefix("file://")):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(directory)


def _own(points: DataFrame) -> list[str]:
    return ["cloud_id"] if "cloud_id" in points.columns else []


def voxel_stream(points: DataFrame, voxel_size: float) -> DataFrame:
    """``(vx, vy, vz, x, y, z, n)``: running centroids of zero-anchored voxels; the state is one row per voxel.

    Of a stream with ``cloud_id`` each cloud has voxels of its own, and the column comes first.
    """
    positive(voxel_size=voxel_size)
    cells = {f"v{c}": F.floor(F.col(c) / voxel_size) for c in XYZ}
    own = _own(points)
    return points.select(*own, *XYZ).withColumns(cells).groupBy(*own, "vx", "vy", "vz").agg(*(F.avg(c).alias(c) for c in XYZ), F.count(F.lit(1)).alias("n"))


def statistics_stream(points: DataFrame) -> DataFrame:
    """``(n, min, max and mean of x, y, z)`` of all points so far, of a stream with ``cloud_id`` for each cloud."""
    return points.groupBy(*_own(points)).agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{k}_{c}") for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg)) for c in XYZ))


def windowed_voxels(points: DataFrame, voxel_size: float, time: str, window: str, lateness: str) -> DataFrame:
    """Voxel centroids per event-time window; points later than ``lateness`` are left out and closed windows leave the state."""
    positive(voxel_size=voxel_size)
    cells = [F.floor(F.col(c) / voxel_size).alias(f"v{c}") for c in XYZ]
    timed = points.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    return timed.groupBy(F.window(time, window), *cells).agg(*(F.avg(c).alias(c) for c in XYZ), F.count(F.lit(1)).alias("n"))


@dataclass
class Metrics:
    """What a query has done, and of a :class:`Feed` what it was sent."""

    batches: int
    rows: int
    rows_per_second: float
    sent: int = 0
    dropped: int = 0
    queued: int = 0


def metrics(query: StreamingQuery) -> Metrics:
    """Counts of a running or finished query."""
    progress = query.recentProgress
    return Metrics(len(progress), int(sum(p["numInputRows"] for p in progress)), float(progress[-1]["processedRowsPerSecond"]) if progress and progress[-1]["numInputRows"] else 0.0)


def finish(stream: DataFrame, mode: str | None = None, each: Callable[[DataFrame, int], None] | None = None, skipped: list[Exception] | None = None) -> DataFrame:
    """Run a stream over all that is available and return the last result as a table.

    ``complete`` results (aggregates) are replaced with every batch, others appended; both and the checkpoint lie in the
    shared folder, so a batch that runs twice is written once. ``each`` is called with every batch; if ``skipped`` is a list,
    a batch for which it fails is left out and the error added there (its length is their number), else the stream fails.
    """
    spark = stream.sparkSession
    path, state = scratch.new_path(spark, "stream"), scratch.new_path(spark, "state")
    grouped = mode or ("complete" if "Aggregate" in stream._jdf.queryExecution().logical().toString() else "append")

    def write(batch: DataFrame, number: int) -> None:
        if each is not None:
            try:
                each(batch, number)
            except Exception as e:
                if skipped is None:
                    raise
                skipped.append(e)
                return
        target = path if grouped == "complete" else f"{path}/b{number}"
        batch.write.mode("overwrite").parquet(target)

    query = stream.writeStream.outputMode(grouped).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    try:
        return spark.read.schema(stream.schema).parquet(path if grouped == "complete" else f"{path}/*")
    except Exception as e:  # no batch: nothing was available
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], stream.schema)


def start(stream: DataFrame, path: str, checkpoint: str, every: str = "10 milliseconds", mode: str = "append") -> StreamingQuery:
    """A query that keeps running, by default as soon as there is something; ``stop`` ends it, a restart goes on."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=every)
    if mode == "append":
        return writer.format("parquet").option("path", path).start()
    return writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()


class Feed:
    """Chunks pushed into a stream through a bounded queue.

    A chunk is a table written to a folder of the shared file system from which a query reads one after the other; those
    written and not yet read are the queue. :meth:`send` waits for room, :meth:`try_send` drops and counts a chunk for which
    there is none. ``build`` makes the result of the stream of chunks; :meth:`finish` works off the rest and returns it.
    """

    def __init__(self, spark: SparkSession, schema: str, build: Callable[[DataFrame], DataFrame], capacity: int = 1024, mode: str = "complete") -> None:
        positive(capacity=capacity)
        self.spark, self.kind, self.capacity = spark, schema, capacity
        self.sent = self.dropped = 0
        self.folder, self.path = scratch.new_path(spark, "feed"), scratch.new_path(spark, "fed")
        scratch.make_folder(spark, self.folder)
        stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(self.folder))
        self.schema = stream.schema
        target = (lambda n: self.path) if mode == "complete" else (lambda n: f"{self.path}/b{n}")
        write = lambda batch, n: batch.write.mode("overwrite").parquet(target(n))
        self.mode, self.read = mode, 0
        self.query = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch.new_path(spark, "state")).foreachBatch(write).start()

    def depth(self) -> int:
        """Chunks in the queue."""
        if self.query.exception() is not None:
            raise RuntimeError(str(self.query.exception()))
        last = self.query.lastProgress
        if last:
            # a batch is a chunk; the last one counts once it has read its rows
            self.read = max(self.read, int(last["batchId"]) + bool(last["numInputRows"]))
        return max(0, self.sent - self.read)

    def try_send(self, rows: list[tuple]) -> bool:
        """Put a chunk into the queue; False, and the chunk is counted as dropped, if the queue is full."""
        if self.depth() >= self.capacity:
            self.dropped += 1
            return False
        self.spark.createDataFrame(rows, self.kind).coalesce(1).write.mode("append").parquet(self.folder)
        self.sent += 1
        return True

    def send(self, rows: list[tuple], timeout: float = 60.0) -> None:
        """Put a chunk into the queue as soon as there is room; none within ``timeout`` seconds is an error."""
        until = time.monotonic() + timeout
        while self.depth() >= self.capacity:
            if time.monotonic() > until:
                raise TimeoutError("the queue stayed full")
            time.sleep(0.01)
        self.try_send(rows)

    def metrics(self) -> Metrics:
        done = metrics(self.query)
        return Metrics(done.batches, done.rows, done.rows_per_second, self.sent, self.dropped, self.depth())

    def finish(self) -> DataFrame:
        """Work off what is queued, end the query and return its result."""
        self.query.processAllAvailable()
        self.query.stop()
        try:
            return self.spark.read.schema(self.schema).parquet(self.path if self.mode == "complete" else f"{self.path}/*")
        except Exception as e:  # nothing was sent
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)
