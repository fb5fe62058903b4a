"""Reading and writing clouds, meshes, text and bags by path; formats can be added."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.sources import parsing, ros
from pointlake.plans.ranks import ranked
from pointlake.sources.datasource import BAG, EXTENSIONS, PointSource, UnsupportedFormat, files_of, format_of, written_file

Reader = Callable[[SparkSession, str], DataFrame]
_readers: dict[str, Reader] = {}
_writers: dict[str, Callable[[DataFrame, str], None]] = {}
TEXT = (".xyz", ".csv", ".txt")
MESHES = ("ply", "obj", "stl")


def register_reader(extension: str, reader: Reader) -> None:
    """Let :func:`read_point_cloud` read files of an extension by a function of session and path."""
    _readers[extension.lower()] = reader


def register_writer(extension: str, writer: Callable[[DataFrame, str], None]) -> None:
    """Let :func:`write_point_cloud` write files of an extension."""
    _writers[extension.lower()] = writer


def supported_formats() -> dict[str, list[str]]:
    """Extensions that can be read and written, as clouds and as meshes."""
    return {"read": sorted({*EXTENSIONS, *TEXT, *_readers}), "write": sorted({".ply", ".pcd", ".bin", ".obj", ".e57", *TEXT, *_writers}), "read_mesh": [".obj", ".ply", ".stl"], "write_mesh": [".obj", ".ply", ".stl"]}


def _extension(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower()


def can_read(path: str, form: str | None = None) -> bool:
    """Whether a cloud can be read from a path: by the format given, a registered reader, an extension, else the first bytes."""
    end = _extension(path)
    if form is not None:
        return form in {*EXTENSIONS.values(), "xyz", "csv", "txt"} - {"mcap", "db3"}
    if end in _readers or end in TEXT:
        return True
    try:
        return all(format_of(f) not in ("mcap", "db3") for f in files_of(path))
    except (OSError, ValueError):
        return False


def read_point_cloud(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """A cloud by the format given, by a registered reader, by extension, else by the first bytes."""
    end = _extension(path)
    if form is None and end in _readers:
        return _readers[end](spark, path)
    if form in ("xyz", "csv", "txt") or form is None and end in TEXT:
        return read_xyz(spark, path)
    if end in (".las", ".laz"):
        raise UnsupportedFormat(f"{path}: LAS and LAZ are not supported")
    spark.dataSource.register(PointSource)
    reader = spark.read.format("pointlake").option("path", path)
    return (reader.option("form", form) if form else reader).load()


def write_point_cloud(cloud: DataFrame, path: str, form: str | None = None, text: bool = False, single: bool = True) -> None:
    """Write a cloud: to one file in pid order, or (``single`` off, or a path without extension) a file per partition."""
    end = _extension(path)
    if end in _writers:
        return _writers[end](cloud, path)
    if form in ("xyz", "csv", "txt") or end in TEXT:
        return write_xyz(cloud, path)
    cloud.sparkSession.dataSource.register(PointSource)
    if single and end:
        cloud = cloud.coalesce(1).sortWithinPartitions("pid") if "pid" in cloud.columns else cloud.coalesce(1)
    writer = cloud.write.format("pointlake").option("path", path).option("ascii", str(text).lower())
    (writer.option("form", form) if form else writer).mode("overwrite").save()


# -- text -----------------------------------------------------------------------------------------------------------------


def xyz_points(lines: DataFrame, schema: parsing.XyzSchema, value: str = "value") -> DataFrame:
    """Text lines as points by a schema; works on batches and streams. Colours are clamped to 0..255, bad values null.

    Runs of blanks count as one where the delimiter is a blank. The header line, blank lines and comments go.
    """
    line = F.trim(F.col(value))
    split = F.split(line, r"[ \t]+" if schema.delimiter == " " else schema.delimiter if schema.delimiter != "\t" else "\t")
    rows = lines.where((line != "") & ~line.startswith("#") & ~line.startswith("//"))
    if schema.has_header:
        names = split[schema.columns.index("x")]
        rows = rows.where(~(names.try_cast("double").isNull() & F.lower(F.trim(names)).isin(*parsing.XYZ_NAMES["x"].split())))
    at = lambda c: F.trim(F.get(split, schema.columns.index(c)))
    out: dict[str, Column] = {c: at(c).try_cast("double") for c in ("x", "y", "z", "intensity", "nx", "ny", "nz") if c in schema.columns}
    out |= {c: F.greatest(F.lit(0), F.least(F.lit(255), at(c).try_cast("double").cast("int"))) for c in "rgb" if c in schema.columns}
    return rows.select("*", *(v.alias(k) for k, v in out.items())).drop(value)


_SCHEMA = "path string, names array<string>, delimiter string, has_header boolean, head bigint, problem string"


def _detected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, at, line in batch.itertuples(index=False):
            try:
                found = parsing.detect_xyz(line)
                rows.append((path, list(found.columns), found.delimiter, found.has_header, at, None))
            except ValueError as e:
                rows.append((path, None, None, None, at, str(e)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SCHEMA.split(", ")])


def file_schemas(spark: SparkSession, path: str) -> DataFrame:
    """``(path, names, delimiter, has_header, head, problem)``: the schema of each file, from its first line that is no comment.

    ``head`` is the byte at which that line starts; a file whose first line shows no schema has nulls and the ``problem``.
    """
    spark.dataSource.register(PointSource)
    heads = spark.read.format("pointlake").option("kind", "heads").option("path", path).load()
    return heads.mapInPandas(_detected, _SCHEMA)


def detect_schema(spark: SparkSession, path: str) -> parsing.XyzSchema:
    """The schema of the first file of a path."""
    found = file_schemas(spark, path).orderBy("path").first()
    if found is None:
        raise ValueError(f"{path} is empty")
    if found.problem:
        raise ValueError(f"{found.path}: {found.problem}")
    return parsing.XyzSchema(tuple(found.names), found.delimiter, found.has_header)


def xyz_lines(spark: SparkSession, path: str, schema: parsing.XyzSchema | None = None) -> DataFrame:
    """``(cloud_id, pid, line, names, vals, reason)``: every data line of text files, each by the schema of its own file.

    ``cloud_id`` is the file's name, ``pid`` the byte at which the line starts. ``reason`` is null for a point, else ``schema``
    (the file shows none), ``columns`` (another number of values) or ``value`` (x, y, z not a number, or another known column
    neither empty nor a number). Headers, blank lines and comments are no data. Runs of blanks separate once.
    """
    spark.dataSource.register(PointSource)
    lines = spark.read.format("pointlake").option("kind", "lines").option("path", path).load()
    if schema is None:
        known = file_schemas(spark, path)
    else:
        known = lines.select("path").distinct().select("path", F.array(*map(F.lit, schema.columns)).alias("names"), F.lit(schema.delimiter).alias("delimiter"), F.lit(schema.has_header).alias("has_header"), F.lit(None).cast("bigint").alias("head"), F.lit(None).cast("string").alias("problem"))
    line = F.col("line")
    # the header of a given schema is the line that names the columns
    named = F.lower(F.get(F.col("vals"), F.array_position("names", "x").cast("int") - 1)).isin(*parsing.XYZ_NAMES["x"].split())
    header = F.col("has_header") & (named if schema is not None else F.col("pid") == F.col("head"))
    split = lambda d: F.transform(F.split(line, r"[ \t]+" if d == " " else d), lambda v: F.trim(v))
    values = F.coalesce(*(F.when(F.col("delimiter") == d, split(d)) for d in (",", ";", "\t", " ")), F.array().cast("array<string>"))
    rows = lines.withColumn("line", F.btrim("value", F.lit(" \t\r\n"))).where((line != "") & ~line.startswith("#") & ~line.startswith("//")).join(known, "path")
    rows = rows.withColumn("vals", values).where(~F.coalesce(header, F.lit(False)))
    # a file without header may carry further values beside its first three
    least = F.when(F.col("has_header"), F.size("vals") == F.size("names")).otherwise(F.size("vals") >= F.size("names"))
    wrong = F.exists(F.arrays_zip("names", "vals"), lambda p: p["names"].isin("x", "y", "z", "intensity", "r", "g", "b", "nx", "ny", "nz") & p["vals"].try_cast("double").isNull() & (p["names"].isin("x", "y", "z") | (p["vals"] != "")))
    reason = F.when(F.col("problem").isNotNull(), "schema").when(~least, "columns").when(F.coalesce(wrong, F.lit(False)), "value")
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("cloud_id"), "pid", "line", "names", "vals", reason.alias("reason"))


def read_xyz(spark: SparkSession, path: str, schema: parsing.XyzSchema | None = None) -> DataFrame:
    """XYZ, CSV or TXT files as clouds, each file by its own delimiter, header and order of columns; files are split like any text.

    ``(cloud_id, pid, x, y, z, intensity, nx, ny, nz, r, g, b)``; columns a file lacks are null, colours are clamped to 0..255.
    Lines of another width than their file's and files without a schema come out with the reason in :func:`xyz_failures` only;
    a value that is no number is null here, and its line is there too. A path of which no file shows a schema is an error.
    """
    if schema is None and file_schemas(spark, path).where("problem IS NULL").isEmpty():
        raise ValueError(f"{path}: no file shows a schema")
    rows = xyz_lines(spark, path, schema).where("reason IS NULL OR reason = 'value'")
    at = lambda c: F.try_element_at("vals", F.nullif(F.array_position("names", F.lit(c)), F.lit(0)).cast("int"))
    numbers = [at(c).try_cast("double").alias(c) for c in ("x", "y", "z", "intensity", "nx", "ny", "nz")]
    value = {c: at(c).try_cast("double") for c in "rgb"}
    colours = [F.when(v.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(255), v.cast("int")))).alias(c) for c, v in value.items()]
    return rows.select("cloud_id", "pid", *numbers, *colours)


def xyz_failures(spark: SparkSession, path: str, schema: parsing.XyzSchema | None = None) -> DataFrame:
    """``(cloud_id, pid, line, reason)``: the lines that :func:`read_xyz` leaves out or reads with a null."""
    return xyz_lines(spark, path, schema).where("reason IS NOT NULL").select("cloud_id", "pid", "line", "reason")


def stream_xyz(spark: SparkSession, folder: str, schema: parsing.XyzSchema, files_per_trigger: int = 1) -> DataFrame:
    """The same of files that arrive in a folder, as a stream."""
    return xyz_points(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder), schema)


def write_xyz(cloud: DataFrame, path: str, columns: tuple[str, ...] = ("x", "y", "z"), delimiter: str = ",", header: bool = True) -> None:
    """Text files in a folder, a file per partition; columns that the cloud lacks are written as 0."""
    have = set(cloud.columns)
    out = cloud.select(*(F.coalesce(F.col(c), F.lit(0)).alias(c) if c in have else F.lit(0).alias(c) for c in columns))
    out.write.option("sep", delimiter).option("header", str(header).lower()).mode("overwrite").csv(path)


# -- meshes ---------------------------------------------------------------------------------------------------------------

_MESH = "mesh_id string, id bigint, is_vertex boolean, x double, y double, z double, nx double, ny double, nz double, a bigint, b bigint, c bigint"


def _mesh_arrays(path: str, data: bytes) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    form = EXTENSIONS.get(_extension(path)) or parsing.sniff(data[:4096])
    if form == "ply":
        found = parsing.read_ply(data)
        v = found.get("vertex", {})
        points = np.stack([np.asarray(v[c], float) for c in "xyz"], 1)
        normals = np.stack([np.asarray(v[f"n{c}"], float) for c in "xyz"], 1) if "nx" in v else None
        face = found.get("face", {})
        polygons = face.get("vertex_indices", face.get("vertex_index", []))
        return points, normals, parsing.fans(polygons)
    if form == "obj":
        o = parsing.read_obj(data.decode("utf-8", "replace"))
        points = np.array([p[:3] for p in o.vertices]).reshape(-1, 3)
        normals = np.array(o.normals) if o.normals and len(o.normals) == len(o.vertices) else None
        return points, normals, parsing.obj_triangles(o)
    if form == "stl":
        said, corners = parsing.read_stl(data)
        points, faces, kept = parsing.weld(corners)
        normals = np.zeros_like(points)
        for i in range(3):
            np.add.at(normals, faces[:, i], said[kept])
        length = np.linalg.norm(normals, axis=1, keepdims=True)
        return points, np.divide(normals, length, out=np.zeros_like(normals), where=length > 0), faces
    raise UnsupportedFormat(f"{path}: no mesh format")


def _mesh_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, data in zip(batch["path"], batch["content"]):
            points, normals, faces = _mesh_arrays(path, bytes(data))
            v = pd.DataFrame({"id": np.arange(len(points)), "is_vertex": True, **{c: points[:, i] for i, c in enumerate("xyz")}, **({f"n{c}": normals[:, i] for i, c in enumerate("xyz")} if normals is not None else {})})
            f = pd.DataFrame({"id": np.arange(len(faces)), "is_vertex": False, **{c: faces[:, i] for i, c in enumerate("abc")}})
            out = pd.concat([v, f], ignore_index=True).reindex(columns=[c.split()[0] for c in _MESH.split(", ")[1:]])
            out.insert(0, "mesh_id", os.path.basename(path))
            yield out.astype({c: "Int64" for c in "abc"})


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of PLY, OBJ or STL files, one mesh per file; polygons become fans of triangles."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_mesh_rows, _MESH)
    vertices = rows.where("is_vertex").select("mesh_id", F.col("id").alias("vid"), "x", "y", "z", "nx", "ny", "nz")
    return vertices, rows.where("NOT is_vertex").select("mesh_id", F.col("id").alias("fid"), "a", "b", "c")


def read_obj_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of OBJ files of any size, as :func:`read_mesh` gives them but without normals, read by byte ranges.

    Vertices are numbered by their order in the file, polygons become fans. Faces with an index that is no vertex of their file
    (negative ones too, which count from the end) are left out of the triangles.
    """
    spark.dataSource.register(PointSource)
    lines = spark.read.format("pointlake").option("kind", "lines").option("path", path).load()
    parts = lines.select(F.element_at(F.split("path", "/"), -1).alias("mesh_id"), "pid", F.split(F.btrim("value", F.lit(" \t\r\n")), r"[ \t]+").alias("p"))
    at = [F.get("p", i).try_cast("double").alias(c) for i, c in enumerate("xyz", 1)]
    points = ranked(parts.where("p[0] = 'v'").select("mesh_id", "pid", *at), ["mesh_id", "pid"])
    first = points.groupBy("mesh_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    vertices = points.join(first, "mesh_id").select("mesh_id", (F.col("rank") - F.col("first")).alias("vid"), *"xyz")
    corner = F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda c: F.split_part(c, F.lit("/"), F.lit(1)).try_cast("bigint") - 1)
    corners = parts.where("p[0] = 'f'").select("mesh_id", "pid", corner.alias("c"))
    fans = corners.where("size(c) >= 3").select("mesh_id", "pid", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("c") - 2), lambda i: F.struct(F.get("c", F.lit(0)).alias("a"), F.get("c", i).alias("b"), F.get("c", i + 1).alias("c")))).alias("n", "t"))
    known = fans.select("mesh_id", "pid", F.col("n").alias("piece"), "t.*").join(first, "mesh_id").where("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND least(a, b, c) >= 0 AND greatest(a, b, c) < n")
    faces = ranked(known.select("mesh_id", "pid", "piece", "a", "b", "c"), ["mesh_id", "pid", "piece"])
    start = faces.groupBy("mesh_id").agg(F.min("rank").alias("first"))
    return vertices, faces.join(start, "mesh_id").select("mesh_id", (F.col("rank") - F.col("first")).alias("fid"), "a", "b", "c")


def write_mesh(vertices: DataFrame, faces: DataFrame, path: str, text: bool = False) -> None:
    """One mesh to one file. Such files are ordered and number their vertices, so the rows of the mesh meet on the driver."""
    form = EXTENSIONS.get(_extension(path))
    if form not in MESHES:
        raise UnsupportedFormat(f"{path}: no mesh format that can be written")
    v = vertices.orderBy("vid").toPandas()
    f = faces.orderBy("fid").select("a", "b", "c").toPandas().to_numpy()
    place = np.searchsorted(v["vid"].to_numpy(), f) if len(f) else np.empty((0, 3), int)
    points = v[["x", "y", "z"]].to_numpy(dtype=float)
    normals = v[["nx", "ny", "nz"]].to_numpy(dtype=float) if "nx" in v and v["nx"].notna().all() else None
    if form == "ply":
        columns = {c: points[:, i] for i, c in enumerate("xyz")} | ({f"n{c}": normals[:, i] for i, c in enumerate("xyz")} if normals is not None else {})
        data = parsing.write_ply(columns, place, "ascii" if text else "binary_little_endian")
    elif form == "obj":
        data = parsing.write_obj(points, place, normals).encode()
    else:
        data = parsing.write_stl(points[place], "ascii" if text else "binary")
    written_file(path, data)


# -- bags and messages ----------------------------------------------------------------------------------------------------


def read_bag(spark: SparkSession, path: str, topics: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """``(topic, message_type, ts_ns, data)`` of MCAP or SQLite bags, by topic and (inclusive) nanoseconds."""
    spark.dataSource.register(PointSource)
    reader = spark.read.format("pointlake").schema(BAG).option("kind", "bag").option("path", path)
    for k, v in (("topics", ",".join(topics) if topics else None), ("start", start), ("end", end)):
        if v is not None:
            reader = reader.option(k, str(v))
    return reader.load()


def bag_topics(messages: DataFrame) -> DataFrame:
    """``(topic, message_type)``: each topic once."""
    return messages.select("topic", "message_type").dropDuplicates(["topic"])


def decode_clouds(messages: DataFrame, key: str = "msg_id", data: str = "data") -> DataFrame:
    """``(key, pid, x, y, z, error)``: the points of point cloud messages in CDR form, numbered within a message.

    A payload that is null or cannot be decoded gives one row with the reason in ``error`` and no point.
    """
    kind = messages.schema[key].dataType.simpleString()

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, payload in zip(batch["k"], batch["d"]):
                try:
                    if payload is None:
                        raise ValueError("null payload")
                    columns = ros.decode_cdr(bytes(payload)).columns()
                    yield pd.DataFrame({key: k, "pid": np.arange(len(columns["x"])), **columns, "error": None})
                except ValueError as e:
                    yield pd.DataFrame({key: [k], "pid": pd.array([None], "Int64"), **{c: [np.nan] for c in "xyz"}, "error": [str(e)]})

    rows = messages.select(F.col(key).alias("k"), F.col(data).alias("d"))
    out = rows.mapInPandas(decode, f"`{key}` {kind}, pid bigint, x double, y double, z double, error string")
    return out.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in "xyz"})


def encode_clouds(cloud: DataFrame, key: str = "cloud_id") -> DataFrame:
    """``(key, data BINARY)``: each cloud as one message in CDR form, points in pid order; a message holds what one may."""
    kind = cloud.schema[key].dataType.simpleString()
    names = [c for c in ("x", "y", "z", "nx", "ny", "nz", "r", "g", "b") if c in cloud.columns]

    def encode(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pid")
        message = ros.make_message({c: group[c].to_numpy() for c in names})
        return pd.DataFrame({key: [group[key].iloc[0]], "data": [ros.encode_cdr(message)]})

    return cloud.select(key, "pid", *names).groupBy(key).applyInPandas(encode, f"`{key}` {kind}, data binary")
