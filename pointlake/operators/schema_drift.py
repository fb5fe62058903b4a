"""Schemas that drift between the files of a stream: one consistent table, and every change.

Profiles of columns (layout, type, value sketch) of each file are compared with those of the file before it. Columns of the
same name need no search; what is left over on both sides is matched by a minimum-cost bipartite matching, which finds the
renames. The unit of work is a pair of files, never a stream, so a stream may hold any share of all files.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointlake.functions.matching import assignment, name_similarity
from pointlake.plans import scratch

#: Weight of the parts of a column pair's cost, and the cost above which a pair is no rename.
NAME_WEIGHT, TYPE_WEIGHT, VALUE_WEIGHT, ORDER_WEIGHT, THRESHOLD = 0.4, 0.2, 0.4, 0.15, 0.45
#: The kinds behind the datatype numbers 1 to 8 of point messages.
DATATYPES = ("I1", "U1", "I2", "U2", "I4", "U4", "F4", "F8")
REALS = ("7", "8")


def layout_of_fields(point_field: DataFrame) -> DataFrame:
    """``(file_id, stream_id, at, field_name, kind, elem_count, byte_offset)`` of a table with one row per field."""
    c = F.col
    return point_field.select("file_id", "stream_id", c("recorded_at").alias("at"), "field_name", c("datatype").cast("string").alias("kind"), c("elem_count").cast("bigint").alias("elem_count"), c("field_offset").alias("byte_offset"))


def layout_of_headers(pcd_header: DataFrame) -> DataFrame:
    """The same of headers with blank-separated lists; the offset is the sum of size x count over the fields before."""
    once = pcd_header.dropDuplicates(["file_id"])
    per = {c: F.split(F.trim(c), r"[ \t]+") for c in ("fields", "sizes", "types", "counts")}
    lists = once.select("file_id", "stream_id", F.col("written_at").alias("at"), *(v.alias(c) for c, v in per.items()))
    widths = F.zip_with("sizes", "counts", lambda s, n: s.try_cast("bigint") * n.try_cast("bigint"))
    rows = lists.withColumn("widths", widths).select("file_id", "stream_id", "at", "widths", F.posexplode(F.arrays_zip("fields", "sizes", "types", "counts")).alias("pos", "f"))
    before = F.aggregate(F.slice("widths", F.lit(1), F.col("pos")), F.lit(0).cast("bigint"), lambda a, w: a + w)
    return rows.select("file_id", "stream_id", "at", F.col("f.fields").alias("field_name"), F.concat("f.types", "f.sizes").alias("kind"), F.col("f.counts").try_cast("bigint").alias("elem_count"), before.alias("byte_offset"))


def previous_files(files: DataFrame, span: str = "HOUR") -> DataFrame:
    """``(file_id, previous_id)`` for files ``(file_id, stream_id, at)`` that have one before them in their stream.

    Order is ``at``, at equal times ``file_id``; files without a time come first. Within a stream and a span of time the file
    before is found by a window; the first of a span gets the last of the stream's span before from a table of one row per
    span. So no window holds more of a hot stream than one span, or one row per span.
    """
    key = F.struct("at", "file_id")
    spans = files.select("file_id", "stream_id", "at", F.date_trunc(span, "at").alias("span"))
    inside = spans.withColumn("near", F.lag("file_id").over(Window.partitionBy("stream_id", "span").orderBy("at", "file_id")))
    ends = spans.groupBy("stream_id", "span").agg(F.max(key).alias("last"))
    far = ends.select("stream_id", F.col("span").alias("of_span"), F.lag("last.file_id").over(Window.partitionBy("stream_id").orderBy("span")).alias("far")).where("far IS NOT NULL")
    first = inside.where("near IS NULL").alias("i").join(far.alias("f"), (F.col("i.stream_id") == F.col("f.stream_id")) & F.col("span").eqNullSafe(F.col("of_span")))
    return inside.where("near IS NOT NULL").select("file_id", F.col("near").alias("previous_id")).unionAll(first.select("file_id", F.col("far").alias("previous_id")))


def file_pairs(fields: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Each file with a file before it in its stream: ``(file_id, previous_id, stream_id, at, new, old)``.

    ``new`` and ``old`` are the two files' columns, ARRAY<STRUCT<name, kind, elem_count, byte_offset>> and what ``more`` names;
    an array is as long as a file is wide. Rows of fields are shuffled once, by file; the files are written, as three plans
    read them.
    """
    column = F.struct(F.col("field_name").alias("name"), "kind", "elem_count", "byte_offset", *more)
    files = fields.groupBy("file_id").agg(F.first("stream_id").alias("stream_id"), F.min("at").alias("at"), F.array_sort(F.collect_set(column)).alias("new"))
    files = scratch.written(files, "files")
    before = previous_files(files.select("file_id", "stream_id", "at"))
    old = files.select(F.col("file_id").alias("previous_id"), F.col("new").alias("old"))
    return files.join(before, "file_id").join(old, "previous_id").select("file_id", "previous_id", "stream_id", "at", "new", "old")


#: The layout of a column as text, null parts as ``?``, and the columns of one list whose names the other lacks.
_layout = lambda x: F.concat_ws("|", *(F.coalesce(x[c].cast("string"), F.lit("?")) for c in ("kind", "elem_count", "byte_offset")))
_only = lambda a, b: F.filter(a, lambda x: ~F.exists(b, lambda y: y["name"] == x["name"]))


def with_renames(pairs: DataFrame, sketches_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """File pairs with ``lost`` and ``gained`` columns and ``renamed``, ARRAY<STRUCT<old_name, new_name, cost>>.

    ``renamed`` is what :func:`match_layouts` finds, and null where no layout lies both among the lost and among the gained
    columns. ``sketches_of`` gives :func:`value_sketches` of a table of ``file_id``; it is asked for the files that hold
    candidates, of both sides, as in all others there is nothing to match.
    """
    loose = lambda df: df.withColumns({"lost": _only("old", "new"), "gained": _only("new", "old")})
    shared = F.arrays_overlap(F.transform("lost", _layout), F.transform("gained", _layout))
    pairs = scratch.written(pairs, "pairs")
    candidates = loose(pairs).where(shared).select("file_id", "previous_id", "old", "new")
    sides = {"old": "previous_id", "new": "file_id"}
    values = {side: F.lit(None).cast("array<struct<field_name:string,sketch:struct<quantiles:array<double>,missing:double>>>") for side in sides}
    if sketches_of:
        files = scratch.written(candidates.select(F.explode(F.array("file_id", "previous_id")).alias("file_id")).distinct(), "candidates")
        known = sketches_of(files).groupBy("file_id").agg(F.collect_list(F.struct("field_name", "sketch")).alias("v"))
        known = scratch.written(known, "sketches")
        for side, key in sides.items():
            candidates = candidates.join(known.select(F.col("file_id").alias(key), F.col("v").alias(f"{side}_values")), key, "left")
            values[side] = F.col(f"{side}_values")
    # marked non-deterministic so that no rule copies the call into an explode or a filter
    match = F.pandas_udf(_match, "array<struct<old_name:string,new_name:string,cost:double>>").asNondeterministic()
    found = candidates.select("file_id", match("old", "new", values["old"], values["new"]).alias("renamed"))
    return loose(pairs.join(found, "file_id", "left"))


def compared(fields: DataFrame, sketches_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every change of :func:`changes`, with where it came from: ``(file_id, field_name, change_kind, old_names, cost)``.

    ``old_names`` are the names of the column in the file before, none for ``added``. Of a ``renamed`` one the first is the
    partner of the matching and ``cost`` (0 to 1, :func:`pair_cost`) how little the two are alike by name, neighbours and, as
    far as ``sketches_of`` (see :func:`with_renames`) has both, values; others follow only where a layout has more lost names
    than new ones.
    """
    pairs = with_renames(file_pairs(fields.where("field_name IS NOT NULL")).drop("stream_id", "at"), sketches_of)
    none = F.array().cast("array<string>")
    said = lambda name, kind, old, cost=F.lit(None): F.struct(name.alias("field_name"), kind.alias("change_kind"), old.alias("old_names"), cost.cast("double").alias("cost"))
    same = lambda name, kind: said(name, F.lit(kind), F.array(name))
    twin = lambda x: F.element_at(F.filter("old", lambda y: y["name"] == x["name"]), 1)
    kept = F.filter("new", lambda x: F.exists("old", lambda y: y["name"] == x["name"]))
    differs = lambda x, y, *cs: ~F.struct(*(x[c].alias(c) for c in cs)).eqNullSafe(F.struct(*(y[c].alias(c) for c in cs)))
    beside = F.transform(kept, lambda x: F.struct(x.alias("n"), twin(x).alias("o")))
    retyped = F.transform(F.filter(beside, lambda p: differs(p["n"], p["o"], "kind", "elem_count")), lambda p: same(p["n"]["name"], "retyped"))
    moved = F.transform(F.filter(beside, lambda p: differs(p["n"], p["o"], "byte_offset")), lambda p: same(p["n"]["name"], "moved"))
    renamed = F.coalesce("renamed", F.array().cast(pairs.schema["renamed"].dataType))
    into = lambda x: F.filter(renamed, lambda r: r["new_name"] == x["name"])
    is_from = lambda x: F.exists(renamed, lambda r: r["old_name"] == x["name"])
    partner = lambda x, rs: F.when(F.size(rs) > 0, said(x["name"], F.lit("renamed"), F.array_distinct(F.transform(rs, lambda r: r["old_name"])), F.get(rs, F.lit(0))["cost"])).otherwise(said(x["name"], F.lit("added"), none))
    gained = F.transform("gained", lambda x: partner(x, into(x)))
    removed = F.transform(F.filter("lost", lambda x: ~is_from(x)), lambda x: same(x["name"], "removed"))
    return pairs.select("file_id", F.explode(F.concat(retyped, moved, gained, removed)).alias("c")).select("file_id", "c.*")


def changes(fields: DataFrame, sketches_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every change between a file and the one before it in its stream: ``(file_id, field_name, change_kind)``.

    ``fields`` as :func:`layout_of_fields` gives it. Kinds: ``retyped`` (type or count differs), ``moved`` (offset differs),
    ``renamed`` (a new name in the place, type and count of a lost one), ``added`` (any other new name), ``removed`` (a lost
    name from which nothing was renamed, reported under that name). Null types, counts and offsets compare as values; columns
    without a name are left out. The first file of a stream has no changes; an empty table gives an empty one. The renames are
    those of :func:`compared`, which also tells their old names.
    """
    return compared(fields, sketches_of).select("file_id", "field_name", "change_kind")


def _canonical(rows: pd.DataFrame) -> pd.DataFrame:
    """Names of one stream joined by renames: each gets the one of its family that came first."""
    parent: dict[str, str] = {}

    def root(n: str) -> str:
        while parent.setdefault(n, n) != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    first = {}
    for o, n, at in zip(rows.old_name, rows.new_name, rows["at"]):
        for name, when in ((o, (at, 0)), (n, (at, 1))):
            first[name] = min(first.get(name, when), when)
        parent[root(n)] = root(o)
    family: dict[str, list] = {}
    for n in parent:
        family.setdefault(root(n), []).append(n)
    head = {n: min(ns, key=lambda x: (first[x], x)) for ns in family.values() for n in ns}
    return pd.DataFrame({"stream_id": rows.stream_id.iloc[0], "field_name": list(head), "canonical": list(head.values())})


def _family(kind: str | None) -> str:
    return "real" if kind in REALS or (kind or "").startswith("F") else "whole"


def _sketch_gap(a: dict | None, b: dict | None) -> float | None:
    """Distance of two value sketches from 0 to 1: of the quantiles, over their common span, and of the shares without number."""
    if a is None or b is None:
        return None
    # values beyond a DOUBLE are read as infinite, which have no distance
    x, y = (np.clip(np.asarray(s["quantiles"] if s["quantiles"] is not None else [], dtype=float), -1e300, 1e300) for s in (a, b))
    if len(x) and len(y):
        span = max(x.max(), y.max()) - min(x.min(), y.min())
        gap = float(np.mean(np.abs(x - y)) / span) if span > 0 else 0.0
    else:
        gap = float(len(x) != len(y))
    return 0.7 * min(1.0, 3 * gap) + 0.3 * abs(a["missing"] - b["missing"])


def _around(columns: list[dict], kept: set[str]) -> dict[str, tuple[str, str]]:
    """For each column the kept ones before and after it, by offset."""
    order = sorted(columns, key=lambda c: (c["byte_offset"] is None, c["byte_offset"] or 0, c["name"]))
    out, last = {}, ""
    for c in order:
        out[c["name"]] = (last, "")
        last = c["name"] if c["name"] in kept else last
    last = ""
    for c in reversed(order):
        out[c["name"]] = (out[c["name"]][0], last)
        last = c["name"] if c["name"] in kept else last
    return out


def pair_cost(old: dict, new: dict, near_old: tuple[str, str], near_new: tuple[str, str]) -> float:
    """Cost from 0 to 1 of taking a new column for a lost one: name, type, kept neighbours and, where both have them, values.

    Equal layout (offset, type, count) makes a pair cheap whatever its names.
    """
    same_type = old["kind"] == new["kind"] and old["elem_count"] == new["elem_count"]
    parts = [
        (NAME_WEIGHT, 1 - name_similarity(old["name"], new["name"])),
        (TYPE_WEIGHT, 0.0 if same_type else 0.4 if _family(old["kind"]) == _family(new["kind"]) else 1.0),
        (ORDER_WEIGHT, 0.5 * ((near_old[0] != near_new[0]) + (near_old[1] != near_new[1]))),
    ]
    values = _sketch_gap(old.get("sketch"), new.get("sketch"))
    if values is not None:
        parts.append((VALUE_WEIGHT, values))
    cost = sum(w * v for w, v in parts) / sum(w for w, _ in parts)
    return cost * 0.4 if same_type and old["byte_offset"] == new["byte_offset"] else cost


def _costs(lost: list[dict], gained: list[dict], around: tuple[dict, dict]) -> np.ndarray:
    return np.array([[pair_cost(p, q, around[0][p["name"]], around[1][q["name"]]) for q in gained] for p in lost])


def match_columns(old: list[dict], new: list[dict], threshold: float = THRESHOLD) -> list[tuple[str, str]]:
    """Renames (old name, new name) between two versions: a minimum-cost matching of what is lost to what is new, one to one.

    Columns are dicts of name, kind, elem_count, byte_offset and sketch. Pairs that cost more than ``threshold`` are none.
    """
    names = {c["name"] for c in old} & {c["name"] for c in new}
    lost, gained = ([c for c in side if c["name"] not in names] for side in (old, new))
    if not lost or not gained:
        return []
    cost = _costs(lost, gained, (_around(old, names), _around(new, names)))
    return [(lost[i]["name"], gained[j]["name"]) for i, j in assignment(np.where(cost <= threshold, cost, np.inf))]


def match_layouts(old: list[dict], new: list[dict]) -> list[tuple[str, str, float]]:
    """Renames (old name, new name, cost) in the sense of :func:`changes` between two versions, columns as for :func:`match_columns`.

    Only columns of equal layout may be matched, so each layout is a minimum-cost matching of its own, and no cost is too
    high. A layout that lies on both sides is a rename there for each of its names: columns for which the matching had no
    partner left get, after it, the cheapest of those already taken.
    """
    names = {c["name"] for c in old} & {c["name"] for c in new}
    around = _around(old, names), _around(new, names)
    layouts: dict[tuple, tuple[list, list]] = defaultdict(lambda: ([], []))
    for side, columns in enumerate((old, new)):
        for c in columns:
            if c["name"] not in names:
                layouts[c["kind"], c["elem_count"], c["byte_offset"]][side].append(c)
    out = []
    for lost, gained in layouts.values():
        if not lost or not gained:
            continue
        cost = _costs(lost, gained, around)
        pairs = assignment(cost)
        done_old, done_new = ({p[side] for p in pairs} for side in (0, 1))
        pairs += [(int(np.argmin(cost[:, j])), j) for j in range(len(gained)) if j not in done_new]
        pairs += [(i, int(np.argmin(cost[i]))) for i in range(len(lost)) if i not in done_old]
        out += [(lost[i]["name"], gained[j]["name"], float(cost[i, j])) for i, j in pairs]
    return out


def _plain(row) -> dict:
    return row.asDict(recursive=True) if hasattr(row, "asDict") else dict(row)


def _renames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [(s, at, o, n) for s, at, new, old in zip(batch["stream_id"], batch["at"], batch["new"], batch["old"]) for o, n in match_columns([_plain(c) for c in old], [_plain(c) for c in new])]
        yield pd.DataFrame(out, columns=["stream_id", "at", "old_name", "new_name"])


def _match(old: pd.Series, new: pd.Series, old_values: pd.Series, new_values: pd.Series) -> pd.Series:
    def columns(side, values) -> list[dict]:
        known = {v["field_name"]: v["sketch"] for v in map(_plain, [] if values is None else values)}
        return [c | {"sketch": known.get(c["name"])} for c in map(_plain, side)]

    return pd.Series([[dict(zip(("old_name", "new_name", "cost"), r)) for r in match_layouts(columns(o, a), columns(n, b))] for o, n, a, b in zip(old, new, old_values, new_values)], dtype=object)


def widest(kind: Column, count: Column) -> list[Column]:
    """Aggregates ``column_kind, column_count``: the narrowest kind that holds every kind of a group, and the greatest count.

    Whole numbers become the least signed kind that holds all (``D20``, a decimal, where an unsigned one of 8 bytes meets a
    signed one), whole numbers of up to 4 bytes and reals ``F8``; anything else of different kinds is ``text``.
    """
    code = F.coalesce(*(F.when(kind == str(n), F.lit(k)) for n, k in enumerate(DATATYPES, 1)), kind)
    letter, size = F.substring(code, 1, 1), F.expr("0") + F.substring(code, 2, 9).try_cast("int")
    known = letter.isin("I", "U", "F") & size.isNotNull()
    most = lambda l: F.max(F.when(known & (letter == l), size))  # noqa: E731, E741
    signed, unsigned, real = most("I"), most("U"), most("F")
    odd = F.bool_or(~F.coalesce(known, F.lit(False)))
    whole = F.when(signed.isNull(), F.concat(F.lit("U"), unsigned)).when(unsigned.isNull() | (signed > unsigned), F.concat(F.lit("I"), signed)).when(unsigned < 8, F.concat(F.lit("I"), unsigned * 2)).otherwise("D20")
    mixed = F.when(F.greatest(signed, unsigned) <= 4, "F8").otherwise("text")
    found = F.when(real.isNull(), whole).when(signed.isNull() & unsigned.isNull(), F.concat(F.lit("F"), real)).otherwise(mixed)
    first = F.when(F.count_distinct(code) == 1, F.min(code))
    return [F.when(odd, F.coalesce(first, F.lit("text"))).otherwise(found).alias("column_kind"), F.max(count).alias("column_count")]


def value_sketches(checked: DataFrame, quantiles: int = 8) -> DataFrame:
    """``(file_id, field_name, sketch)`` of checked lines with typed values: quantiles of the numbers and the share without one.

    One pass over the valid lines' values; sketches are mergeable aggregates of fixed size.
    """
    cells = checked.where(F.size("errors") == 0).select("file_id", F.explode(F.arrays_zip("names", "vals")).alias("c")).select("file_id", F.col("c.names").alias("field_name"), F.col("c.vals").try_cast("double").alias("v"))
    number = F.when(~F.isnan("v"), F.col("v"))
    at = [(i + 0.5) / quantiles for i in range(quantiles)]
    return cells.groupBy("file_id", "field_name").agg(F.struct(F.percentile_approx(number, at, 200).alias("quantiles"), (1 - F.count(number) / F.count(F.lit(1))).alias("missing")).alias("sketch"))


def unified(fields: DataFrame, sketches: DataFrame | None = None) -> DataFrame:
    """One consistent table of columns: ``(file_id, stream_id, field_name, column_name, column_kind, column_count, kind, elem_count, byte_offset)``.

    ``column_name`` is the same for a column under all its names, the first name of a chain of renames in the stream, and
    ``column_kind`` and ``column_count`` are the same in all files of the stream and hold every value of them. Renames are
    matched one to one between a file and the one before it by name, type, neighbours, layout and, where ``sketches``
    (:func:`value_sketches`) has both columns, values; so a column keeps its place when others are put in front of it. Where
    two columns of one file would share a name, the one that bears it keeps it and the others keep their own. Renames of a
    stream are aggregated to distinct pairs of names before they are grouped, so a group is bounded by the names in use. Rows
    delivered twice count once; columns without a name are left out.
    """
    fields = fields.where("field_name IS NOT NULL").dropDuplicates(["file_id", "field_name"])
    kind = "struct<quantiles: array<double>, missing: double>"
    known = fields.withColumn("sketch", F.lit(None).cast(kind)) if sketches is None else fields.join(sketches.select("file_id", "field_name", F.col("sketch").cast(kind).alias("sketch")), ["file_id", "field_name"], "left")
    names = lambda side: F.transform(side, lambda c: c["name"])
    # only files that both lost and gained a name can hold a rename
    loose = file_pairs(known, ("sketch",)).where((F.size(F.array_except(names("old"), names("new"))) > 0) & (F.size(F.array_except(names("new"), names("old"))) > 0))
    at_kind = loose.schema["at"].dataType.simpleString()
    stream_kind = loose.schema["stream_id"].dataType.simpleString()
    found = loose.select("stream_id", "at", "new", "old").mapInPandas(_renames, f"stream_id {stream_kind}, at {at_kind}, old_name string, new_name string")
    pairs = found.groupBy("stream_id", "old_name", "new_name").agg(F.min("at").cast("timestamp").alias("at"))
    heads = pairs.groupBy("stream_id").applyInPandas(_canonical, f"stream_id {stream_kind}, field_name string, canonical string")
    named = fields.join(heads, ["stream_id", "field_name"], "left").withColumn("canonical", F.coalesce("canonical", "field_name"))
    own = Window.partitionBy("file_id", "canonical").orderBy(F.col("canonical") != F.col("field_name"), "field_name")
    column = F.when(F.row_number().over(own) == 1, F.col("canonical")).otherwise(F.col("field_name"))
    rows = scratch.written(named.select("file_id", "stream_id", "field_name", column.alias("column_name"), "kind", "elem_count", "byte_offset"), "columns")
    kinds = rows.groupBy("stream_id", "column_name").agg(*widest(F.col("kind"), F.col("elem_count")))
    joined = rows.alias("r").join(kinds.alias("k"), F.col("r.stream_id").eqNullSafe(F.col("k.stream_id")) & (F.col("r.column_name") == F.col("k.column_name")))
    return joined.select("file_id", "r.stream_id", "field_name", "r.column_name", "column_kind", "column_count", "kind", "elem_count", "byte_offset")


def unified_values(checked: DataFrame, columns: DataFrame) -> DataFrame:
    """``(file_id, line_no, column_name, element, column_kind, number, text)``: the values of checked lines under their unified columns.

    One row per value of a valid line, numbered within its column from 0; ``number`` is null where the kind is ``text`` or the
    value no number, ``text`` is the value as it was read. A line delivered twice counts once.
    """
    once = checked.where(F.size("errors") == 0).select("file_id", "line_no", "names", "vals").dropDuplicates(["file_id", "line_no"])
    element = F.transform("names", lambda n, i: F.size(F.filter(F.slice("names", 1, i), lambda m: m == n)))
    cells = once.select("file_id", "line_no", F.explode(F.arrays_zip("names", "vals", element.alias("element"))).alias("c"))
    cells = cells.select("file_id", "line_no", F.col("c.names").alias("field_name"), F.col("c.element").alias("element"), F.col("c.vals").alias("text"))
    named = cells.join(columns.select("file_id", "field_name", "column_name", "column_kind"), ["file_id", "field_name"])
    return named.select("file_id", "line_no", "column_name", "element", "column_kind", F.when(F.col("column_kind") != "text", F.col("text").try_cast("double")).alias("number"), "text")


def profile(df: DataFrame, keys: list[str], quantiles: int = 8) -> DataFrame:
    """A value sketch of every other column per group: ``(*keys, column_name, type, rows, nulls, distinct_estimate, quantiles)``.

    One pass over long rows; quantiles are approximate, of the value where it is a number, else of its length. All sketches
    are mergeable aggregates of fixed size. Nulls count in ``nulls`` only; an empty table has no profiles.
    """
    columns = [c for c in df.columns if c not in keys]
    numeric = {c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")}
    cell = lambda c: F.struct(F.lit(c).alias("column_name"), F.lit(dict(df.dtypes)[c]).alias("type"), F.col(f"`{c}`").cast("string").alias("text"), (F.col(f"`{c}`").cast("double") if c in numeric else F.length(F.col(f"`{c}`").cast("string")).cast("double")).alias("measure"))
    long = df.select(*keys, F.explode(F.array(*map(cell, columns))).alias("c")).select(*keys, "c.*")
    at = [(i + 0.5) / quantiles for i in range(quantiles)]
    return long.groupBy(*keys, "column_name", "type").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("text").isNull()).alias("nulls"), F.approx_count_distinct("text").alias("distinct_estimate"), F.percentile_approx("measure", at, 200).alias("quantiles"))


def match_profiles(old: pd.DataFrame, new: pd.DataFrame, threshold: float = 0.55) -> list[tuple[str, str]]:
    """Columns of two versions matched by name, type and value sketch: pairs (old name, new name) of least total cost.

    ``old`` and ``new`` are profiles of one version each, as :func:`profile` gives them (a row per column). Equal names match
    first; the rest is a minimum-cost matching in which no pair costs more than ``threshold``. For renames between tables
    whose layout does not give them away.
    """
    names = set(old.column_name) & set(new.column_name)
    a, b = old[~old.column_name.isin(names)].reset_index(drop=True), new[~new.column_name.isin(names)].reset_index(drop=True)
    cost = np.full((len(a), len(b)), np.inf)
    for i, p in a.iterrows():
        for j, q in b.iterrows():
            x, y = (np.asarray(v, dtype=float) if v is not None else np.empty(0) for v in (p.quantiles, q.quantiles))
            if len(x) and len(y):
                scale = max(np.ptp(x), np.ptp(y), abs(x).max() * 1e-3, 1e-9)
                value = min(1.0, float(np.mean(abs(x - y)) / scale))
            else:
                value = float(len(x) != len(y))
            rows = [max(1, int(v.rows)) for v in (p, q)]
            value = 0.7 * value + 0.3 * abs(p.nulls / rows[0] - q.nulls / rows[1])
            c = NAME_WEIGHT * (1 - name_similarity(p.column_name, q.column_name)) + TYPE_WEIGHT * (p.type != q.type) + VALUE_WEIGHT * value
            if c <= threshold:
                cost[i, j] = c
    return sorted((n, n) for n in names) + [(a.column_name[i], b.column_name[j]) for i, j in assignment(cost)]


def unify(versions: list[DataFrame], threshold: float = 0.55) -> DataFrame:
    """Tables of one stream in order, read into one: matched columns get the first name, types their common widest.

    Missing columns are null; ``version`` is the table's place in the list. Types that have no common numeric type become
    text. Only the profiles (a row per column) come to the driver.
    """
    heads: list[tuple[DataFrame, dict[str, str]]] = []
    before: pd.DataFrame | None = None
    names: dict[str, str] = {}
    for df in versions:
        now = profile(df, []).toPandas()
        got = {n: names[o] for o, n in match_profiles(before, now, threshold)} if before is not None else {}
        taken = set(got.values())
        names = {c: got.get(c) or (c if c not in taken else f"{c}_{len(heads)}") for c in df.columns}
        heads.append((df, names))
        before = now
    order = ["tinyint", "smallint", "int", "bigint", "float", "double"]
    kinds: dict[str, str] = {}
    for df, to in heads:
        for c, t in df.dtypes:
            k = kinds.setdefault(to[c], t)
            if k != t:
                kinds[to[c]] = order[max(order.index(k), order.index(t))] if k in order and t in order else "string"
                if {k, t} == {"bigint", "float"}:
                    kinds[to[c]] = "double"
    out = None
    for i, (df, to) in enumerate(heads):
        have = {v: k for k, v in to.items()}
        part = df.select(F.lit(i).alias("version"), *((F.col(f"`{have[c]}`") if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))
        out = part if out is None else out.unionByName(part)
    return out


def layouts(point_field: DataFrame, pcd_header: DataFrame) -> DataFrame:
    """Layouts of both kinds of files in one table."""
    return layout_of_fields(point_field).unionByName(layout_of_headers(pcd_header))
