from __future__ import annotations

import itertools
from datetime import datetime

import numpy as np
import pandas as pd

from pointlake.functions.matching import assignment, name_similarity
from pointlake.operators import parse_split, schema_drift

FIELD = "file_id bigint, stream_id bigint, topic string, recorded_at timestamp, field_pos int, field_name string, datatype int, field_offset bigint, elem_count bigint"


def fields(spark, files):
    rows = [(f, 1, None, at, i, n, t, o, c) for f, at, layout in files for i, (n, t, o, c) in enumerate(layout)]
    return schema_drift.layout_of_fields(spark.createDataFrame(rows, FIELD))


def test_assignment_equals_all_permutations():
    rng = np.random.default_rng(0)
    for n in range(1, 6):
        cost = rng.uniform(0, 1, (n, n))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert abs(sum(cost[i, j] for i, j in assignment(cost)) - best) < 1e-9
    assert assignment(np.array([[np.inf, 1.0], [np.inf, np.inf]])) == [(0, 1)]
    assert assignment(np.empty((0, 3))) == []


def test_name_similarity():
    assert name_similarity("Ring", "ring") == 1 and name_similarity("intensity", "intensities") > 0.7 > name_similarity("x", "stamp")


def test_every_kind_of_change(spark):
    a = [("x", 7, 0, 1), ("y", 7, 4, 1), ("t", 6, 8, 1), ("old", 2, 12, 1), ("gone", 4, 13, 1)]
    b = [("x", 8, 0, 1), ("y", 7, 8, 1), ("t", 8, 16, 1), ("new", 2, 12, 1), ("more", 4, 30, 2)]
    got = {(r.file_id, r.field_name, r.change_kind) for r in schema_drift.changes(fields(spark, [(1, datetime(2025, 1, 1), a), (2, datetime(2025, 1, 2), b)])).collect()}
    assert got == {(2, "x", "retyped"), (2, "y", "moved"), (2, "t", "retyped"), (2, "t", "moved"), (2, "new", "renamed"), (2, "more", "added"), (2, "gone", "removed")}


def test_order_is_time_and_not_arrival_and_copies_count_once(spark):
    one, two = [("a", 7, 0, 1)], [("b", 7, 0, 1)]
    f = fields(spark, [(9, datetime(2025, 1, 1), one), (3, datetime(2025, 3, 1), two), (5, datetime(2025, 2, 1), one), (5, datetime(2025, 2, 1), one)])
    assert [(r.file_id, r.field_name, r.change_kind) for r in schema_drift.changes(f).collect()] == [(3, "b", "renamed")]


def test_a_layout_shared_by_two_new_names(spark):
    f = fields(spark, [(1, datetime(2025, 1, 1), [("a", 7, 0, 1)]), (2, datetime(2025, 1, 2), [("b", 7, 0, 1), ("c", 7, 0, 1)])])
    assert {(r.field_name, r.change_kind) for r in schema_drift.changes(f).collect()} == {("b", "renamed"), ("c", "renamed")}


def test_empty_table_has_no_changes(spark):
    assert schema_drift.changes(fields(spark, [])).count() == 0
    assert schema_drift.unified(fields(spark, [])).count() == 0


def test_headers_give_offsets(spark):
    rows = [(1, 7, datetime(2025, 1, 1), "x y tag", "4 8 2", "F F U", "1 2 3", None)]
    h = spark.createDataFrame(rows, "file_id bigint, stream_id bigint, written_at timestamp, fields string, sizes string, types string, counts string, viewpoint string")
    got = {r.field_name: (r.kind, r.elem_count, r.byte_offset) for r in schema_drift.layout_of_headers(h).collect()}
    assert got == {"x": ("F4", 1, 0), "y": ("F8", 2, 4), "tag": ("U2", 3, 20)}


def test_unified_follows_renames(spark):
    f = fields(spark, [(1, datetime(2025, 1, 1), [("a", 7, 0, 1)]), (2, datetime(2025, 1, 2), [("b", 7, 0, 1)]), (3, datetime(2025, 1, 3), [("c", 7, 0, 1), ("a", 2, 4, 1)])])
    got = {(r.file_id, r.field_name): r.column_name for r in schema_drift.unified(f).collect()}
    assert got == {(1, "a"): "a", (2, "b"): "a", (3, "c"): "c", (3, "a"): "a"}


def test_tables_are_unified_by_their_values(spark):
    rng = np.random.default_rng(1)
    a = spark.createDataFrame(pd.DataFrame({"x": rng.normal(0, 1, 200), "intensity": rng.uniform(0, 100, 200)}))
    b = spark.createDataFrame(pd.DataFrame({"x": rng.normal(0, 1, 200), "intensities": rng.uniform(0, 100, 200), "flag": rng.integers(0, 2, 200)}))
    both = schema_drift.unify([a, b])
    assert set(both.columns) == {"version", "x", "intensity", "flag"} and both.count() == 400
    assert both.where("intensity IS NULL").count() == 0 and both.where("flag IS NULL").count() == 200


def lines(spark, values, columns="x,y,z", delimiter="comma", header=False):
    raw = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(values)], "file_id bigint, line_no int, line string")
    schemas = spark.createDataFrame([(1, columns, delimiter, header, None)] * 2, "file_id bigint, column_list string, delimiter string, has_header boolean, received_at timestamp")
    return parse_split.check_delimited(raw, schemas)


def reasons(checked):
    return {r.line_no: r.reason for r in parse_split.failed(checked).collect()}


def test_delimited_lines(spark):
    got = reasons(lines(spark, ["x,y,z", "1,2,3", '"1", 2 ,+3.', "1,2", '1,"2,3', '1,2"a,3', "1,,3", "1e5,.5,-2.E-3", ".,1,2", '"a""b",1,2', '"1"x,2,3', "", " \t ", None, "1,2,٣", '"1.5" ,2,3', '" 1",2,3'], header=True))
    assert got == {4: "columns", 5: "quoting", 6: "quoting", 7: "value", 9: "value", 10: "value", 11: "quoting", 15: "value", 17: "value"}


def test_blank_delimiters(spark):
    assert reasons(lines(spark, ['1 2 "a ""b"" c"', "1  2 3", "1\t 2 x", "1 2 3 "], "x,y,label", "space")) == {2: "columns", 4: "columns"}
    assert reasons(lines(spark, ["1\t2 \t3", "1\t\t3", '1\t"2" \t3'], delimiter="tab")) == {2: "value"}


def test_colours_and_optional_values(spark):
    got = reasons(lines(spark, ["1,2,3,,255,", "1,2,3,nan,0,0", "1,2,3,1,256,0", "1,2,3,1,-1,0", "1,2,3,1,000255,0", "1,2,3,1,1.0,0"], "x,y,z,intensity,red,green"))
    assert got == {2: "value", 3: "value", 4: "value", 6: "value"}


def test_typed_lines(spark):
    raw = spark.createDataFrame([(2, i + 1, v) for i, v in enumerate(["1 -128 255 7 8", "NaN 127 0 7 8", "-nan 1 1 7 8", "1 128 1 7 8", "1 1 256 7 8", " 1\t1  1 7 8 ", "1 1 1 7", "1 1.0 1 7 8", "1 +5 -0 7 8", "1 1 00000000000000000000000255 7 8", "inf 1 1 7 8"])], "file_id bigint, line_no int, line string")
    headers = spark.createDataFrame([(2, "x a b p", "4 1 1 2", "F I U U", "1 1 1 2", "ascii"), (3, "x", "4", "F", "1", "binary")], "file_id bigint, fields string, sizes string, types string, counts string, data_format string")
    assert reasons(parse_split.check_typed(raw, headers)) == {3: "value", 4: "value", 5: "value", 7: "columns", 8: "value", 11: "value"}
    assert parse_split.points(parse_split.check_typed(raw, headers)).where("line_no = 1").first().more == {"a": "-128", "b": "255", "p": "7 8"}


def test_rows_are_typed_once_and_the_rest_reported(spark):
    c = lines(spark, ["1,2,a", "1,2,a"], "x,y,label")
    both = parse_split.points(c.unionAll(c)).collect()
    assert len(both) == 2 and both[0].x == 1.0 and both[0].label == "a" and both[0].z is None
    assert parse_split.failed(lines(spark, [])).count() == 0


def test_nulls_in_schemas_and_clashing_columns(spark):
    raw = spark.createDataFrame([(1, 1, "1,2", "x"), (1, None, "1,2", "x"), (2, 1, "1 2", "x"), (3, 1, "1,2", None)], "file_id bigint, line_no int, line string, delimiter string").selectExpr("*", "1 as names", "2 as vals", "3 as errors", "4 as layout")
    schemas = spark.createDataFrame([(1, None, "comma", True), (3, "x,y", None, None)], "file_id bigint, column_list string, delimiter string, has_header boolean")
    got = {(r.file_id, r.line_no, r.reason) for r in parse_split.failed(parse_split.check_delimited(raw, schemas)).collect()}
    assert got == {(1, None, "columns"), (3, 1, "quoting")}
    headers = spark.createDataFrame([(2, "a b", "4 4", "F F", None, "ascii"), (3, "a b", "4 4", "F F", "1 ?", "ascii")], "file_id bigint, fields string, sizes string, types string, counts string, data_format string").selectExpr("*", "'z' as line")
    got = {(r.file_id, r.reason) for r in parse_split.failed(parse_split.check_typed(raw, headers)).collect()}
    assert got == {(2, "columns"), (3, "columns")}


def test_p4_points_holds_every_value(spark, tmp_path):
    from pointlake.catalog import drift

    raw = [(1, 1, "1 2 3 4 0.5 7 18446744073709551615 -1 nan"), (1, 1, "1 2 3 4 0.5 7 18446744073709551615 -1 nan"), (2, 1, "1,2,3,a,b")]
    spark.createDataFrame(raw, "file_id bigint, line_no int, line string").write.parquet(str(tmp_path / "raw_line.parquet"))
    header = (1, "x py z red tag echo f", "4 8 4 4 1 8 4", "F F F F U U F", "2 1 1 1 1 1 2", "ascii")
    spark.createDataFrame([header], "file_id bigint, fields string, sizes string, types string, counts string, data_format string").write.parquet(str(tmp_path / "pcd_header.parquet"))
    spark.createDataFrame([(2, "x,y,z,label,note", "comma", False)], "file_id bigint, column_list string, delimiter string, has_header boolean").write.parquet(str(tmp_path / "xyz_schema.parquet"))
    got = {r.file_id: r for r in drift.QUERIES["p4_points"](spark, str(tmp_path)).collect()}
    held = {k: [(v.kind, v.whole, v.real, v.text) for v in vs] for k, vs in got[1].more.items()}
    assert (got[1].x, got[1].y, got[1].z, got[1].red) == (1.0, None, 4.0, None)
    assert np.isnan(held["f"].pop()[2]) and held == {"x": [("F4", None, 2.0, None)], "py": [("F8", None, 3.0, None)], "red": [("F4", None, 0.5, None)], "tag": [("U1", 7, None, None)], "echo": [("U8", 2**64 - 1, None, None)], "f": [("F4", None, -1.0, None)]}
    assert got[2].label == "a" and {k: [v.text for v in vs] for k, vs in got[2].more.items()} == {"note": ["b"]}


def test_a_column_put_in_front_does_not_tear_a_rename_apart(spark):
    one = [("a", 7, 0, 1), ("intensity", 7, 4, 1), ("stamp", 8, 8, 1)]
    two = [("new", 2, 0, 1), ("a", 7, 1, 1), ("intensty", 7, 5, 1), ("stamp", 8, 9, 1)]
    f = fields(spark, [(1, datetime(2025, 1, 1), one), (2, datetime(2025, 1, 2), two)])
    got = {(r.file_id, r.field_name): r.column_name for r in schema_drift.unified(f).collect()}
    assert got == {(1, "a"): "a", (1, "intensity"): "intensity", (1, "stamp"): "stamp", (2, "new"): "new", (2, "a"): "a", (2, "intensty"): "intensity", (2, "stamp"): "stamp"}


def test_renames_are_one_to_one_and_need_likeness(spark):
    f = fields(spark, [(1, datetime(2025, 1, 1), [("a", 7, 0, 1)]), (2, datetime(2025, 1, 2), [("b", 7, 0, 1), ("c", 7, 0, 1), ("ring", 4, 4, 1)])])
    names = [r.column_name for r in schema_drift.unified(f).where("file_id = 2").collect()]
    assert sorted(names) in (["a", "b", "ring"], ["a", "c", "ring"])
    assert schema_drift.match_columns([{"name": "label", "kind": "U1", "elem_count": 1, "byte_offset": 0}], [{"name": "temperature", "kind": "F8", "elem_count": 1, "byte_offset": 9}]) == []


def test_values_tell_columns_apart_that_names_do_not(spark):
    column = lambda n, at, q: {"name": n, "kind": "F4", "elem_count": 1, "byte_offset": at, "sketch": {"quantiles": q, "missing": 0.0}}
    small, large = [0.1 * i for i in range(8)], [1e4 + i for i in range(8)]
    old = [column("q1", 0, small), column("q2", 4, large)]
    assert schema_drift.match_columns(old, [column("v_b", 12, small), column("v_a", 8, large)]) == [("q1", "v_b"), ("q2", "v_a")]


def test_types_are_widened_over_the_files_of_a_stream(spark):
    cases = {"u1 i1": (["2", "1"], "I2"), "i u4": (["1", "U4"], "I8"), "u8 i": (["U8", "I1"], "D20"), "f": (["7", "8"], "F8"), "i f": (["5", "7"], "F8"), "i8 f": (["I8", "F4"], "text"), "odd": (["F4", "what"], "text"), "one": (["what"], "what"), "u": (["2", "4"], "U2"), "null": ([None], "text")}
    rows = [(c, k, 1 + n) for c, (ks, _) in cases.items() for n, k in enumerate(ks)]
    df = spark.createDataFrame(rows, "c string, kind string, n bigint")
    got = {r.c: (r.column_kind, r.column_count) for r in df.groupBy("c").agg(*schema_drift.widest(df["kind"], df["n"])).collect()}
    assert got == {c: (k, len(ks)) for c, (ks, k) in cases.items()}


def test_lines_of_all_files_in_one_table(spark):
    h = spark.createDataFrame([(1, 7, datetime(2025, 1, 1), "x value", "4 4", "F F", "1 1", "ascii"), (2, 7, datetime(2025, 1, 2), "x values", "4 8", "F F", "1 2", "ascii")], "file_id bigint, stream_id bigint, written_at timestamp, fields string, sizes string, types string, counts string, data_format string")
    raw = spark.createDataFrame([(1, 1, "1 2"), (1, 1, "1 2"), (1, 2, "1"), (2, 1, "3 2.5 nan")], "file_id bigint, line_no int, line string")
    checked = parse_split.check_typed(raw, h)
    columns = schema_drift.unified(schema_drift.layout_of_headers(h), schema_drift.value_sketches(checked))
    got = {(r.file_id, r.line_no, r.column_name, r.element, r.column_kind, str(r.number), r.text) for r in schema_drift.unified_values(checked, columns).collect()}
    assert got == {(1, 1, "x", 0, "F4", "1.0", "1"), (1, 1, "value", 0, "F8", "2.0", "2"), (2, 1, "x", 0, "F4", "3.0", "3"), (2, 1, "value", 0, "F8", "2.5", "2.5"), (2, 1, "value", 1, "F8", "nan", "nan")}
    assert schema_drift.unified_values(checked.limit(0), columns).count() == 0


HEADER = "file_id bigint, stream_id bigint, written_at timestamp, fields string, sizes string, types string, counts string, data_format string"


def drift_tables(spark, folder, headers, lines, messages=()):
    for name, rows, schema in (("pcd_header", headers, HEADER), ("raw_line", lines, "file_id bigint, line_no int, line string"), ("point_field", messages, FIELD)):
        spark.createDataFrame(list(rows), schema).write.parquet(str(folder / f"{name}.parquet"))


def test_changes_are_matched_by_name_and_values(spark, tmp_path):
    from pointlake.catalog import drift

    # a size that is no number leaves the columns behind it without an offset, so that both have one layout
    header = lambda f, day, names: (f, 7, datetime(2025, 1, day), names, "4 ? 4 4", "F F F F", "1 1 1 1", "ascii")
    headers = [header(1, 1, "x odd q1 q2"), header(2, 2, "x odd q2x q1x"), header(3, 3, "x odd p1 p2")]
    lines = [(f, i, f"0 0 {i} {900 + i}") for f in (1, 2) for i in range(9)] + [(2, 9, "0 0 1e999 no")]
    messages = [(f, 8, None, datetime(2025, 1, f), i, n, 7, 4 * i, 1) for f, ns in ((11, ("a", "b")), (12, ("a", "c")), (13, ("d",))) for i, n in enumerate(ns)]
    drift_tables(spark, tmp_path, headers, lines * 2, messages)
    rows = drift.QUERIES["p1_changes"](spark, str(tmp_path)).collect()
    got = {(r.file_id, r.field_name): (r.change_kind, r.old_names) for r in rows}
    # names alone would take q1 for q1x; the files 3 and 12 have no lines
    assert got[2, "q2x"] == ("renamed", ["q1"]) and got[2, "q1x"] == ("renamed", ["q2"])
    assert got[3, "p1"] == ("renamed", ["q1x"]) and got[3, "p2"] == ("renamed", ["q2x"])
    assert got[12, "c"] == ("renamed", ["b"]) and got[13, "d"] == ("renamed", ["a"]) and got[13, "c"] == ("removed", ["c"])
    assert len(rows) == len(got) == 7 and all((0 <= r.cost <= 1) if r.change_kind == "renamed" else r.cost is None for r in rows)
    found = drift.QUERIES["p1_found"](spark, str(tmp_path))
    assert found.columns == ["file_id", "field_name", "change_kind"] and sorted(map(tuple, found.collect())) == sorted((f, n, k) for (f, n), (k, _) in got.items())


def test_values_beyond_a_double_do_not_stop_the_matching(spark, tmp_path):
    from pointlake.catalog import drift

    header = lambda f, names: (f, 7, datetime(2025, 1, f), names, "4 8", "F F", "1 1", "ascii")
    values = {1: ("1", "2"), 2: ("1", "2"), 3: ("1e999", "-1e999"), 4: ("1e999", "nan"), 5: ("nan", "nan")}
    drift_tables(spark, tmp_path, [header(f, f"x {n}") for f, n in zip(values, ("value", "v", "w", "u", "t"))], [(f, i, f"0 {v}") for f, vs in values.items() for i, v in enumerate(vs)])
    got = {r.file_id: (r.change_kind, r.cost) for r in drift.QUERIES["p1_changes"](spark, str(tmp_path)).collect()}
    assert {k for k, _ in got.values()} == {"renamed"} and sorted(got) == [2, 3, 4, 5] and all(0 <= c <= 1 for _, c in got.values())
    assert got[2][1] < got[3][1]


def test_layouts_are_matched_at_least_cost():
    rng = np.random.default_rng(3)
    column = lambda n, at: {"name": n, "kind": "F4", "elem_count": 1, "byte_offset": at, "sketch": {"quantiles": sorted(rng.uniform(0, 9, 4)), "missing": 0.0}}
    for n in range(1, 5):
        old, new = ([column(f"{side}{rng.integers(1000)}_{i}", None) for i in range(n)] for side in "ab")
        got = schema_drift.match_layouts([column("x", 0), *old], [column("x", 0), *new, column("y", 8)])
        cost = lambda p, q: schema_drift.pair_cost(p, q, ("x", ""), ("x", ""))
        best = min(sum(cost(p, q) for p, q in zip(old, order)) for order in itertools.permutations(new))
        assert abs(sum(c for _, _, c in got) - best) < 1e-9 and {o for o, _, _ in got} == {c["name"] for c in old} and {q for _, q, _ in got} == {c["name"] for c in new}
    one, two = [column("a", 0)], [column("a2", 0), column("zz", 0)]
    assert {(o, n) for o, n, _ in schema_drift.match_layouts(one, two)} == {("a", "a2"), ("a", "zz")} and len(schema_drift.match_layouts(two, one)) == 2
