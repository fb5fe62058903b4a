"""Queries on drifting schemas (p1) and on lines that fail to parse (p4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.operators import parse_split, schema_drift
from pointlake.plans.tables import table


def _layouts(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.layouts(table(spark, d, "point_field"), table(spark, d, "pcd_header"))


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return parse_split.check_lines(table(spark, d, "raw_line"), table(spark, d, "xyz_schema"), table(spark, d, "pcd_header"))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return parse_split.check_typed(table(spark, d, "raw_line"), table(spark, d, "pcd_header"))


def _unified(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.unified(_layouts(spark, d), schema_drift.value_sketches(_typed(spark, d)))


def _sketches_of(spark: SparkSession, d: str) -> Callable[[DataFrame], DataFrame]:
    """Value sketches of the typed files that a table of ``file_id`` names; lines delivered twice count once."""

    def of(files: DataFrame) -> DataFrame:
        lines = table(spark, d, "raw_line").select("file_id", "line_no", "line").join(files, "file_id", "left_semi").distinct()
        return schema_drift.value_sketches(parse_split.check_typed(lines, table(spark, d, "pcd_header").join(files, "file_id", "left_semi")))

    return of


QUERIES = {
    "p1_found": lambda s, d: schema_drift.changes(_layouts(s, d), _sketches_of(s, d)),
    "p1_changes": lambda s, d: schema_drift.compared(_layouts(s, d), _sketches_of(s, d)),
    "p1_unified": _unified,
    "p1_table": lambda s, d: schema_drift.unified_values(_typed(s, d), _unified(s, d)),
    "p4_found": lambda s, d: parse_split.failed(_checked(s, d)),
    "p4_lines": lambda s, d: _checked(s, d).where("size(errors) = 0").select("file_id", "line_no", F.array_join("vals", "|", "").alias("vals")).distinct(),
    "p4_points": lambda s, d: parse_split.points(_checked(s, d), typed=True),
}

P1_FOUND = r"""
WITH header AS (
  SELECT DISTINCT file_id, stream_id, written_at, string_split(fields, ' ') AS f, string_split(sizes, ' ') AS s,
         string_split(types, ' ') AS t, string_split(counts, ' ') AS c FROM pcd_header),
header_field AS (
  SELECT file_id, stream_id, written_at AS seen, unnest(range(1, len(f) + 1)) AS i, f, s, t, c FROM header),
field AS (
  SELECT DISTINCT file_id, stream_id, recorded_at AS seen, field_name AS name, CAST(datatype AS VARCHAR) AS kind,
         CAST(elem_count AS BIGINT) AS n, field_offset AS pos FROM point_field WHERE field_name IS NOT NULL
  UNION ALL
  SELECT h.file_id, h.stream_id, h.seen, h.f[h.i], h.t[h.i] || h.s[h.i], CAST(h.c[h.i] AS BIGINT),
         CAST(coalesce(list_sum(list_transform(range(1, h.i), lambda k: CAST(h.s[k] AS BIGINT) * CAST(h.c[k] AS BIGINT))), 0) AS BIGINT)
  FROM header_field h),
file AS (SELECT DISTINCT file_id, stream_id, seen FROM field),
pair AS (
  SELECT * FROM (SELECT file_id, lag(file_id) OVER (PARTITION BY stream_id ORDER BY seen NULLS FIRST, file_id) AS prev FROM file)
  WHERE prev IS NOT NULL),
cur AS (SELECT p.file_id, x.name, x.kind, x.n, x.pos FROM pair p JOIN field x ON x.file_id = p.file_id),
old AS (SELECT p.file_id, x.name, x.kind, x.n, x.pos FROM pair p JOIN field x ON x.file_id = p.prev),
gained AS (SELECT * FROM cur WHERE (file_id, name) NOT IN (SELECT (file_id, name) FROM old)),
lost AS (SELECT * FROM old WHERE (file_id, name) NOT IN (SELECT (file_id, name) FROM cur)),
match AS (
  SELECT g.file_id, g.name AS new_name, l.name AS old_name FROM gained g JOIN lost l ON g.file_id = l.file_id
  AND g.pos IS NOT DISTINCT FROM l.pos AND g.kind IS NOT DISTINCT FROM l.kind AND g.n IS NOT DISTINCT FROM l.n)
SELECT c.file_id, c.name AS field_name, 'retyped' AS change_kind FROM cur c JOIN old o ON c.file_id = o.file_id AND c.name = o.name
 WHERE c.kind IS DISTINCT FROM o.kind OR c.n IS DISTINCT FROM o.n
UNION ALL
SELECT c.file_id, c.name, 'moved' FROM cur c JOIN old o ON c.file_id = o.file_id AND c.name = o.name WHERE c.pos IS DISTINCT FROM o.pos
UNION ALL
SELECT file_id, name, CASE WHEN (file_id, name) IN (SELECT (file_id, new_name) FROM match) THEN 'renamed' ELSE 'added' END FROM gained
UNION ALL
SELECT file_id, name, 'removed' FROM lost WHERE (file_id, name) NOT IN (SELECT (file_id, old_name) FROM match)
"""

_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def _sql_values(delimiter: str) -> tuple[str, str, str]:
    blanks = "".join(b for b in " \t" if b != delimiter)
    value = f'[{blanks}]*"([^"]|"")*"[{blanks}]*|[^{delimiter}"]*'
    return f"[{delimiter}]", f"([{delimiter}]({value}))+", blanks


def _sql_branch(name: str, delimiter: str) -> str:
    d, line, blanks = _sql_values(delimiter)
    value = f'[{blanks}]*"(?:[^"]|"")*"[{blanks}]*|[^{delimiter}"]*'
    return f"""
  SELECT file_id, line_no, names, regexp_full_match('{delimiter}' || line, '{line}') AS quoted,
         list_transform(regexp_extract_all('{delimiter}' || line, '{d}({value})', 1), lambda v: trim(v, '{blanks}')) AS vals
  FROM xyz WHERE delimiter = '{name}'"""


P4_FOUND = rf"""
WITH raw AS (SELECT DISTINCT file_id, line_no, line FROM raw_line WHERE NOT regexp_full_match(line, '[ \t]*')),
xyz AS (
  SELECT r.file_id, r.line_no, r.line, string_split(s.column_list, ',') AS names, s.delimiter
  FROM raw r JOIN (SELECT DISTINCT file_id, column_list, delimiter, has_header FROM xyz_schema) s ON r.file_id = s.file_id
  WHERE NOT (s.has_header AND r.line_no = 1)),
read AS ({" UNION ALL ".join(_sql_branch(n, d) for n, d in parse_split.DELIMITERS.items())}),
bare AS (
  SELECT file_id, line_no, names, quoted,
         list_transform(vals, lambda v: CASE WHEN v[1] = '"' THEN replace(v[2:len(v) - 1], '""', '"') ELSE v END) AS vals FROM read),
cell AS (SELECT file_id, line_no, unnest(names) AS name, unnest(vals) AS v FROM bare WHERE quoted AND len(vals) = len(names)),
header AS (
  SELECT DISTINCT file_id, string_split(sizes, ' ') AS s, string_split(types, ' ') AS t, string_split(counts, ' ') AS c
  FROM pcd_header WHERE data_format = 'ascii'),
kind AS (
  SELECT file_id, flatten(list_transform(range(1, len(c) + 1), lambda i: list_transform(range(CAST(c[i] AS BIGINT)), lambda k: t[i] || s[i]))) AS kinds
  FROM header),
pcd AS (SELECT r.file_id, r.line_no, regexp_extract_all(r.line, '[^ \t]+') AS vals, k.kinds FROM raw r JOIN kind k ON r.file_id = k.file_id),
typed AS (SELECT file_id, line_no, unnest(kinds) AS kind, unnest(vals) AS v FROM pcd WHERE len(vals) = len(kinds)),
whole AS (
  SELECT *, regexp_full_match(v, '[+-]?[0-9]+') AS is_whole,
         ltrim(regexp_replace(v, '^[+-]', ''), '0') AS digits, starts_with(v, '-') AS negative FROM typed)
SELECT file_id, line_no, 'quoting' AS reason FROM bare WHERE NOT quoted
UNION ALL
SELECT file_id, line_no, 'columns' FROM bare WHERE quoted AND len(vals) <> len(names)
UNION ALL
SELECT DISTINCT file_id, line_no, 'value' FROM cell WHERE
  (name IN ('x', 'y', 'z') AND NOT regexp_full_match(v, '{_NUMBER}'))
  OR (name IN ('intensity', 'nx', 'ny', 'nz') AND v <> '' AND NOT regexp_full_match(v, '{_NUMBER}'))
  OR (name IN ('red', 'green', 'blue') AND v <> '' AND NOT coalesce(regexp_full_match(v, '[0-9]+') AND TRY_CAST(right('000' || right(v, 18), 18) AS BIGINT) <= 255, false))
UNION ALL
SELECT file_id, line_no, 'columns' FROM pcd WHERE len(vals) <> len(kinds)
UNION ALL
SELECT DISTINCT file_id, line_no, 'value' FROM whole WHERE
  CASE WHEN kind[1] = 'F' THEN NOT (regexp_full_match(v, '{_NUMBER}') OR lower(v) = 'nan')
       ELSE NOT is_whole OR len(digits) > 20
            OR CASE WHEN negative THEN -CAST('0' || CASE WHEN is_whole AND len(digits) <= 20 THEN digits ELSE '' END AS HUGEINT)
                    ELSE CAST('0' || CASE WHEN is_whole AND len(digits) <= 20 THEN digits ELSE '' END AS HUGEINT) END
               NOT BETWEEN CASE WHEN kind[1] = 'U' THEN 0 ELSE -CAST(2 ** (8 * CAST(kind[2:] AS INT) - 1) AS HUGEINT) END
               AND CASE WHEN kind[1] = 'U' THEN CAST(2 ** (8 * CAST(kind[2:] AS INT)) AS HUGEINT) - 1 ELSE CAST(2 ** (8 * CAST(kind[2:] AS INT) - 1) AS HUGEINT) - 1 END
  END
"""

_HEAD, _FAILED = P4_FOUND.split("SELECT file_id, line_no, 'quoting'", 1)
#: The lines that do not fail, with their values.
P4_LINES = f"""{_HEAD.rstrip()},
failed AS (SELECT file_id, line_no FROM (SELECT file_id, line_no, 'quoting'{_FAILED}))
SELECT file_id, line_no, array_to_string(vals, '|') AS vals FROM (
  SELECT file_id, line_no, vals FROM bare WHERE quoted UNION SELECT file_id, line_no, vals FROM pcd) WHERE (file_id, line_no) NOT IN (SELECT (file_id, line_no) FROM failed)"""
SQL = {"p1_found": P1_FOUND, "p4_found": P4_FOUND, "p4_lines": P4_LINES}
