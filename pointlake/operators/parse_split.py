"""Rows that fail to parse: separate them, with the reason, from typed rows.

Every value is kept as text, rules are evaluated on all of them as Column expressions into an array of errors per line, and
an empty array makes a line a row. Nothing leaves the JVM, no line is looked at by Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The delimiters by name, and the blanks that may surround a value under each (a blank that is the delimiter is none).
DELIMITERS = {"comma": ",", "space": " ", "tab": "\t", "semicolon": ";"}
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
WHOLE = r"^[+-]?[0-9]+\z"
UNSIGNED = r"^[0-9]+\z"
BLANK_LINE = r"^[ \t]*\z"
POSITION, OPTIONAL, COLOUR = ("x", "y", "z"), ("intensity", "nx", "ny", "nz"), ("red", "green", "blue")
TYPED = (*POSITION, *OPTIONAL, *COLOUR, "label")


def _patterns(delimiter: str) -> tuple[str, str, str]:
    """Of one delimiter: the pattern of a well-quoted line, of a delimiter with its value, and of outer blanks."""
    blanks = "".join(b for b in " \t" if b != delimiter)
    quoted = rf'[{blanks}]*+"(?:[^"]|"")*+"[{blanks}]*+(?=[{delimiter}]|\z)'
    # an unquoted value has no quote at all
    value = rf'(?:{quoted}|[^{delimiter}"]*+(?=[{delimiter}]|\z))'
    return rf"^(?:[{delimiter}]{value})+\z", rf"[{delimiter}]({value})", blanks


def _by_delimiter(name: Column, make) -> Column:
    out = None
    for key, delimiter in DELIMITERS.items():
        out = F.when(name == key, make(delimiter)) if out is None else out.when(name == key, make(delimiter))
    return out


def _unquote(value: Column, blanks: str) -> Column:
    bare = F.regexp_replace(value, rf"^[{blanks}]+|[{blanks}]+\z", "")
    inner = F.replace(F.substring(bare, F.lit(2), F.length(bare) - 2), F.lit('""'), F.lit('"'))
    return F.when(bare.startswith('"'), inner).otherwise(bare)


def delimited_values(line: Column, delimiter: Column) -> Column:
    """The values of a delimited line as ARRAY<STRING>; null where its quoting is broken."""

    def make(d: str) -> Column:
        whole, each, blanks = _patterns(d)
        led = F.concat(F.lit(d), line)
        values = F.regexp_extract_all(led, F.lit(each), F.lit(1))
        return F.when(F.regexp_like(led, F.lit(whole)), F.transform(values, lambda v: _unquote(v, blanks)))

    return _by_delimiter(delimiter, make)


def _digits_at_most(digits: Column, limit: Column) -> Column:
    """Whether a run of digits of any length is at most a limit given as digits without leading zeros."""
    bare = F.regexp_replace(digits, r"^0+(?=[0-9])", "")
    return (F.length(bare) < F.length(limit)) | ((F.length(bare) == F.length(limit)) & (bare <= limit))


def _fits(name: Column, value: Column) -> Column:
    """Whether a value of a text column obeys the rule of the column's name."""
    number = F.regexp_like(value, F.lit(NUMBER))
    byte = F.regexp_like(value, F.lit(UNSIGNED)) & _digits_at_most(value, F.lit("255"))
    return (
        F.when(name.isin(*POSITION), number)
        .when(name.isin(*OPTIONAL), (value == "") | number)
        .when(name.isin(*COLOUR), (value == "") | byte)
        .otherwise(F.lit(True))
    )


def _whole_limit(kind: Column, size: Column, negative: bool) -> Column:
    """Largest magnitude of a signed (I) or unsigned (U) whole number of so many bytes, as digits."""
    out = F.lit("0")
    for n in (1, 2, 4, 8):
        signed = 2 ** (8 * n - 1) - (not negative)
        unsigned = 0 if negative else 2 ** (8 * n) - 1
        out = F.when(size == str(n), F.when(kind == "I", F.lit(str(signed))).otherwise(F.lit(str(unsigned)))).otherwise(out)
    return out


def _fits_type(kind: Column, size: Column, value: Column) -> Column:
    real = F.regexp_like(value, F.lit(NUMBER)) | (F.lower(value) == "nan")
    digits = F.regexp_replace(value, r"^[+-]", "")
    limit = F.when(value.startswith("-"), _whole_limit(kind, size, True)).otherwise(_whole_limit(kind, size, False))
    return F.when(kind == "F", real).otherwise(F.regexp_like(value, F.lit(WHOLE)) & _digits_at_most(digits, limit))


def check_delimited(lines: DataFrame, schemas: DataFrame) -> DataFrame:
    """Lines ``(file_id, line_no, line)`` of files with a schema ``(file_id, column_list, delimiter, has_header)``, checked.

    Returns ``(file_id, line_no, names, vals, kinds, errors)``: ``kinds`` are the types of the values, null here, and ``errors`` holds ``quoting``, ``columns`` or one ``value`` for each
    wrong value, and is empty for a row. Header lines and blank lines come out neither way, as do lines of unknown files and
    null lines; an unknown or null delimiter leaves no readable value and counts as ``quoting``, a null column list has no
    columns. A line delivered twice stays twice. Other columns are not read.
    """
    known = schemas.select("file_id", "column_list", "delimiter", "has_header").dropDuplicates(["file_id"])
    line = F.col("line")
    lines = lines.select("file_id", "line_no", "line")  # other columns may bear the names used here
    rows = (
        lines.where(line.isNotNull() & ~F.regexp_like(line, F.lit(BLANK_LINE)))
        .join(known, "file_id")
        .where(~(F.coalesce("has_header", F.lit(False)) & F.col("line_no").eqNullSafe(F.lit(1))))
        .select("file_id", "line_no", F.coalesce(F.split("column_list", ","), F.array().cast("array<string>")).alias("names"), delimited_values(line, F.col("delimiter")).alias("vals"))
    )
    wrong = F.filter(F.zip_with("names", "vals", lambda n, v: ~_fits(F.trim(n), v)), lambda bad: bad)
    errors = (
        F.when(F.col("vals").isNull(), F.array(F.lit("quoting")))
        .when(F.size("vals") != F.size("names"), F.array(F.lit("columns")))
        .otherwise(F.transform(wrong, lambda _: F.lit("value")))
    )
    kinds = F.transform("names", lambda _: F.lit(None).cast("string"))
    return rows.select("file_id", "line_no", "names", "vals", kinds.alias("kinds"), errors.alias("errors"))


def check_typed(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines of files with a typed header ``(file_id, fields, sizes, types, counts, data_format)`` in text form, checked.

    Returns what :func:`check_delimited` returns, with a name and a type (letter and size) for each value: a field of count n
    names n values.
    A header with null or broken lists has no values, so that its lines count as ``columns``.
    """
    known = headers.where(F.col("data_format") == "ascii").select("file_id", "fields", "sizes", "types", "counts").dropDuplicates(["file_id"])
    per_field = {c: F.split(F.trim(c), r"[ \t]+") for c in ("fields", "sizes", "types", "counts")}
    spread = lambda c: F.flatten(F.zip_with(c, "counts", lambda v, n: F.array_repeat(v, n.try_cast("int"))))
    layout = known.select("file_id", *(v.alias(c) for c, v in per_field.items())).select("file_id", spread("fields").alias("names"), F.arrays_zip(spread("types").alias("kind"), spread("sizes").alias("size")).alias("layout"))
    line = F.col("line")
    lines = lines.select("file_id", "line_no", "line")  # other columns may bear the names used here
    rows = (
        lines.where(line.isNotNull() & ~F.regexp_like(line, F.lit(BLANK_LINE)))
        .join(layout, "file_id")
        .select("file_id", "line_no", F.coalesce("names", F.array().cast("array<string>")).alias("names"), F.regexp_extract_all(line, F.lit(r"([^ \t]+)"), F.lit(1)).alias("vals"), "layout")
    )
    wrong = F.filter(F.zip_with("layout", "vals", lambda t, v: ~_fits_type(t["kind"], t["size"], v)), lambda bad: bad)
    errors = F.when(F.size("vals") != F.size("names"), F.array(F.lit("columns"))).otherwise(F.transform(wrong, lambda _: F.lit("value")))
    kinds = F.transform("layout", lambda t: F.concat(t["kind"], t["size"]))
    return rows.select("file_id", "line_no", "names", "vals", kinds.alias("kinds"), errors.alias("errors"))


def failed(checked: DataFrame) -> DataFrame:
    """The failed lines with their reason, each once: ``(file_id, line_no, reason)``."""
    return checked.where(F.size("errors") > 0).select("file_id", "line_no", F.col("errors")[0].alias("reason")).distinct()


def points(checked: DataFrame, typed: bool = False) -> DataFrame:
    """The other lines as typed points, each once: x, y, z, intensity, nx, ny, nz DOUBLE, red, green, blue INT, label STRING.

    Columns a file lacks and empty values are null. All values that these columns do not hold are in the map ``more`` by name:
    those of further columns, the second and later ones of a name that has several, and a colour that is no INT. They stay as
    text, blank-separated; if ``typed``, they are an array of structs of the ``kind`` in the header (null in files without
    types) and the value as ``whole`` DECIMAL(20,0) for I and U, ``real`` DOUBLE for F, else ``text``.
    """
    value = lambda n: F.nullif(F.try_element_at("vals", F.nullif(F.array_position("names", n), F.lit(0)).cast("int")), F.lit(""))
    columns = {**dict.fromkeys((*POSITION, *OPTIONAL), "double"), **dict.fromkeys(COLOUR, "int"), "label": "string"}
    first = F.transform("names", lambda n, i: F.array_position("names", n) == i + 1)
    cells = F.arrays_zip("names", "vals", "kinds", first.alias("first"))
    lost = lambda p: p["names"].isin(*COLOUR) & (p["vals"] != "") & p["vals"].try_cast("int").isNull()
    cells = F.filter(cells, lambda p: ~p["names"].isin(*TYPED) | ~p["first"] | lost(p))
    kind = lambda p, *letters: F.coalesce(F.substring(p["kinds"], 1, 1).isin(*letters), F.lit(False))

    def as_typed(p: Column) -> Column:
        whole, real = F.when(kind(p, "I", "U"), p["vals"].try_cast("decimal(20,0)")), F.when(kind(p, "F"), p["vals"].try_cast("double"))
        return F.struct(p["kinds"].alias("kind"), whole.alias("whole"), real.alias("real"), F.when(~kind(p, "I", "U", "F"), p["vals"]).alias("text"))

    own = lambda n: F.filter("cells", lambda p: p["names"] == n)
    held = (lambda n: F.transform(own(n), as_typed)) if typed else (lambda n: F.array_join(F.transform(own(n), lambda p: p["vals"]), " "))
    rest = F.array_distinct(F.transform("cells", lambda p: p["names"]))
    once = checked.where(F.size("errors") == 0).dropDuplicates(["file_id", "line_no"]).withColumn("cells", cells)
    return once.select("file_id", "line_no", *(value(n).try_cast(k).alias(n) for n, k in columns.items()), F.map_from_arrays(rest, F.transform(rest, held)).alias("more"))


def check_lines(raw: DataFrame, schemas: DataFrame, headers: DataFrame) -> DataFrame:
    """Both kinds of files checked in one table; a file is of one kind."""
    return check_delimited(raw, schemas).unionByName(check_typed(raw, headers))
