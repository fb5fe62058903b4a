"""Point-cloud and mesh files as numpy arrays and back: PLY, PCD, STL, OBJ/MTL, KITTI, XYZ/CSV schemas.

Pure functions on bytes; Spark readers call them inside tasks. Malformed input raises ValueError.
"""

from __future__ import annotations

import io
import re
from dataclasses import dataclass, field

import numpy as np

# -- PLY ------------------------------------------------------------------------------------------------------------------

# Scalar types of PLY and their numpy kinds.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


@dataclass
class PlyElement:
    name: str
    count: int
    #: (name, type) of a scalar, (name, count type, item type) of a list.
    properties: list[tuple] = field(default_factory=list)

    @property
    def is_fixed(self) -> bool:
        return all(len(p) == 2 for p in self.properties)


@dataclass
class PlyHeader:
    form: str
    elements: list[PlyElement]
    comments: list[str]
    size: int

    def dtype(self, element: PlyElement) -> np.dtype:
        order = ">" if self.form == "binary_big_endian" else "<"
        return np.dtype([(p[0], order + PLY_TYPES[p[1]]) for p in element.properties])


def ply_header(data: bytes) -> PlyHeader:
    """The header at the start of a file's bytes."""
    end = re.search(rb"end_header[ \t]*\r?\n", data)
    if not data.startswith(b"ply") or not end:
        raise ValueError("no PLY header")
    form, elements, comments = "", [], []
    for line in data[: end.start()].decode("ascii", "replace").splitlines()[1:]:
        words = line.split()
        if not words:
            continue
        if words[0] == "format":
            form = words[1]
        elif words[0] in ("comment", "obj_info"):
            comments.append(line.split(None, 1)[1] if len(words) > 1 else "")
        elif words[0] == "element":
            elements.append(PlyElement(words[1], int(words[2])))
        elif words[0] == "property":
            if not elements:
                raise ValueError("property before element")
            p = (words[4], words[2], words[3]) if words[1] == "list" else (words[2], words[1])
            if any(t not in PLY_TYPES for t in p[1:]):
                raise ValueError(f"unknown type in {line!r}")
            elements[-1].properties.append(p)
    if form not in ("ascii", "binary_little_endian", "binary_big_endian"):
        raise ValueError(f"unknown format {form!r}")
    return PlyHeader(form, elements, comments, end.end())


def read_ply(data: bytes) -> dict[str, dict[str, np.ndarray | list]]:
    """Elements by name, each with its properties: arrays, and lists of arrays for list properties."""
    header = ply_header(data)
    out: dict[str, dict] = {}
    if header.form == "ascii":
        lines = [x for x in data[header.size :].decode("ascii", "replace").splitlines() if x.strip()]
        at = 0
        for e in header.elements:
            rows = [x.split() for x in lines[at : at + e.count]]
            if len(rows) < e.count:
                raise ValueError(f"{e.name}: {len(rows)} of {e.count} rows")
            at += e.count
            try:
                if e.is_fixed:
                    table = [r[: len(e.properties)] for r in rows]
                    out[e.name] = {p[0]: np.array([r[i] for r in table], dtype="f8").astype(PLY_TYPES[p[1]]) for i, p in enumerate(e.properties)}
                else:
                    columns: dict[str, list] = {p[0]: [] for p in e.properties}
                    for r in rows:
                        i = 0
                        for p in e.properties:
                            if len(p) == 2:
                                columns[p[0]].append(float(r[i]))
                                i += 1
                            else:
                                n = int(r[i])
                                columns[p[0]].append(np.array(r[i + 1 : i + 1 + n], dtype="f8").astype(PLY_TYPES[p[2]]))
                                i += 1 + n
                    out[e.name] = {p[0]: np.array(columns[p[0]]).astype(PLY_TYPES[p[1]]) if len(p) == 2 else columns[p[0]] for p in e.properties}
            except (IndexError, ValueError) as error:
                raise ValueError(f"{e.name}: broken row ({error})") from error
        return out
    order = ">" if header.form == "binary_big_endian" else "<"
    at = header.size
    for e in header.elements:
        if e.is_fixed:
            kind = header.dtype(e)
            if len(data) < at + kind.itemsize * e.count:
                raise ValueError(f"{e.name}: the file is too short")
            rows = np.frombuffer(data, dtype=kind, count=e.count, offset=at)
            at += kind.itemsize * e.count
            out[e.name] = {p[0]: rows[p[0]].astype(PLY_TYPES[p[1]]) for p in e.properties}
            continue
        columns = {p[0]: [] for p in e.properties}
        try:
            for _ in range(e.count):
                for p in e.properties:
                    if len(p) == 2:
                        kind = np.dtype(order + PLY_TYPES[p[1]])
                        columns[p[0]].append(np.frombuffer(data, kind, 1, at)[0])
                        at += kind.itemsize
                    else:
                        kind = np.dtype(order + PLY_TYPES[p[1]])
                        n = int(np.frombuffer(data, kind, 1, at)[0])
                        at += kind.itemsize
                        item = np.dtype(order + PLY_TYPES[p[2]])
                        columns[p[0]].append(np.frombuffer(data, item, n, at).astype(PLY_TYPES[p[2]]))
                        at += item.itemsize * n
        except ValueError as error:
            raise ValueError(f"{e.name}: the file is too short") from error
        out[e.name] = {p[0]: columns[p[0]] if len(p) == 3 else np.array(columns[p[0]]) for p in e.properties}
    return out


def fans(polygons: list) -> np.ndarray:
    """Triangles of polygons: a fan over each of three or more corners."""
    out = [(int(p[0]), int(p[i]), int(p[i + 1])) for p in polygons for i in range(1, len(p) - 1)]
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def write_ply(columns: dict[str, np.ndarray], faces: np.ndarray | None = None, form: str = "ascii", comments: list[str] | None = None) -> bytes:
    """A file of vertices (columns in order) and triangles. Columns r, g, b become red, green, blue."""
    names = {"r": "red", "g": "green", "b": "blue"}
    kinds = {n: "uchar" if n in ("r", "g", "b", "red", "green", "blue", "alpha") else ("double" if c.dtype == np.float64 else "int" if c.dtype.kind in "iu" else "float") for n, c in columns.items()}
    n = len(next(iter(columns.values()))) if columns else 0
    head = ["ply", f"format {form} 1.0", *(f"comment {c}" for c in comments or []), f"element vertex {n}", *(f"property {kinds[c]} {names.get(c, c)}" for c in columns)]
    if faces is not None:
        head += [f"element face {len(faces)}", "property list uchar int vertex_indices"]
    head.append("end_header")
    out = io.BytesIO()
    out.write(("\n".join(head) + "\n").encode())
    if form == "ascii":
        rows = zip(*(c.tolist() for c in columns.values()))
        out.write("".join(" ".join(repr(v) if isinstance(v, float) else str(v) for v in r) + "\n" for r in rows).encode())
        if faces is not None:
            out.write("".join(f"3 {a} {b} {c}\n" for a, b, c in faces.tolist()).encode())
        return out.getvalue()
    order = ">" if form == "binary_big_endian" else "<"
    table = np.empty(n, dtype=[(c, order + PLY_TYPES[kinds[c]]) for c in columns])
    for c, v in columns.items():
        table[c] = v
    out.write(table.tobytes())
    if faces is not None:
        rows = np.empty(len(faces), dtype=[("n", "u1"), ("v", order + "i4", 3)])
        rows["n"], rows["v"] = 3, faces
        out.write(rows.tobytes())
    return out.getvalue()


# -- PCD ------------------------------------------------------------------------------------------------------------------


@dataclass
class PcdHeader:
    version: str
    fields: list[str]
    sizes: list[int]
    types: list[str]
    counts: list[int]
    width: int
    height: int
    viewpoint: list[float]
    points: int
    form: str
    size: int

    @property
    def dtype(self) -> np.dtype:
        kinds = {"F": "f", "I": "i", "U": "u"}
        return np.dtype([(f"{f}__{i}", f"<{kinds[t]}{s}", (c,)) for i, (f, t, s, c) in enumerate(zip(self.fields, self.types, self.sizes, self.counts))])


def pcd_header(data: bytes) -> PcdHeader:
    """The header at the start of a file's bytes."""
    end = re.search(rb"^DATA[ \t]+(\w+)[ \t]*\r?\n", data, re.M)
    if not end:
        raise ValueError("no PCD header")
    said: dict[str, list[str]] = {}
    for line in data[: end.start()].decode("ascii", "replace").splitlines():
        words = line.split()
        if words and not words[0].startswith("#"):
            said[words[0]] = words[1:]
    try:
        fields = said["FIELDS"]
        counts = [int(v) for v in said.get("COUNT", ["1"] * len(fields))]
        width, height = int(said["WIDTH"][0]), int(said.get("HEIGHT", ["1"])[0])
        out = PcdHeader(said.get("VERSION", ["0.7"])[0], fields, [int(v) for v in said["SIZE"]], said["TYPE"], counts, width, height, [float(v) for v in said.get("VIEWPOINT", "0 0 0 1 0 0 0".split())], int(said.get("POINTS", [str(width * height)])[0]), end.group(1).decode(), end.end())
    except (KeyError, IndexError, ValueError) as error:
        raise ValueError(f"broken PCD header ({error})") from error
    if not len(fields) == len(out.sizes) == len(out.types) == len(counts):
        raise ValueError("the lists of the PCD header differ in length")
    return out


def read_pcd(data: bytes) -> tuple[PcdHeader, dict[str, np.ndarray]]:
    """Header and fields; a field of count n is an array with n columns. Compressed data are not supported."""
    header = pcd_header(data)
    if header.form == "binary_compressed":
        raise ValueError("binary_compressed PCD is not supported")
    if header.form == "ascii":
        rows = [x.split() for x in data[header.size :].decode("ascii", "replace").splitlines() if x.strip()][: header.points]
        width = sum(header.counts)
        if len(rows) < header.points or any(len(r) != width for r in rows):
            raise ValueError("PCD rows do not fit the header")
        table = np.array(rows, dtype="f8").reshape(-1, width)
        starts = np.cumsum([0, *header.counts])
        parts = [table[:, a:b] for a, b in zip(starts, starts[1:])]
        kinds = [header.dtype[i].base for i in range(len(header.fields))]
        parts = [p.astype(k) for p, k in zip(parts, kinds)]
    elif header.form == "binary":
        if len(data) - header.size < header.dtype.itemsize * header.points:
            raise ValueError("the PCD file is too short")
        rows = np.frombuffer(data, header.dtype, header.points, header.size)
        parts = [rows[n] for n in header.dtype.names]
    else:
        raise ValueError(f"unknown PCD data format {header.form!r}")
    return header, {f: (p[:, 0] if c == 1 else p) for f, p, c in zip(header.fields, parts, header.counts)}


def write_pcd(columns: dict[str, np.ndarray], form: str = "binary", viewpoint: tuple = (0, 0, 0, 1, 0, 0, 0), version: str = "0.7") -> bytes:
    """A file of one row per point; columns in order, 64-bit numbers as they are."""
    if form not in ("ascii", "binary"):
        raise ValueError("only ascii and binary PCD can be written")
    n = len(next(iter(columns.values()))) if columns else 0
    letter = {"f": "F", "i": "I", "u": "U"}
    kinds = [c.dtype for c in columns.values()]
    head = [f"# .PCD v{version}", f"VERSION {version}", "FIELDS " + " ".join(columns), "SIZE " + " ".join(str(k.itemsize) for k in kinds), "TYPE " + " ".join(letter[k.kind] for k in kinds), "COUNT " + " ".join("1" for _ in kinds), f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT " + " ".join(f"{v:g}" for v in viewpoint), f"POINTS {n}", f"DATA {form}"]
    start = ("\n".join(head) + "\n").encode()
    if form == "ascii":
        rows = zip(*(c.tolist() for c in columns.values()))
        return start + "".join(" ".join(repr(v) if isinstance(v, float) else str(v) for v in r) + "\n" for r in rows).encode()
    table = np.empty(n, dtype=[(c, v.dtype.newbyteorder("<")) for c, v in columns.items()])
    for c, v in columns.items():
        table[c] = v
    return start + table.tobytes()


# -- STL ------------------------------------------------------------------------------------------------------------------

_STL = np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")])


def read_stl(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Normals (n, 3) and corners (n, 3, 3) of all triangles; binary where the size fits the count."""
    if len(data) >= 84:
        n = int.from_bytes(data[80:84], "little")
        if len(data) == 84 + 50 * n:
            rows = np.frombuffer(data, _STL, n, 84)
            return rows["n"].astype(float), rows["v"].astype(float)
    text = data.decode("ascii", "replace")
    if not text.lstrip().startswith("solid"):
        raise ValueError("neither binary nor ascii STL")
    number = r"([-+\w.]+)"
    facets = re.findall(rf"facet(?:\s+normal\s+{number}\s+{number}\s+{number})?(.*?)endfacet", text, re.S)
    normals, corners = [], []
    for *n, body in facets:
        v = re.findall(rf"vertex\s+{number}\s+{number}\s+{number}", body)
        if len(v) == 3:
            normals.append([float(x or 0) for x in n])
            corners.append([[float(x) for x in p] for p in v])
    return np.array(normals).reshape(-1, 3), np.array(corners).reshape(-1, 3, 3)


def weld(corners: np.ndarray, step: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertices, faces and the rows kept: corners equal to a multiple of ``step`` become one, degenerate triangles go."""
    flat = corners.reshape(-1, 3)
    _, first, which = np.unique(np.round(flat / step).astype(np.int64), axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)  # vertices in order of their first use
    rank = np.empty(len(order), dtype=int)
    rank[order] = np.arange(len(order))
    faces = rank[np.ravel(which)].reshape(-1, 3)
    whole = (faces[:, 0] != faces[:, 1]) & (faces[:, 1] != faces[:, 2]) & (faces[:, 2] != faces[:, 0])
    return flat[first[order]], faces[whole], whole


def write_stl(corners: np.ndarray, form: str = "binary", name: str = "mesh") -> bytes:
    """A file of triangles (n, 3, 3) with their normals."""
    n = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
    length = np.linalg.norm(n, axis=1, keepdims=True)
    n = np.divide(n, length, out=np.zeros_like(n), where=length > 0)
    if form == "binary":
        rows = np.zeros(len(corners), _STL)
        rows["n"], rows["v"] = n, corners
        return name.encode().ljust(80, b" ")[:80] + len(corners).to_bytes(4, "little") + rows.tobytes()
    if form != "ascii":
        raise ValueError("form must be binary or ascii")
    line = lambda v: " ".join(repr(float(x)) for x in v)
    facets = (f"facet normal {line(a)}\nouter loop\n" + "".join(f"vertex {line(v)}\n" for v in t) + "endloop\nendfacet\n" for a, t in zip(n, corners))
    return f"solid {name}\n{''.join(facets)}endsolid {name}\n".encode()


# -- OBJ and MTL ----------------------------------------------------------------------------------------------------------


@dataclass
class Obj:
    vertices: list = field(default_factory=list)
    uvs: list = field(default_factory=list)
    normals: list = field(default_factory=list)
    #: (corners as (vertex, uv, normal) with None where absent, group, material)
    faces: list = field(default_factory=list)
    libraries: list = field(default_factory=list)


def read_obj(text: str) -> Obj:
    """Vertices, texture places, normals and polygons. Indices count from 1; relative (negative) ones are an error."""
    out, group, material = Obj(), None, None
    for n, line in enumerate(text.replace("\\\n", " ").splitlines(), 1):
        words = line.split("#")[0].split()
        if not words:
            continue
        try:
            if words[0] in ("v", "vn"):
                (out.vertices if words[0] == "v" else out.normals).append([float(w) for w in words[1 : 7 if words[0] == "v" else 4]])
                if len(words) < 4:
                    raise ValueError("three numbers are needed")
            elif words[0] == "vt":
                out.uvs.append([float(w) for w in words[1:3]])
            elif words[0] == "f":
                corners = []
                for w in words[1:]:
                    parts = [int(p) if p else None for p in w.split("/")]
                    parts += [None] * (3 - len(parts))
                    if any(p is not None and p < 1 for p in parts):
                        raise ValueError("indices must be positive")
                    corners.append(tuple(None if p is None else p - 1 for p in parts[:3]))
                if len(corners) < 3:
                    raise ValueError("a face needs three corners")
                if any(c[0] >= len(out.vertices) for c in corners):
                    raise ValueError("a vertex is not there")
                out.faces.append((corners, group, material))
            elif words[0] in ("g", "o"):
                group = " ".join(words[1:]) or None
            elif words[0] == "usemtl":
                material = " ".join(words[1:]) or None
            elif words[0] == "mtllib":
                out.libraries.append(" ".join(words[1:]))
        except ValueError as error:
            raise ValueError(f"line {n}: {error}") from error
    return out


def obj_triangles(obj: Obj) -> np.ndarray:
    """Vertex triples of all faces, polygons as fans."""
    return fans([[c[0] for c in corners] for corners, _, _ in obj.faces])


def write_obj(vertices: np.ndarray, faces: np.ndarray, normals: np.ndarray | None = None, uvs: np.ndarray | None = None, groups: list | None = None, materials: list | None = None, library: str | None = None) -> str:
    """The text of a mesh; groups and materials are given per face and written where they change."""
    out = [f"mtllib {library}"] if library else []
    for key, rows in (("v", vertices), ("vt", uvs), ("vn", normals)):
        if rows is not None:
            out += [f"{key} " + " ".join(repr(float(x)) for x in r) for r in rows]
    last = [None, None]
    for i, f in enumerate(np.asarray(faces) + 1):
        for j, (key, names) in enumerate((("g", groups), ("usemtl", materials))):
            if names is not None and names[i] != last[j]:
                last[j] = names[i]
                out.append(f"{key} {names[i]}")
        corner = (lambda v: f"{v}/{v}/{v}") if uvs is not None and normals is not None else (lambda v: f"{v}/{v}") if uvs is not None else (lambda v: f"{v}//{v}") if normals is not None else str
        out.append("f " + " ".join(corner(v) for v in f))
    return "\n".join(out) + "\n"


_MTL = {"Ka": "ambient", "Kd": "diffuse", "Ks": "specular", "Ke": "emissive", "Ns": "shininess", "Ni": "density", "d": "opacity", "illum": "illumination", "map_Kd": "diffuse_map", "map_Ka": "ambient_map", "map_Ks": "specular_map", "map_Bump": "bump_map"}


def read_mtl(text: str) -> dict[str, dict]:
    """Materials by name; colours are lists, maps are file names, ``Tr`` counts as 1 - opacity."""
    out: dict[str, dict] = {}
    now: dict | None = None
    for line in text.splitlines():
        words = line.split("#")[0].split()
        if not words:
            continue
        if words[0] == "newmtl":
            now = out.setdefault(" ".join(words[1:]), {})
        elif now is not None and words[0] == "Tr":
            now["opacity"] = 1 - float(words[1])
        elif now is not None and words[0] in _MTL:
            key = _MTL[words[0]]
            now[key] = " ".join(words[1:]) if words[0].startswith("map") else [float(w) for w in words[1:4]] if words[0].startswith("K") else float(words[1])
    return out


def write_mtl(materials: dict[str, dict]) -> str:
    out = []
    for name, m in materials.items():
        out.append(f"newmtl {name}")
        for key, said in _MTL.items():
            if said in m:
                v = m[said]
                out.append(f"{key} " + (" ".join(f"{x:g}" for x in v) if isinstance(v, list) else str(v) if isinstance(v, str) else f"{v:g}"))
        out.append("")
    return "\n".join(out)


# -- KITTI, quantisation, XYZ ---------------------------------------------------------------------------------------------

KITTI = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("intensity", "<f4")])


def read_kitti(data: bytes) -> np.ndarray:
    """Rows of x, y, z, intensity; a length that is no multiple of 16 is an error."""
    if len(data) % KITTI.itemsize:
        raise ValueError("the size is no multiple of 16")
    return np.frombuffer(data, KITTI)


def quantize(points: np.ndarray, bits: int = 14) -> tuple[np.ndarray, np.ndarray, float]:
    """Whole-number places on a cube of 2^bits steps, its corner and its step: error at most half a step."""
    if not 1 <= bits <= 30:
        raise ValueError("bits must be between 1 and 30")
    low = points.min(axis=0) if len(points) else np.zeros(3)
    step = float(max((points.max(axis=0) - low).max(), 1e-300) / (2**bits - 1)) if len(points) else 1.0
    return np.round((points - low) / step).astype(np.int64), low, step


def dequantize(places: np.ndarray, low: np.ndarray, step: float) -> np.ndarray:
    return places * step + low


# Names of XYZ/CSV header columns.
XYZ_NAMES = {
    "x": "x px pos_x position_x", "y": "y py pos_y position_y", "z": "z pz pos_z position_z", "intensity": "i intensity int",
    "r": "r red color_r", "g": "g green color_g", "b": "b blue color_b", "nx": "nx normal_x n_x", "ny": "ny normal_y n_y", "nz": "nz normal_z n_z",
}
_BY_NAME = {n: k for k, names in XYZ_NAMES.items() for n in names.split()}


@dataclass(frozen=True)
class XyzSchema:
    columns: tuple[str, ...]
    delimiter: str
    has_header: bool


def detect_xyz(first: str) -> XyzSchema:
    """The schema that a first line shows: the most frequent delimiter (of equal ones the comma first), a header if it has words.

    Without a header the first three columns are x, y, z. A header must name all three.
    """
    first = first.rstrip("\r\n")
    counts = {d: first.count(d) for d in (",", ";", "\t", " ")}
    delimiter = max(counts, key=lambda d: counts[d])
    if not counts[delimiter]:
        raise ValueError("no delimiter found")
    parts = [p.strip() for p in first.split(delimiter)]
    try:
        [float(p) for p in parts if p]
        return XyzSchema(("x", "y", "z"), delimiter, False)
    except ValueError:
        columns = tuple(_BY_NAME.get(p.lower(), p) for p in parts)
    if not {"x", "y", "z"} <= set(columns):
        raise ValueError("the header names no x, y and z")
    return XyzSchema(columns, delimiter, True)


def sniff(head: bytes) -> str | None:
    """The format that a file's first bytes show."""
    if head.startswith(b"ply"):
        return "ply"
    if head.startswith((b"# .PCD", b"VERSION")) or re.search(rb"^FIELDS ", head, re.M):
        return "pcd"
    if head.startswith(b"ASTM-E57"):
        return "e57"
    if head.startswith(b"LASF"):
        return "las"
    if head.startswith(b"livox_tech"):
        return "lvx"
    if head.startswith((b"\xd4\xc3\xb2\xa1", b"\xa1\xb2\xc3\xd4", b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d")):
        return "pcap"
    if head.startswith(b"\x89MCAP0\r\n"):
        return "mcap"
    if head.startswith(b"SQLite format 3\0"):
        return "db3"
    if re.match(rb"(?:\s*#[^\n]*\n)*\s*(?:v|vn|vt|f|o|g|mtllib|usemtl)\s", head):
        return "obj"
    if head.startswith(b"solid"):
        return "stl"
    return None
