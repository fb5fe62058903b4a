"""E57 files: scans in paged, packed binary sections that an XML section describes.

Every page of a file ends with a checksum; offsets in the file count these, lengths do not. A scan's points are a compressed
vector: packets with one byte stream per field, of floats as they are and of whole numbers in as many bits as their range needs.
"""

from __future__ import annotations

import struct
from xml.etree import ElementTree

import numpy as np

# Fixed values of the format: signature, page size with its checksum, header layout, namespace, field names.
SIGNATURE, PAGE, SUM = b"ASTM-E57", 1024, 4
HEADER = struct.Struct("<8sIIQQQQ")
SECTION = struct.Struct("<B7xQQQ")
NAMESPACE = "http://www.astm.org/COMMIT/E57/2010-e57-v1.0"
FIELDS = {"cartesianX": "x", "cartesianY": "y", "cartesianZ": "z", "intensity": "intensity", "colorRed": "r", "colorGreen": "g", "colorBlue": "b", "normalX": "nx", "normalY": "ny", "normalZ": "nz"}
POLYNOMIAL = 0x82F63B78


def _checksums(pages: np.ndarray) -> np.ndarray:
    """CRC-32C of each row of bytes, all rows at a time."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    crc = np.full(len(pages), 0xFFFFFFFF, dtype=np.uint32)
    for column in pages.T:
        crc = table[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def _logical(data: bytes, page: int) -> bytes:
    """The bytes without checksums, each of which must be right."""
    pages = np.frombuffer(data, dtype=np.uint8).reshape(-1, page)
    said = np.ascontiguousarray(pages[:, page - SUM :]).view(">u4").ravel()
    if (said != _checksums(pages[:, : page - SUM])).any():
        raise ValueError("a checksum is wrong")
    return np.ascontiguousarray(pages[:, : page - SUM]).tobytes()


def _streams(body: bytes, at: int, end: int, count: int) -> list[bytes]:
    """The bytes of each field, collected from the packets of a section."""
    parts: list[list[bytes]] = [[] for _ in range(count)]
    while at + 4 <= end:
        kind, _, length = struct.unpack_from("<BBH", body, at)
        if kind == 1:
            n = struct.unpack_from("<H", body, at + 4)[0]
            if n != count:
                raise ValueError("a packet has another number of fields than the prototype")
            sizes = struct.unpack_from(f"<{n}H", body, at + 6)
            place = at + 6 + 2 * n
            for i, size in enumerate(sizes):
                parts[i].append(body[place : place + size])
                place += size
        elif kind not in (0, 2):
            raise ValueError(f"unknown packet {kind}")
        at += length + 1
    return [b"".join(p) for p in parts]


def _whole(data: bytes, bits: int, n: int) -> np.ndarray:
    """n whole numbers of so many bits, the lowest first."""
    if not bits:
        return np.zeros(n, dtype=np.int64)
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little")[: n * bits]
    if len(flat) < n * bits:
        raise ValueError("a byte stream is too short")
    weights = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
    return flat.reshape(n, bits).astype(np.int64) @ weights


def _field(node: ElementTree.Element, data: bytes, n: int) -> np.ndarray:
    kind = node.get("type")
    if kind == "Float":
        form = "<f4" if node.get("precision") == "single" else "<f8"
        out = np.frombuffer(data, form)[:n].astype(float)
        if len(out) < n:
            raise ValueError("a byte stream is too short")
        return out
    if kind not in ("Integer", "ScaledInteger"):
        raise ValueError(f"fields of type {kind} are not supported")
    low, high = int(node.get("minimum", -(2**63))), int(node.get("maximum", 2**63 - 1))
    values = _whole(data, (high - low).bit_length(), n) + low
    return values * float(node.get("scale", 1)) + float(node.get("offset", 0)) if kind == "ScaledInteger" else values.astype(float)


def _pose(scan: ElementTree.Element, points: np.ndarray) -> np.ndarray:
    number = lambda path, other: float(scan.findtext(path, str(other), {"": NAMESPACE}) or other)
    if scan.find("pose", {"": NAMESPACE}) is None:
        return points
    w, x, y, z = (number(f"pose/rotation/{c}", float(c == "w")) for c in "wxyz")
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    return points @ turn.T + np.array([number(f"pose/translation/{c}", 0.0) for c in "xyz"])


def read_e57(data: bytes) -> dict[str, np.ndarray]:
    """Columns of all scans of a file, one after the other: x, y, z and what all scans have of intensity, colours and normals.

    Spherical coordinates become Cartesian ones, scans stand where their pose says, points marked invalid are left out.
    """
    if len(data) < HEADER.size or data[:8] != SIGNATURE:
        raise ValueError("no E57 file")
    _, _, _, length, xml_at, xml_size, page = HEADER.unpack_from(data)
    if page <= SUM or len(data) < length or length % page:
        raise ValueError("the file is too short")
    body = _logical(data[:length], page)
    place = lambda physical: physical // page * (page - SUM) + physical % page
    try:
        root = ElementTree.fromstring(body[place(xml_at) : place(xml_at) + xml_size])
    except ElementTree.ParseError as e:
        raise ValueError(f"the XML section is broken: {e}") from e
    spaces = {"": NAMESPACE}
    scans: list[dict[str, np.ndarray]] = []
    for scan in root.findall("data3D/vectorChild", spaces):
        points = scan.find("points", spaces)
        if points is None:
            continue
        n, fields = int(points.get("recordCount", 0)), list(points.find("prototype", spaces))
        start = place(int(points.get("fileOffset", 0)))
        _, size, first, _ = SECTION.unpack_from(body, start)
        streams = _streams(body, place(first), start + size, len(fields))
        got = {f.tag.rsplit("}", 1)[-1]: _field(f, s, n) for f, s in zip(fields, streams)}
        if "cartesianX" in got:
            xyz, invalid = np.column_stack([got[f"cartesian{c}"] for c in "XYZ"]), got.get("cartesianInvalidState")
        elif "sphericalRange" in got:
            r, a, e = (got[f"spherical{c}"] for c in ("Range", "Azimuth", "Elevation"))
            xyz, invalid = np.column_stack([r * np.cos(e) * np.cos(a), r * np.cos(e) * np.sin(a), r * np.sin(e)]), got.get("sphericalInvalidState")
        else:
            raise ValueError("a scan has no coordinates")
        kept = np.ones(n, dtype=bool) if invalid is None else invalid == 0
        columns = dict(zip("xyz", _pose(scan, xyz)[kept].T))
        scans.append(columns | {k: got[f][kept] for f, k in FIELDS.items() if f in got and k not in "xyz"})
    if not scans:
        raise ValueError("the file holds no scan")
    return {c: np.concatenate([s[c] for s in scans]) for c in scans[0] if all(c in s for s in scans)}


def write_e57(columns: dict[str, np.ndarray]) -> bytes:
    """A file with one scan: floats as doubles, colours as whole numbers up to 255."""
    fields = {f: c for f, c in FIELDS.items() if c in columns}
    n = len(columns["x"])
    colour = lambda c: c in "rgb"
    arrays = [np.asarray(columns[c]).astype("u1" if colour(c) else "<f8") for c in fields.values()]
    packets, step = [], max(1, 60_000 // max(1, sum(a.itemsize for a in arrays)))
    for at in range(0, n, step):
        parts = [a[at : at + step].tobytes() for a in arrays]
        inner = struct.pack(f"<H{len(parts)}H", len(parts), *map(len, parts)) + b"".join(parts)
        inner += bytes(-(len(inner) + 4) % 4)
        packets.append(struct.pack("<BBH", 1, 0, len(inner) + 3) + inner)
    stored = b"".join(packets)
    physical = lambda logical: logical // (PAGE - SUM) * PAGE + logical % (PAGE - SUM)
    start = HEADER.size
    section = SECTION.pack(1, SECTION.size + len(stored), physical(start + SECTION.size), 0) + stored
    whole = lambda f: f'<{f} type="Integer" minimum="0" maximum="255"/>'
    prototype = "".join(whole(f) if colour(c) else f'<{f} type="Float" precision="double"/>' for f, c in fields.items())
    xml = f"""<?xml version="1.0" encoding="UTF-8"?>
<e57Root type="Structure" xmlns="{NAMESPACE}"><formatName type="String">ASTM E57 3D Imaging Data File</formatName><guid type="String">{{pointlake}}</guid><versionMajor type="Integer">1</versionMajor><versionMinor type="Integer">0</versionMinor><data3D type="Vector" allowHeterogeneousChildren="1"><vectorChild type="Structure"><guid type="String">{{scan}}</guid><points type="CompressedVector" fileOffset="{physical(start)}" recordCount="{n}"><prototype type="Structure">{prototype}</prototype><codecs type="Vector" allowHeterogeneousChildren="1"/></points></vectorChild></data3D></e57Root>""".encode()
    xml_at = start + len(section)
    body = bytes(start) + section + xml
    body += bytes(-len(body) % (PAGE - SUM))
    length = len(body) // (PAGE - SUM) * PAGE
    body = HEADER.pack(SIGNATURE, 1, 0, length, physical(xml_at), len(xml), PAGE) + body[start:]
    pages = np.frombuffer(body, dtype=np.uint8).reshape(-1, PAGE - SUM)
    return np.hstack([pages, _checksums(pages).astype(">u4").view(np.uint8).reshape(-1, SUM)]).tobytes()
