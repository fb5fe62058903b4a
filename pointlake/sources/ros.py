"""Robot recordings: point cloud messages, their CDR form, and two kinds of bags."""

from __future__ import annotations

import sqlite3
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np

# Numpy kinds of point field datatypes 1 to 8.
FIELD_KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}
_DATATYPE = {v: k for k, v in FIELD_KINDS.items()}


@dataclass
class CloudMessage:
    """A point cloud message: its layout and its bytes."""

    fields: list[tuple[str, int, int, int]]  # name, offset, datatype, count
    point_step: int
    row_step: int
    width: int
    height: int
    big: bool
    dense: bool
    data: bytes

    def field(self, name: str) -> np.ndarray:
        """Values (height, width) of a field, float64."""
        found = next((f for f in self.fields if f[0] == name), None)
        if found is None:
            raise ValueError(f"no field {name}")
        if found[2] not in FIELD_KINDS:
            raise ValueError(f"unknown datatype {found[2]}")
        return self._view(found[1], (">" if self.big else "<") + FIELD_KINDS[found[2]]).astype(float)

    def _view(self, offset: int, kind: str) -> np.ndarray:
        if len(self.data) < self.height * self.row_step:
            raise ValueError(f"{self.height * self.row_step} bytes needed, {len(self.data)} there")
        size = np.dtype(kind).itemsize
        if self.width and self.height and (offset + size > self.point_step or self.point_step * self.width > self.row_step):
            raise ValueError("the layout does not fit the steps")
        return np.ndarray((self.height, self.width), kind, self.data, offset, (self.row_step, self.point_step)) if self.width * self.height else np.empty((self.height, self.width), kind)

    def packed_rgb(self) -> np.ndarray:
        """Colours (height, width, 3) of the field rgb or rgba, whose four bytes are read as they are."""
        found = next((f for f in self.fields if f[0] in ("rgb", "rgba")), None)
        if found is None or found[2] not in (6, 7):
            raise ValueError("no packed colour field")
        raw = self._view(found[1], (">" if self.big else "<") + "u4")
        return np.stack([raw >> 16 & 255, raw >> 8 & 255, raw & 255], -1).astype(np.int16)

    def columns(self, normals: bool = False, colors: bool = False) -> dict[str, np.ndarray]:
        """Flat columns x, y, z (and nx, ny, nz; r, g, b); rows with NaN places go unless the message is dense."""
        out = {c: self.field(c).ravel() for c in "xyz"}
        if normals:
            out |= {f"n{c}": self.field(f"normal_{c}").ravel() for c in "xyz"}
        if colors:
            rgb = self.packed_rgb().reshape(-1, 3)
            out |= {c: rgb[:, i] for i, c in enumerate("rgb")}
        if not self.dense:
            keep = ~np.isnan(np.stack([out[c] for c in "xyz"])).any(axis=0)
            out = {k: v[keep] for k, v in out.items()}
        return out

    def organized(self) -> dict[str, np.ndarray]:
        """row, col and x, y, z with NaN where a place is not finite."""
        p = np.stack([self.field(c) for c in "xyz"], -1)
        p[~np.isfinite(p).all(axis=-1)] = np.nan
        row, col = np.indices((self.height, self.width))
        return {"row": row.ravel(), "col": col.ravel(), **{c: p[..., i].ravel() for i, c in enumerate("xyz")}}


def make_message(columns: dict[str, np.ndarray], width: int | None = None) -> CloudMessage:
    """A little-endian message of 32-bit floats x, y, z (and normals), colours packed into rgb."""
    n = len(columns["x"])
    names = ["x", "y", "z", *(f"n{c}" for c in "xyz" if f"n{c}" in columns)]
    kind = [(c, "<f4") for c in names] + ([("rgb", "<u4")] if "r" in columns else [])
    rows = np.zeros(n, kind)
    for c in names:
        rows[c] = columns[c]
    if "r" in columns:
        rows["rgb"] = columns["r"].astype(np.uint32) << 16 | columns["g"].astype(np.uint32) << 8 | columns["b"].astype(np.uint32)
    said = {"nx": "normal_x", "ny": "normal_y", "nz": "normal_z"}
    fields = [(said.get(c, c), rows.dtype.fields[c][1], 7, 1) for c in rows.dtype.names]
    width = n if width is None else width
    height = 1 if width == n else n // max(1, width)
    dense = bool(np.isfinite(np.stack([rows[c] for c in "xyz"])).all()) if n else True
    return CloudMessage(fields, rows.dtype.itemsize, rows.dtype.itemsize * width, width, height, False, dense, rows.tobytes())


class _Cdr:
    """Reads aligned values after the four bytes that tell the byte order."""

    def __init__(self, payload: bytes) -> None:
        if len(payload) < 4 or payload[1] not in (0, 1):
            raise ValueError("no CDR payload")
        self.order, self.body, self.at = "<" if payload[1] else ">", payload[4:], 0

    def take(self, kind: str) -> int:
        size = struct.calcsize(kind)
        self.at += -self.at % size
        if self.at + size > len(self.body):
            raise ValueError("the payload is too short")
        (value,) = struct.unpack_from(self.order + kind, self.body, self.at)
        self.at += size
        return value

    def bytes(self, n: int) -> bytes:
        if self.at + n > len(self.body):
            raise ValueError("the payload is too short")
        self.at += n
        return self.body[self.at - n : self.at]

    def text(self) -> str:
        n = self.take("I")
        return self.bytes(n).rstrip(b"\0").decode("utf-8", "replace")


def decode_cdr(payload: bytes) -> CloudMessage:
    """A point cloud message from its CDR form."""
    r = _Cdr(payload)
    r.take("i"), r.take("I"), r.text()
    height, width = r.take("I"), r.take("I")
    fields = []
    for _ in range(r.take("I")):
        name = r.text()
        fields.append((name, r.take("I"), r.take("B"), r.take("I")))
    big, point_step, row_step = bool(r.take("B")), r.take("I"), r.take("I")
    data = r.bytes(r.take("I"))
    return CloudMessage(fields, point_step, row_step, width, height, big, bool(r.take("B")), data)


def encode_cdr(message: CloudMessage, sec: int = 0, nanosec: int = 0, frame: str = "map") -> bytes:
    """The CDR form of a message, little-endian."""
    out = bytearray()

    def put(kind: str, value: int) -> None:
        out.extend(b"\0" * (-len(out) % struct.calcsize(kind)))
        out.extend(struct.pack("<" + kind, value))

    def text(value: str) -> None:
        raw = value.encode() + b"\0"
        put("I", len(raw))
        out.extend(raw)

    put("i", sec), put("I", nanosec), text(frame)
    put("I", message.height), put("I", message.width), put("I", len(message.fields))
    for name, offset, datatype, count in message.fields:
        text(name), put("I", offset), put("B", datatype), put("I", count)
    put("B", message.big), put("I", message.point_step), put("I", message.row_step), put("I", len(message.data))
    out.extend(message.data)
    put("B", message.dense)
    return b"\0\1\0\0" + bytes(out)


# -- bags -----------------------------------------------------------------------------------------------------------------

Message = tuple[str, str, int, bytes]  # topic, type, nanoseconds, data
_MCAP = b"\x89MCAP0\r\n"


def _records(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 9 <= len(data):
        op, size = data[at], struct.unpack_from("<Q", data, at + 1)[0]
        if at + 9 + size > len(data):
            raise ValueError("the MCAP file is too short")
        yield op, data[at + 9 : at + 9 + size]
        at += 9 + size


def _string(data: bytes, at: int) -> tuple[str, int]:
    (n,) = struct.unpack_from("<I", data, at)
    return data[at + 4 : at + 4 + n].decode("utf-8", "replace"), at + 4 + n


def mcap_messages(data: bytes, topics: set[str] | None = None, start: int | None = None, end: int | None = None) -> Iterator[Message]:
    """Messages of an MCAP file, by topic and (inclusive) log time; chunks plain or compressed by zstd."""
    if not data.startswith(_MCAP):
        raise ValueError("no MCAP file")
    schemas: dict[int, str] = {}
    channels: dict[int, tuple[str, str]] = {}

    def walk(part: bytes) -> Iterator[Message]:
        for op, body in _records(part):
            if op == 3:
                schemas[struct.unpack_from("<H", body)[0]] = _string(body, 2)[0]
            elif op == 4:
                number, schema = struct.unpack_from("<HH", body)
                channels[number] = (_string(body, 4)[0], schemas.get(schema, ""))
            elif op == 5:
                number, _, logged, _ = struct.unpack_from("<HIQQ", body)
                topic, kind = channels.get(number, ("", ""))
                if (topics is None or topic in topics) and (start is None or logged >= start) and (end is None or logged <= end):
                    yield topic, kind, logged, body[22:]
            elif op == 6:
                low, high, size, _ = struct.unpack_from("<QQQI", body)
                method, at = _string(body, 28)
                if (start is not None and high < start) or (end is not None and low > end):
                    continue  # the chunk's own index rules it out
                (held,) = struct.unpack_from("<Q", body, at)
                raw = body[at + 8 : at + 8 + held]
                if method == "zstd":
                    import zstandard

                    raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=size)
                elif method:
                    raise ValueError(f"compression {method} is not supported")
                yield from walk(raw)
            elif op == 0x0F:
                return

    body = data[len(_MCAP) :]
    yield from walk(body[: -len(_MCAP)] if body.endswith(_MCAP) else body)


def write_mcap(messages: list[Message], chunk: bool = True) -> bytes:
    """An MCAP file of messages, in one uncompressed chunk or none."""
    record = lambda op, body: struct.pack("<BQ", op, len(body)) + body
    string = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
    inner, kinds, channels = b"", {}, {}
    for n, (topic, kind, time, payload) in enumerate(messages):
        if kind not in kinds:
            kinds[kind] = len(kinds) + 1
            inner += record(3, struct.pack("<H", kinds[kind]) + string(kind) + string("ros2msg") + struct.pack("<I", 0))
        if (topic, kind) not in channels:
            channels[topic, kind] = len(channels)
            inner += record(4, struct.pack("<HH", channels[topic, kind], kinds[kind]) + string(topic) + string("cdr") + struct.pack("<I", 0))
        inner += record(5, struct.pack("<HIQQ", channels[topic, kind], n, time, time) + payload)
    if chunk:
        times = [m[2] for m in messages] or [0]
        inner = record(6, struct.pack("<QQQI", min(times), max(times), len(inner), zlib.crc32(inner)) + string("") + struct.pack("<Q", len(inner)) + inner)
    return _MCAP + record(1, string("") + string("pointlake")) + inner + record(0x0F, struct.pack("<I", 0)) + record(2, struct.pack("<QQI", 0, 0, 0)) + _MCAP


def bag_file(path: str) -> Path:
    """The database of a bag given as a file or a folder."""
    p = Path(path)
    if p.is_dir():
        found = sorted(f for f in p.iterdir() if f.suffix.lower() == ".db3")
        if not found:
            raise ValueError(f"no .db3 file in {path}")
        return found[0]
    return p


def sqlite_topics(path: str) -> list[tuple[str, str]]:
    """Topics and their types."""
    with sqlite3.connect(f"file:{bag_file(path)}?mode=ro", uri=True) as db:
        return db.execute("SELECT name, type FROM topics ORDER BY id").fetchall()


def sqlite_messages(path: str, topics: set[str] | None = None, start: int | None = None, end: int | None = None, data: bytes | None = None) -> Iterator[Message]:
    """Messages by topic and (inclusive) time, in order of time; an unknown topic is an error.

    ``data`` is the content of a file that does not lie on a local disk.
    """
    with sqlite3.connect(":memory:") if data is not None else sqlite3.connect(f"file:{bag_file(path)}?mode=ro", uri=True) as db:
        if data is not None:
            db.deserialize(data)
        known = {r[0] for r in db.execute("SELECT name FROM topics")}
        if topics is not None and topics - known:
            raise ValueError(f"topic not in the bag: {', '.join(sorted(topics - known))}")
        where, values = ["TRUE"], []
        if topics is not None:
            where.append(f"t.name IN ({','.join('?' * len(topics))})")
            values += sorted(topics)
        for limit, sign in ((start, ">="), (end, "<=")):
            if limit is not None:
                where.append(f"m.timestamp {sign} ?")
                values.append(limit)
        yield from db.execute(f"SELECT t.name, t.type, m.timestamp, m.data FROM messages m JOIN topics t ON m.topic_id = t.id WHERE {' AND '.join(where)} ORDER BY m.timestamp", values)
