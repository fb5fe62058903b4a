"""Sensor recordings: packet captures of two makers of spinning lidars, and two versions of a frame file."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

# Magic numbers (as stored) of packet captures with little- and big-endian headers.
_LITTLE = (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1")
_BIG = (b"\xa1\xb2\xc3\xd4", b"\xa1\xb2\x3c\x4d")

VELODYNE_PORT, OUSTER_PORT = 2368, 7502
# Elevation angles in degrees by laser.
VLP16 = np.array([-15.0, 1.0, -13.0, 3.0, -11.0, 5.0, -9.0, 7.0, -7.0, 9.0, -5.0, 11.0, -3.0, 13.0, -1.0, 15.0])
HDL32E = np.array([-30.67, -9.33, -29.33, -8.00, -28.00, -6.67, -26.67, -5.33, -25.33, -4.00, -24.00, -2.67, -22.67, -1.33, -21.33, 0.00, -20.00, 1.33, -18.67, 2.67, -17.33, 4.00, -16.00, 5.33, -14.67, 6.67, -13.33, 8.00, -12.00, 9.33, -10.67, 10.67])
OS1_64 = np.array([16.611, 16.084, 15.557, 15.029, 14.502, 13.975, 13.447, 12.920, 12.393, 11.865, 11.338, 10.811, 10.283, 9.756, 9.229, 8.701, 8.174, 7.647, 7.119, 6.592, 6.065, 5.537, 5.010, 4.483, 3.955, 3.428, 2.901, 2.373, 1.846, 1.319, 0.791, 0.264, -0.264, -0.791, -1.319, -1.846, -2.373, -2.901, -3.428, -3.955, -4.483, -5.010, -5.537, -6.065, -6.592, -7.119, -7.647, -8.174, -8.701, -9.229, -9.756, -10.283, -10.811, -11.338, -11.865, -12.393, -12.920, -13.447, -13.975, -14.502, -15.029, -15.557, -16.084, -16.611])
OS_128 = 22.5 - np.arange(128) / 127 * 45
# Layout of the frame files.
LVX_MAGIC, LVX2_MAGIC = 0xAC0EA767, 0x20200903


def udp_payloads(data: bytes, port: int) -> Iterator[bytes]:
    """Payloads of UDP packets to a port in a capture of Ethernet frames, with or without a VLAN tag."""
    if len(data) < 24 or data[:4] not in (*_LITTLE, *_BIG):
        raise ValueError("no packet capture")
    order = "<" if data[:4] in _LITTLE else ">"
    at = 24
    while at + 16 <= len(data):
        (size,) = struct.unpack_from(order + "I", data, at + 8)
        at += 16
        if at + size > len(data):
            return
        packet = data[at : at + size]
        at += size
        if len(packet) < 42:
            continue
        start = 12
        kind = int.from_bytes(packet[start : start + 2], "big")
        if kind == 0x8100:
            start += 4
            kind = int.from_bytes(packet[start : start + 2], "big")
        ip = start + 2
        if kind != 0x0800 or len(packet) < ip + 20 or packet[ip + 9] != 17:
            continue
        udp = ip + (packet[ip] & 15) * 4
        if len(packet) >= udp + 8 and int.from_bytes(packet[udp + 2 : udp + 4], "big") == port and len(packet) > udp + 8:
            yield packet[udp + 8 :]


_VELODYNE_BLOCK = np.dtype([("flag", "<u2"), ("azimuth", "<u2"), ("returns", [("distance", "<u2"), ("intensity", "u1")], 32)])


def velodyne_points(payload: bytes) -> np.ndarray:
    """x, y, z of a data packet of twelve blocks; the model is told by its last byte. Short packets have none."""
    if len(payload) < 1206:
        return np.empty((0, 3))
    blocks = np.frombuffer(payload, _VELODYNE_BLOCK, 12)
    good = blocks["flag"] == 0xFFEE
    azimuth = blocks["azimuth"] / 100.0
    half = np.ones(12)
    follows = good[1:] & good[:-1]
    half[:-1] = np.where(follows, (azimuth[1:] - azimuth[:-1]) % 360 / 2, 1.0)
    laser = np.arange(32)
    model = payload[1205]
    turned = np.repeat(azimuth[:, None], 32, axis=1)
    if model == 0x22:
        elevation = VLP16[laser % 16]
        turned = (turned + np.where(laser >= 16, half[:, None], 0)) % 360
    elif model == 0x28:
        elevation = HDL32E
    else:
        elevation = -15 + laser / 31 * 30
    distance = blocks["returns"]["distance"] * 0.002
    keep = good[:, None] & (distance > 0)
    el, az = np.radians(np.broadcast_to(elevation, (12, 32))), np.radians(turned)
    xyz = np.stack([distance * np.cos(el) * np.sin(az), distance * np.cos(el) * np.cos(az), distance * np.sin(el)], -1)
    return xyz[keep]


def ouster_points(payload: bytes, altitudes: np.ndarray = OS1_64, columns: int = 16) -> np.ndarray:
    """x, y, z of a data packet of columns of pixels with 20-bit ranges in millimetres."""
    pixels = len(altitudes)
    kind = np.dtype([("head", "u1", 12), ("encoder", "<u4"), ("pixel", [("range", "<u4"), ("rest", "u1", 8)], pixels), ("status", "<u4")])
    if len(payload) < kind.itemsize * columns:
        return np.empty((0, 3))
    rows = np.frombuffer(payload, kind, columns)
    azimuth = rows["encoder"][:, None] / 90112.0 * 2 * np.pi
    r = (rows["pixel"]["range"] & 0xFFFFF) / 1000.0
    alt = np.radians(altitudes)[None, :]
    xyz = np.stack([r * np.cos(alt) * np.cos(azimuth), r * np.cos(alt) * np.sin(azimuth), r * np.sin(alt) + 0 * azimuth], -1)
    return xyz[r > 0]


def _spherical(rows: np.ndarray) -> np.ndarray:
    r, theta, phi = rows["depth"] / 1000.0, np.radians(rows["theta"] * 0.01), np.radians(rows["phi"] * 0.01)
    return np.stack([r * np.sin(theta) * np.cos(phi), r * np.sin(theta) * np.sin(phi), r * np.cos(theta)], -1)


_TAIL = [("reflectivity", "u1"), ("tag", "u1")]
_BALL = np.dtype([("depth", "<u4"), ("theta", "<u2"), ("phi", "<u2"), *_TAIL])
_MILLI = np.dtype([("p", "<i4", 3), *_TAIL])
_METRE = np.dtype([("p", "<f4", 3), *_TAIL])
_CENTI = np.dtype([("p", "<i2", 3), *_TAIL])
_CUBE = lambda scale: lambda rows: rows["p"] * scale
#: Point layouts by data type, for each version of the file.
LVX_TYPES = {1: (_MILLI, _CUBE(0.001)), 2: (_BALL, _spherical), 3: (_METRE, _CUBE(1.0))}
LVX2_TYPES = {0: (_CENTI, _CUBE(0.01)), 1: (_MILLI, _CUBE(0.001)), 2: (_BALL, _spherical)}


def _frames(data: bytes, start: int, head: int, type_at: int, length_at: int, length: str, kinds: dict) -> Iterator[np.ndarray]:
    at = start
    while at + 24 <= len(data):
        (offset,) = struct.unpack_from("<Q", data, at + 8)
        end = len(data) if offset == 0 else min(start + offset, len(data))
        package = at + 24
        while package + head <= end:
            (size,) = struct.unpack_from(length, data, package + length_at)
            body = package + head
            if body + size > len(data):
                break
            if data[package + type_at] in kinds:
                kind, place = kinds[data[package + type_at]]
                yield place(np.frombuffer(data, kind, size // kind.itemsize, body)).astype(float)
            package = body + size
        if offset == 0 or start + offset <= at:
            return
        at = start + offset


def read_lvx(data: bytes) -> np.ndarray:
    """x, y, z of all frames of a version 1 file."""
    if len(data) < 29 or not data.startswith(b"livox_tech") or struct.unpack_from("<I", data, 20)[0] != LVX_MAGIC:
        raise ValueError("no LVX file")
    start = 29 + data[28] * 59
    if start > len(data):
        raise ValueError("the LVX file is too short")
    return np.concatenate([np.empty((0, 3)), *_frames(data, start, 27, 10, 21, "<H", LVX_TYPES)])


def read_lvx2(data: bytes) -> np.ndarray:
    """x, y, z of all frames of a version 2 file."""
    if len(data) < 28 or struct.unpack_from("<I", data, 0)[0] != LVX2_MAGIC:
        raise ValueError("no LVX2 file")
    start = struct.unpack_from("<I", data, 8)[0] + data[24] * 41
    if start > len(data):
        raise ValueError("the LVX2 file is too short")
    return np.concatenate([np.empty((0, 3)), *_frames(data, start, 11, 6, 7, "<I", LVX2_TYPES)])


def read_capture(data: bytes, port: int) -> np.ndarray:
    """x, y, z of all data packets to a port; none at all is an error."""
    decode = velodyne_points if port == VELODYNE_PORT else ouster_points
    payloads = list(udp_payloads(data, port))
    if not payloads:
        raise ValueError(f"no packets to port {port}")
    return np.concatenate([decode(p) for p in payloads])
