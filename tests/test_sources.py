from __future__ import annotations

import sqlite3
import struct

import numpy as np
import pytest

from pointlake.sources import datasource, e57, packets, parsing, registry, ros

CLOUD = "cloud_id string, pid bigint, x double, y double, z double, r int, g int, b int"


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([("c", i, *map(float, p), i % 256, 1, 2) for i, p in enumerate(rng.uniform(-5, 5, (250, 3)).astype("f4"))], CLOUD)


def places(df):
    return np.array(sorted((r.x, r.y, r.z) for r in df.collect()))


@pytest.mark.parametrize("name,text", [("a.ply", False), ("b.ply", True), ("a.pcd", False), ("b.pcd", True), ("a.bin", False), ("a.obj", False), ("a.e57", False)])
def test_round_trip(spark, cloud, tmp_path, name, text):
    path = str(tmp_path / name)
    registry.write_point_cloud(cloud, path, text=text)
    back = registry.read_point_cloud(spark, path)
    assert np.allclose(places(back), places(cloud), atol=1e-6)
    if name.endswith(("ply", "pcd", "e57")):
        assert back.where("r IS NULL").count() == 0 and back.orderBy("pid").limit(3).toPandas().r.tolist() == [0, 1, 2]


def test_a_file_is_read_in_ranges_and_a_folder_file_by_file(spark, cloud, tmp_path):
    registry.write_point_cloud(cloud.repartition(3), str(tmp_path / "many"), form="pcd", single=False)
    assert registry.read_point_cloud(spark, str(tmp_path / "many")).count() == 250
    registry.write_point_cloud(cloud, str(tmp_path / "one.bin"))
    read = spark.read.format("pointlake").option("path", str(tmp_path / "one.bin")).option("rangerows", 60).load()
    assert read.rdd.getNumPartitions() == 5 and read.select("pid").distinct().count() == 250


@pytest.mark.parametrize("header", [True, False])
@pytest.mark.parametrize("sep", [",", ";", "\t", " "])
def test_text(spark, cloud, tmp_path, sep, header):
    path = str(tmp_path / f"t{ord(sep)}{header}.csv")
    registry.write_xyz(cloud, path, delimiter=sep, header=header)
    assert np.allclose(places(registry.read_point_cloud(spark, path)), places(cloud))


def test_detected_schemas():
    assert parsing.detect_xyz("1, 2, 3") == parsing.XyzSchema(("x", "y", "z"), ",", False)
    assert parsing.detect_xyz("Px;PY;pos_z;Red;label").columns == ("x", "y", "z", "r", "label")
    for bad in ("a,b,c", "12", ""):
        with pytest.raises(ValueError):
            parsing.detect_xyz(bad)


def test_clamped_colours_and_missing_columns(spark, tmp_path):
    (tmp_path / "c.csv").write_text("x,y,z,red\n1,2,3,300\n4,5,oops,-7\n\n")
    rows = registry.read_point_cloud(spark, str(tmp_path / "c.csv")).orderBy("x").collect()
    assert [(r.x, r.z, r.r) for r in rows] == [(1.0, 3.0, 255), (4.0, None, 0)]


def test_sniffing_and_unsupported_formats(spark, tmp_path):
    assert [parsing.sniff(b) for b in (b"ply\n", b"# .PCD v0.7\nVERSION", b"# made by\nv 1 2 3\n", b"LASF", b"ASTM-E57", b"solid x", b"nothing")] == ["ply", "pcd", "obj", "las", "e57", "stl", None]
    (tmp_path / "x.las").write_bytes(b"LASF")
    with pytest.raises(datasource.UnsupportedFormat):
        registry.read_point_cloud(spark, str(tmp_path / "x.las"))
    registry.register_reader(".mine", lambda s, p: s.range(3).selectExpr("id as pid"))
    assert registry.read_point_cloud(spark, "x.mine").count() == 3 and ".mine" in registry.supported_formats()["read"]


def test_broken_files():
    good = parsing.write_ply({c: np.arange(4.0) for c in "xyz"}, form="binary_little_endian")
    for read, data in ((parsing.read_ply, good[:-3]), (parsing.read_ply, b"plx"), (parsing.read_pcd, parsing.write_pcd({"x": np.arange(3.0)})[:-1]), (parsing.read_kitti, b"123"), (parsing.read_stl, b"??"), (parsing.read_obj, "f 1 2 3"), (parsing.read_obj, "v 0 0 0\nf -1 -1 -1"), (packets.read_lvx, b""), (packets.read_lvx2, b"x" * 40), (packets.read_capture, b"")):
        with pytest.raises(ValueError):
            read(data, 2368) if read is packets.read_capture else read(data)
    with pytest.raises(ValueError):
        parsing.read_pcd(parsing.write_pcd({"x": np.arange(3.0)}).replace(b"DATA binary", b"DATA binary_compressed"))


def test_big_endian_and_polygons():
    data = parsing.write_ply({c: np.arange(5.0) for c in "xyz"}, np.array([[0, 1, 2]]), "binary_big_endian")
    assert parsing.read_ply(data)["vertex"]["z"].tolist() == [0, 1, 2, 3, 4]
    assert parsing.fans([[0, 1, 2, 3, 4]]).tolist() == [[0, 1, 2], [0, 2, 3], [0, 3, 4]]


@pytest.mark.parametrize("name,text", [("m.ply", False), ("m.ply", True), ("m.obj", False), ("m.stl", False), ("m.stl", True)])
def test_mesh_round_trip(spark, tmp_path, name, text):
    from pointlake.catalog.surfaces import _boxes

    v, f = _boxes(spark, 0, 2)
    path = str(tmp_path / name)
    registry.write_mesh(v, f, path, text)
    rv, rf = registry.read_mesh(spark, path)
    assert rv.count() == 8 and rf.count() == 12 and np.allclose(places(rv), places(v))


def test_materials():
    text = "newmtl a b\nKd 1 0.5 0\nd 0.25\nmap_Kd pic one.png\nNs 8\n"
    m = parsing.read_mtl(text)
    assert m["a b"] == {"diffuse": [1.0, 0.5, 0.0], "opacity": 0.25, "diffuse_map": "pic one.png", "shininess": 8.0} and parsing.read_mtl(parsing.write_mtl(m)) == m
    o = parsing.read_obj(parsing.write_obj(np.zeros((3, 3)), np.array([[0, 1, 2]]), groups=["g"], materials=["a b"], library="x.mtl"))
    assert o.faces[0][1:] == ("g", "a b") and o.libraries == ["x.mtl"]


def test_quantisation():
    p = np.random.default_rng(1).uniform(-3, 3, (100, 3))
    q, low, step = parsing.quantize(p, 14)
    assert abs(parsing.dequantize(q, low, step) - p).max() <= step / 2 + 1e-12 and q.max() == 2**14 - 1


def udp(payload, port):
    ip = bytes([0x45, 0, 0, 0, 0, 0, 0, 0, 64, 17, 0, 0]) + bytes(8)
    frame = bytes(12) + b"\x08\x00" + ip + struct.pack(">HHHH", 1, port, 8 + len(payload), 0) + payload
    return struct.pack("<IIII", 0, 0, len(frame), len(frame)) + frame


def capture(*packs):
    return b"\xd4\xc3\xb2\xa1" + bytes(20) + b"".join(packs)


def test_velodyne_packets(spark, tmp_path):
    block = struct.pack("<HH", 0xFFEE, 9000) + struct.pack("<HB", 500, 1) + bytes(31 * 3)
    payload = block + bytes(1100) + bytes(4) + bytes([0x37, 0x22])
    (tmp_path / "v.pcap").write_bytes(capture(udp(payload, 2368), udp(payload, 99)))
    rows = registry.read_point_cloud(spark, str(tmp_path / "v.pcap")).collect()
    assert len(rows) == 1 and rows[0].x == pytest.approx(np.cos(np.radians(15))) and rows[0].z == pytest.approx(-np.sin(np.radians(15)))
    with pytest.raises(ValueError):
        packets.read_capture(capture(udp(payload, 99)), 2368)


def test_ouster_packets():
    column = bytes(12) + struct.pack("<I", 0) + struct.pack("<I", 2000 | 1 << 20) + bytes(8) + bytes(63 * 12) + bytes(4)
    p = packets.ouster_points(column * 16)
    assert p.shape == (16, 3) and np.allclose(np.linalg.norm(p, axis=1), 2)
    assert len(packets.ouster_points(b"short")) == 0


def test_frame_files():
    points = struct.pack("<iiiBB", 1000, -2000, 3000, 1, 2) * 2
    package = bytes(10) + bytes([1]) + bytes(10) + struct.pack("<H", len(points)) + bytes(4) + points
    head = b"livox_tech".ljust(20, b"\0") + struct.pack("<I", packets.LVX_MAGIC)
    one = head + struct.pack("<IB", 50, 1) + bytes(59) + struct.pack("<QQQ", 0, 0, 0) + package
    assert packets.read_lvx(one).tolist() == [[1.0, -2.0, 3.0]] * 2
    small = struct.pack("<hhhBB", 100, 200, -300, 1, 2)
    pack2 = bytes(6) + bytes([0]) + struct.pack("<I", len(small)) + small
    two = struct.pack("<IIIQ", packets.LVX2_MAGIC, 0, 28, 0) + bytes(4) + bytes([0]) + bytes(3)
    assert np.allclose(packets.read_lvx2(two + struct.pack("<QQQ", 0, 0, 0) + pack2), [[1.0, 2.0, -3.0]])


def test_messages(spark):
    columns = {c: np.array([1.0, np.nan, 3.0], "f4") for c in "xyz"} | {"r": np.array([255, 1, 2]), "g": np.array([3, 4, 5]), "b": np.array([6, 7, 8])}
    m = ros.decode_cdr(ros.encode_cdr(ros.make_message(columns)))
    got = m.columns(colors=True)
    assert got["x"].tolist() == [1, 3] and got["r"].tolist() == [255, 2] and np.isnan(m.organized()["x"][1])
    rows = [(1, ros.encode_cdr(m)), (2, None), (3, ros.encode_cdr(m)[:60]), (4, b"")]
    out = registry.decode_clouds(spark.createDataFrame(rows, "msg_id bigint, data binary")).collect()
    assert [(r.msg_id, r.pid, r.error is None) for r in sorted(out, key=lambda r: (r.msg_id, r.pid or 0))] == [(1, 0, True), (1, 1, True), (2, None, False), (3, None, False), (4, None, False)]


def test_encoded_clouds_decode_again(spark, cloud):
    back = registry.decode_clouds(registry.encode_clouds(cloud), "cloud_id")
    assert np.allclose(places(back), places(cloud))


def test_bags(spark, tmp_path):
    messages = [("/a", "T", 5, b"1"), ("/b", "U", 7, b"2"), ("/a", "T", 9, b"3")]
    (tmp_path / "x.mcap").write_bytes(ros.write_mcap(messages))
    folder = tmp_path / "bag"
    folder.mkdir()
    with sqlite3.connect(folder / "x.db3") as db:
        db.execute("CREATE TABLE topics(id INTEGER, name TEXT, type TEXT)")
        db.execute("CREATE TABLE messages(id INTEGER, topic_id INTEGER, timestamp INTEGER, data BLOB)")
        db.executemany("INSERT INTO topics VALUES (?, ?, ?)", [(1, "/a", "T"), (2, "/b", "U")])
        db.executemany("INSERT INTO messages VALUES (?, ?, ?, ?)", [(i, 1 if t == "/a" else 2, n, d) for i, (t, _, n, d) in enumerate(messages)])
    for path in (tmp_path / "x.mcap", folder):
        read = lambda **k: [tuple(r)[2] for r in registry.read_bag(spark, str(path), **k).orderBy("ts_ns").collect()]  # noqa: B023, E731
        assert read() == [5, 7, 9] and read(topics=["/a"]) == [5, 9] and read(start=7, end=9) == [7, 9] and read(start=5, end=5) == [5]
        assert registry.bag_topics(registry.read_bag(spark, str(path))).count() == 2
    with pytest.raises(Exception, match="not in the bag"):
        registry.read_bag(spark, str(folder), topics=["/zzz"]).collect()


def test_a_folder_of_text_files_with_schemas_of_their_own(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_text("x,y,z\n1,2,3\n4,5,6\n")
    (folder / "b.xyz").write_text("# made by hand\nz;y;x;label\r\n7;8;9;q\r\n10;11;12;r\r\n13;14\r\n")
    (folder / "c.txt").write_text("1.5   2.5  3.5\n\n 4.5 5.5 6.5")
    (folder / "d.txt").write_text("one word\n")
    (folder / "e.csv").write_text("")
    rows = {(r.cloud_id, r.x, r.y, r.z) for r in registry.read_xyz(spark, str(folder)).collect()}
    assert rows == {("a.csv", 1.0, 2.0, 3.0), ("a.csv", 4.0, 5.0, 6.0), ("b.xyz", 9.0, 8.0, 7.0), ("b.xyz", 12.0, 11.0, 10.0), ("c.txt", 1.5, 2.5, 3.5), ("c.txt", 4.5, 5.5, 6.5)}
    assert {(r.cloud_id, r.line, r.reason) for r in registry.xyz_failures(spark, str(folder)).collect()} == {("b.xyz", "13;14", "columns"), ("d.txt", "one word", "schema")}
    with pytest.raises(ValueError):
        registry.read_xyz(spark, str(folder / "d.txt"))
    with pytest.raises(FileNotFoundError):
        datasource.files_of(str(tmp_path / "none" / "*.csv"))


def test_lines_are_the_same_however_files_are_cut(spark, tmp_path):
    text = "".join(f"{i},{i * 2},{'9' * (i % 7)}1\n" for i in range(300)) + "5,6,7"
    (tmp_path / "l.csv").write_text(text)
    read = lambda width: sorted((r.pid, r.value.rstrip("\n")) for r in spark.read.format("pointlake").option("kind", "lines").option("path", str(tmp_path / "l.csv")).option("rangebytes", width).load().collect())
    starts = [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]
    assert read(1 << 20) == read(7) == read(100) == sorted(zip(starts, text.split("\n")))


def test_a_header_longer_than_the_first_look(tmp_path):
    comment = b"comment " + b"x" * 200_000 + b"\n"
    data = parsing.write_ply({c: np.arange(4.0) for c in "xyz"}, form="binary_little_endian").replace(b"element vertex", comment + b"element vertex")
    (tmp_path / "long.ply").write_bytes(data)
    assert datasource._strided(str(tmp_path / "long.ply"), "ply")[2] == 4


def test_a_large_obj_by_ranges(spark, tmp_path):
    (tmp_path / "m.obj").write_text("# c\nv 0 0 0\nv 1 0 0\nvn 0 0 1\nv 1 1 0\nf 1//1 2//1 3//1\nv 0 1 0\nf 1/1 2/2 3/3 4/4\nf 1 2 9\n")
    v, f = registry.read_obj_lines(spark, str(tmp_path / "m.obj"))
    assert [(r.vid, r.x, r.y) for r in v.orderBy("vid").collect()] == [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 1.0), (3, 0.0, 1.0)]
    assert [(r.fid, r.a, r.b, r.c) for r in f.orderBy("fid").collect()] == [(0, 0, 1, 2), (1, 0, 1, 2), (2, 0, 2, 3)]
    assert registry.can_read(str(tmp_path / "m.obj")) and not registry.can_read(str(tmp_path / "none.ply")) and not registry.can_read("x", "mcap")


def test_e57_of_other_makers(tmp_path):
    assert e57._checksums(np.frombuffer(b"123456789", np.uint8).reshape(1, 9))[0] == 0xE3069283  # the published check value
    # packed whole numbers, the lowest bit first
    values = np.array([0, 5, 9])
    bits = np.array([[v >> i & 1 for i in range(4)] for v in values], np.uint8).ravel()
    stream = np.packbits(bits, bitorder="little").tobytes()
    assert e57._whole(stream, 4, 3).tolist() == [0, 5, 9]
    data = e57.write_e57({"x": np.arange(5000.0), "y": np.zeros(5000), "z": np.ones(5000), "r": np.arange(5000) % 256, "g": np.zeros(5000), "b": np.zeros(5000)})
    back = e57.read_e57(data)
    assert back["x"].tolist() == list(range(5000)) and back["r"].tolist() == [i % 256 for i in range(5000)]
    for broken in (data[:-1], b"x" + data[1:], data[:2000] + b"?" + data[2001:]):
        with pytest.raises(ValueError):
            e57.read_e57(broken)
