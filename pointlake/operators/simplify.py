"""Simplification by edge collapses, progressive meshes and solid booleans: sequential per mesh, parallel over meshes.

Costs of all edges are DataFrames (:func:`collapse_costs`); the greedy order is sequential, so a mesh is one task. For one mesh
that does not fit use the clustering simplifier, which is distributed throughout.
"""

from __future__ import annotations

import heapq
import json
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.functions.geometry import XYZ
from pointlake.operators import mesh as M
from pointlake.plans import scratch

KEY = M.KEY
_SPLIT = "mesh_id string, seq int, kept bigint, gone bigint, kept_place array<double>, gone_place array<double>, removed array<array<bigint>>, moved array<array<bigint>>"


def collapse_costs(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """``(mesh_id, u, v, x, y, z, cost)``: for each edge (u < v) the place of least quadric error and that error.

    The midpoint where the summed quadric has no inverse. All edges at once, as joins and expressions.
    """
    q = M.vertex_quadrics(vertices, faces)
    ends = M.edges(faces).select(KEY, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    side = lambda n: q.select(KEY, F.col("vid").alias(n), *(F.col(c).alias(f"{n}{c}") for c in M.QUADRIC))
    place = lambda n: vertices.select(KEY, F.col("vid").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in XYZ))
    e = ends.join(side("u"), [KEY, "u"]).join(side("v"), [KEY, "v"]).join(place("u"), [KEY, "u"]).join(place("v"), [KEY, "v"])
    e = e.select(KEY, "u", "v", F.xxhash64("u", "v").alias("cluster"), *((F.col(f"u{c}") + F.col(f"v{c}")).alias(c) for c in M.QUADRIC), *(((F.col(f"u_{c}") + F.col(f"v_{c}")) / 2).alias(f"h_{c}") for c in XYZ))
    best = M._least_error(e.withColumn(KEY, F.struct(KEY, "u", "v"))).select(F.col(f"{KEY}.*"), *(f"o_{c}" for c in XYZ))
    e = e.join(best, [KEY, "u", "v"]).withColumns({c: F.coalesce(f"o_{c}", f"h_{c}") for c in XYZ})
    at = {"a": F.col("x"), "b": F.col("y"), "c": F.col("z"), "d": F.lit(1.0)}
    cost = sum((F.col(n) * at[n[1]] * at[n[2]] * (1 if n[1] == n[2] else 2) for n in M.QUADRIC), F.lit(0.0))
    return e.select(KEY, "u", "v", *XYZ, cost.alias("cost"))


class Collapser:
    """A mesh under edge collapses, in order of quadric error; every collapse can be recorded as a split."""

    def __init__(self, vid: np.ndarray, points: np.ndarray, faces: np.ndarray, preserve_boundary: bool, boundary_weight: float | None = None, link: bool = False, max_edge: float | None = None) -> None:
        number = {v: i for i, v in enumerate(vid.tolist())}
        self.vid, self.points, self.link, self.max_edge = vid, points.astype(float).copy(), link, max_edge
        self.faces = {i: [number[x] for x in f] for i, f in enumerate(faces.tolist()) if len({*f}) == 3}
        self.at: list[set[int]] = [set() for _ in vid]
        for i, f in self.faces.items():
            for v in f:
                self.at[v].add(i)
        self.quadric = np.zeros((len(vid), 4, 4))
        count: dict[tuple[int, int], list[int]] = {}
        for i, f in self.faces.items():
            n = np.cross(self.points[f[1]] - self.points[f[0]], self.points[f[2]] - self.points[f[0]])
            length = np.linalg.norm(n)
            p = np.array([0, 0, 1.0, 0]) if length < 1e-300 else np.append(n / length, -n @ self.points[f[0]] / length)
            for v in f:
                self.quadric[v] += np.outer(p, p)
            for a, b in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0])):
                count.setdefault((min(a, b), max(a, b)), []).append(i)
        rim = [(e, fs[0]) for e, fs in count.items() if len(fs) == 1]
        self.fixed = {v for e, _ in rim for v in e} if preserve_boundary and boundary_weight is None else set()
        if preserve_boundary and boundary_weight is not None:
            for (a, b), i in rim:  # a plane through the edge, upright on its face
                f = self.points[self.faces[i]]
                n = np.cross(np.cross(f[1] - f[0], f[2] - f[0]), self.points[b] - self.points[a])
                length = np.linalg.norm(n)
                if length > 0:
                    p = np.append(n / length, -n @ self.points[a] / length)
                    for v in (a, b):
                        self.quadric[v] += boundary_weight * np.outer(p, p)
        self.stamp = np.zeros(len(vid), dtype=int)
        self.heap: list[tuple] = []
        for a, b in count:
            self._offer(a, b)

    def around(self, v: int) -> set[int]:
        return {w for i in self.at[v] for w in self.faces[i]} - {v}

    def _offer(self, a: int, b: int) -> None:
        if a in self.fixed or b in self.fixed:
            return
        if self.max_edge is not None and np.linalg.norm(self.points[a] - self.points[b]) > self.max_edge:
            return
        q = self.quadric[a] + self.quadric[b]
        try:
            place = np.linalg.solve(q[:3, :3], -q[:3, 3]) if abs(np.linalg.det(q[:3, :3])) > 1e-12 else (self.points[a] + self.points[b]) / 2
        except np.linalg.LinAlgError:
            place = (self.points[a] + self.points[b]) / 2
        h = np.append(place, 1.0)
        a, b = min(a, b), max(a, b)
        heapq.heappush(self.heap, (float(h @ q @ h), int(self.vid[a]), int(self.vid[b]), a, b, int(self.stamp[a]), int(self.stamp[b]), tuple(place)))

    def _allowed(self, a: int, b: int, place: np.ndarray) -> bool:
        shared = self.at[a] & self.at[b]
        if not shared:
            return False
        if self.link and len(self.around(a) & self.around(b)) != len(shared):
            return False
        for v, other in ((a, b), (b, a)):
            for i in self.at[v] - shared:
                old = self.points[self.faces[i]]
                new = np.array([place if w == v else self.points[w] for w in self.faces[i]])
                if np.cross(old[1] - old[0], old[2] - old[0]) @ np.cross(new[1] - new[0], new[2] - new[0]) < 0:
                    return False  # the face would turn over
                if other in self.faces[i]:
                    return False
        return True

    def step(self, limit: float | None = None) -> dict | None:
        """The next collapse, None when there is none (within the error limit)."""
        while self.heap:
            cost, _, _, a, b, sa, sb, place = heapq.heappop(self.heap)
            if sa != self.stamp[a] or sb != self.stamp[b]:
                continue
            if limit is not None and cost > limit:
                return None
            place = np.array(place)
            if not self._allowed(a, b, place):
                continue
            shared = sorted(self.at[a] & self.at[b])
            split = {"kept": a, "gone": b, "kept_place": self.points[a].tolist(), "gone_place": self.points[b].tolist(), "removed": [[i, *self.faces[i]] for i in shared], "moved": []}
            for i in shared:
                for v in self.faces.pop(i):
                    self.at[v].discard(i)
            for i in sorted(self.at[b]):
                split["moved"].append([i, self.faces[i].index(b)])
                self.faces[i][self.faces[i].index(b)] = a
                self.at[a].add(i)
            self.at[b] = set()
            self.points[a] = place
            self.quadric[a] += self.quadric[b]
            self.stamp[a] += 1
            self.stamp[b] = -1
            for v in self.around(a):
                self._offer(a, v)
            return split
        return None

    def run(self, target: int, limit: float | None = None) -> list[dict]:
        """Collapse until at most ``target`` faces are left."""
        splits = []
        while len(self.faces) > target and (split := self.step(limit)) is not None:
            splits.append(split)
        return splits


def _as_rows(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Both tables in one, so that a mesh's rows meet in one group."""
    # no nulls: pandas would turn whole numbers with nulls into floats and lose their last digits
    v = vertices.select(KEY, F.col("vid").alias("id"), F.lit(True).alias("is_vertex"), *XYZ, *(F.lit(-1).cast("bigint").alias(c) for c in "abc"))
    f = faces.select(KEY, F.col("fid").alias("id"), F.lit(False).alias("is_vertex"), *(F.lit(0.0).alias(c) for c in XYZ), *"abc")
    return v.unionByName(f)


def _arrays(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    v = group[group.is_vertex].drop_duplicates("id").sort_values("id")
    f = group[~group.is_vertex].drop_duplicates("id").sort_values("id")
    inside = f[["a", "b", "c"]].isin(v.id.to_numpy()).all(axis=1)
    f = f[inside]
    return v.id.to_numpy(), v[list(XYZ)].to_numpy(), f.id.to_numpy(), f[["a", "b", "c"]].to_numpy().astype(np.int64)


def _simplified(vertices: DataFrame, faces: DataFrame, ratio: float, **options) -> tuple[DataFrame, DataFrame]:
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must be between 0 and 1")
    limit = options.pop("limit", None)

    def shrink(group: pd.DataFrame) -> pd.DataFrame:
        vid, points, fid, f = _arrays(group)
        c = Collapser(vid, points, f, **options)
        c.run(int(round(len(c.faces) * (1 - ratio))), limit)
        live = sorted({v for t in c.faces.values() for v in t})
        v = pd.DataFrame({"id": vid[live], "is_vertex": True, **{n: c.points[live, i] for i, n in enumerate(XYZ)}, **dict.fromkeys("abc", -1)})
        t = np.array([c.faces[i] for i in sorted(c.faces)], dtype=int).reshape(-1, 3)
        out = pd.concat([v, pd.DataFrame({"id": fid[sorted(c.faces)], "is_vertex": False, **dict.fromkeys(XYZ, 0.0), **{n: vid[t[:, i]] for i, n in enumerate("abc")}})], ignore_index=True)
        out.insert(0, KEY, group[KEY].iloc[0])
        return out

    done = scratch.written(_as_rows(vertices, faces).groupBy(KEY).applyInPandas(shrink, "mesh_id string, id bigint, is_vertex boolean, x double, y double, z double, a bigint, b bigint, c bigint"), "simplified")
    return done.where("is_vertex").select(KEY, F.col("id").alias("vid"), *XYZ), done.where("NOT is_vertex").select(KEY, F.col("id").alias("fid"), *"abc")


def simplify_quadric(vertices: DataFrame, faces: DataFrame, ratio: float = 0.5, preserve_boundary: bool = True, max_edge: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces after collapsing the cheapest edges until ``ratio`` of the faces is gone; boundary vertices stay."""
    return _simplified(vertices, faces, ratio, preserve_boundary=preserve_boundary, max_edge=max_edge)


def simplify_edge_collapse(vertices: DataFrame, faces: DataFrame, ratio: float = 0.5, preserve_boundary: bool = True, boundary_weight: float = 100.0, error_threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The same with the link condition, boundaries held by weighted planes, and an optional limit of the error."""
    return _simplified(vertices, faces, ratio, preserve_boundary=preserve_boundary, boundary_weight=boundary_weight, link=True, limit=error_threshold)


def progressive_splits(vertices: DataFrame, faces: DataFrame, base_ratio: float = 0.1) -> DataFrame:
    """The collapses from the mesh down to ``base_ratio`` of its faces, one row each, in order of ``seq``.

    A row undoes itself: it holds the two vertices and their places, the faces that went (with an id), and those that changed.
    """
    if not 0 < base_ratio <= 1:
        raise ValueError("base_ratio must be above 0 and at most 1")

    def record(group: pd.DataFrame) -> pd.DataFrame:
        vid, points, fid, f = _arrays(group)
        c = Collapser(vid, points, f, preserve_boundary=True, boundary_weight=100.0, link=True)
        rows = c.run(max(1, int(round(len(c.faces) * base_ratio))))
        name = lambda s: {**s, "kept": int(vid[s["kept"]]), "gone": int(vid[s["gone"]]), "removed": [[int(fid[r[0]]), *(int(vid[v]) for v in r[1:])] for r in s["removed"]], "moved": [[int(fid[i]), at] for i, at in s["moved"]]}
        out = pd.DataFrame([{KEY: group[KEY].iloc[0], "seq": i, **name(s)} for i, s in enumerate(rows)], columns=[KEY, "seq", "kept", "gone", "kept_place", "gone_place", "removed", "moved"])
        return out

    return _as_rows(vertices, faces).groupBy(KEY).applyInPandas(record, _SPLIT)


class ProgressiveMesh:
    """One mesh at any level of detail: the base and the splits that lead back to the full mesh."""

    def __init__(self, points: dict[int, list[float]], faces: dict[int, list[int]], splits: list[dict]) -> None:
        self.points, self.faces, self.splits = points, faces, splits

    @classmethod
    def of(cls, vertices: DataFrame, faces: DataFrame, base_ratio: float = 0.1) -> ProgressiveMesh:
        """Of a single mesh; its rows come to the driver, which holds what a viewer would."""
        splits = [r.asDict() for r in progressive_splits(vertices, faces, base_ratio).orderBy("seq").collect()]
        points = {r.vid: [r.x, r.y, r.z] for r in vertices.select("vid", *XYZ).collect()}
        shape = {r.fid: [r.a, r.b, r.c] for r in faces.select("fid", *"abc").collect()}
        for s in splits:  # down to the base by the recorded steps
            for r in s["removed"]:
                shape.pop(r[0])
            for i, at in s["moved"]:
                shape[i][at] = s["kept"]
        ids = np.array(sorted(points))
        full = np.array([[r.a, r.b, r.c] for r in faces.orderBy("fid").select(*"abc").collect()]).reshape(-1, 3)
        c = Collapser(ids, np.array([points[i] for i in ids.tolist()]), full, preserve_boundary=True, boundary_weight=100.0, link=True)
        c.run(max(1, int(round(len(c.faces) * base_ratio))))
        place = dict(zip(ids.tolist(), c.points.tolist()))
        live = {v for f in shape.values() for v in f}
        return cls({v: place[v] for v in live}, shape, splits)

    @property
    def levels(self) -> int:
        return len(self.splits)

    def at_level(self, level: int) -> tuple[dict[int, list[float]], dict[int, list[int]]]:
        """Points and faces after ``level`` splits of the base; at the last level the full mesh."""
        points, faces = dict(self.points), {i: list(f) for i, f in self.faces.items()}
        for s in reversed(self.splits[len(self.splits) - min(max(level, 0), len(self.splits)) :]):
            points[s["kept"]], points[s["gone"]] = list(s["kept_place"]), list(s["gone_place"])
            for i, at in s["moved"]:
                faces[i][at] = s["gone"]
            for i, *f in s["removed"]:
                faces[i] = list(f)
        return points, faces

    def at_ratio(self, ratio: float) -> tuple[dict[int, list[float]], dict[int, list[int]]]:
        """The level nearest to a share of detail from 0 (base) to 1 (full)."""
        return self.at_level(round(min(max(ratio, 0.0), 1.0) * len(self.splits)))

    def detail_chain(self, count: int) -> list[tuple[dict[int, list[float]], dict[int, list[int]]]]:
        """``count`` meshes from full to base."""
        if count < 1:
            raise ValueError("count must be positive")
        return [self.at_ratio(1 - n / max(1, count - 1)) for n in range(count)]

    def to_bytes(self) -> bytes:
        return zlib.compress(json.dumps({"points": list(self.points.items()), "faces": list(self.faces.items()), "splits": self.splits}).encode())

    @classmethod
    def from_bytes(cls, data: bytes) -> ProgressiveMesh:
        d = json.loads(zlib.decompress(data))
        return cls(dict((k, v) for k, v in d["points"]), dict((k, v) for k, v in d["faces"]), d["splits"])


# -- booleans -------------------------------------------------------------------------------------------------------------

EPSILON = 1e-5


class _Node:
    """A plane of a binary space partition with what lies in it, before it and behind it. Built and used without recursion."""

    def __init__(self, polygons: list[tuple[np.ndarray, np.ndarray, float]]) -> None:
        self.normal, self.offset = polygons[0][1], polygons[0][2]
        self.own: list = []
        self.front: _Node | None = None
        self.back: _Node | None = None


def _cut(polygon: tuple, normal: np.ndarray, offset: float) -> tuple[list, list, list, list]:
    """Parts of a polygon in the plane facing with it, against it, before it and behind it."""
    points, n, w = polygon
    side = points @ normal - offset
    kind = np.where(side < -EPSILON, 2, np.where(side > EPSILON, 1, 0))
    if not kind.any():
        return ([polygon], [], [], []) if n @ normal > 0 else ([], [polygon], [], [])
    if not (kind == 2).any():
        return [], [], [polygon], []
    if not (kind == 1).any():
        return [], [], [], [polygon]
    front, back = [], []
    for i in range(len(points)):
        j = (i + 1) % len(points)
        if kind[i] != 2:
            front.append(points[i])
        if kind[i] != 1:
            back.append(points[i])
        if {kind[i], kind[j]} == {1, 2}:
            cross = points[i] + side[i] / (side[i] - side[j]) * (points[j] - points[i])
            front.append(cross)
            back.append(cross)
    part = lambda p: [(np.array(p), n, w)] if len(p) >= 3 else []
    return [], [], part(front), part(back)


def _tree(polygons: list) -> _Node | None:
    if not polygons:
        return None
    root = _Node(polygons)
    todo = [(root, polygons)]
    while todo:
        node, held = todo.pop()
        front, back = [], []
        for p in held:
            same, against, f, b = _cut(p, node.normal, node.offset)
            node.own += same + against
            front += f
            back += b
        for name, part in (("front", front), ("back", back)):
            if part:
                setattr(node, name, _Node(part))
                todo.append((getattr(node, name), part))
    return root


def _clipped(polygons: list, tree: _Node | None, keep_outside: bool, keep_shared: bool, keep_against: bool = False) -> list:
    """Parts of polygons outside (or inside) the solid of a tree; those in its surface, facing alike or against, as asked."""
    if tree is None:
        return polygons if keep_outside else []
    out, todo = [], [(tree, p) for p in polygons]
    while todo:
        node, p = todo.pop()
        same, against, f, b = _cut(p, node.normal, node.offset)
        # a polygon in the plane goes on on the side on which it would lie just off the surface
        front, back = list(f), list(b)
        kept, dropped = (front, back) if keep_outside else (back, front)
        (kept if keep_shared else dropped).extend(same)
        (kept if keep_against else dropped).extend(against)
        for part, nxt, outside in ((front, node.front, True), (back, node.back, False)):
            for q in part:
                if nxt is not None:
                    todo.append((nxt, q))
                elif outside == keep_outside:
                    out.append(q)
    return out


def _polygons(points: np.ndarray, faces: np.ndarray) -> list:
    out = []
    for f in points[faces]:
        n = np.cross(f[1] - f[0], f[2] - f[0])
        length = np.linalg.norm(n)
        if length > 1e-12:
            out.append((f, n / length, float(n @ f[0] / length)))
    return out


def _flipped(polygons: list) -> list:
    return [(p[::-1], -n, -w) for p, n, w in polygons]


def boolean_triangles(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], kind: str) -> np.ndarray:
    """Triangles (n, 3, 3) of the union, intersection or difference of two closed meshes that face outwards."""
    pa, pb = _polygons(*a), _polygons(*b)
    ta, tb = _tree(pa), _tree(pb)
    if kind == "union":
        parts = _clipped(pa, tb, True, True) + _clipped(pb, ta, True, False)
    elif kind == "intersection":
        parts = _clipped(pa, tb, False, True) + _clipped(pb, ta, False, False)
    elif kind == "difference":
        parts = _clipped(pa, tb, True, False, True) + _flipped(_clipped(pb, ta, False, False))
    else:
        raise ValueError("kind must be union, intersection or difference")
    fans = [np.stack([np.repeat(p[:1], len(p) - 2, axis=0), p[1:-1], p[2:]], axis=1) for p, _, _ in parts]
    return np.concatenate(fans) if fans else np.empty((0, 3, 3))


def mesh_boolean(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame], kind: str) -> DataFrame:
    """``(mesh_id, a, b, c)``, corners as structs (x, y, z): the boolean of the meshes of equal mesh_id of both sides.

    Meshes must be closed and face outwards; an empty side counts as nothing. One task per pair of meshes.
    """
    if kind not in ("union", "intersection", "difference"):
        raise ValueError("kind must be union, intersection or difference")

    def combine(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for g in (p, q):
            if not len(g):
                sides.append((np.empty((0, 3)), np.empty((0, 3), dtype=int)))
                continue
            vid, points, _, f = _arrays(g)
            sides.append((points, np.searchsorted(vid, f)))
        t = boolean_triangles(*sides, kind)
        name = (p if len(p) else q)[KEY].iloc[0]
        corner = lambda i: [dict(zip(XYZ, map(float, r))) for r in t[:, i]]
        return pd.DataFrame({KEY: [name] * len(t), "a": corner(0), "b": corner(1), "c": corner(2)})

    p = "struct<x:double,y:double,z:double>"
    return _as_rows(*left).groupBy(KEY).cogroup(_as_rows(*right).groupBy(KEY)).applyInPandas(combine, f"mesh_id string, a {p}, b {p}, c {p}")
