"""Scalar grids, depth images, isosurfaces, signed-distance fusion and moving least squares.

A grid is ``(i, j, k, value)``; its place in space is ``Lattice(origin, spacing, dims)`` on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.functions.geometry import XYZ, unit
from pointlake.operators import transforms
from pointlake.operators.neighbors import KEY, nearest
from pointlake.plans.blocks import Blocks, in_blocks
from pointlake.plans.ranks import ranked
from pointlake.schema import one_cloud, positive

IJK = ("i", "j", "k")


@dataclass(frozen=True)
class Lattice:
    """Where a grid lies: the first node, the spacing and the number of nodes along each axis."""

    origin: tuple[float, float, float]
    spacing: tuple[float, float, float]
    dims: tuple[int, int, int]

    def __post_init__(self) -> None:
        if min(self.dims) < 1 or min(self.spacing) <= 0:
            raise ValueError("dimensions and spacing must be positive")

    @classmethod
    def around(cls, low, high, dims, padding: float = 0.0) -> Lattice:
        low, high = np.asarray(low, dtype=float) - padding, np.asarray(high, dtype=float) + padding
        return cls(tuple(map(float, low)), tuple(float(max((b - a) / max(1, n - 1), 1e-12)) for a, b, n in zip(low, high, dims)), tuple(dims))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """``(i, j, k, x, y, z)`` of all nodes, generated where they are used."""
        nx, ny, nz = self.dims
        n = F.col("id")
        index = {"i": F.floor(n / (ny * nz)).cast("int"), "j": F.floor((n % (ny * nz)) / nz).cast("int"), "k": (n % nz).cast("int")}
        return spark.range(nx * ny * nz).select(*(c.alias(a) for a, c in index.items())).withColumns({x: self.place(a, t) for t, (x, a) in enumerate(zip(XYZ, IJK))})

    def place(self, column: Column | str, axis: int) -> Column:
        c = F.col(column) if isinstance(column, str) else column
        return c * float(self.spacing[axis]) + float(self.origin[axis])


def sphere_volume(spark: SparkSession, center: tuple[float, float, float], radius: float, lattice: Lattice) -> DataFrame:
    """Signed distance to a sphere, negative inside."""
    d2 = sum(((F.col(c) - float(v)) ** 2 for c, v in zip(XYZ, center)), F.lit(0.0))
    return lattice.nodes(spark).select(*IJK, (F.sqrt(d2) - float(radius)).alias("value"))


def cube_volume(spark: SparkSession, center: tuple[float, float, float], half: float, lattice: Lattice) -> DataFrame:
    """Signed distance to a cube with edges of twice ``half``, negative inside."""
    d = [F.abs(F.col(c) - float(v)) - float(half) for c, v in zip(XYZ, center)]
    outside = F.sqrt(sum((F.greatest(x, F.lit(0.0)) ** 2 for x in d), F.lit(0.0)))
    return lattice.nodes(spark).select(*IJK, (outside + F.least(F.greatest(*d), F.lit(0.0))).alias("value"))


def cloud_box(cloud: DataFrame) -> tuple[list[float], list[float]]:
    """Least and greatest corner of a cloud; an empty one is an error."""
    row = cloud.agg(*(f(c).alias(f"{n}{c}") for n, f in (("a", F.min), ("b", F.max)) for c in XYZ)).first()
    if row["ax"] is None:
        raise ValueError("the cloud is empty")
    return [row[f"a{c}"] for c in XYZ], [row[f"b{c}"] for c in XYZ]


def distance_grid(cloud: DataFrame, dims: tuple[int, int, int], padding: float = 0.0) -> tuple[DataFrame, Lattice]:
    """Unsigned distance of each node to the nearest point of one cloud: an isosurface needs a positive level."""
    one_cloud(cloud)
    lattice = Lattice.around(*cloud_box(cloud), dims, padding)
    nodes = lattice.nodes(cloud.sparkSession).withColumns({KEY: F.lit("grid"), "pid": (F.col("i").cast("bigint") * dims[1] + F.col("j")) * dims[2] + F.col("k")})
    near = nearest(nodes, cloud.withColumn(KEY, F.lit("grid")))
    return nodes.join(near, [KEY, "pid"]).select(*IJK, F.col("distance").alias("value")), lattice


# -- depth images ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Camera:
    """A pinhole camera: focal lengths, centre and size in pixels."""

    fx: float
    fy: float
    cx: float
    cy: float
    width: int
    height: int


def depth_to_cloud(depth: DataFrame, camera: Camera, scale: float = 0.001) -> DataFrame:
    """``(row, col, x, y, z)`` of a depth image ``(row, col, d)``; where d is 0, null or not finite, x, y, z are null."""
    z = F.col("d").cast("double") * scale
    ok = (F.col("d") > 0) & (F.abs(z) < 1e300)
    return depth.select("row", "col", F.when(ok, (F.col("col") - camera.cx) * z / camera.fx).alias("x"), F.when(ok, (F.col("row") - camera.cy) * z / camera.fy).alias("y"), F.when(ok, z).alias("z"))


def valid_points(organized: DataFrame) -> DataFrame:
    """The cells of an organized cloud that hold a point."""
    return organized.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")


def is_dense(organized: DataFrame) -> DataFrame:
    """``(cells, valid, is_dense)`` of an organized cloud; an empty one is dense."""
    return organized.agg(F.count(F.lit(1)).alias("cells"), F.count("x").alias("valid")).withColumn("is_dense", F.col("cells") == F.col("valid"))


def _projected(points: DataFrame, camera: Camera, world_to_camera: np.ndarray) -> DataFrame:
    """Points with camera coordinates px, py, pz and image place u, v (null behind the camera)."""
    m = np.asarray(world_to_camera, dtype=float)
    moved = transforms.transform_points(points.withColumns({f"p{c}": F.col(c) for c in XYZ}), m, ("px", "py", "pz"))
    ahead = lambda c: F.when(F.col("pz") != 0, F.try_divide(F.col(c), F.col("pz")))
    return moved.withColumns({"u": ahead("px") * camera.fx + camera.cx, "v": ahead("py") * camera.fy + camera.cy})


def _half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def colorize(cloud: DataFrame, pixels: DataFrame, camera: Camera, world_to_camera: np.ndarray | None = None, default: tuple[int, int, int] = (128, 128, 128), bilinear: bool = True, min_depth: float = 1e-4) -> DataFrame:
    """The cloud with ``r, g, b`` and ``is_colored`` from the image ``(u, v, r, g, b)`` of a camera.

    Nearest or bilinear sampling, nearest where the four pixels reach over the border. A colour equal to the default counts
    as none. Pixels are looked up by joins on (u, v): one for nearest, four corners in one join for bilinear.
    """
    rgb = ("r", "g", "b")
    at = _projected(cloud.select(KEY, "pid", *XYZ), camera, np.eye(4) if world_to_camera is None else world_to_camera).where(F.col("pz") >= min_depth)
    inner = (F.floor("u") >= 0) & (F.floor("v") >= 0) & (F.floor("u") + 1 < camera.width) & (F.floor("v") + 1 < camera.height)
    corner = lambda du, dv: F.struct((F.floor("u") + du).alias("u"), (F.floor("v") + dv).alias("v"), ((F.col("u") - F.floor("u") if du else 1 - F.col("u") + F.floor("u")) * (F.col("v") - F.floor("v") if dv else 1 - F.col("v") + F.floor("v"))).alias("w"))
    closest = F.array(F.struct(_half_up(F.col("u")).alias("u"), _half_up(F.col("v")).alias("v"), F.lit(1.0).alias("w")))
    wanted = F.when(inner, F.array(*(corner(du, dv) for du, dv in product((0, 1), repeat=2)))).otherwise(closest) if bilinear else closest
    asked = at.select(KEY, "pid", F.explode(wanted).alias("s")).select(KEY, "pid", F.col("s.u").cast("int").alias("u"), F.col("s.v").cast("int").alias("v"), "s.w")
    asked = asked.where(F.col("u").between(0, camera.width - 1) & F.col("v").between(0, camera.height - 1))
    looked = asked.join(pixels.select("u", "v", *rgb), ["u", "v"]).groupBy(KEY, "pid").agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in rgb))
    found = looked.select(KEY, "pid", *(_half_up(F.col(c)).cast("int").alias(c) for c in rgb))
    out = cloud.drop(*rgb).join(found, [KEY, "pid"], "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in zip(rgb, default)})
    return out.withColumn("is_colored", ~((F.col("r") == default[0]) & (F.col("g") == default[1]) & (F.col("b") == default[2])))


def colorize_from_images(cloud: DataFrame, sources: list[tuple[DataFrame, Camera, np.ndarray]], default: tuple[int, int, int] = (128, 128, 128), bilinear: bool = True, min_depth: float = 1e-4) -> DataFrame:
    """The same from several cameras: the first that gives a colour wins. No camera is an error."""
    if not sources:
        raise ValueError("no camera given")
    parts = None
    for n, (pixels, camera, pose) in enumerate(sources):
        hit = colorize(cloud.select(KEY, "pid", *XYZ), pixels, camera, pose, default, bilinear, min_depth).where("is_colored").select(KEY, "pid", F.lit(n).alias("n"), F.struct("r", "g", "b").alias("c"))
        parts = hit if parts is None else parts.unionAll(hit)
    first = parts.groupBy(KEY, "pid").agg(F.min_by("c", "n").alias("c"))
    out = cloud.drop("r", "g", "b").join(first, [KEY, "pid"], "left")
    return out.withColumns({**{n: F.coalesce(F.col(f"c.{n}"), F.lit(v)) for n, v in zip("rgb", default)}, "is_colored": F.col("c").isNotNull()}).drop("c")


# -- signed-distance fusion -----------------------------------------------------------------------------------------------


def tsdf_volume(spark: SparkSession, lattice: Lattice) -> DataFrame:
    """An empty volume ``(i, j, k, tsdf, weight, r, g, b)``."""
    return lattice.nodes(spark).select(*IJK, F.lit(0.0).alias("tsdf"), F.lit(0.0).alias("weight"), *(F.lit(0).alias(c) for c in "rgb"))


def tsdf_integrate(volume: DataFrame, lattice: Lattice, depth: DataFrame, camera: Camera, world_to_camera: np.ndarray, truncation: float, max_weight: float = 100.0, color: DataFrame | None = None) -> DataFrame:
    """A depth frame ``(row, col, d)`` in metres (and colours ``(row, col, r, g, b)``) folded into the volume.

    Each node looks up the pixel it projects to; without a depth above 0 it stays. The clamped difference of depth and camera
    distance enters a running mean whose weight saturates at ``max_weight``. Black pixels do not change colours.
    """
    positive(truncation=truncation, max_weight=max_weight)
    at = volume.withColumns({c: lattice.place(a, t) for t, (c, a) in enumerate(zip(XYZ, IJK))})
    # nodes behind or beside the image have no pixel
    at = _projected(at, camera, world_to_camera).withColumns({"col": F.when(F.col("u").between(-0.5, camera.width), F.floor(F.col("u") + 0.5)).cast("int"), "row": F.when(F.col("v").between(-0.5, camera.height), F.floor(F.col("v") + 0.5)).cast("int")})
    image = depth.select("row", "col", F.col("d").cast("double").alias("d")).where((F.col("d") > 0) & (F.col("row") < camera.height) & (F.col("col") < camera.width))
    if color is not None:
        image = image.join(color.select("row", "col", *(F.col(c).alias(f"n{c}") for c in "rgb")), ["row", "col"], "left")
    seen = at.join(image, ["row", "col"], "left")
    hit = F.col("d").isNotNull()
    weight = F.least(F.col("weight") + 1, F.lit(float(max_weight)))
    share = 1 / weight
    sdf = F.greatest(F.least(F.col("d") - F.col("pz"), F.lit(float(truncation))), F.lit(-float(truncation)))
    columns = [F.when(hit, (1 - share) * F.col("tsdf") + share * sdf).otherwise(F.col("tsdf")).alias("tsdf"), F.when(hit, weight).otherwise(F.col("weight")).alias("weight")]
    if color is None:
        columns += [F.col(c) for c in "rgb"]
    else:
        lit = hit & (F.coalesce(F.greatest("nr", "ng", "nb"), F.lit(0)) > 0)
        columns += [F.when(lit, F.floor((1 - share) * F.col(c) + share * F.col(f"n{c}"))).otherwise(F.col(c)).cast("int").alias(c) for c in "rgb"]
    return seen.select(*IJK, *columns)


def _cells(grid: DataFrame, value: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """Cells with their eight corner values ``v0 .. v7`` (bit 0 is i, bit 1 j, bit 2 k); one shuffle of nodes, no self-joins."""
    steps = F.array(*(F.struct(F.lit(n).alias("n"), *(F.lit(n >> t & 1).alias(f"d{a}") for t, a in enumerate(IJK))) for n in range(8)))
    lent = grid.select(*IJK, value.alias("value"), *extra, F.explode(steps).alias("s"))
    cells = lent.select(*((F.col(a) - F.col(f"s.d{a}")).alias(a) for a in IJK), F.col("s.n").alias("n"), "value", *extra)
    corner = [F.max(F.when(F.col("n") == n, F.col("value"))).alias(f"v{n}") for n in range(8)]
    own = [F.max(F.when(F.col("n") == 0, F.col(c))).alias(c) for c in extra]
    return cells.groupBy(*IJK).agg(F.count("value").alias("whole"), *corner, *own).where("whole = 8").drop("whole")


#: The twelve edges of a cell as corner pairs: along i, then j, then k.
EDGES = [(a, a | 1 << t) for t in range(3) for a in range(8) if not a >> t & 1]


def tsdf_surface(volume: DataFrame, lattice: Lattice, iso: float = 0.0) -> DataFrame:
    """``(i, j, k, edge, x, y, z, r, g, b)``: a point on each cell edge whose corners differ in sign or touch the level.

    Cells whose own node has been seen (weight at least 0.001); edges shared by cells give a point for each.
    """
    cells = _cells(volume, F.col("tsdf") - iso, ("weight", "r", "g", "b")).where("weight >= 0.001")

    def crossing(edge: int) -> Column:
        a, b = EDGES[edge]
        va, vb = F.col(f"v{a}"), F.col(f"v{b}")
        t = F.when(F.abs(va - vb) < 1e-5, 0.5).otherwise(F.greatest(F.least(F.try_divide(va, va - vb), F.lit(1.0)), F.lit(0.0)))
        place = [lattice.place(F.col(n) + (a >> x & 1) + (t if (a ^ b) >> x & 1 else 0), x).alias(c) for x, (n, c) in enumerate(zip(IJK, XYZ))]
        return F.when(va * vb <= 0, F.struct(F.lit(edge).alias("edge"), *place))

    points = cells.select(*IJK, "r", "g", "b", F.explode(F.array_compact(F.array(*map(crossing, range(12))))).alias("p"))
    return points.select(*IJK, "p.*", "r", "g", "b")


# -- isosurfaces ----------------------------------------------------------------------------------------------------------


@cache
def cube_triangles() -> tuple[tuple[tuple[int, int, int], ...], ...]:
    """For each of the 256 sets of inner corners, the triangles as edge triples, derived from the cube's faces.

    On every face the crossed edges are joined so that each run of inner corners is cut off by itself, which two cubes that
    share the face do alike; the joins form loops, which are cut into fans and wind outwards from the inner corners.
    """
    at = np.array([[n >> t & 1 for t in range(3)] for n in range(8)], dtype=float)
    middle = {e: (at[a] + at[b]) / 2 for e, (a, b) in enumerate(EDGES)}
    by_pair = {frozenset(p): e for e, p in enumerate(EDGES)}
    faces = []
    for t, side in product(range(3), (0, 1)):
        u, v = (x for x in range(3) if x != t)
        ring = [side << t | p << u | q << v for p, q in ((0, 0), (1, 0), (1, 1), (0, 1))]
        out = np.zeros(3)
        out[t] = 2 * side - 1
        faces.append((ring, out))
    table = []
    for inside in range(256):
        is_in = [inside >> n & 1 for n in range(8)]
        follow: dict[int, int] = {}
        for ring, out in faces:
            for n in range(4):
                # a run of inner corners from ring[n] on: it is cut off between the edges before and after it
                if not is_in[ring[n]] or is_in[ring[n - 1]]:
                    continue
                m = n
                while is_in[ring[(m + 1) % 4]]:
                    m += 1
                first = by_pair[frozenset((ring[n - 1], ring[n]))]
                last = by_pair[frozenset((ring[m % 4], ring[(m + 1) % 4]))]
                turn = np.cross(middle[last] - middle[first], out) @ (at[ring[n]] - middle[first])
                a, b = (first, last) if turn > 0 else (last, first)
                follow[a] = b
        triangles = []
        while follow:
            loop = [next(iter(follow))]
            while (nxt := follow.pop(loop[-1])) != loop[0]:
                loop.append(nxt)
            triangles += [(loop[0], loop[n], loop[n + 1]) for n in range(1, len(loop) - 1)]
        table.append(tuple(triangles))
    return tuple(table)


def cube_index(grid: DataFrame, iso: float = 0.0) -> DataFrame:
    """``(i, j, k, cube_index, v0 .. v7)`` of all cells: the bit of a corner is set where its value is below the level."""
    cells = _cells(grid, F.col("value"))
    index = sum((F.when(F.col(f"v{n}") < iso, 1 << n).otherwise(0) for n in range(8)), F.lit(0))
    return cells.withColumn("cube_index", index)


def _edge_gradient(edge: int, t: Column, lattice: Lattice) -> list[Column]:
    """The gradient of the trilinear field of a cell at the part ``t`` of an edge."""
    a, b = EDGES[edge]
    axis = (a ^ b).bit_length() - 1
    v = lambda n: F.col(f"v{n}")
    out = []
    for x in range(3):
        rise = lambda n: v(n | 1 << x) - v(n & ~(1 << x))  # noqa: B023, E731
        out.append((rise(a) if x == axis else (1 - t) * rise(a) + t * rise(b)) / float(lattice.spacing[x]))
    return out


def isosurface(grid: DataFrame, lattice: Lattice, iso: float = 0.0, normals: bool = False) -> DataFrame:
    """``(i, j, k, n, a, b, c)``: triangles of the level set, corners as structs (x, y, z); cells do not share vertices.

    The 256-row table of triangles is a constant; corners are interpolated along their edges. With ``normals`` corners also
    have the unit gradient nx, ny, nz of the field, null where it vanishes.
    """
    spark = grid.sparkSession
    cells = cube_index(grid, iso).where("cube_index BETWEEN 1 AND 254")
    table = spark.createDataFrame([(n, [list(t) for t in ts]) for n, ts in enumerate(cube_triangles()) if ts], "cube_index int, triangles array<array<int>>")

    def place(edge: int) -> Column:
        a, b = EDGES[edge]
        va, vb = F.col(f"v{a}"), F.col(f"v{b}")
        t = F.coalesce(F.try_divide(F.lit(float(iso)) - va, vb - va), F.lit(0.5))
        slope = unit(tuple(_edge_gradient(edge, t, lattice))) if normals else ()
        return F.struct(*(lattice.place(F.col(n) + (a >> x & 1) + (t if (a ^ b) >> x & 1 else 0), x).alias(c) for x, (n, c) in enumerate(zip(IJK, XYZ))), *(g.alias(f"n{c}") for g, c in zip(slope, XYZ)))

    placed = cells.withColumn("e", F.array(*map(place, range(12)))).join(F.broadcast(table), "cube_index")
    rows = placed.select(*IJK, "e", F.posexplode("triangles").alias("n", "t"))
    return rows.select(*IJK, "n", *(F.get("e", F.get("t", m)).alias(c) for m, c in enumerate("abc")))


def triangle_mesh(triangles: DataFrame, mesh_id: str = "surface", places: int = 9) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of triangles whose corners are structs: corners at one place (rounded) become one vertex.

    Vertices are numbered in the order of their places and faces in that of their corners; both are compared themselves and
    not by hashes. Faces that lose a corner go, and of equal ones one stays. Normals of the corners are averaged, if there are any.
    """
    names = set(triangles.schema["a"].dataType.names)
    place = lambda c: F.struct(*((F.round(F.col(f"{c}.{x}"), places) + 0.0).alias(x) for x in XYZ))
    rows = triangles.select(*"abc", *(place(c).alias(f"p{c}") for c in "abc")).where("pa <> pb AND pb <> pc AND pc <> pa")
    corners = rows.select(F.explode(F.array(*(F.struct(F.col(f"p{c}").alias("p"), F.col(c).alias("v")) for c in "abc"))).alias("s"))
    more = [F.avg(f"s.v.n{x}").alias(f"n{x}") for x in XYZ] if "nx" in names else []
    met = corners.groupBy("s.p").agg(*more) if more else corners.select("s.p").distinct()
    numbered = ranked(met, ["p"], "vid")
    vertices = numbered.select(F.lit(mesh_id).alias("mesh_id"), "vid", "p.x", "p.y", "p.z", *(f"n{x}" for x in XYZ if more))
    known = numbered.select("p", "vid")
    faces = rows.select("pa", "pb", "pc").distinct()
    for c in "abc":
        faces = faces.join(known.withColumnsRenamed({"p": f"p{c}", "vid": c}), f"p{c}").drop(f"p{c}")
    return vertices, ranked(faces.select(*"abc"), list("abc"), "fid").select(F.lit(mesh_id).alias("mesh_id"), "fid", *"abc")


# -- moving least squares -------------------------------------------------------------------------------------------------

_BASES = {"constant": 1, "linear": 4, "quadratic": 10, "cubic": 20}


def _basis(d: np.ndarray, size: int) -> np.ndarray:
    x, y, z = d.T
    terms = [np.ones(len(d)), x, y, z, x * x, y * y, z * z, x * y, x * z, y * z, x**3, y**3, z**3, x * x * y, x * x * z, x * y * y, y * y * z, x * z * z, y * z * z, x * y * z]
    return np.stack(terms[:size], axis=1)


def mls_field(queries: DataFrame, cloud: DataFrame, support: float = 0.1, basis: str = "quadratic", weight: str = "wendland", ridge: float = 1e-6, gradient: bool = False) -> DataFrame:
    """``(cloud_id, pid, value)``: the fitted signed distance at each query, from points with normals within the support.

    Weighted least squares of the normal offsets in a polynomial basis; queries without points get 0, a cloud without normals
    a field of zeros. With ``gradient`` also its slope ``gx, gy, gz`` (0 for a constant basis and for queries without points).
    Queries and points meet in blocks with a rim of the support, and all systems of a chunk are solved at once.
    """
    positive(support=support)
    if basis not in _BASES or weight not in ("gaussian", "wendland", "cubic", "inverse"):
        raise ValueError("unknown basis or weight")
    out = ["value", *(("gx", "gy", "gz") if gradient else ())]
    if "nx" not in cloud.columns:
        return queries.select(KEY, "pid", *(F.lit(0.0).alias(c) for c in out))
    size, h = _BASES[basis], float(support)
    at = np.triu_indices(size)

    def weights(r: np.ndarray) -> np.ndarray:
        if weight == "gaussian":
            return np.exp(-(r**2) / h**2)
        if weight == "inverse":
            return np.where(r < 1e-10, 1e10, 1 / np.maximum(r, 1e-10))
        s = np.maximum(1 - r / h, 0)
        return s**4 * (4 * r / h + 1) if weight == "wendland" else s**3

    def fit(b: Blocks) -> Iterator[pa.RecordBatch]:
        asks = b.table["asks"].to_numpy(zero_copy_only=False).astype(bool)
        points, home = np.flatnonzero(~asks), np.flatnonzero(asks & b.home)
        normals = np.column_stack([np.nan_to_num(b.table[f"n{c}"].to_numpy(zero_copy_only=False).astype(float)) for c in "xyz"])
        found, grid = np.zeros((len(home), len(out))), b.grid(points)
        order = np.argsort(b.block[home], kind="stable")
        home = home[order]
        # so many queries at a time that their systems and pairs stay small
        for first in range(0, len(home), 2_000):
            part = home[first : first + 2_000]
            left, right = np.zeros((len(part), len(at[0]))), np.zeros((len(part), size))
            seen = np.zeros(len(part), dtype=bool)
            for q, m, _ in grid.within(b.block[part], b.xyz[part], h):
                by = np.argsort(q, kind="stable")
                for cut in range(0, len(by), 50_000):
                    i, j = q[by[cut : cut + 50_000]], points[m[by[cut : cut + 50_000]]]
                    d = b.xyz[j] - b.xyz[part[i]]
                    f, w = _basis(d, size), weights(np.linalg.norm(d, axis=1))
                    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                    left[i[starts]] += np.add.reduceat(f[:, at[0]] * f[:, at[1]] * w[:, None], starts, axis=0)
                    right[i[starts]] += np.add.reduceat(f * (w * (d * normals[j]).sum(axis=1))[:, None], starts, axis=0)
                    seen[i] = True
            whole = np.zeros((len(part), size, size))
            whole[:, at[0], at[1]] = left
            whole[:, at[1], at[0]] = left
            whole += ridge * np.eye(size)
            solved = np.linalg.solve(whole, right[:, :, None])[:, :, 0]
            solved[~seen] = 0.0
            found[first : first + 2_000, 0] = solved[:, 0]
            if gradient and size > 1:
                found[first : first + 2_000, 1:] = solved[:, 1:4]
        rows = pa.array(home)
        columns = [b.table[KEY].combine_chunks().take(rows), b.table["pid"].combine_chunks().take(rows)]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(found[:, i]) for i in range(len(out)))], names=[KEY, "pid", *out])

    tidy = lambda df, asks, more: df.select(KEY, F.col("pid").cast("bigint").alias("pid"), *(F.col(c).cast("double").alias(c) for c in XYZ), F.lit(asks).alias("asks"), *more)
    both = tidy(queries, True, [F.lit(None).cast("double").alias(f"n{c}") for c in XYZ]).unionByName(tidy(cloud, False, [F.col(f"n{c}").cast("double").alias(f"n{c}") for c in XYZ]))
    kind = queries.schema[KEY].dataType.simpleString()
    return in_blocks(both, h, fit, f"{KEY} {kind}, pid bigint, " + ", ".join(f"{c} double" for c in out))


def mls_surface(cloud: DataFrame, support: float = 0.1, dims: tuple[int, int, int] = (50, 50, 50), basis: str = "quadratic", weight: str = "wendland", iso: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The zero level of the field over the cloud's box padded by two supports; without normals there is none, an error."""
    if "nx" not in cloud.columns:
        raise ValueError("no isosurface: the field of a cloud without normals is zero everywhere")
    one_cloud(cloud)
    low, high = cloud_box(cloud)
    lattice = Lattice.around(low, high, dims, 2 * support)
    nodes = lattice.nodes(cloud.sparkSession).withColumns({KEY: F.lit("grid"), "pid": (F.col("i").cast("bigint") * dims[1] + F.col("j")) * dims[2] + F.col("k")})
    field = mls_field(nodes, cloud.withColumn(KEY, F.lit("grid")), support, basis, weight)
    grid = nodes.join(field, [KEY, "pid"]).select(*IJK, "value")
    # cells in which no point has a say do not bound anything
    triangles = isosurface(grid.where("value <> 0"), lattice, iso)
    return triangle_mesh(triangles, "mls")
