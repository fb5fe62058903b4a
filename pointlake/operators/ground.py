"""Ground segmentation by concentric zones: patches, plane fits per patch, and checks on the fit."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise
from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointlake.functions.linear import with_eigen
from pointlake.operators.normals import COVARIANCE
from pointlake.plans import scratch

KEY = "cloud_id"


@dataclass(frozen=True)
class GroundConfig:
    """Defaults of the zone model."""

    sensor_height: float = 1.723
    radii: tuple[float, ...] = (0.0, 2.7, 12.3625, 22.025, 80.0)
    rings: tuple[int, ...] = (2, 4, 4, 4)
    sectors: tuple[int, ...] = (16, 32, 54, 32)
    max_range: float = 80.0
    min_points: int = 10
    seeds: int = 20
    seed_threshold: float = 0.5
    distance: float = 0.125
    iterations: int = 3
    upright: float = 0.707
    flat: float = 0.05
    elevation: float = 1.0

    def __post_init__(self) -> None:
        if len(self.radii) < 2 or len(self.rings) != len(self.radii) - 1 or len(self.sectors) != len(self.rings):
            raise ValueError("zones, rings and sectors must fit together")
        if any(b <= a for a, b in pairwise(self.radii)) or min(*self.rings, *self.sectors) < 1 or self.max_range <= 0:
            raise ValueError("zone radii must grow, and counts and range be positive")
        if self.iterations < 1 or self.min_points < 3 or self.distance <= 0:
            raise ValueError("iterations, points and distance are too small")


def zone_buckets(cloud: DataFrame, config: GroundConfig = GroundConfig()) -> DataFrame:
    """The cloud with ``zone, ring, sector`` (INT); null beyond the range or the zones. Zones are half-open."""
    r, angle = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), F.atan2("y", "x")
    turned = F.when(angle < 0, angle + 2 * pi).otherwise(angle)
    zone = ring = sector = None
    for i, (inner, outer) in enumerate(pairwise(config.radii)):
        inside = (r >= inner) & (r < outer) & (r <= config.max_range)
        in_ring = F.least(F.floor((r - inner) / ((outer - inner) / config.rings[i])), F.lit(config.rings[i] - 1)).cast("int")
        in_sector = F.least(F.floor(turned / (2 * pi / config.sectors[i])), F.lit(config.sectors[i] - 1)).cast("int")
        zone = F.when(inside, F.lit(i)) if zone is None else zone.when(inside, F.lit(i))
        ring = F.when(inside, in_ring) if ring is None else ring.when(inside, in_ring)
        sector = F.when(inside, in_sector) if sector is None else sector.when(inside, in_sector)
    return cloud.withColumns({"zone": zone, "ring": ring, "sector": sector})


def segment_ground(cloud: DataFrame, config: GroundConfig = GroundConfig()) -> DataFrame:
    """The cloud with ``is_ground BOOLEAN``.

    Each patch is fitted from its lowest points and refitted from its inliers ``iterations`` times; a patch's inliers are
    ground if the plane is upright, near the expected height and flat. Fits are aggregates per patch joined back to the
    points, so a patch may hold any number of them.
    """
    patch = [KEY, "zone", "ring", "sector"]
    points = scratch.written(zone_buckets(cloud.select(KEY, "pid", "x", "y", "z"), config).where("zone IS NOT NULL"), "zones")
    order = Window.partitionBy(*patch).orderBy("z", "pid")
    big = points.groupBy(*patch).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= config.min_points).select(*patch)
    # the ranking keeps only the lowest few per patch; Spark limits each task's window before the shuffle
    low = points.join(big, patch, "left_semi").withColumn("i", F.row_number().over(order)).where(F.col("i") <= config.seeds)
    cut = low.groupBy(*patch).agg((F.avg("z") + config.seed_threshold).alias("cut"))
    active = points.join(cut, patch).where(F.col("z") <= F.col("cut")).select(*patch, "pid", "x", "y", "z")
    stopped: DataFrame | None = None
    fitted: DataFrame | None = None
    for turn in range(config.iterations):
        cov = active.groupBy(*patch).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in "xyz"), *(F.covar_pop(ab[0], ab[1]).alias(c) for c, ab in COVARIANCE.items())).where("n >= 3")
        shape = with_eigen(cov)
        up = F.when(F.col("vz") < 0, -1.0).otherwise(1.0)
        plane = shape.select(*patch, "n", *((F.col(f"v{c}") * up).alias(f"p{c}") for c in "xyz"), (-(F.col("vx") * F.col("mean_x") + F.col("vy") * F.col("mean_y") + F.col("vz") * F.col("mean_z")) * up).alias("pd"))
        near = points.join(plane, patch).where(F.abs(F.col("px") * F.col("x") + F.col("py") * F.col("y") + F.col("pz") * F.col("z") + F.col("pd")) <= config.distance)
        near = scratch.written(near, "inliers")
        near = near.join(near.groupBy(*patch).agg(F.count(F.lit(1)).alias("m")).where("m >= 3"), patch)
        last = turn == config.iterations - 1
        ready = near if last else near.where("m = n")
        fitted = ready if fitted is None else fitted.unionByName(ready)
        if last:
            break
        active = near.where("m <> n").select(*patch, "pid", "x", "y", "z")
    stopped = fitted
    cov = stopped.groupBy(*patch).agg(F.first("pz").alias("pz"), F.avg("z").alias("mean_z"), *(F.covar_pop(ab[0], ab[1]).alias(c) for c, ab in COVARIANCE.items()))
    shape = with_eigen(cov)
    total = F.col("e_min") + F.col("e_mid") + F.col("e_max")
    good = shape.where((F.abs("pz") >= config.upright) & (F.abs(F.col("mean_z") + config.sensor_height) <= config.elevation) & ((total <= 0) | (F.try_divide(F.col("e_min"), total) <= config.flat)))
    ground = stopped.join(good.select(*patch), patch, "left_semi").select(KEY, "pid", F.lit(True).alias("is_ground"))
    return cloud.join(ground, [KEY, "pid"], "left").withColumn("is_ground", F.coalesce("is_ground", F.lit(False)))
