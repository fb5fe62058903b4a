"""Dividing records into clusters of mutually similar ones by distributed k-means with parallel oversampled seeding.

Records become vectors of hashed weighted features; those of a group (a cloud) are seeded, averaged and assigned among
themselves, all groups in the same passes. Seeding takes, in a few rounds, every record with a probability that grows
with its distance from the seeds so far, which gives a few times k candidates; these are weighted by the records they stand
for and reduced to k on the driver. Lloyd rounds follow. What the driver and every task hold are k (or a few k) centres a group
of ``dims`` numbers, never records.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointlake.plans import scratch

#: Distances computed at a time.
DISTANCES = 4_000_000


def hashed_features(df: DataFrame, numbers: dict[str, float], names: dict[str, float], dims: int = 16) -> Column:
    """ARRAY<DOUBLE> of ``dims`` slots: weighted numeric columns at hashed slots of their own, weighted values at hashed slots.

    A numeric column adds value x weight to its slot (null and NaN add nothing, what lies beyond 1e100 counts as that), a value of another column adds its weight,
    with a hashed sign, to one of the slots left. More numeric columns than half the slots are an error.
    """
    if len(numbers) > dims // 2:
        raise ValueError("too many numeric columns for the number of slots")
    slots: dict[int, Column] = {}
    for c, w in numbers.items():
        slot = zlib.crc32(c.encode()) % dims
        while slot in slots:
            slot = (slot + 1) % dims
        v = F.col(f"`{c}`").cast("double")
        slots[slot] = F.when(~F.isnan(v), F.greatest(F.least(v, F.lit(1e100)), F.lit(-1e100)) * w).otherwise(0.0)
    free = [i for i in range(dims) if i not in slots]
    added: dict[int, list[Column]] = {}
    for c, w in names.items():
        h = F.xxhash64(F.lit(c), F.col(f"`{c}`"))
        at, sign = F.pmod(h, F.lit(len(free))), F.when(F.pmod(F.shiftright(h, 17), F.lit(2)) == 0, w).otherwise(-w)
        for i, slot in enumerate(free):
            added.setdefault(slot, []).append(F.when(F.col(f"`{c}`").isNotNull() & (at == i), sign).otherwise(0.0))
    value = lambda i: slots[i] if i in slots else sum(added.get(i, []), F.lit(0.0))
    return F.array(*(value(i).cast("double") for i in range(dims)))


def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return np.asarray(batch.column("f").flatten(), dtype=np.float64).reshape(-1, dims)


def _nearest(f: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector (ties to the first) and the squared distance."""
    which, d2 = np.empty(len(f), dtype=np.int64), np.empty(len(f))
    squares = (centres**2).sum(axis=1)
    step = max(1, DISTANCES // max(1, len(centres)))
    for i in range(0, len(f), step):
        part = f[i : i + step]
        d = squares - 2 * part @ centres.T
        at = d.argmin(axis=1)
        which[i : i + step] = at
        d2[i : i + step] = np.maximum(((part - centres[at]) ** 2).sum(axis=1), 0)
    return which, d2


def _seed(candidates: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the weighted candidates by distance-weighted sampling."""
    chosen = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
    d2 = ((candidates - candidates[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(candidates)):
        p = d2 * weights
        if p.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(candidates), p=p / p.sum())))
        d2 = np.minimum(d2, ((candidates - candidates[chosen[-1]]) ** 2).sum(axis=1))
    return candidates[chosen]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """The groups of a batch, each with the places of its rows."""
    g = batch.column("g_").dictionary_encode()
    code = g.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    cut = np.searchsorted(code[order], np.arange(len(g.dictionary) + 1))
    for i, name in enumerate(g.dictionary.to_pylist()):
        yield name, order[cut[i] : cut[i + 1]]


def _assigned(batch: pa.RecordBatch, centres: dict[str, np.ndarray], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row among those of its group, and the squared distance."""
    f = _vectors(batch, dims)
    which, d2 = np.empty(len(f), dtype=np.int64), np.empty(len(f))
    for g, at in _groups(batch):
        which[at], d2[at] = _nearest(f[at], centres[g])
    return which, d2


def kmeans(vectors: DataFrame, k: int | Callable[[int], int], keys: list[str], dims: int, rounds: int = 3, iterations: int = 12, oversampling: float = 1.0, tolerance: float = 0.01, seed: int = 7) -> dict[str, np.ndarray]:
    """By group, the centres (at most k, ``dims``) of ``vectors (*keys, g_ STRING, f ARRAY<DOUBLE>)``; fewer where there are fewer different vectors.

    ``k`` is a number for every group or a function of a group's rows. Sampling is by a hash of the keys, so a run over the same
    records gives the same centres. Lloyd rounds, at most ``iterations``, end when one lowers the sum of squared distances of all
    records by less than the share ``tolerance``. An empty table gives none.
    """
    if isinstance(k, int) and k < 1 or rounds < 1 or iterations < 0:
        raise ValueError("k and rounds must be positive")
    spark = vectors.sparkSession
    rng = np.random.default_rng(seed)
    draw = lambda r: ((F.pmod(F.xxhash64(F.lit(seed), F.lit(r), *keys), F.lit(1 << 40)) + 0.5) / float(1 << 40)).alias("u")
    start = vectors.select("g_", "f", draw(-1)).groupBy("g_").agg(F.min_by("f", "u").alias("f"), F.count(F.lit(1)).alias("n")).toArrow().to_pylist()
    start.sort(key=lambda r: r["g_"])
    centres = {r["g_"]: np.array([r["f"]], dtype=float) for r in start}
    wanted = {r["g_"]: k if isinstance(k, int) else max(1, k(r["n"])) for r in start}
    if not centres:
        return {}

    def pass_over(columns: list, work, schema: str, held: dict[str, np.ndarray]) -> DataFrame:
        shared = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield work(batch, shared.value)

        return vectors.select("g_", *columns).mapInArrow(run, schema)

    most = {g: max(1, int(oversampling * n)) for g, n in wanted.items()}
    for turn in range(rounds):

        def pick(batch: pa.RecordBatch, c: dict[str, np.ndarray]) -> pa.RecordBatch:
            # an exponential clock per record that runs at the rate of its squared distance: the first to ring are the sample
            d2 = _assigned(batch, c, dims)[1]
            with np.errstate(divide="ignore"):
                rings = np.where(d2 > 0, -np.log(batch.column("u").to_numpy()) / d2, np.inf)
            first = np.concatenate([at[np.argsort(rings[at], kind="stable")[: most[g]]] for g, at in _groups(batch)])
            first = first[np.isfinite(rings[first])]
            own = batch.select(["g_", "f"]).take(pa.array(first))
            return pa.RecordBatch.from_arrays([*own.columns, pa.array(rings[first]), pa.array([most[g] for g in own.column("g_").to_pylist()], pa.int64())], names=["g_", "f", "rings", "most"])

        # oversampling x k rows a group and round, whatever the number of records
        rung = pass_over(["f", draw(turn)], pick, "g_ string, f array<double>, rings double, most bigint", centres)
        place = F.row_number().over(Window.partitionBy("g_").orderBy("rings"))
        more = rung.withColumn("i_", place).where(F.col("i_") <= F.col("most")).select("g_", "f").toArrow()
        if not more.num_rows:
            break
        for part in more.combine_chunks().to_batches():
            f = _vectors(part, dims)
            for g, at in _groups(part):
                centres[g] = np.unique(np.r_[centres[g], f[at]], axis=0)

    def sums(batch: pa.RecordBatch, c: dict[str, np.ndarray]) -> pa.RecordBatch:
        f = _vectors(batch, dims)
        which, d2 = _assigned(batch, c, dims)
        names, centre, n, total, cost = [], [], [], [], []
        for g, at in _groups(batch):
            seen, inverse = np.unique(which[at], return_inverse=True)
            names += [g] * len(seen)
            centre.append(seen)
            n.append(np.bincount(inverse))
            cost.append(np.bincount(inverse, d2[at]))
            total.append(np.column_stack([np.bincount(inverse, f[at, i]) for i in range(dims)]))
        whole = np.concatenate(total)
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate(centre)), pa.array(np.concatenate(n).astype(np.int64)), pa.array(np.concatenate(cost)), *(pa.array(whole[:, i]) for i in range(dims))], names=["g_", "c", "n", "d2", *(f"s{i}" for i in range(dims))])

    schema = "g_ string, c bigint, n bigint, d2 double, " + ", ".join(f"s{i} double" for i in range(dims))

    def totals(held: dict[str, np.ndarray]) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], float]:
        rows = pass_over(["f"], sums, schema, held).groupBy("g_", "c").agg(F.sum("n").alias("n"), F.sum("d2").alias("d2"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(dims))).toArrow()
        out, cost = {g: (np.zeros(len(c)), np.zeros((len(c), dims))) for g, c in held.items()}, 0.0
        for part in rows.combine_chunks().to_batches():
            c, n = part.column("c").to_numpy(), part.column("n").to_numpy()
            cost += float(part.column("d2").to_numpy().sum())
            s = np.column_stack([part.column(f"s{i}").to_numpy() for i in range(dims)])
            for g, at in _groups(part):
                out[g][0][c[at]], out[g][1][c[at]] = n[at], s[at]
        return out, cost

    weights, _ = totals(centres)
    centres = {g: _seed(c, np.maximum(weights[g][0], 1e-9), wanted[g], rng) for g, c in centres.items()}
    last = np.inf
    for _ in range(iterations):
        sums_, cost = totals(centres)
        if cost >= last * (1 - tolerance):
            break
        last = cost
        centres = {g: np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centres[g]) for g, (n, s) in sums_.items()}
    return {g: c[np.lexsort(c.T[::-1])] for g, c in centres.items()}


def similarity_clusters(records: DataFrame, keys: list[str], numbers: dict[str, float], names: dict[str, float] | None = None, k: int | Callable[[int], int] = 256, typical: int = 3, dims: int = 16, within: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Members ``(*keys, cluster, distance)`` and clusters ``(cluster, size, spread, typical)`` of records with unique ``keys``.

    ``within`` names one of the keys, a string, whose values never share a cluster: each has its own centres, ``k`` of them (or
    as many as the function ``k`` makes of its rows), numbered from 0, and the clusters begin with that column.
    ``spread`` is the root mean square of the members' distances, ``typical`` lists the members nearest the centre, ties by key, as structs of the keys and the distance. Rows delivered
    twice count once, rows with a null key do not take part, null features add nothing; an empty table gives empty tables.
    Members nearest a centre are kept per batch before anything is shuffled, so no cluster meets in one task.
    """
    group = F.col(f"`{within}`") if within else F.lit("")
    whole = records.select(*keys, group.alias("g_"), hashed_features(records, numbers, names or {}, dims).alias("f")).dropna(subset=keys)
    # by range, so that a task sees few groups
    ranges = whole.repartitionByRange("g_", *(c for c in keys if c != within))
    vectors = scratch.written(ranges.dropDuplicates(["g_", *(c for c in keys if c != within)]), "vectors")
    centres = kmeans(vectors, k, keys, dims, **options)
    shared = records.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                which, d2 = _assigned(batch, shared.value, dims)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(which.astype(np.int32)), pa.array(np.sqrt(d2))], names=[*keys, "cluster", "distance"])

    kinds = ", ".join(f"`{c}` {records.schema[c].dataType.simpleString()}" for c in keys)
    members = vectors.mapInArrow(assign, f"{kinds}, cluster int, distance double")
    by = [*([within] if within else []), "cluster"]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The members of a batch nearest their centre; the first of a cluster carries count and squares of all in the batch."""
        for batch in assign(batches):
            order = pa.compute.sort_indices(batch, sort_keys=[*((c, "ascending") for c in by), ("distance", "ascending"), *((c, "ascending") for c in keys)])
            batch = batch.take(order)
            new = np.ones(batch.num_rows, dtype=bool)
            new[1:] = np.any([pa.compute.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False) for v in map(batch.column, by)], axis=0)
            first = np.flatnonzero(new)
            size = np.diff(np.r_[first, batch.num_rows])
            place = np.arange(batch.num_rows) - np.repeat(first, size)
            n, d2 = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows)
            n[first] = size
            d2[first] = np.add.reduceat(batch.column("distance").to_numpy() ** 2, first)
            yield batch.append_column("n", pa.array(n)).append_column("d2", pa.array(d2)).filter(pa.array(place < typical))

    near = scratch.written(vectors.mapInArrow(nearest, f"{kinds}, cluster int, distance double, n bigint, d2 double"), "near")
    sizes = near.groupBy(*by).agg(F.sum("n").alias("size"), F.sqrt(F.sum("d2") / F.sum("n")).alias("spread"))
    order = Window.partitionBy(*by).orderBy("distance", *keys)
    best = near.withColumn("i_", F.row_number().over(order)).where(F.col("i_") <= typical)
    listed = best.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("distance", *keys))).alias("typical"))
    return members, sizes.join(listed, by)


def typical_members(records: DataFrame, members: DataFrame, by: list[str], keys: list[str], numbers: list[str], typical: int = 3) -> DataFrame:
    """``(*by, size, typical)`` of given ``members (*keys, *by)``: the members nearest the mean of ``numbers``, ties by key.

    ``typical`` holds structs of the distance and the keys, as in :func:`similarity_clusters`. Rows delivered twice count once.
    """
    values = [F.col(f"`{c}`").cast("double").alias(f"v{i}_") for i, c in enumerate(numbers)]
    once = records.select(*keys, *values).dropDuplicates(keys)
    placed = scratch.written(members.join(once, keys), "placed")
    mean = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("size"), *(F.avg(f"v{i}_").alias(f"m{i}_") for i in range(len(numbers))))
    distance = F.sqrt(sum(((F.col(f"v{i}_") - F.col(f"m{i}_")) ** 2 for i in range(len(numbers))), F.lit(0.0)))
    order = Window.partitionBy(*by).orderBy("distance", *keys)
    ranked = placed.join(mean, by).withColumn("distance", distance).withColumn("i_", F.row_number().over(order)).where(F.col("i_") <= typical)
    return ranked.groupBy(*by).agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("distance", *keys))).alias("typical"))
