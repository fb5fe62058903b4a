"""The k most similar vectors of every query vector by multi-probe p-stable hashing.

A table hashes a vector by Gaussian (2-stable) directions, each cut into slots of a width fitted to the key's spread and number
of vectors. Every vector is filed once per table; a query goes to its own bucket and to perturbed ones in the order of their
estimated success, the squared distance to the slot borders that a perturbation crosses. Buckets are compared exactly, and the
best of all probes and tables are merged and ranked by exact distance.

Two liberties are taken with the scheme. The Gaussian directions of a table are made orthonormal, so a bucket not visited is at
least its border distance away, and with 2^hashes probes all neighbours nearer than half a slot are found; of ``DRAWS`` such draws
the one along which the vectors spread most is kept. And slots have no random offset. Hash functions are so no longer
independent of the data; recall is measured and not derived.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointlake.plans import scratch

#: Rows of a task, rows beyond which a bucket is cut by row id, and distances computed at a time.
TASK_ROWS, BUCKET_MOST, DISTANCES = 150_000, 200_000, 2_000_000
#: Draws among which a table takes the directions along which the vectors spread most.
DRAWS = 64
#: Widest vectors whose moments are columns; those of wider ones are summed in Arrow batches.
WIDE = 16


def _directions(covariance: np.ndarray, tables: int, hashes: int, seed: int) -> np.ndarray:
    """Gaussian directions (tables, hashes, dimensions), orthonormal in each table; of several draws the best spread."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(tables):
        draws = [np.linalg.qr(rng.standard_normal((len(covariance), hashes)))[0].T for _ in range(DRAWS)]
        out.append(max(draws, key=lambda a: np.linalg.slogdet(a @ covariance @ a.T + 1e-12 * np.eye(hashes))[1]))
    return np.array(out)


def _pooled(vectors: DataFrame, dims: int) -> np.ndarray:
    """The covariance of all vectors, from sums of products per task; only its entries reach the driver."""
    size = 1 + dims + dims * dims

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy() for i in range(dims)])
            total += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "s"])

    rows = vectors.mapInArrow(sums, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros(size)
    out[rows["i"].to_numpy()] = rows["s"].to_numpy()
    n = max(1.0, out[0])
    mean = out[1 : 1 + dims] / n
    return out[1 + dims :].reshape(dims, dims) / n - np.outer(mean, mean)


def _dot(values: list[float], columns: list[Column]) -> Column:
    return reduce(add, (F.lit(float(v)) * c for v, c in zip(values, columns)))


def _search(groups: list[str], dims: int, k: int, key: str, self_match: bool):
    columns = [f"v{i}" for i in range(dims)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        whole = pa.Table.from_batches(parts)
        asked = whole["asked"].to_numpy()
        if not asked.any():
            return
        names, name_of = np.unique(whole[key].to_numpy(), return_inverse=True)
        head = np.stack([name_of, *(whole[g].to_numpy() for g in groups)])
        ids = whole["id"].to_numpy()
        vectors = np.column_stack([whole[c].to_numpy() for c in columns])
        if np.abs(vectors).max() > 1e150:  # squares of these need a wider exponent
            vectors = vectors.astype(np.longdouble)
        rank = np.lexsort((ids, asked, *head[::-1]))
        head, ids, vectors, asked = head[:, rank], ids[rank], vectors[rank], asked[rank]
        cut = np.nonzero((head[:, 1:] != head[:, :-1]).any(axis=0))[0] + 1
        found = []
        for a, b in zip([0, *cut], [*cut, len(ids)]):
            m = a + int(np.searchsorted(asked[a:b], True))  # members first, then queries
            if m == a or m == b:
                continue
            first = np.r_[True, ids[a + 1 : m] != ids[a : m - 1]]  # rows delivered twice
            own, mine = vectors[a:m][first], ids[a:m][first]
            again = np.r_[True, ids[m + 1 : b] != ids[m : b - 1]]
            queries, theirs = vectors[m:b][again], ids[m:b][again]
            step = max(1, DISTANCES // len(own))
            for s in range(0, len(queries), step):
                q, who = queries[s : s + step], theirs[s : s + step]
                d = np.zeros((len(q), len(own)), dtype=vectors.dtype)
                for j in range(dims):
                    d += (q[:, j, None] - own[None, :, j]) ** 2
                if not self_match:
                    at = np.minimum(np.searchsorted(mine, who), len(mine) - 1)
                    same = np.nonzero(mine[at] == who)[0]
                    d[same, at[same]] = np.inf
                limit = np.partition(d, k - 1, axis=1)[:, k - 1] if len(own) > k else np.full(len(q), np.inf)
                row, col = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
                dist = d[row, col]
                order = np.lexsort((mine[col], dist, row))
                row, col, dist = row[order], col[order], dist[order]
                start = np.searchsorted(row, np.arange(len(q)))
                kept = np.arange(len(row)) - start[row] < k
                found.append((np.full(kept.sum(), head[0, a]), who[row[kept]], mine[col[kept]], dist[kept]))
        if found:
            code, q, n, d = (np.concatenate(x) for x in zip(*found))
            far = np.sqrt(d).astype(float)
            with np.errstate(over="ignore"):
                d = d.astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(names[code], whole.schema.field(key).type), pa.array(q), pa.array(n), pa.array(d), pa.array(far)], names=[key, "id", "neighbour", "squared", "distance"])

    return search


def nearest_vectors(base: DataFrame, queries: DataFrame, vector: list[str], k: int, key: str = "cloud_id", row_id: str = "pid", tables: int = 2, hashes: int = 2, probes: int = 4, bucket_rows: int = 400, seed: int = 7) -> DataFrame:
    """``(key, row_id, neighbour, distance, rank)``: the ``k`` nearest of ``base`` for each of ``queries``, within equal keys.

    Both tables have ``key``, ``row_id`` (whole number) and the ``vector`` columns. A row is no neighbour of itself (equal id);
    at equal distance the smaller id comes first; equal vectors under several ids are different rows. Vectors with a null, NaN
    or infinite part and rows with a null key or id do not take part; rows delivered twice count once; a key with fewer than
    k other vectors gives fewer rows. Empty tables give an empty result; other columns are not read.

    ``tables`` hash tables of ``hashes`` directions, ``probes`` buckets visited in each, ``bucket_rows`` vectors in a bucket on
    average. Slot widths follow the moments of all vectors of a key, one aggregation; keys with few vectors have one bucket.
    Buckets beyond ``BUCKET_MOST`` rows are cut by row id and a query visits all parts, so none is dropped and no task holds
    an unbounded bucket.
    """
    if k < 1 or tables < 1 or hashes < 1 or not 1 <= probes <= 3**hashes or bucket_rows < 1:
        raise ValueError("k, tables, hashes and bucket_rows must be positive, probes between 1 and 3^hashes")
    spark = base.sparkSession
    dims = len(vector)
    v = [F.col(f"v{i}") for i in range(dims)]
    parts = [F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(vector)]
    usable = reduce(lambda a, b: a & b, (F.abs(c) < float("inf") for c in v)) & F.col(key).isNotNull() & F.col("id").isNotNull()
    tidy = lambda df: df.select(key, F.col(row_id).cast("bigint").alias("id"), *parts).where(usable)
    members, asked = tidy(base), tidy(queries)

    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    covariance = np.zeros((dims, dims))
    if dims <= WIDE:
        moments = scratch.written(members.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(F.covar_pop(v[i], v[j]).alias(f"c{i}_{j}") for i, j in pairs)), "moments")
        pooled = moments.agg(*(F.avg(F.col(f"c{i}_{j}")).alias(f"c{i}_{j}") for i, j in pairs)).first()
        for i, j in pairs:
            covariance[i, j] = covariance[j, i] = pooled[f"c{i}_{j}"] or 0.0
    else:
        covariance = _pooled(members.select(*v), dims)
    if not np.isfinite(covariance).all() or np.abs(covariance).max(initial=0) > 1e200:
        covariance = np.eye(dims)  # some key's spread has no measure: any directions do
    directions = _directions(covariance, tables, hashes, seed)
    if dims > WIDE:
        moments = scratch.written(members.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(F.var_pop(_dot(directions[t, h], v)).alias(f"s{t}_{h}") for t, h in product(range(tables), range(hashes)))), "moments")
    total = moments.agg(F.sum("n")).first()[0] or 0
    slots = F.pow(F.col("n") / bucket_rows, F.lit(1.0 / hashes))
    widths = []
    for t, h in product(range(tables), range(hashes)):
        a = directions[t, h]
        variance = F.col(f"s{t}_{h}") if dims > WIDE else reduce(add, (F.lit(float(a[i] * a[j] * (1 if i == j else 2))) * F.col(f"c{i}_{j}") for i, j in pairs))
        # four standard deviations hold nearly all of a key; a spread of nothing, or less than two slots, is one slot
        widths.append(F.when((slots >= 1.5) & (variance > 0) & (variance < 1e300), 4 * F.sqrt(variance) / slots).alias(f"w{t}_{h}"))
    fitted = moments.select(key, *widths)

    place = lambda t, h: _dot(directions[t, h], v) / F.col(f"w{t}_{h}")
    slot = lambda t, h: F.coalesce(F.floor(place(t, h)), F.lit(0).cast("bigint"))
    head = ["table", *(f"b{h}" for h in range(hashes))]
    bucket = lambda t, shift, score: F.struct(F.lit(t).alias("table"), *((slot(t, h) + shift[h]).alias(f"b{h}") for h in range(hashes)), score.alias("score"))
    ids = [key, "id", *(f"v{i}" for i in range(dims))]
    filed = members.join(fitted, key).select(*ids, F.explode(F.array(*(bucket(t, [0] * hashes, F.lit(0.0)) for t in range(tables)))).alias("b"))
    filed = filed.select(*ids, *(f"b.{c}" for c in head))

    def visited(t: int) -> Column:
        """Buckets of a query in table t, those crossed at least distance first; border distances in squared length."""
        choices = []
        for shift in product((0, -1, 1), repeat=hashes):
            inside = [place(t, h) - F.floor(place(t, h)) for h in range(hashes)]
            cost = [F.lit(0.0) if s == 0 else F.pow((inside[h] if s < 0 else 1 - inside[h]) * F.col(f"w{t}_{h}"), F.lit(2.0)) for h, s in enumerate(shift)]
            # a direction of one slot has no neighbours
            open_ = reduce(lambda a, b: a & b, (F.col(f"w{t}_{h}").isNotNull() for h, s in enumerate(shift) if s), F.lit(True))
            choices.append(F.when(open_, bucket(t, shift, reduce(add, cost))))
        ordered = F.array_sort(F.array_compact(F.array(*choices)), lambda x, y: F.when(x["score"] < y["score"], -1).when(x["score"] > y["score"], 1).otherwise(0))
        return F.slice(ordered, 1, probes)

    sent = asked.join(fitted, key).select(*ids, F.explode(F.concat(*(visited(t) for t in range(tables)))).alias("b")).select(*ids, *(f"b.{c}" for c in head))
    where = [key, *head]
    hot = scratch.written(filed.groupBy(*where).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET_MOST).select(*where, F.ceil(F.col("n") / BUCKET_MOST).cast("int").alias("pieces")), "hot")
    if hot.isEmpty():
        filed, sent = filed.withColumn("piece", F.lit(0)), sent.withColumn("piece", F.lit(0))
    else:
        filed = filed.join(hot, where, "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"), F.lit(0))).drop("pieces")
        sent = sent.join(hot, where, "left").withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("pieces") - 1, F.lit(0))))).drop("pieces")
    both = filed.withColumn("asked", F.lit(False)).unionByName(sent.withColumn("asked", F.lit(True)))
    tasks = max(spark.sparkContext.defaultParallelism, -(-total * tables // TASK_ROWS))
    groups = [*head, "piece"]
    kind = base.schema[key].dataType.simpleString()
    near = both.repartition(tasks, key, *groups).mapInArrow(_search(groups, dims, k, key, False), f"`{key}` {kind}, id bigint, neighbour bigint, squared double, distance double")
    merged = near.groupBy(key, "id", "neighbour").agg(F.min("squared").alias("squared"), F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy(key, "id").orderBy("squared", "distance", "neighbour"))
    best = merged.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select(key, F.col("id").alias(row_id), "neighbour", "distance", "rank")
