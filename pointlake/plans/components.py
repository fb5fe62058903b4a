"""Connected components: vectorised within a task, by contraction across tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.plans import scratch

#: Most edges that one task solves; more are first contracted by distributed rounds.
LOCAL_EDGES = 1_000_000


def labels(n: int, a: np.ndarray, b: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """The smallest node of each node's component, of nodes 0..n-1 and edges a-b; ``start`` holds labels found before."""
    own = np.arange(n) if start is None else start.copy()
    while True:
        x, y = own[a], own[b]
        apart = x != y
        if not apart.any():
            return own
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(own, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = own[own]
            if (up == own).all():
                break
            own = up


def _solve(keys: list[str]):
    def solve(edges: pd.DataFrame) -> pd.DataFrame:
        sides = [edges[[*keys, c]].rename(columns={c: "node"}) for c in ("u", "v")]
        both = pd.concat(sides, ignore_index=True)
        code, nodes = pd.factorize(pd.MultiIndex.from_frame(both))
        frame = nodes.to_frame(index=False)
        frame.columns = [*keys, "node"]
        # numbered by node, so that the smallest number is the smallest node
        rank = np.empty(len(frame), dtype=np.int64)
        order = np.argsort(frame["node"].to_numpy(), kind="stable")
        rank[order] = np.arange(len(frame))
        code = rank[code]
        own = labels(len(frame), code[: len(edges)], code[len(edges) :])
        frame["root"] = frame["node"].to_numpy()[order][own[rank]]
        return frame

    return solve


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, node, root)``: of every node of the edges ``(*keys, u, v)`` the smallest node of its component.

    Node ids are BIGINT and belong together only under equal keys. Edges with a null end are left out. While there are more
    than ``LOCAL_EDGES`` different ones, every node joins the neighbour of least random priority (a minimum with map-side
    combination), which shrinks the graph by a constant factor a round whatever its shape; each round is written to the shared
    folder. What is left is solved by one task, its size having been counted.
    """
    kind = ", ".join(f"`{k}` {edges.schema[k].dataType.simpleString()}" for k in keys)
    tidy = lambda e: e.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    left = scratch.written(tidy(edges), "edges")
    joined: DataFrame | None = None  # (*keys, node, at): where every node met so far has gone
    turn = 0
    while left.count() > LOCAL_EDGES:
        turn += 1
        priority = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("p"), c.alias("n"))  # noqa: B023, E731
        both = left.select(*keys, F.col("u").alias("node"), F.col("v").alias("other")).unionAll(left.select(*keys, F.col("v"), F.col("u")))
        least = both.groupBy(*keys, "node").agg(F.least(F.min(priority(F.col("other"))), F.first(priority(F.col("node")))).alias("m"))
        moves = scratch.written(least.select(*keys, "node", F.col("m.n").alias("at")), "moves")
        ends = left
        for c in ("u", "v"):
            ends = ends.join(moves.withColumnsRenamed({"node": c, "at": f"to_{c}"}), [*keys, c])
        shrunk = scratch.written(tidy(ends.select(*keys, F.col("to_u").alias("u"), F.col("to_v").alias("v"))), "edges")
        if joined is None:
            joined = moves
        else:
            further = joined.join(moves.select(*keys, F.col("at").alias("next"), F.col("node").alias("at")), [*keys, "at"], "left").select(*keys, "node", F.coalesce("next", "at").alias("at"))
            fresh = moves.join(joined, [*keys, "node"], "left_anti")
            older, joined = joined, scratch.written(further.unionByName(fresh), "joined")
            scratch.drop(older)
        scratch.drop(left)
        left = shrunk
    solved = left.groupBy(F.lit("all")).applyInPandas(_solve(keys), f"{kind}, node bigint, root bigint")
    if joined is None:
        return solved
    # contraction follows priorities, so roots are renamed to the smallest node at the end
    far = joined.join(solved.withColumnsRenamed({"node": "at"}), [*keys, "at"], "left").select(*keys, "node", F.coalesce("root", "at").alias("root"))
    smallest = far.groupBy(*keys, "root").agg(F.min("node").alias("low"))
    return far.join(smallest, [*keys, "root"]).select(*keys, "node", F.least("low", "root").alias("root"))
