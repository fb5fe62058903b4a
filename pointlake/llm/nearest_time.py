"""Matching records of two tables by nearest time within a tolerance.

Right-side times become intervals: each reaches to the midpoints towards its neighbours and no further than the tolerance,
so intervals of one entity never overlap and a left time lies in at most one. The range join is then an equality join on
(entity, time bucket) with an interval filed under the one or two buckets it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONG = 2**63 - 1


def topic_key(topic: Column) -> Column:
    """Topics that differ only in letter case, outer blanks or outer slashes get one key; null stays null."""
    return F.lower(F.regexp_replace(topic, r"^[ \t/]+|[ \t/]+\z", ""))


def _bucket(time: Column, width: int) -> Column:
    """Floor of time / width in whole numbers."""
    return F.call_function("div", time - F.pmod(time, F.lit(width)), F.lit(width))


def nearest_in_time(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_key: Column, right_key: Column, time: str, tolerance: int, span: int = 512) -> DataFrame:
    """``(left_id, right_id)``: for each left row the right row of the same key whose time is nearest, if within ``tolerance``.

    At equal difference the earlier right row is taken, of right rows at one time that with the smallest id. A right row may
    serve several left rows. Rows with a null key or time do not take part; rows delivered twice count once. Times are whole
    numbers of 64 bits; those within two spans of the ends of that range are no times and do not take part. Where a left id comes
    with several times or keys, the match of least difference is taken. Empty tables give an empty result; other columns are
    not looked at.

    Neighbours of right rows are found by windows over (key, span of ``span`` tolerances) to which rows within two tolerances
    of its ends are copied, so that a key with any share of the rows is split by time; before that, rows of one key and time
    are aggregated to one.
    """
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    if span < 2:
        raise ValueError("a span must hold at least two tolerances")
    width = max(1, 2 * tolerance)
    chunk = max(1, tolerance) * span
    t = F.col("t")
    usable = F.col("k").isNotNull() & t.between(-LONG + 2 * chunk, LONG - 2 * chunk)
    once = right.select(right_key.alias("k"), F.col(time).cast("bigint").alias("t"), F.col(right_id).alias("r")).where(usable).groupBy("k", "t").agg(F.min("r").alias("r"))
    home = t - F.pmod(t, F.lit(chunk))
    low_copy = F.when(t - home <= 2 * tolerance, home - chunk)
    high_copy = F.when(F.lit(chunk) - (t - home) <= 2 * tolerance, home + chunk)
    copies = once.select("k", "t", "r", home.alias("home"), F.explode(F.array_compact(F.array(home, low_copy, high_copy))).alias("part"))
    order = Window.partitionBy("k", "part").orderBy("t")
    beside = copies.withColumns({"before": F.lag("t").over(order), "after": F.lead("t").over(order)}).where("part = home")
    gap_before, gap_after = t - F.col("before"), F.col("after") - t
    half = lambda gap: F.shiftright(gap, 1)
    low = F.greatest(F.col("before") + half(gap_before) + 1, t - tolerance)
    high = F.least(t + half(gap_after), t + tolerance)
    spans = beside.select("k", "r", t.alias("rt"), low.alias("low"), high.alias("high"))
    filed = spans.select("k", "r", "rt", "low", "high", F.explode(F.sequence(_bucket(F.col("low"), width), _bucket(F.col("high"), width))).alias("b"))
    asked = left.select(left_key.alias("k"), F.col(time).cast("bigint").alias("t"), F.col(left_id).alias("l")).where(usable).withColumn("b", _bucket(t, width))
    hits = asked.join(filed, ["k", "b"]).where("t BETWEEN low AND high")
    best = hits.groupBy("l").agg(F.min(F.struct(F.abs(t - F.col("rt")).alias("gap"), "rt", "r")).alias("m"))
    return best.select(F.col("l").alias(left_id), F.col("m.r").alias(right_id))
