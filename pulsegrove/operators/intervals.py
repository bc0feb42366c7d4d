"""Joins of points with intervals, and greedy thinning of points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pulsegrove.operators.in_order import with_last_known
from pulsegrove.session import cut


def within(points: DataFrame, intervals: DataFrame, by: str, at: str, start: str, stop: str, width: int) -> DataFrame:
    """Every pair of a point and an interval of the same ``by`` with start <= at <= stop.

    Intervals are spread over the cells of ``width`` that they touch and met by the points' cells in an equi-join, so
    only points near an interval are compared with it. ``width`` should be about an interval's length.
    """
    cells = intervals.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))))
    held = points.withColumn("_cell", F.floor(F.col(at) / width))
    return held.join(cells, [by, "_cell"]).where(F.col(at).between(F.col(start), F.col(stop))).drop("_cell")


#: A block spans this many of the least distances, so it holds at most that many kept points, and few can be its first.
SPAN = 64


def _walk(pdf: pd.DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's times in order, and for each the next point that would be kept, as an index (their number if it is beyond the block)."""
    ts = np.sort(pdf["t"].to_numpy())
    return ts, np.searchsorted(ts, ts + least)


def thinned(points: DataFrame, by: str, at: str, least: int) -> DataFrame:
    """by, at of the points kept greedily: each at least ``least`` after the last one kept; ``at`` is whole.

    Distinct times are cut into blocks of ``SPAN * least``. A block sums up, for each point that can be its first kept one
    (those less than ``least`` from its start, the one after them, and the first one), which point is its last kept one and where the walk
    enters the blocks after it; from there on pointers double in length until they reach the end, so a key's walk takes as
    many rounds as the logarithm of its blocks. A last pass walks each block from its entry. A block holds at most as many
    times as it spans.
    """
    width = SPAN * least
    times = cut(points.where(F.col(at).isNotNull() & F.col(by).isNotNull()).select(F.col(by).alias("by"), F.col(at).cast("long").alias("t")).distinct().withColumn("block", F.floor(F.col("t") / width)))

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        ts, ahead = _walk(pdf, least)
        last = np.arange(len(ts))
        for i in range(len(ts) - 1, -1, -1):
            if ahead[i] < len(ts):
                last[i] = last[ahead[i]]
        begin = pdf["block"].iloc[0] * width + least
        first = (ts < begin) | np.isin(np.arange(len(ts)), [0, np.searchsorted(ts, begin)])
        return pd.DataFrame({"by": pdf["by"].iloc[0], "t": ts[first], "ready": ts[last[first]] + least})

    steps = times.groupBy("by", "block").applyInPandas(entries, f"by {dict(times.dtypes)['by']}, t long, ready long")
    # the entry that a walk ready at a time takes is the first time from then on
    marks = times.select("by", F.col("t").alias("k"), F.lit(1).alias("side"), F.lit(None).cast("struct<t:bigint>").alias("walk"))
    asked = steps.select("by", F.col("ready").alias("k"), F.lit(0).alias("side"), F.struct("t").alias("walk"))
    met = with_last_known(marks.unionByName(asked), "by", F.floor(F.col("k") / width), ["k", "side"], F.when(F.col("side") == 1, F.col("k")), "to", descending=True)
    jumps = cut(met.where("side = 0").select("by", F.col("walk.t").alias("t"), "to").withColumn("on", F.lit(False)))
    starts = times.groupBy("by").agg(F.min("t").alias("t"), F.lit(True).alias("first"))
    jumps = jumps.join(starts, ["by", "t"], "left").select("by", "t", "to", F.coalesce("first", F.lit(False)).alias("on"))
    while True:
        # whoever the reached ones point to is reached; then every pointer takes that of its target
        reached = jumps.where("on and to is not null").select("by", F.col("to").alias("t"), F.lit(True).alias("hit")).distinct()
        further = jumps.select("by", F.col("t").alias("to"), F.col("to").alias("far"))
        live = Observation()
        step = jumps.join(reached, ["by", "t"], "left").join(further, ["by", "to"], "left").select("by", "t", F.col("far").alias("to"), (F.col("on") | F.coalesce("hit", F.lit(False))).alias("on"))
        jumps = cut(step.observe(live, F.coalesce(F.bool_or(F.col("to").isNotNull()), F.lit(False)).alias("any")))
        if not live.get["any"]:
            break
    begun = jumps.where("on").select("by", F.floor(F.col("t") / width).alias("block"), F.col("t").alias("begin"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        ts, ahead = _walk(pdf, least)
        i, kept = int(np.searchsorted(ts, pdf["begin"].iloc[0])), []
        while i < len(ts):
            kept.append(ts[i])
            i = ahead[i]
        return pd.DataFrame({by: [pdf["by"].iloc[0]] * len(kept), at: kept})

    return times.join(begun, ["by", "block"]).groupBy("by", "block").applyInPandas(walk, f"{by} {dict(times.dtypes)['by']}, {at} long")
