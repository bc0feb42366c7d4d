"""Streams of pulses and samples: window statistics, session clusters, duplicates, onsets and thinning.

Batch twins are in ``operators``; on a finished input both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_time(events: DataFrame, ts: str, late: str) -> DataFrame:
    """``events`` with ``ts`` as a timestamp (a stream's event time needs one) and a watermark for rows up to ``late`` late."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def window_statistics(events: DataFrame, channel: str, ts: str, value: str, size: str, slide: str | None = None) -> DataFrame:
    """Per channel and (tumbling or sliding) window: n, mean, sample deviation, least and greatest value."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = events.groupBy(F.col(channel).alias("channel"), window.alias("w")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select("channel", F.col("w.start").alias("start"), "n", "mean", "std", "least", "most")


def session_clusters(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Per key: clusters of events that follow each other within ``gap``, as start, stop and n."""
    return events.groupBy(F.col(key).alias("key"), F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("stop")).select("key", "start", "stop", "n")


def without_repeats(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each event once, however often it is sent within the watermark."""
    return events.dropDuplicatesWithinWatermark(keys)


def _in_order(rows: DataFrame, ts: str, at: str, extra: str, schema: str, carry: str, step: Callable[[Any, list[tuple]], tuple[Any, list[tuple]]]) -> DataFrame:
    """Rows of key, ``ts`` (watermarked), ``at`` and ``extra`` through ``step`` key by key, in order of event time, then ``at``.

    A row waits in the state until the watermark has passed it, so results do not depend on how micro-batches fall; a
    timer on event time wakes keys that get no more rows. Rows older than the watermark are late and left out. ``step``
    takes what is carried from row to row (null at first) and rows (at, extra), and gives what is carried on and rows out.
    """
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(keys: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, carried = (list(zip(*(state.get[i] for i in range(3)))), state.get[3]) if state.exists else ([], None)
        mark = state.getCurrentWatermarkMs()
        for pdf in batches:
            ms = pdf[ts].astype("datetime64[ms]").astype("int64")
            waiting += [(int(m), int(a), bool(x)) for m, a, x in zip(ms, pdf[at], pdf[extra].fillna(False)) if m > mark]
        waiting.sort()
        ready = [w for w in waiting if w[0] <= mark]
        carried, out = step(carried, [w[1:] for w in ready])
        waiting = waiting[len(ready) :]
        state.update(([w[0] for w in waiting], [w[1] for w in waiting], [w[2] for w in waiting], carried))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0], mark + 1))
        yield pd.DataFrame([(keys[0], *r) for r in out], columns=names)

    kept = f"ms array<bigint>, at array<bigint>, extra array<boolean>, carried {carry}"
    return rows.groupBy("key").applyInPandasWithState(run, schema, kept, "append", GroupStateTimeout.EventTimeTimeout)


def onsets(samples: DataFrame, key: str, ts: str, at: str, active: str) -> DataFrame:
    """key, at, edge where ``active`` (boolean) changes: what is carried is each key's last level."""

    def step(level: bool | None, rows: list[tuple]) -> tuple[Any, list[tuple]]:
        out = []
        for at_, on in rows:
            if on != bool(level):
                out.append((at_, "rising" if on else "falling"))
            level = on
        return level, out

    rows = samples.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(at).alias("at"), F.col(active).alias("on"))
    return _in_order(rows, "ts", "at", "on", "key string, at long, edge string", "boolean", step)


def thinned(pulses: DataFrame, key: str, ts: str, at: str, least: int) -> DataFrame:
    """key, at of the pulses at least ``least`` after the last one kept: what is carried is that one's time."""

    def step(last: int | None, rows: list[tuple]) -> tuple[Any, list[tuple]]:
        out = []
        for at_, _ in rows:
            if last is None or at_ - last >= least:
                out.append((at_,))
                last = at_
        return last, out

    rows = pulses.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(at).alias("at"), F.lit(True).alias("on"))
    return _in_order(rows, "ts", "at", "on", "key string, at long", "bigint", step)
