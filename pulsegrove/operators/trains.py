"""Pulse trains: events from written times, triggers, how regular a train is, and which of several detections to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrove.operators.intervals import thinned
from pulsegrove.operators.windows import medians, onsets, value_counts

#: What a way of finding events costs beforehand; any other one costs ``OTHER``.
PENALTIES, OTHER = {"annotations": 0.0, "trigger": 0.0, "adjacent": 0.02, "consensus": 0.025, "adjacent_adaptive": 0.04, "consensus_adaptive": 0.045}, 0.05
#: How far a pulse's interval may be off; bounds of the median interval and of the count, as parts of the expected ones.
TOLERANCE, INTERVALS, COUNTS, REGULAR = 0.12, (0.65, 1.5), (0.5, 1.5), 0.65


def from_times(rows: DataFrame, key: str, at: str, label: str) -> DataFrame:
    """key, at, label, number: each time of a key once (the smallest label of repeats), numbered in order from 1 within the key.

    A key is a recording, whose events are few.
    """
    one = rows.where(F.col(at).isNotNull()).groupBy(key, at).agg(F.min(label).alias(label))
    return one.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy(at)))


def triggers(samples: DataFrame, block: Column, refractory: int) -> DataFrame:
    """channel, k: where a channel rises through the middle of its range, at least ``refractory`` steps after the last one kept."""
    middle = samples.where("value is not null").groupBy("channel").agg(((F.min("value") + F.max("value")) / 2).alias("_mid"))
    on = onsets(samples.join(middle, "channel"), "channel", block, ["k"], F.col("value") >= F.col("_mid"))
    return thinned(on.where("edge = 'rising'"), "channel", "k", refractory)


def regularity(events: DataFrame, key: list[str], at: str, interval: str) -> DataFrame:
    """key, n, median_interval, cadence_error, regular: how well a train's events follow each other at the expected interval.

    An interval may span several pulses; its error is that of one pulse's share. ``interval`` is a column of the events.
    """
    step = events.withColumn("_d", F.col(at) - F.lag(at).over(Window.partitionBy(*key).orderBy(at)))
    pulses = F.greatest(F.rint(F.col("_d") / F.col(interval)), F.lit(1.0))
    off = F.abs(F.col("_d") / pulses - F.col(interval)) / F.col(interval)
    known = step.withColumn("_e", F.when(F.col("_d") > 0, off))
    out = known.groupBy(*key).agg(F.count("*").alias("n"), F.avg("_e").alias("cadence_error"), F.avg(F.when(F.col("_e").isNotNull(), (F.col("_e") <= TOLERANCE).cast("double"))).alias("regular"))
    middle = medians(value_counts(known.where("_d > 0"), key, "_d"), key, "median_interval")
    return out.join(middle, key, "left").select(*key, "n", "median_interval", "cadence_error", "regular")


def candidate_scores(trains: DataFrame, method: str, interval: str, expected: str) -> DataFrame:
    """``trains`` (of ``regularity``, with the way they were found and the expected interval and count) with score and plausible.

    The score adds the count's error, a quarter of the cadence's and the way's own penalty; the lower the better.
    """
    penalty = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in PENALTIES.items() for x in pair)), F.col(method)), F.lit(OTHER))
    count = F.when(F.col(expected) > 0, F.abs(F.col("n") - F.col(expected)) / F.col(expected)).otherwise(0.0)
    ratio = F.col("median_interval") / F.col(interval)
    fits = F.coalesce(ratio.between(*INTERVALS), F.lit(True)) & ((F.col("n") < 4) | (F.col("regular") >= REGULAR))
    low, high = F.greatest(F.floor(F.col(expected) * COUNTS[0]), F.lit(2)), F.ceil(F.col(expected) * COUNTS[1]) + 1
    counted = (F.coalesce(F.col(expected), F.lit(0.0)) < 3) | F.col("n").between(low, high)
    return trains.withColumns({"score": count + 0.25 * F.coalesce("cadence_error", F.lit(0.0)) + penalty, "plausible": (F.col("n") > 0) & fits & counted})


def best_candidates(scored: DataFrame, key: list[str], method: str) -> DataFrame:
    """The plausible candidate of each key with the lowest score, the first way by name of equals."""
    rest = [c for c in scored.columns if c not in key]
    return scored.where("plausible").groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("score", method)).alias("_b")).select(*key, "_b.*")


def overlapping(files: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """wanted's rows with each file of the same key that overlaps them (start <= w_stop and stop > w_start), all files of the key if none does."""
    pairs = wanted.join(files, key).withColumn("_hit", F.coalesce((F.col("start") <= F.col("w_stop")) & (F.col("stop") > F.col("w_start")), F.lit(False)))
    any_ = pairs.groupBy("w_id").agg(F.bool_or("_hit").alias("_any"))
    return pairs.join(any_, "w_id").where(F.col("_hit") | ~F.col("_any")).select("w_id", "file_id", F.col("_any").alias("overlaps"))
