"""Event-aligned samples: grids, as-of matches, epochs, baselines and mean responses.

Samples are rows of channel, k (sample index) and value; missing samples are absent or null, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrove.operators.in_order import with_last_known, with_previous

EPS = 1e-12


def sample_index(ts: str, step: str = "HOUR") -> Column:
    """Whole steps since 1970-01-01 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff({step}, timestamp_ntz'1970-01-01 00:00:00', cast({ts} AS timestamp_ntz))")


def regular_grid(readings: DataFrame, channel: str, k: Column, value: str) -> DataFrame:
    """channel, k, value: the mean of the finite readings of each channel in each step."""
    finite = F.when(~F.isnan(value), F.col(value))
    return readings.groupBy(F.col(channel).alias("channel"), k.alias("k")).agg(F.avg(finite).alias("value"))


def asof(left: DataFrame, right: DataFrame, by: str, at: str, value: str, block: Column, forward: bool = False) -> DataFrame:
    """``left`` with ``value`` (and its time ``matched_at``) of the last row of ``right`` at or before each row of the same ``by``.

    ``forward``: the first row at or after. ``block`` is an expression of ``at`` that rises with it, such as the day. No
    key is sorted as a whole, so one may hold any share of the rows. Rows without a match come out with nulls. Among
    several rows of ``right`` at one time the greatest value counts.
    """
    points = right.where(F.col(at).isNotNull()).groupBy(by, at).agg(F.max(value).alias("_v"))
    marks = points.select(by, at, F.struct(F.col(at).alias("t"), F.col("_v").alias("v")).alias("_mark"), F.lit(1 if forward else 0).alias("_side"))
    rows = left.withColumn("_row", F.struct(*left.columns)).select(by, at, "_row", F.lit(0 if forward else 1).alias("_side"))
    both = marks.unionByName(rows, allowMissingColumns=True)
    known = with_last_known(both, by, block, [at, "_side"], F.col("_mark"), "_hit", descending=forward)
    return known.where(F.col("_row").isNotNull()).select("_row.*", F.col("_hit.t").alias("matched_at"), F.col("_hit.v").alias(f"matched_{value}"))


def epochs(samples: DataFrame, anchors: DataFrame, before: int, after: int, recording: Column | None = None, extent: DataFrame | None = None) -> DataFrame:
    """epoch, channel, offset, value: the samples from ``before`` steps ahead of each anchor k to ``after`` steps past it.

    An equi-join on (k): every anchor is spread over its offsets, so nothing is compared that does not match. Epochs that
    overrun their recording's first or last sample are left out; ``recording`` tells recordings apart by k (one, if none),
    and ``extent`` has the k of their ends where reading them from ``samples`` costs more.
    """
    part = (F.lit(0) if recording is None else recording).cast("long").alias("_part")
    spans = (samples if extent is None else extent).groupBy(part).agg(F.min("k").alias("_lo"), F.max("k").alias("_hi"))
    whole = anchors.select("k", part).join(spans, "_part").where((F.col("k") - before >= F.col("_lo")) & (F.col("k") + after <= F.col("_hi")))
    spread = whole.select(F.col("k").alias("epoch"), F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset")).withColumn("k", F.col("epoch") + F.col("offset"))
    return spread.join(samples, "k").select("epoch", "channel", "offset", "value")


def baseline_centered(epoched: DataFrame, start: int, stop: int) -> DataFrame:
    """``epoched`` less the mean of each trial and channel over the offsets from ``start`` to ``stop``."""
    trial = Window.partitionBy("epoch", "channel")
    return epoched.withColumn("value", F.col("value") - F.avg(F.when(F.col("offset").between(start, stop), F.col("value"))).over(trial))


def mean_waveform(epoched: DataFrame) -> DataFrame:
    """channel, offset, n_trials, mean, std (sample), sem across trials."""
    n, std = F.count("value"), F.stddev_samp("value")
    return epoched.groupBy("channel", "offset").agg(n.alias("n_trials"), F.avg("value").alias("mean"), std.alias("std"), (std / F.sqrt(n)).alias("sem"))


def responses(waveform: DataFrame, base: tuple[int, int], reply: tuple[int, int], threshold: float) -> DataFrame:
    """Per channel: the peak of the mean response (first of equals), its offset, RMS, area, and z against the baseline."""
    within, prior = F.col("offset").between(*reply), F.col("offset").between(*base)
    inside = F.when(within, F.col("mean"))
    peak = F.max_by(F.struct("mean", "offset"), F.when(within, F.struct(F.abs("mean").alias("a"), (-F.col("offset")).alias("o"))))
    out = waveform.groupBy("channel").agg(
        peak.alias("p"), F.sqrt(F.avg(inside * inside)).alias("rms"), F.sum(F.abs(inside)).alias("area"),
        F.avg(F.when(prior, F.col("mean"))).alias("base_mean"), (F.stddev_samp(F.when(prior, F.col("mean"))) + EPS).alias("base_std"),
    )
    z = F.abs(F.col("p.mean") - F.col("base_mean")) / F.col("base_std")
    return out.select("channel", F.col("p.mean").alias("peak"), F.col("p.offset").alias("latency"), "rms", "area", z.alias("z"), (z >= threshold).alias("significant"))


def interpolated(samples: DataFrame, block: Column) -> DataFrame:
    """``samples`` with null values filled linearly between neighbours, at the ends by the nearest value."""
    point = F.when(F.col("value").isNotNull(), F.struct("k", "value"))
    both = with_last_known(with_last_known(samples, "channel", block, ["k"], point, "_p"), "channel", block, ["k"], point, "_n", descending=True)
    p, n = F.col("_p"), F.col("_n")
    line = p["value"] + (n["value"] - p["value"]) * (F.col("k") - p["k"]) / (n["k"] - p["k"])
    return both.withColumn("filled", F.coalesce("value", F.when(p.isNotNull() & n.isNotNull(), line), p["value"], n["value"])).drop("_p", "_n")


def lines(samples: DataFrame, session: str, block: Column) -> DataFrame:
    """session, channel, k, value, k_before, value_before: each value with the one before it of its channel and session, null at the first."""
    known = samples.where("value is not null").select(session, "channel", "k", "value")
    pairs = with_previous(known, [session, "channel"], block, ["k"], F.struct("k", "value"), "_p")
    return pairs.select(session, "channel", "k", "value", F.col("_p.k").alias("k_before"), F.col("_p.value").alias("value_before"))


def bridged(samples: DataFrame, session: str, block: Column) -> DataFrame:
    """``samples`` with values and rows on the line between each two neighbours of a channel and session; none beyond the ends."""
    k, value, at, was = (F.col(c) for c in ("k", "value", "k_before", "value_before"))
    steps = lines(samples, session, block).withColumn("_k", F.explode(F.when(at.isNull(), F.array(k)).otherwise(F.sequence(at + 1, k))))
    line = F.when(F.col("_k") == k, value).otherwise(was + (value - was) * (F.col("_k") - at) / (k - at))
    return steps.select(session, "channel", F.col("_k").alias("k"), line.alias("value"))


def blanked(samples: DataFrame, events: DataFrame, before: int, after: int, block: Column) -> DataFrame:
    """``samples`` with ``filled``: values from ``before`` steps ahead of any event k to ``after`` past it bridged linearly."""
    hit = events.select(F.explode(F.sequence(F.col("k") - before, F.col("k") + after)).alias("k")).distinct().withColumn("_hit", F.lit(True))
    masked = samples.join(hit, "k", "left").withColumn("value", F.when(F.col("_hit").isNull(), F.col("value"))).drop("_hit")
    return interpolated(masked, block)


def artifact_envelope(epoched: DataFrame) -> DataFrame:
    """epoch, offset, envelope: the 95th percentile over channels of the absolute value, the greatest of up to two."""
    size = F.abs("value")
    return epoched.groupBy("epoch", "offset").agg(F.when(F.count("value") > 2, F.percentile(size, 0.95)).otherwise(F.max(size)).alias("envelope"))
