"""Dependence between channels: coherence, Granger causality, and coupling of phase and amplitude."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pulsegrove.functions import kernels
from pulsegrove.operators.lagged import lagged_moments, merged_moments
from pulsegrove.operators.spectral import array_udf, phases
from pulsegrove.operators.stats import beta_tail, fit_of_sums


def coherence(epochs: DataFrame, trial: str, channel: str, rate: float, low: float, high: float) -> DataFrame:
    """a, b, coherence, imaginary: of each pair of channels over trials, averaged over the frequencies of a band.

    Each trial's Hann-windowed spectrum is one array; channels meet within a trial, and cross-spectra are averaged by pair
    and frequency.
    """

    def spectrum(x: np.ndarray) -> np.ndarray:
        z = np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * np.hanning(x.shape[1]), axis=1)
        return np.concatenate([z.real, z.imag], axis=1)

    own = epochs.select(trial, F.col(channel).alias("c"), F.size("y").alias("n"), array_udf(spectrum)("y").alias("z")).where("z is not null")
    half = (F.size("z") / 2).cast("int")
    bins = own.select(trial, "c", "n", F.posexplode(F.arrays_zip(F.slice("z", F.lit(1), half).alias("re"), F.slice("z", half + 1, half).alias("im"))).alias("i", "z"))
    bins = bins.select(trial, "c", "i", (F.col("i") * rate / F.col("n")).alias("freq"), "z.re", "z.im").where(F.col("freq").between(low, high))
    a, b = (bins.select(trial, "i", F.col("c").alias(s), F.col("re").alias(f"re_{s}"), F.col("im").alias(f"im_{s}")) for s in "ab")
    pairs = a.join(b, [trial, "i"]).where("a < b")
    power = lambda s: F.avg(F.col(f"re_{s}") * F.col(f"re_{s}") + F.col(f"im_{s}") * F.col(f"im_{s}")).alias(f"p_{s}")
    cross = pairs.groupBy("a", "b", "i").agg(power("a"), power("b"), F.avg(F.col("re_a") * F.col("re_b") + F.col("im_a") * F.col("im_b")).alias("re"), F.avg(F.col("im_a") * F.col("re_b") - F.col("re_a") * F.col("im_b")).alias("im"))
    both = F.col("p_a") * F.col("p_b")
    return cross.where(both > 0).groupBy("a", "b").agg(F.avg((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / both).alias("coherence"), F.avg(F.abs("im") / F.sqrt(both)).alias("imaginary"))


@F.pandas_udf(T.DoubleType())
def _f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([beta_tail(b / 2, a / 2, b / (b + a * x)) if pd.notna(x) and b > 0 else None for x, a, b in zip(f, d1, d2)], dtype=float)


def granger(samples: DataFrame, trial: str, order: int) -> DataFrame:
    """source, target, n, causality (log ratio of residual sums), p of every ordered pair of channels.

    Each target's value is fitted on its own last ``order`` values, with and without those of the source; lags never cross
    trials, and the fits need only each pair's sums of products. A trial has one row per channel and k.
    """
    ends = {"k_before": F.lit(None).cast("long"), "value_before": F.lit(None).cast("double")}
    return granger_over_lines(samples.withColumns(ends), trial, order)


#: Steps of a trial that one block of ``granger_over_lines`` holds.
LINE_BLOCK = 4096


def granger_over_lines(lines: DataFrame, trial: str, order: int, length: int = LINE_BLOCK) -> DataFrame:
    """``granger`` of the samples on ``epoching.lines``, which only the tasks that sum up their products spell out.

    A trial is cut into blocks of ``length`` steps, each with the ``order`` steps before it, so that a shuffle moves each
    line once per block that it touches; tasks return the moments of each pair of channels.
    """
    kind, arrow = lines.schema["channel"].dataType.simpleString(), to_arrow_type(lines.schema["channel"].dataType)
    first = F.coalesce(F.col("k_before") + 1, F.col("k"))
    blocks = F.explode(F.sequence(F.floor(first / length), F.floor((F.col("k") + order) / length)))
    known = lines.where(F.col(trial).isNotNull() & F.col("channel").isNotNull() & F.col("k").isNotNull())
    spread = known.select(F.col(trial).alias("trial"), blocks.alias("block"), "channel", first.cast("long").alias("first"), *(F.col(c).cast(t) for c, t in (("k_before", "long"), ("value_before", "double"), ("k", "long"), ("value", "double"))))
    parts = spread.repartition("trial", "block").sortWithinPartitions("trial", "block")
    schema = f"source {kind}, target {kind}, n long, m array<double>, s array<double>"
    moments = parts.mapInArrow(lambda batches: lagged_moments(batches, order, length, arrow), schema)
    whole = moments.groupBy("source", "target").applyInPandas(merged_moments, schema)
    ys, xs, width = [f"y{i}" for i in range(1, order + 1)], [f"x{i}" for i in range(1, order + 1)], 2 * order + 1
    names = ["y", *ys, *xs]
    at = lambda i, j: F.get("s", F.lit(i * width + j))

    def fit(df: DataFrame, keys: list[str], on: list[str], name: str) -> DataFrame:
        ids = [names.index(x) for x in on]
        means = {f"_m_{c}": F.get("m", F.lit(i)) for i, c in enumerate(names)}
        sums = df.withColumns(means | {"_sums": F.array(*(at(i, j) for i in ids for j in [*ids, 0])), "_syy": at(0, 0)})
        return fit_of_sums(sums, [*keys, "m", "s"], "y", on).select(*keys, "m", "s", "n", F.col("rss").alias(name))

    keys = ["source", "target"]
    joined = fit(fit(whole, keys, ys + xs, "rss_full"), [*keys, "rss_full"], ys, "rss_alone")
    rest, left = F.col("n") - 2 * order - 1, F.nullif("rss_full", F.lit(0.0))  # without residuals there is no ratio
    f = (F.col("rss_alone") - left) / order * rest / left
    return joined.select(*keys, "n", F.log(F.col("rss_alone") / left).alias("causality"), _f_tail(F.greatest(f, F.lit(0.0)), F.lit(float(order)), rest.cast("double")).alias("p"))


def phase_amplitude(epochs: DataFrame, channel: str, rate: float, slow: tuple[float, float], fast: tuple[float, float], bins: int = 18) -> DataFrame:
    """channel, modulation, preferred: how far the amplitude of a fast band depends on the phase of a slow one.

    Modulation is the divergence of the mean amplitudes by phase bin from uniform, over log(bins); preferred is the middle
    of the bin of the greatest mean amplitude.
    """
    low, high = kernels.butterworth(2, *slow, rate), kernels.butterworth(2, *fast, rate)

    def both(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.angle(kernels.analytic(kernels.filtered(low, x))), np.abs(kernels.analytic(kernels.filtered(high, x)))], axis=1)

    parts = epochs.select(channel, F.size("y").alias("n"), array_udf(both)("y").alias("z")).where("z is not null")
    points = parts.select(channel, F.explode(F.arrays_zip(F.slice("z", F.lit(1), F.col("n")).alias("phase"), F.slice("z", F.col("n") + 1, F.col("n")).alias("amp"))).alias("z"))
    cell = F.least(F.floor((F.col("z.phase") + np.pi) / (2 * np.pi) * bins), F.lit(bins - 1))
    means = points.groupBy(channel, cell.alias("cell")).agg(F.avg("z.amp").alias("m"))
    total = means.groupBy(channel).agg(F.sum("m").alias("t"))
    p = F.col("m") / F.col("t")
    out = means.join(total, channel).groupBy(channel).agg(F.sum(F.when(p > 0, p * F.log(p * bins)).otherwise(0.0)).alias("kl"), F.max_by("cell", F.struct("m", -F.col("cell"))).alias("top"))
    return out.select(channel, (F.col("kl") / np.log(bins)).alias("modulation"), ((F.col("top") + 0.5) * (2 * np.pi / bins) - np.pi).alias("preferred"))


def locking_over_samples(signals: DataFrame, recording: str, channel: str) -> DataFrame:
    """recording, a, b, plv: of each pair of channels of a recording, the length of the mean phase difference over its samples."""
    own = phases(signals).select(recording, F.col(channel).alias("c"), F.posexplode(F.arrays_zip("cos", "sin")).alias("k", "z")).select(recording, "k", "c", "z.cos", "z.sin")
    a, b = (own.select(recording, "k", F.col("c").alias(s), F.col("cos").alias(f"c{s}"), F.col("sin").alias(f"s{s}")) for s in "ab")
    along, across = F.col("ca") * F.col("cb") + F.col("sa") * F.col("sb"), F.col("sa") * F.col("cb") - F.col("ca") * F.col("sb")
    return a.join(b, [recording, "k"]).where("a < b").groupBy(recording, "a", "b").agg(F.sqrt(F.pow(F.avg(along), F.lit(2)) + F.pow(F.avg(across), F.lit(2))).alias("plv"))


def segments(signals: DataFrame, length: int) -> DataFrame:
    """``signals`` with a row for each segment of ``length`` samples of ``y`` that overlap by half, numbered by ``segment``."""
    starts = F.sequence(F.lit(0), F.size("y") - length, F.lit(max(1, length // 2)))
    cut = signals.where(F.size("y") >= length).withColumn("_at", F.explode(starts))
    return cut.withColumn("y", F.slice("y", F.col("_at") + 1, F.lit(length))).withColumn("segment", F.col("_at")).drop("_at")


def continuous_coherence(signals: DataFrame, recording: str, channel: str, rate: float, length: int, low: float, high: float) -> DataFrame:
    """a, b, coherence, imaginary of each pair of channels over all segments of all recordings, averaged over a band."""
    parts = segments(signals, length).withColumn("_trial", F.concat_ws("/", F.col(recording).cast("string"), F.col("segment").cast("string")))
    return coherence(parts, "_trial", channel, rate, low, high)


def phase_phase(epochs: DataFrame, channel: str, rate: float, slow: tuple[float, float], fast: tuple[float, float], n: int, m: int) -> DataFrame:
    """channel, locking: the length of the mean of n times the slow band's phase less m times the fast band's, over all samples."""
    low, high = kernels.butterworth(2, *slow, rate), kernels.butterworth(2, *fast, rate)

    def both(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.angle(kernels.analytic(kernels.filtered(s, x))) for s in (low, high)], axis=1)

    parts = epochs.select(channel, F.size("y").alias("n"), array_udf(both)("y").alias("z")).where("z is not null")
    points = parts.select(channel, F.explode(F.arrays_zip(F.slice("z", F.lit(1), F.col("n")).alias("p"), F.slice("z", F.col("n") + 1, F.col("n")).alias("q"))).alias("z"))
    off = n * F.col("z.p") - m * F.col("z.q")
    return points.groupBy(channel).agg(F.sqrt(F.pow(F.avg(F.cos(off)), F.lit(2)) + F.pow(F.avg(F.sin(off)), F.lit(2))).alias("locking"))


def comodulogram(epochs: DataFrame, channel: str, rate: float, slow: list[tuple[float, float]], fast: list[tuple[float, float]]) -> DataFrame:
    """channel, slow, fast (the bands' lower ends), modulation: phase-amplitude coupling for each pair of a few bands."""
    cells = [phase_amplitude(epochs, channel, rate, s, f).select(channel, F.lit(float(s[0])).alias("slow"), F.lit(float(f[0])).alias("fast"), "modulation") for s in slow for f in fast]
    return reduce(DataFrame.unionByName, cells)


def wavelet_locking(epochs: DataFrame, trial: str, channel: str, rate: float, freqs: list[float], cycles: float = 7.0) -> DataFrame:
    """a, b, freq, k, plv: over trials, the length of the mean wavelet phase difference of each pair of channels."""
    grid = np.asarray(freqs, float)

    def unit(x: np.ndarray) -> np.ndarray:
        z = kernels.morlet(x, rate, grid, cycles).reshape(len(x), -1)
        z = z / np.maximum(np.abs(z), 1e-300)
        return np.concatenate([z.real, z.imag], axis=1)

    parts = epochs.select(trial, F.col(channel).alias("c"), F.size("y").alias("n"), array_udf(unit)("y").alias("z")).where("z is not null")
    total = F.col("n") * len(freqs)
    cells = parts.select(trial, "c", "n", F.posexplode(F.arrays_zip(F.slice("z", F.lit(1), total).alias("re"), F.slice("z", total + 1, total).alias("im"))).alias("i", "z")).select(trial, "c", "n", "i", "z.re", "z.im")
    a, b = (cells.select(trial, "i", "n", F.col("c").alias(s), F.col("re").alias(f"re_{s}"), F.col("im").alias(f"im_{s}")) for s in "ab")
    along, across = F.col("re_a") * F.col("re_b") + F.col("im_a") * F.col("im_b"), F.col("im_a") * F.col("re_b") - F.col("re_a") * F.col("im_b")
    frequency = F.get(F.array(*map(F.lit, grid.tolist())), F.floor(F.col("i") / F.col("n")).cast("int"))
    pairs = a.join(b, [trial, "i", "n"]).where("a < b")
    return pairs.groupBy("a", "b", frequency.alias("freq"), (F.col("i") % F.col("n")).alias("k")).agg(F.sqrt(F.pow(F.avg(along), F.lit(2)) + F.pow(F.avg(across), F.lit(2))).alias("plv"))
