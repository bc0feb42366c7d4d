"""Spectra, phases and their agreement over packed epochs: rows of key columns and one array of samples ``y``.

Kernels turn each row's array into arrays on Arrow batches; everything across rows (means over trials, locking between
channels, bands) is grouping and joining. Rows with a null array, a null or non-finite sample or fewer samples than two
give no result; rows of one batch may differ in length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrove.functions import kernels


def _by_length(kernel: Callable[[np.ndarray], np.ndarray]) -> Callable[[pd.Series], pd.Series]:
    """A function of many arrays as one of a series of arrays: those of equal length are stacked."""

    def run(ys: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(ys), index=ys.index, dtype=object)
        sizes = ys.map(lambda y: len(y) if y is not None and len(y) > 1 and np.isfinite(np.asarray(y, float)).all() else 0)
        for size, own in ys.groupby(sizes):
            if size:
                for at, row in zip(own.index, kernel(np.stack([np.asarray(y, float) for y in own]))):
                    out[at] = row
        return out

    return run


def array_udf(kernel: Callable[[np.ndarray], np.ndarray]) -> Callable[..., Column]:
    run = _by_length(kernel)

    def apply(ys: pd.Series) -> pd.Series:
        return run(ys)

    return F.pandas_udf(apply, T.ArrayType(T.DoubleType()))


def packed(samples: DataFrame, keys: list[str], k: str, value: str) -> DataFrame:
    """keys, y: each trial's samples in order of k."""
    return samples.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(k, F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("y"))


def power_spectra(epochs: DataFrame, channel: str, rate: float, length: int) -> DataFrame:
    """channel, freq, power: Welch densities averaged over trials."""
    spectrum = array_udf(lambda x: kernels.welch(x, rate, length)[1])
    bins = epochs.select(channel, F.size("y").alias("n"), F.posexplode(spectrum("y")).alias("i", "p"))
    freq = F.col("i") * rate / F.least(F.lit(length), F.col("n"))
    return bins.groupBy(channel, freq.alias("freq")).agg(F.avg("p").alias("power"))


def band_power(spectra: DataFrame, channel: str, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """channel and the mean density of each band, ends included."""
    return spectra.groupBy(channel).agg(*(F.avg(F.when(F.col("freq").between(*b), F.col("power"))).alias(name) for name, b in bands.items()))


def bandpassed(epochs: DataFrame, low: float | None, high: float | None, rate: float, order: int = 4) -> DataFrame:
    """``epochs`` with ``y`` filtered without phase by a Butterworth filter."""
    sections = kernels.butterworth(order, low, high, rate)
    return epochs.withColumn("y", array_udf(lambda x: kernels.filtered(sections, x))("y"))


def phases(epochs: DataFrame) -> DataFrame:
    """``epochs`` with ``cos`` and ``sin``, arrays of the unit phase of each sample's analytic signal, for ``y``."""

    def unit(x: np.ndarray) -> np.ndarray:
        z = kernels.analytic(x - x.mean(axis=1, keepdims=True))
        z = z / np.maximum(np.abs(z), 1e-300)
        return np.concatenate([z.real, z.imag], axis=1)

    both = epochs.withColumn("_z", array_udf(unit)("y")).withColumn("_n", F.size("_z").cast("int") / 2)
    n = F.col("_n").cast("int")
    return both.where("_z is not null").withColumns({"cos": F.slice("_z", F.lit(1), n), "sin": F.slice("_z", n + 1, n)}).drop("_z", "_n", "y")


def phase_locking(epochs: DataFrame, trial: str, channel: str) -> DataFrame:
    """a, b, plv: over trials, the mean length of the mean phase difference of each pair of channels, averaged over samples.

    Channels meet within a trial; there are as many pairs as its few channels make.
    """
    own = phases(epochs).select(trial, F.col(channel).alias("c"), "cos", "sin")
    a, b = own.select(trial, F.col("c").alias("a"), F.col("cos").alias("ca"), F.col("sin").alias("sa")), own.select(trial, F.col("c").alias("b"), F.col("cos").alias("cb"), F.col("sin").alias("sb"))
    pairs = a.join(b, trial).where("a < b")
    spread = pairs.select("a", "b", F.posexplode(F.arrays_zip("ca", "sa", "cb", "sb")).alias("k", "z"))
    along, across = F.col("z.ca") * F.col("z.cb") + F.col("z.sa") * F.col("z.sb"), F.col("z.sa") * F.col("z.cb") - F.col("z.ca") * F.col("z.sb")
    at = spread.groupBy("a", "b", "k").agg(F.sqrt(F.pow(F.avg(along), F.lit(2)) + F.pow(F.avg(across), F.lit(2))).alias("r"))
    return at.groupBy("a", "b").agg(F.avg("r").alias("plv"))


def wavelet_power(epochs: DataFrame, channel: str, rate: float, freqs: list[float], cycles: float = 7.0) -> DataFrame:
    """channel, freq, k, power, itc: mean wavelet power over trials, and how far phases agree across them."""
    grid = np.asarray(freqs, float)

    def coefficients(x: np.ndarray) -> np.ndarray:
        z = kernels.morlet(x, rate, grid, cycles).reshape(len(x), -1)
        return np.concatenate([z.real, z.imag], axis=1)

    parts = epochs.select(channel, F.size("y").alias("_n"), array_udf(coefficients)("y").alias("_z")).where("_z is not null")
    total = F.col("_n") * len(freqs)
    cells = parts.select(channel, "_n", F.posexplode(F.arrays_zip(F.slice("_z", F.lit(1), total).alias("re"), F.slice("_z", total + 1, total).alias("im"))).alias("_i", "z"))
    re, im = F.col("z.re"), F.col("z.im")
    size = F.sqrt(re * re + im * im)
    frequency = F.get(F.array(*map(F.lit, grid.tolist())), F.floor(F.col("_i") / F.col("_n")).cast("int"))
    unit = lambda part: F.avg(F.when(size > 0, part / size))
    out = cells.groupBy(channel, frequency.alias("freq"), (F.col("_i") % F.col("_n")).alias("k"))
    return out.agg(F.avg(size * size).alias("power"), F.sqrt(F.pow(unit(re), F.lit(2)) + F.pow(unit(im), F.lit(2))).alias("itc"))


def notched(epochs: DataFrame, line: float, width: float, rate: float, top: float = 0.98) -> DataFrame:
    """``epochs`` with ``y`` without the line frequency and its harmonics below ``top`` of half the rate, without phase."""
    sections = [kernels.notch(f, width, rate) for f in np.arange(line, top * rate / 2, line)]
    return epochs.withColumn("y", array_udf(lambda x: kernels.filtered(sections, x))("y"))


def decimated(epochs: DataFrame, factor: int) -> DataFrame:
    """``epochs`` with every ``factor``-th sample of ``y``, after a phaseless low-pass at 0.8 of the new half rate."""
    sections = kernels.butterworth(8, None, 0.8 / (2 * factor), 1.0)
    return epochs.withColumn("y", array_udf(lambda x: kernels.filtered(sections, x)[:, ::factor])("y"))


def resampled(epochs: DataFrame, up: int, down: int) -> DataFrame:
    """``epochs`` with ``y`` at up/down times its rate."""
    return epochs.withColumn("y", array_udf(lambda x: kernels.resampled(x, up, down))("y"))
