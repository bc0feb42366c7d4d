from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pulsegrove.functions import kernels
from pulsegrove.operators import responses, spectral, stats


def test_filter_passes_its_band_only():
    t = np.arange(0, 4, 1 / 250)
    tone = lambda f: np.sin(2 * np.pi * f * t)[None]
    middle = slice(250, 750)
    for order in (1, 2, 3, 4):
        band = kernels.butterworth(order, 8, 30, 250)
        assert np.allclose(kernels.filtered(band, tone(16))[:, middle], tone(16)[:, middle], atol=0.05)
        assert np.abs(kernels.filtered(band, tone(0.5))[:, middle]).max() < 0.15 and np.abs(kernels.filtered(band, tone(110))[:, middle]).max() < 0.15
        assert np.abs(kernels.filtered(kernels.butterworth(order, 10, None, 250), np.ones((1, 500)))).max() < 1e-9
        assert np.allclose(kernels.filtered(kernels.butterworth(order, None, 10, 250), np.ones((1, 500))), 1)
        # half power at the corner each way, so a quarter both ways
        corner = np.sqrt((kernels.filtered(kernels.butterworth(order, None, 20, 250), tone(20))[:, middle] ** 2).mean() * 2)
        assert abs(corner - 0.5) < 0.01


def test_spectrum_and_wavelets_find_the_tone():
    t = np.arange(256) / 128
    x = np.sin(2 * np.pi * 16 * t)[None]
    freq, power = kernels.welch(x, 128, 64)
    assert freq[power[0].argmax()] == 16 and abs(power[0].sum() * 2 - 0.5) < 0.01
    z = kernels.morlet(x, 128, np.array([8.0, 16.0, 32.0]))
    assert np.abs(z[0, :, 128]).argmax() == 1
    assert np.allclose(np.abs(kernels.analytic(x)), 1, atol=1e-9)


def test_spectra_skip_unusable_rows(spark):
    tone = np.sin(2 * np.pi * 8 * np.arange(64) / 64).tolist()
    rows = [("a", tone), ("a", tone[:48]), ("a", None), ("b", [1.0]), ("b", [None, 1.0, 2.0]), ("b", [float("nan")] * 64)]
    df = spark.createDataFrame(rows, "channel string, y array<double>")
    out = spectral.power_spectra(df, "channel", 64.0, 32)
    got = {r.freq: r.power for r in out.collect() if r.channel == "a"}
    assert max(got, key=got.get) == 8.0 and {r.channel for r in out.collect()} == {"a"}
    assert spectral.power_spectra(df.limit(0), "channel", 64.0, 32).count() == 0
    peak = spectral.wavelet_power(df.limit(1), "channel", 64.0, [4.0, 8.0]).where("k = 32").orderBy(F.desc("power")).first()
    assert peak.freq == 8.0 and abs(peak.itc - 1) < 1e-9


def test_phase_locking(spark):
    rng = np.random.default_rng(1)
    t = np.arange(128) / 64
    rows = []
    for trial in range(30):
        phase = rng.uniform(0, 6)
        rows += [(trial, "a", np.sin(2 * np.pi * 8 * t + phase).tolist()), (trial, "b", np.sin(2 * np.pi * 8 * t + phase + 0.7).tolist()), (trial, "c", np.sin(2 * np.pi * 8 * t + rng.uniform(0, 6)).tolist())]
    got = {(r.a, r.b): r.plv for r in spectral.phase_locking(spark.createDataFrame(rows, "epoch int, channel string, y array<double>"), "epoch", "channel").collect()}
    assert got["a", "b"] > 0.99 and got["a", "c"] < 0.5


def test_response_classes(spark):
    rng = np.random.default_rng(104)
    shape = np.exp(-0.5 * ((np.arange(1, 41) - 12) / 5) ** 2)
    rows = []
    for trial in range(20):
        for name in ("both", "loud", "none"):
            y = rng.normal(0, 0.5, 61)
            y[21:] += {"both": 3 * shape, "loud": rng.normal(0, 2, 40), "none": 0}[name]
            rows += [(trial, name, k - 20, float(v)) for k, v in enumerate(y)]
    rows += [(0, "few", k, 1.0 * k) for k in range(-20, 41)]
    df = spark.createDataFrame(rows, "epoch int, channel string, offset int, value double")
    got = {r.channel: (r["class"], r.significant) for r in responses.calls(df, (-20, -1), (1, 40)).collect()}
    assert got == {"both": ("reproducible_energetic", True), "loud": ("energetic_inconsistent", False), "none": ("no_response", False), "few": ("insufficient_data", False)}
    projections = {(r.epoch, r.channel): r.projection for r in responses.cross_projections(df, (1, 40)).collect()}
    x = np.array([[r[3] for r in rows if r[0] == i and r[1] == "both" and r[2] >= 1] for i in range(20)])
    want = [np.mean([x[i] @ x[j] for j in range(20) if j != i]) / np.linalg.norm(x[i]) for i in range(20)]
    assert np.allclose([projections[i, "both"] for i in range(20)], want)
    assert responses.calls(df.limit(0), (-20, -1), (1, 40)).count() == 0


def test_windows_count_when_missing(spark):
    df = spark.createDataFrame([("a", 0.01), ("a", 0.5), ("b", None), ("c", 0.9)], "u string, p double")
    assert {r.u: r.p_any for r in responses.over_windows(df, ["u"], 3, "p").collect()} == {"a": 0.03, "b": 1.0, "c": 1.0}


def test_fit_and_bootstrap(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)) * 20 + 50
    y = 20 + x @ [0.5, -0.2, 0.1] + rng.normal(size=60)
    rows = [("g", *map(float, r), float(v)) for r, v in zip(x, y)] + [("flat", 1.0, 2.0, 3.0, 4.0)] * 5 + [("g", None, 1.0, 1.0, 1.0)]
    got = {r.g: r for r in stats.linear_fit(spark.createDataFrame(rows, "g string, x double, y double, z double, v double"), ["g"], "v", ["x", "y", "z"]).collect()}
    want = np.linalg.lstsq(np.c_[np.ones(60), x], y, rcond=None)[0]
    assert np.allclose([got["g"].intercept, got["g"].slope_x, got["g"].slope_y, got["g"].slope_z], want) and got["g"].n == 60 and got["flat"].slope_x is None
    values = spark.createDataFrame([(str(i % 50), float(v)) for i, v in enumerate(rng.normal(5, 1, 2000))], "c string, v double")
    (r,) = stats.bootstrap_interval(values, "c", "v", 500, 3).collect()
    means = np.array([v.m for v in values.groupBy("c").agg(F.avg("v").alias("m")).collect()])
    assert abs(r.estimate - means.mean()) < 1e-9 and r.n_clusters == 50
    assert abs((r.high - r.low) / (2 * 1.96 * means.std() / np.sqrt(50)) - 1) < 0.2
