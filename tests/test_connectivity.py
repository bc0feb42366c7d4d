from __future__ import annotations

import numpy as np

from pulsegrove.operators import connectivity, directed, epoching, stats, windows
from pyspark.sql import functions as F


def test_granger_finds_the_direction(spark):
    rng = np.random.default_rng(11)
    rows, design = [], []
    for trial in range(10):
        x, y = rng.normal(size=120), np.zeros(120)
        for t in range(1, 120):
            y[t] = 0.65 * y[t - 1] + 0.85 * x[t - 1] + 0.3 * rng.normal()
        rows += [(trial, c, t, float(v[t])) for c, v in (("X", x), ("Y", y)) for t in range(120)]
        design += [(y[t], y[t - 1], y[t - 2], x[t - 1], x[t - 2]) for t in range(2, 120)]
    got = {(r.source, r.target): r for r in connectivity.granger(spark.createDataFrame(rows, "trial int, channel string, k long, value double"), "trial", 2).collect()}
    assert got["X", "Y"].causality > 1 > 0.1 > got["Y", "X"].causality and got["X", "Y"].p < 0.001
    m = np.array(design)
    rss = lambda c: np.linalg.lstsq(np.c_[np.ones(len(m)), m[:, c]], m[:, 0], rcond=None)[1][0]
    assert abs(got["X", "Y"].causality - np.log(rss([1, 2]) / rss([1, 2, 3, 4]))) < 1e-8 and got["X", "Y"].n == len(m)


def test_coherence_and_coupling(spark):
    rng = np.random.default_rng(7)
    t = np.arange(256) / 128
    rows, slow = [], np.sin(2 * np.pi * 4 * t)
    for trial in range(20):
        common = np.sin(2 * np.pi * 10 * t + rng.uniform(0, 6))
        nested = slow + (1 + slow) * np.sin(2 * np.pi * 40 * t)
        for c, y in (("a", common + 0.3 * rng.normal(size=256)), ("b", common + 0.3 * rng.normal(size=256)), ("c", rng.normal(size=256)), ("d", nested + 0.05 * rng.normal(size=256))):
            rows.append((trial, c, y.tolist()))
    df = spark.createDataFrame(rows, "trial int, channel string, y array<double>")
    got = {(r.a, r.b): r.coherence for r in connectivity.coherence(df, "trial", "channel", 128.0, 9.0, 11.0).collect()}
    assert got["a", "b"] > 0.6 > 0.3 > got["a", "c"]
    coupled = {r.channel: r for r in connectivity.phase_amplitude(df, "channel", 128.0, (2.0, 6.0), (30.0, 50.0)).collect()}
    assert coupled["d"].modulation > 5 * coupled["c"].modulation and abs(coupled["d"].preferred) < 0.6
    assert connectivity.coherence(df.limit(0), "trial", "channel", 128.0, 9.0, 11.0).count() == 0


def test_hubs_and_canonical_edges(spark):
    edges = spark.createDataFrame([("S1", "A", 3.0), ("S1", "B", 2.0), ("S2", "A", 1.0), ("S2", "C", 5.0)], "source string, target string, weight double")
    got = {r.node: (r.hub, r.authority) for r in directed.hubs_authorities(edges, 30).collect()}
    assert all(got[n][1] == 0 for n in ("S1", "S2")) and all(got[n][0] == 0 for n in "ABC") and got["S2"][0] > got["S1"][0]
    m = np.array([[3.0, 2, 0], [1, 0, 5]])
    u = np.abs(np.linalg.svd(m)[0][:, 0])
    assert np.allclose([got["S1"][0], got["S2"][0]], u / u.sum(), atol=1e-3)
    both = spark.createDataFrame([("Z2", "A1", True, "zr", "ar"), ("Z2", "A1", False, "zr", "ar")], "source string, target string, und boolean, source_region string, target_region string")
    assert sorted(tuple(r) for r in directed.canonical_edges(both, "und", ["region"]).collect()) == [("A1", "Z2", True, "ar", "zr"), ("Z2", "A1", False, "zr", "ar")]
    regions = spark.createDataFrame([("A", "r"), ("B", "r"), ("C", None)], "node string, region string")
    pairs = spark.createDataFrame([("A", "B"), ("A", "C"), ("X", "Y"), ("A", "X"), ("C", "C")], "source string, target string")
    assert {(r.source, r.target): r.same_region for r in directed.same_region(pairs, regions).collect()} == {("A", "B"): True, ("A", "C"): False, ("X", "Y"): True, ("A", "X"): False, ("C", "C"): False}


def test_slope_permutation_and_consensus(spark):
    rows = [("out", float(d), 18 + 0.5 * d) for d in range(24)] + [("two", 1.0, 2.0), ("two", 2.0, 1.0), ("none", None, 1.0)]
    got = {r.g: r for r in stats.slope_permutation(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], ["x", "y"], "x", "y", 199, 1).collect()}
    assert abs(got["out"].slope - 0.5) < 1e-9 and got["out"].r2 > 0.99 and got["out"].p <= 0.01 and got["two"].p == 1.0 and "none" not in got
    pulses = spark.createDataFrame([("a", 10), ("b", 11), ("c", 12), ("a", 50), ("a", 52), ("b", 90), ("c", 93)], "channel string, k long")
    assert [(r.k, r.n_channels) for r in windows.consensus_events(pulses, 2, 2, F.floor(F.col("k") / 20)).collect()] == [(11, 3)]


def test_blanking_bridges(spark):
    samples = spark.createDataFrame([("a", k, float(k) if k not in (4, 5) else 1000.0) for k in range(10)], "channel string, k long, value double")
    out = epoching.blanked(samples, spark.createDataFrame([(4,)], "k long"), 0, 1, F.floor(F.col("k") / 5)).orderBy("k").collect()
    assert [r.filled for r in out] == [float(k) for k in range(10)]


def test_granger_lays_lines_out_in_tasks(spark):
    rng = np.random.default_rng(4)
    rows, known = [], {}
    for trial in range(6):
        for c in "abc":
            for k in sorted(rng.choice(60, 25, replace=False).tolist()):
                rows.append((trial, c, 1000 * trial + k, float(rng.normal())))
    samples = spark.createDataFrame(rows, "trial long, channel string, k long, value double")
    block = F.floor(F.col("k") / 8)
    for r in epoching.bridged(samples, "trial", block).collect():
        known[r.trial, r.channel, r.k] = r.value
    whole = {(r.source, r.target): r for r in connectivity.granger_over_lines(epoching.lines(samples, "trial", block), "trial", 2, 7).collect()}
    assert len(whole) == 6
    for (s, t), got in whole.items():
        lags = [[known.get((e, c, k - i)) for c, i in ((t, 0), (t, 1), (t, 2), (s, 1), (s, 2))] for e, c, k in known if c == t and (e, s, k) in known]
        m = np.array([r for r in lags if None not in r])
        rss = lambda c: np.linalg.lstsq(np.c_[np.ones(len(m)), m[:, c]], m[:, 0], rcond=None)[1][0]
        assert got.n == len(m) and abs(got.causality - np.log(rss([1, 2]) / rss([1, 2, 3, 4]))) < 1e-8
    # a missing and a NaN value count as in plain rows, and a line of millions of steps is laid out block by block
    odd = spark.createDataFrame([(0, c, k, None if k == 9 and c == "a" else float("nan") if k == 20 else float(rng.normal())) for c in "ab" for k in range(40)], "trial int, channel string, k long, value double")
    assert {(r.source, r.target): r.n for r in connectivity.granger(odd, "trial", 2).collect()} == {("a", "b"): 38 - 3 - 2, ("b", "a"): 38 - 3 - 3}
    far = spark.createDataFrame([(0, c, k, float(v)) for c, k, v in (("a", 0, 0), ("a", 6_000_000, 5), ("b", 0, 1), ("b", 6_000_000, 3))], "trial int, channel string, k long, value double")
    assert {r.n for r in connectivity.granger_over_lines(epoching.lines(far, "trial", F.floor(F.col("k") / 4096)), "trial", 2).collect()} == {5_999_999}
    plan = connectivity.granger_over_lines(epoching.lines(samples, "trial", block), "trial", 2)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("RepartitionByExpression")]
    assert "Join" not in above and "Window" not in above
