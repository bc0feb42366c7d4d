from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrove.operators import directed, epoching, in_order, intervals, quality, stats, windows


@pytest.fixture(scope="module")
def noisy():
    rng = np.random.default_rng(3)
    return [("a" if i % 3 else "hot", i, float(v) if v > -0.5 else None) for i, v in enumerate(rng.normal(size=200).round(2))]


def test_running_values_cross_blocks(spark, noisy):
    df = spark.createDataFrame([(*r, i % 7) for i, r in enumerate(noisy)], "key string, k long, v double, tie long")
    out = in_order.with_previous(df, "key", F.floor(F.col("k") / 10), ["k"], F.col("v"), "prev")
    out = in_order.with_last_known(out, "key", F.floor(F.col("k") / 10), ["k"], F.col("v"), "known")
    out = in_order.with_running_sum(out, "key", F.floor(F.col("k") / 10), ["k"], F.coalesce("v", F.lit(0.0)), "total")
    got = {r.k: (r.prev, r.known, round(r.total, 9)) for r in out.collect()}
    for key in ("a", "hot"):
        before, known, total = None, None, 0.0
        for _, k, v in [r for r in noisy if r[0] == key]:
            known, total = v if v is not None else known, total + (v or 0)
            assert got[k] == (before, known, round(total, 9))
            before = v


def test_adjusted_p(spark):
    rows = [("f", 0.01), ("f", None), ("f", 0.04), ("f", 0.20), ("f", float("nan")), ("g", 0.5), ("g", 0.5), ("g", 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, fam string, p double")
    got = [None if r.q is None else round(r.q, 6) for r in windows.adjusted_p(df, ["fam"], "p", "q").orderBy("i").collect()]
    assert got == [0.03, None, 0.06, 0.2, None, 0.75, 0.75, 1.0]


def test_reciprocity_and_asymmetry(spark):
    tested = [("P1", "ACC", "Thal", True), ("P1", "Thal", "ACC", True), ("P1", "ACC", "Str", True), ("P1", "Str", "ACC", False), ("P1", "PAG", "ACC", True), ("P2", "A", "B", False), ("P2", "B", "A", False)]
    got = {r.p: (r.tested, r.any_response, r.both_respond, r.reciprocity) for r in directed.reciprocity(spark.createDataFrame(tested, "p string, source string, target string, responds boolean"), ["p"]).collect()}
    assert got == {"P1": (2, 2, 1, 0.5), "P2": (1, 0, 0, None)}
    edges = spark.createDataFrame([("ACC", "PAG", 8.0), ("PAG", "ACC", 2.0), ("X", "Y", 1.0)], "source string, target string, weight double")
    (row,) = directed.both_ways(edges, []).collect()
    assert (row.asymmetry, row.dominant) == (2.0, "ACC->PAG")
    assert directed.both_ways(edges.limit(0), []).count() == 0


def test_strengths_and_targets(spark):
    edges = spark.createDataFrame([("ACC", "Thal", 10.0), ("Str", "Thal", 1.0), ("Thal", "ACC", 4.0)], "source string, target string, weight double")
    got = {r.node: r for r in directed.strengths(edges).collect()}
    assert got["ACC"].out_strength == 10 and abs(got["ACC"].sender_receiver - 6 / 14) < 1e-12 and abs(sum(r.out_share for r in got.values()) - 1) < 1e-12
    timed = spark.createDataFrame([("g", 0, "a", 1.0), ("g", 0, "b", 0.0), ("g", 1, "a", 1.0), ("g", 1, "b", 1.0)], "g string, t int, target string, weight double")
    shares = {r.t: (r.active, r.participation, round(r.entropy, 9)) for r in directed.target_shares(timed, ["g"], "t").collect()}
    assert shares == {0: (1, 0.5, 0.0), 1: (2, 1.0, 1.0)}


def test_page_rank_by_power_iteration(spark):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("a", "c", 3.0), ("d", "a", 1.0), ("c", "e", 1.0)]
    names = sorted({x for e in edges for x in e[:2]})
    m = np.zeros((5, 5))
    for s, t, w in edges:
        m[names.index(t), names.index(s)] = w
    out = m.sum(axis=0)
    r = np.full(5, 0.2)
    for _ in range(20):
        r = 0.15 / 5 + 0.85 * (m / np.where(out, out, 1) @ r + r[out == 0].sum() / 5)
    got = {x.node: x.rank for x in directed.page_rank(spark.createDataFrame(edges, "source string, target string, weight double")).collect()}
    assert np.allclose([got[x] for x in names], r)


def test_gate_fails_at_the_cutoff(spark):
    df = spark.createDataFrame([(1, 0.05, 0.05, 19), (2, 0.25, 0.05, 19), (3, 0.05, 0.10, 19), (4, 0.05, 0.05, 7), (5, None, 0.05, 19)], "i int, bad_fraction double, hard_fraction double, n_clean int")
    assert [r.qc_pass for r in quality.gated(df).orderBy("i").collect()] == [True, False, False, False, False]


def test_sign_flips_and_tails(spark):
    xs = [1.0, 2.0, 3.0, 4.0]
    ys = [0.3, -0.2, 0.9, 0.4, -0.1, 0.8]
    df = spark.createDataFrame([("x", i, v) for i, v in enumerate(xs)] + [("y", i, v) for i, v in enumerate(ys)] + [("z", 0, None)], "g string, i int, v double")
    got = {r.g: r.p for r in stats.sign_flips(df, ["g"], "v", "i").collect()}
    brute = np.mean([abs(sum(s * v for s, v in zip(signs, ys))) >= sum(ys) - 1e-12 for signs in itertools.product((1, -1), repeat=len(ys))])
    assert got == {"x": 0.125, "y": brute}
    # random patterns come close to all of them, the same each time, and never give 0
    drawn = [{r.g: r.p for r in stats.sign_flips(df, ["g"], "v", "i", exact=0, draws=5000).collect()} for _ in range(2)]
    assert drawn[0] == drawn[1] and abs(drawn[0]["y"] - brute) < 0.02 and abs(drawn[0]["x"] - 0.125) < 0.02
    sure = spark.createDataFrame([("g", i, 1.0 + i / 100) for i in range(40)], "g string, i int, v double")
    assert stats.sign_flips(sure, ["g"], "v", "i").first()["p"] == 1 / 5001
    assert abs(stats.beta_tail(1.0, 0.5, 0.3) - (1 - math.sqrt(0.7))) < 1e-12
    assert abs(stats.beta_tail(5, 0.5, 10 / (10 + 2.228139**2)) - 0.05) < 1e-6


def test_interval_join_and_thinning_against_brute_force(spark):
    rng = np.random.default_rng(9)
    points = [(str(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 2, 80), rng.integers(0, 500, 80)))]
    spans = [(str(k), int(t), int(t + w)) for k, t, w in zip(rng.integers(0, 2, 20), rng.integers(0, 450, 20), rng.integers(0, 70, 20))]
    p, s = spark.createDataFrame(points, "by string, t long, id long"), spark.createDataFrame(spans, "by string, a long, b long")
    got = sorted((r.id, r.a, r.b) for r in intervals.within(p, s, "by", "t", "a", "b", 40).collect())
    assert got == sorted((i, a, b) for k, t, i in points for j, a, b in spans if k == j and a <= t <= b)
    kept = sorted((r.by, r.t) for r in intervals.thinned(p, "by", "t", 15).collect())
    want = []
    for key in ("0", "1"):
        last = None
        for t in sorted(t for k, t, _ in points if k == key):
            if last is None or t - last >= 15:
                want.append((key, t))
                last = t
    assert kept == want


def test_dense_points_are_thinned_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(intervals, "SPAN", 2)
    rng = np.random.default_rng(2)
    ts = sorted(set(int(t) for t in rng.integers(0, 3000, 1500)) | {9000, 9001, 20_000})
    points = spark.createDataFrame([("a", t) for t in ts] + [("b", 5), ("b", 5), ("c", None), (None, 5)], "by string, t long")
    want, last = [], None
    for t in ts:
        if last is None or t - last >= 7:
            want.append(t)
            last = t
    got = [(r.by, r.t) for r in intervals.thinned(points, "by", "t", 7).orderBy("by", "t").collect()]
    assert got == [("a", t) for t in want] + [("b", 5)]


def test_medians_equal_the_exact_ones_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(windows, "MEDIAN_BLOCKS", 7)
    rng = np.random.default_rng(4)
    rows = [(str(g), float(v)) for g in range(6) for v in np.round(np.exp(rng.normal(0, 3, 5 + 40 * g)), 2)] + [("n", None), ("n", float("nan")), (None, 3.0), (None, 4.0), ("one", 2.0)]
    counts = windows.value_counts(spark.createDataFrame(rows, "g string, v double"), ["g"], "v")
    got = {r.g: r.m for r in windows.medians(counts, ["g"], "m").collect()}
    want = {str(g): float(np.median([v for k, v in rows if k == str(g)])) for g in range(6)} | {None: 3.5, "one": 2.0}
    assert got == want


def test_rolling_means_across_runs(spark):
    rows = [("a" if i % 5 else "b", i, float(i * i % 97)) for i in range(12_000)]
    df = spark.createDataFrame(rows, "g string, t long, v double")
    out = {(r.g, r.t): r.m for r in windows.rolling_mean(df, ["g"], F.floor(F.col("t") / 1000), ["t"], "v", 3, "m").collect()}
    for g in "ab":
        own = [(t, v) for k, t, v in rows if k == g]
        assert len(own) > 2000 and all(abs(out[g, t] - np.mean([x for _, x in own[max(0, i - 2) : i + 1]])) < 1e-9 for i, (t, _) in enumerate(own))


def test_asof_with_ties_and_empty_right(spark):
    left = spark.createDataFrame([("u", 5, "m"), ("u", 10, "n"), ("w", 5, "o")], "by string, t long, name string")
    right = spark.createDataFrame([("u", 5, 1.0), ("u", 5, 2.0), ("u", 200, 3.0)], "by string, t long, v double")
    back = {r.name: (r.matched_at, r.matched_v) for r in epoching.asof(left, right, "by", "t", "v", F.floor(F.col("t") / 7)).collect()}
    assert back == {"m": (5, 2.0), "n": (5, 2.0), "o": (None, None)}
    ahead = {r.name: r.matched_at for r in epoching.asof(left, right, "by", "t", "v", F.floor(F.col("t") / 7), forward=True).collect()}
    assert ahead == {"m": 5, "n": 200, "o": None}
    assert epoching.asof(left, right.limit(0), "by", "t", "v", F.floor(F.col("t") / 7)).where("matched_at is not null").count() == 0


def test_sign_flips_return_a_row_per_group(spark):
    rng = np.random.default_rng(8)
    rows = [(g, i, float(v)) for g, shift in (("a", 0.3), ("b", 0.0), ("c", 0.1)) for i, v in enumerate(rng.normal(shift, 1, 60))]
    df = spark.createDataFrame(rows, "g string, i long, v double")
    got = [{r.g: r.p for r in stats.sign_flips(df, ["g"], "v", "i", draws=999, part=part).collect()} for part in (1 << 16, 7)]
    assert got[0] == got[1] and len(got[0]) == 3
    # a group that goes on in the next batch leaves the task once, without its sums of all draws
    pdf = df.toPandas().rename(columns={"v": "x"}).assign(_unit=lambda p: p["i"] * 7919 + 13, _part=0, _parts=1, _limit=9.0)
    out = pd.concat(list(stats.signed_sums(iter([pdf[:90], pdf[90:]]), ["g"], 999)))
    assert list(out["g"]) == ["a", "b", "c"] and out["s"].isna().all()
    whole = pd.concat(list(stats.signed_sums(iter([pdf]), ["g"], 999)))
    assert list(whole["hits"]) == list(out["hits"])
