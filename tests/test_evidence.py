"""Canonical responses, anchors, trains, edges and source tables against plain programs on small inputs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrove.operators import canonical, connectivity, directed, evidence, in_tasks, stats, trains
from pulsegrove.sources import tables as source_tables

TRIALS = "epoch long, channel string, offset int, value double"


def responses(seed=1, n=14, length=8):
    rng = np.random.default_rng(seed)
    shape = np.sin(np.linspace(0.3, 2.8, length))
    return np.array([(1 + 0.3 * rng.normal()) * shape + 0.4 * rng.normal(size=length) for _ in range(n)])


def test_canonical_response_equals_the_formulas_on_all_pairs(spark):
    x = responses()
    rows = [(e, "a", k + 1, float(v)) for e, y in enumerate(x) for k, v in enumerate(y)] + [(99, "a", 1, 5.0), (98, "a", 2, None)]
    trials = canonical.whole_trials(spark.createDataFrame(rows, TRIALS), 1, 8)
    profile = {r.duration: r.profile for r in canonical.projection_profile(trials, 2).collect()}

    def pairs(d):
        y = x[:, :d]
        p = (y / np.linalg.norm(y, axis=1, keepdims=True)) @ y.T
        return p[~np.eye(len(y), dtype=bool)]

    assert all(abs(profile[d] - pairs(d).mean()) < 1e-9 for d in range(2, 9))
    (got,) = canonical.canonical_response(trials, 2, 1).collect()
    best = max(range(2, 9), key=lambda d: pairs(d).mean())
    y, p = x[:, :best], pairs(best)
    u = np.linalg.svd(y.T, full_matrices=False)[0][:, 0]
    u = u if u @ y.mean(axis=0) > 0 else -u
    alpha = y @ u
    m = len(p) / 2
    assert got.duration == best and got.n == len(x) and np.allclose(got.canonical, u)
    assert abs(got.alpha - (alpha / np.sqrt(best)).mean()) < 1e-9
    assert abs(got.explained - (1 - ((y - np.outer(alpha, u)) ** 2).sum(axis=1) / (y**2).sum(axis=1)).mean()) < 1e-9
    assert abs(got.t - p.mean() / (np.sqrt(p.var() * m / (m - 1)) / np.sqrt(m))) < 1e-6
    weights = {r.start: r.weight for r in canonical.sliding_weights(trials, canonical.canonical_response(trials, 2, 1)).collect()}
    assert abs(weights[1] - (alpha / np.sqrt(best)).mean()) < 1e-9 and set(weights) == set(range(1, 8 - best + 2))


def test_anchor_and_zeroing(spark):
    envelope = [(1, k, v) for k, v in zip(range(-4, 7), [1, 1.2, 0.9, 1.1, 9, 30, 12, 5, 1, 1.1, 1])] + [(2, k, 1.0 + 0.1 * (k % 2)) for k in range(-4, 0)] + [(2, 0, 50.0)]
    frame = spark.createDataFrame([(e, k, float(v)) for e, k, v in envelope], "epoch long, offset int, envelope double")
    got = {r.epoch: r for r in canonical.post_artifact_anchors(frame, (-4, -1), (-1, 6), 1, half=0, run=2).collect()}
    assert got[1].peak_at == 1 and got[1].method == "settled" and got[1].anchor == 5
    assert got[2].peak_at == 0 and got[2].method == "neighbour" and got[2].anchor == 1
    trials = spark.createDataFrame([(1, "a", k, float(k)) for k in range(8)], TRIALS)
    out = {r.offset: r.value for r in canonical.zeroed_after(trials, spark.createDataFrame([(1, 5)], "epoch long, anchor int"), 2).collect()}
    assert out[5] == -0.5 and out[0] == -5.5


def test_rank_sums_equal_all_comparisons(spark):
    rng = np.random.default_rng(3)
    groups = {g: rng.integers(0, 12, 9 + 4 * i).astype(float) for i, g in enumerate("abc")}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), (None, 1.0)], "g string, v double")
    got = {(r.group_a, r.group_b): r.u for r in stats.rank_sums(df, "g", "v").collect()}
    assert got == {(a, b): sum((x > y) + 0.5 * (x == y) for x in groups[a] for y in groups[b]) for a, b in (("a", "b"), ("a", "c"), ("b", "c"))}


def test_plane_wave_permutation(spark):
    rng = np.random.default_rng(5)
    rows = [("wave", i, *map(float, p), float(p @ [1.0, 2.0, 0.5])) for i, p in enumerate(rng.normal(size=(14, 3)))] + [("noise", i, *map(float, p), float(rng.normal())) for i, p in enumerate(rng.normal(size=(14, 3)))] + [("few", 0, 1.0, 2.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "g string, i int, x double, y double, z double, t double")
    got = [{r.g: (r.n, r.p) for r in stats.latency_permutation(df, ["g"], ["i"], "t", ["x", "y", "z"], 99, 3).collect()} for _ in range(2)]
    assert got[0] == got[1] and got[0]["wave"][0] == 14 and got[0]["wave"][1] <= 0.05 and got[0]["noise"][1] > 0.05 and "few" not in got[0]


def test_trains(spark):
    events = spark.createDataFrame([("good", float(t)) for t in (0, 10, 20, 40, 50, 60)] + [("bad", float(t)) for t in (0, 3, 19, 24)], "m string, t double").withColumn("step", F.lit(10.0))
    out = {r.m: r for r in trains.regularity(events, ["m"], "t", "step").collect()}
    assert out["good"].cadence_error == 0 and out["good"].regular == 1 and out["good"].median_interval == 10 and out["bad"].regular < 0.65
    scored = trains.candidate_scores(trains.regularity(events, ["m"], "t", "step").withColumns({"step": F.lit(10.0), "expected": F.lit(6.0), "one": F.lit(1)}), "m", "step", "expected")
    assert [(r.m, r.score) for r in trains.best_candidates(scored, ["one"], "m").collect()] == [("good", 0.05)]
    files = spark.createDataFrame([("p", 1, 0, 10), ("p", 2, 10, 20), ("q", 3, 0, 5)], "k string, file_id int, start int, stop int")
    wanted = spark.createDataFrame([("p", 7, 9, 10), ("q", 8, 6, 9)], "k string, w_id int, w_start int, w_stop int")
    assert sorted(tuple(r) for r in trains.overlapping(files, wanted, "k").collect()) == [(7, 1, True), (7, 2, True), (8, 3, False)]


def test_edges_and_labels(spark):
    found = spark.createDataFrame([("s", "LA01-LA2", "LA1", "r1", 1.0), ("s", "LA01-LA2", "LB03", "r2", 2.0), ("s", "LA01-LA2", "lb3", "r1", 5.0), ("s", None, "LB3", "r1", 1.0), ("s", "odd", "LB3", "r1", 1.0)], "p string, pair string, ch string, m string, w double")
    places = spark.createDataFrame([("s", "LA 1", "x", 0.0, 0.0, 0.0), ("s", "LB3", "y", 3.0, 4.0, 0.0), ("s", "LB3", "y", 3.0, 4.0, 0.0)], "p string, label string, region string, mni_x double, mni_y double, mni_z double")
    out = directed.detection_edges(found, places, ["p"], "pair", "ch", "m", "w").collect()
    assert [tuple(r) for r in out] == [("s", "LA1", "LB3", 5.0, "x", "y", 5.0)]
    labels = spark.createDataFrame([("A10",), ("a2",), ("A1B3",), ("B",), ("A1",)], "l string")
    assert [r.l for r in labels.orderBy(directed.natural_key(F.col("l"))).collect()] == ["A1", "A1B3", "a2", "A10", "B"]
    rows = spark.createDataFrame([("LA_1_2", "LA01"), ("LA_1_2", "LB1"), (None, "LA1"), ("LA_1_2", None)], "pair string, ch string")
    assert {r.ch for r in evidence.without_contacts(rows, "pair", "ch").collect()} == {"LB1", "LA1", None}


def test_continuous_locking(spark):
    t = np.arange(128) / 64
    rows = [(0, "a", np.sin(2 * np.pi * 8 * t)), (0, "b", np.sin(2 * np.pi * 8 * t + 1)), (0, "c", np.random.default_rng(1).normal(size=128))]
    df = spark.createDataFrame([(r, c, [float(v) for v in y]) for r, c, y in rows], "r int, c string, y array<double>")
    got = {(r.a, r.b): r.plv for r in connectivity.locking_over_samples(df, "r", "c").collect()}
    assert got["a", "b"] > 0.99 > 0.6 > got["a", "c"]
    coherent = {(r.a, r.b): r.coherence for r in connectivity.continuous_coherence(df, "r", "c", 64.0, 32, 7.0, 9.0).collect()}
    assert coherent["a", "b"] > 0.95 and connectivity.segments(df, 32).count() == 3 * 7


def test_sources(spark):
    electrodes = spark.createDataFrame([("s", "A1", "x"), ("s", "A1", "w")], "s string, n string, place string")
    channels = spark.createDataFrame([("s", "A1", "z"), ("s", "B1", "v")], "s string, n string, place string")
    assert sorted(tuple(r) for r in source_tables.contacts_table(electrodes, channels, "s", "n").collect()) == [("s", "A1", "w"), ("s", "B1", "v")]
    times = source_tables.times_or_numbers(spark.createDataFrame([("2024-01-01 00:00:00",)] * 9 + [("x",)], "t string"), "t").collect()
    assert sum(r["at"] is not None for r in times) == 9 and all(r.seconds is None for r in times)
    assert [r.seconds for r in source_tables.times_or_numbers(spark.createDataFrame([("1.5",), (None,)], "t string"), "t").collect()] == [1.5, None]
    named = source_tables.unique_labels(spark.createDataFrame([("r", "A", 1), ("r", "A", 2), ("q", "A", 3)], "r string, l string, i int"), "r", "l", "i", "u")
    assert {r.i: r.u for r in named.collect()} == {1: "A", 2: "A_2", 3: "A"}
    parts = spark.createDataFrame([("f1", "a", 0, 1.0, 0.5), ("f2", "a", 0, 2.0, 0.5), ("f2", "a", 1, 3.0, 0.5)], "file string, channel string, k int, value double, scale double")
    assert sorted(tuple(r) for r in source_tables.joined_recordings(parts, "scale").collect()) == [("a", 0, 1.0), ("a", 1, 3.0)]
    with pytest.raises(Exception, match="different scales"):
        source_tables.joined_recordings(parts.withColumn("scale", F.rand(1)), "scale").collect()
    with pytest.raises(ValueError, match="no file"):
        source_tables.only(parts, "file", "f9")


def test_draws_are_dealt_in_tasks(spark):
    hashes = [r.h for r in spark.range(1, 30).select(F.xxhash64(F.col("id").cast("int"), F.lit(3), F.lit(11)).alias("h")).collect()]
    assert in_tasks.pairings(29, np.array([2, 3]), 11)[1].tolist() == sorted(range(29), key=lambda i: hashes[i])
    rng = np.random.default_rng(2)
    rows = [(g, i, float(i), float(0.05 * i + rng.normal())) for g in ("a", None, "b") for i in range(20)] + [("flat", 0, 1.0, 2.0), ("flat", 1, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, i int, x double, y double")
    out = stats.slope_permutation(df, ["g"], ["i"], "x", "y", 99, 1)
    got = {r.g: r.p for r in out.collect()}
    assert got["flat"] is None and all(0 < got[g] < 1 for g in ("a", "b", None))
    # no row per draw, whose number the optimizer doesn't foresee
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    schema = pa.schema({"g": pa.string(), "y": pa.float64(), "x": pa.float64(), "l": pa.float64()})
    batches = [pa.record_batch({"g": g, "y": y, "x": x, "l": [0.3] * len(g)}, schema) for g, x, y in ((["a"] * 3, [1.0, 2, 3], [1.0, 2, 1]), (["a"] * 2 + [None], [4.0, 5, 1], [3.0, 2, 1]), ([None], [2.0], [0.0]))]
    whole = in_tasks.steeper_draws(iter([pa.concat_batches(batches)]), ["g"], "y", ["x"], "l", 50, 1)
    parts = pa.Table.from_batches(list(in_tasks.steeper_draws(iter(batches), ["g"], "y", ["x"], "l", 50, 1)))
    assert pa.Table.from_batches(list(whole)).to_pylist() == parts.to_pylist() and parts.num_rows == 2


def test_draws_and_their_groups_are_not_broadcast(spark):
    df = spark.createDataFrame([(g, i, float(i), float(i * i % 7)) for g in ("a", None, "b") for i in range(9)], "g string, i int, x double, y double")
    out = stats.slope_permutation(df, ["g"], ["i"], "x", "y", 19, 1)
    assert {r.g: r.n for r in out.collect() if r.p} == {"a": 9, None: 9, "b": 9}
    # small enough to be broadcast, yet they grow with the data
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan
