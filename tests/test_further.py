from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrove.functions import kernels
from pulsegrove.operators import directed, epoching, montage, responses, stats
from pulsegrove.plans import pipeline
from pulsegrove.sources import tables


def test_notch_and_resampling():
    t = np.arange(0, 4, 1 / 500)
    x = np.sin(2 * np.pi * 10 * t)[None]
    line = np.sin(2 * np.pi * 50 * t)[None]
    out = kernels.filtered([kernels.notch(50, 2, 500)], x + line)
    assert np.abs(out - x)[:, 500:1500].max() < 0.02
    half = kernels.resampled(x, 1, 2)
    assert half.shape[1] == 1000 and np.abs(half - x[:, ::2])[:, 50:-50].max() < 0.01
    up = kernels.resampled(x, 3, 2)
    assert np.abs(up[:, 60:-60] - np.sin(2 * np.pi * 10 * np.arange(up.shape[1]) / 750)[None, 60:-60]).max() < 0.01


def test_pipeline_chains_steps(spark):
    y = np.sin(2 * np.pi * 4 * np.arange(256) / 128)
    df = spark.createDataFrame([(1, y.tolist()), (2, None)], "id int, y array<double>")
    out, name = pipeline.run(df, [("bandpass", {"low": None, "high": 20.0}), ("decimate", {"factor": 2})], 128.0)
    rows = {r.id: r.y for r in out.collect()}
    assert rows[2] is None and len(rows[1]) == 128 and np.abs(np.array(rows[1]) - y[::2])[30:-30].max() < 0.05
    assert name != pipeline.run(df, "raw", 128.0)[1] and pipeline.run(df, "slow", 500.0)[0].columns == ["id", "y"]
    with pytest.raises(ValueError):
        pipeline.run(df, [("nope", {})], 1.0)


def test_divergence_and_order_over_time(spark):
    edges = spark.createDataFrame([("g", "x", 0, "a", 1.0), ("g", "x", 1, "b", 3.0), ("g", "x", 2, "b", 5.0), ("g", "x", 3, "a", 0.0), ("g", "x", 4, "a", 1.0), ("g", "x", 4, "b", 1.0)], "g string, source string, t int, target string, weight double")
    got = {r.t: round(r.jsd, 9) for r in directed.target_divergence(edges, ["g"], "t").collect()}
    p, q = np.array([0.5, 0.5]), np.array([0.0, 1.0])
    m = (p + q) / 2
    want = (np.sum(p * np.log2(p / m)) + np.log2(1 / m[1])) / 2
    assert got == {1: 1.0, 2: 0.0, 4: round(want, 9)}
    assert {(r.t, r.target) for r in directed.strongest_over_time(edges, "t", 1).collect()} == {(0, "a"), (1, "b"), (2, "b"), (3, "a"), (4, "a")}


def test_completed_contacts(spark):
    rows = [("P", "L", n, 10.0 + 3 * n if n != 5 else None, 2.0 * n if n != 5 else None, 1.0 if n != 5 else None) for n in (1, 2, 3, 4, 5)] + [("P", "L", 9, None, None, None), ("P", "M", 1, None, None, None)]
    contacts = spark.createDataFrame(rows, "patient string, lead string, number int, mni_x double, mni_y double, mni_z double")
    out = {(r.lead, r.number): r for r in montage.completed_contacts(contacts, stats.lead_fits(contacts, ["patient"]), ["patient"]).collect()}
    assert (out["L", 5].mni_x, out["L", 5].mni_y, out["L", 5].filled) == (25.0, 10.0, True) and not out["L", 1].filled
    assert out["L", 9].mni_x is None and out["M", 1].mni_x is None and len(out) == 7


def test_label_match_prefers_the_exact_label(spark):
    rows = spark.createDataFrame([("P", "PT01"), ("P", "pol PT1-Ref"), ("P", "Q1"), ("P", "R1"), (None, "PT1")], "patient string, label string")
    reference = spark.createDataFrame([("P", "PT01", "a"), ("P", "Q01", "c"), ("P", "R01", "d"), ("P", "R001", "e")], "patient string, label string, region string")
    got = {r.label: r.region for r in montage.with_label_match(rows, reference, ["patient"], "label", "region").collect()}
    assert got == {"PT01": "a", "pol PT1-Ref": "a", "Q1": "c", "R1": None, "PT1": None}


def test_early_late_and_zero(spark):
    rng = np.random.default_rng(0)
    rows = []
    for name, shape in (("n1", lambda k: -8 * (2 <= k <= 4) + 6 * (6 <= k <= 9)), ("one-sided", lambda k: 9 * (k >= 1)), ("null", lambda k: 0)):
        rows += [(name, k, float(shape(k) + 0.3 * rng.normal())) for k in range(-20, 20)]
    got = {r.channel: (r.reversal, r.significant) for r in responses.early_late_z(spark.createDataFrame(rows, "channel string, offset int, mean double"), (-20, -1), (1, 4), (5, 15)).collect()}
    assert got["n1"] == (True, True) and got["one-sided"][1] is False and got["null"][1] is False
    flat = spark.createDataFrame([(0, k, 1.0 + 50 * (k == 0) + 0.1 * (k % 3)) for k in range(-9, 5)] + [(1, k, 1.0) for k in range(-9, 5)], "epoch int, offset int, envelope double")
    assert {r.epoch: r.artifact for r in responses.zero_artifacts(flat, (-9, -1)).collect()} == {0: True, 1: False}
    assert epoching.artifact_envelope(spark.createDataFrame([(0, 0, -3.0), (0, 0, 1.0)], "epoch int, offset int, value double")).first().envelope == 3.0


def test_latency_gradient(spark):
    rng = np.random.default_rng(3)
    xyz = rng.normal(size=(30, 3)) * 10
    rows = [("wave", *map(float, r), float(20 + 0.3 * r[0] + 0.4 * r[1])) for r in xyz] + [("few", 1.0, 2.0, 3.0, 4.0)] * 3 + [("line", float(i), 0.0, 0.0, float(i)) for i in range(9)]
    got = {r.g: r for r in stats.latency_gradient(spark.createDataFrame(rows, "g string, x double, y double, z double, t double"), ["g"], "t", ["x", "y", "z"]).collect()}
    assert abs(got["wave"].gradient - 0.5) < 1e-9 and abs(got["wave"].speed - 2) < 1e-9 and abs(got["wave"].unit_x - 0.6) < 1e-9
    assert got["few"].status == "too_few" and got["line"].status == "flat" and got["line"].speed is None


def test_bids_listing(spark, tmp_path):
    for name in ("sub-A_ses-1_task-x_run-1_ieeg.vhdr", "sub-A_ses-1_task-x_run-1_ieeg.eeg", "sub-B_ieeg.edf", "sub-B_events.tsv"):
        (tmp_path / name).write_text("x")
    got = sorted((r.subject, r.session, r.task, r.suffix) for r in tables.bids_recordings(spark, str(tmp_path)).collect())
    assert got == [("A", "1", "x", "vhdr"), ("B", None, None, "edf")]
    assert [r[0] for r in spark.createDataFrame([("LTG1-LTG2",), ("LTG01_2",), ("odd",), (None,)], "p string").select(tables.stim_pair(F.col("p"))).collect()] == ["LTG_1_2", "LTG_1_2", "odd", None]
