"""The signal queries work on each user's own readings, so their input grows with the events."""

from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__ as entry
from pulsegrove.operators import epoching, quality, windows
from pulsegrove.plans import tables


def test_every_error_of_a_user_is_an_epoch(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    errors = events.where("event_type = 'error'").select("user_id", F.date_trunc("hour", "ts")).distinct().count()
    hours = events.where("event_type = 'error'").select(F.date_trunc("hour", "ts")).distinct().count()
    trials = entry.queries()["trial_reasons"](spark, data)
    assert trials.select("epoch").distinct().count() == errors > hours


def test_single_readings_reach_the_thresholds(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    assert tables.sessions(spark, data).count() > 0.95 * events.count()
    assert entry.queries()["trial_features_by_user"](spark, data).where("peak_abs > 60").count() > 0


def test_lines_between_readings_stay_in_their_session(spark):
    rows = [(1, "a", 0, 1.0), (1, "a", 4, 9.0), (1, "b", 2, 5.0), (2, "a", 3, 7.0), (1, "a", 5, None)]
    samples = spark.createDataFrame(rows, "session long, channel string, k long, value double")
    got = {tuple(r) for r in epoching.bridged(samples, "session", F.floor(F.col("k") / 2)).collect()}
    assert got == {(1, "a", k, 1.0 + 2 * k) for k in range(5)} | {(1, "b", 2, 5.0), (2, "a", 3, 7.0)}


def test_whole_trials_of_users(spark, data):
    for name in ("phase_locking", "coherence", "granger", "response_calls"):
        assert entry.queries()[name](spark, data).count() > 0


def test_scores_of_trials_keep_a_small_plan(spark):
    rows = [(e, c, float((7 * e + i) % 11), float((5 * e) % 7), float(e % 3 + i), 0.1, 0.0) for i, c in enumerate("ab") for e in range(30)]
    features = spark.createDataFrame(rows, "epoch long, channel string, peak_abs double, ptp double, max_step double, saturation double, missing double")
    out = quality.with_reasons(features, 1.0)
    # each score adds its own part, not a multiple of those before
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 3
    for column in ("peak_abs", "ptp", "max_step"):
        wanted = {(r.epoch, r.channel): r.s for r in windows.robust_scores(features, ["channel"], column, "s").collect()}
        assert {(r.epoch, r.channel): r[f"{column}_score"] for r in out.collect()} == wanted
