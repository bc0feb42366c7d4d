from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrove.operators import intervals, windows
from pulsegrove.streaming import pulses


@pytest.fixture
def source(spark, tmp_path):
    rng = np.random.default_rng(6)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, str(rng.integers(0, 3)), t0 + dt.timedelta(seconds=int(s)), int(s), float(v)) for i, (s, v) in enumerate(zip(np.sort(rng.integers(0, 40_000, 300)), rng.normal(size=300)))]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp, k long, value double")
    df.where("id < 150").coalesce(1).write.parquet(str(tmp_path / "in/a.parquet"))
    df.where("id >= 150").coalesce(1).write.parquet(str(tmp_path / "in/b.parquet"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    return df, stream


def finished(spark, stream, mode, tmp_path, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def test_windows_and_sessions_equal_batch(spark, source, tmp_path):
    batch, stream = source
    timed = pulses.event_time(stream, "ts", "1 day")
    got = finished(spark, pulses.window_statistics(timed, "key", "ts", "value", "1 hour"), "complete", tmp_path, "w1")
    want = [tuple(r) for r in pulses.window_statistics(batch, "key", "ts", "value", "1 hour").collect()]
    assert sorted((r[0], r[1], r[2], round(r[3], 9)) for r in got) == sorted((r[0], r[1], r[2], round(r[3], 9)) for r in want) and len(got) > 10
    got = finished(spark, pulses.session_clusters(timed, "key", "ts", "10 minutes"), "complete", tmp_path, "w2")
    clusters = windows.clusters(batch, "key", "k", "id", 599, F.floor(F.col("k") / 5000)).groupBy("key", "cluster").agg(F.min("ts"), F.max("ts"), F.count("*"))
    assert sorted(got) == sorted((r[0], *r[2:]) for r in clusters.collect())


def test_state_equals_batch_however_the_rows_come(spark, tmp_path):
    rng, t0 = np.random.default_rng(8), dt.datetime(2024, 1, 1)
    seconds = np.sort(rng.integers(0, 40_000, 300))
    rows = [(i, str(rng.integers(0, 3)), t0 + dt.timedelta(seconds=int(s)), int(s), float(v)) for i, (s, v) in enumerate(zip(seconds, rng.normal(size=300)))]
    schema = "id long, key string, ts timestamp, k long, value double"
    batch = spark.createDataFrame(rows, schema)
    # neighbours out of order across files, and one far row a key, which lets the watermark pass all others
    far = [(1000 + i, str(i), t0 + dt.timedelta(days=9), 9 * 86_400, 0.0) for i in range(3)]
    mixed = [rows[i] for i in np.argsort(np.arange(300) + rng.integers(0, 40, 300))] + far
    for n, part in enumerate((mixed[:120], mixed[120:200], mixed[200:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}.parquet"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    timed = pulses.event_time(stream, "ts", "1 day")
    got = finished(spark, pulses.thinned(timed, "key", "ts", "k", 900), "append", tmp_path, "s1")
    assert sorted(got) == sorted((r.key, r.k) for r in intervals.thinned(batch, "key", "k", 900).collect()) and len(got) > 50
    got = finished(spark, pulses.onsets(timed.withColumn("on", F.col("value") > 0).withColumn("at", F.col("k") * 1000 + F.col("id")), "key", "ts", "at", "on"), "append", tmp_path, "s2")
    marked = windows.onsets(batch.withColumn("at", F.col("k") * 1000 + F.col("id")), "key", F.floor(F.col("k") / 5000), ["at"], F.col("value") > 0)
    assert sorted(got) == sorted((r.key, r["at"], r.edge) for r in marked.where("edge is not null").collect())


def test_repeats_within_the_watermark_come_once(spark, source, tmp_path):
    batch, stream = source
    doubled = pulses.event_time(stream.unionByName(stream), "ts", "1 day")
    got = finished(spark, pulses.without_repeats(doubled, ["id"]).select("id"), "append", tmp_path, "d1")
    assert sorted(r[0] for r in got) == sorted(r.id for r in batch.collect())
