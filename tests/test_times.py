from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

import numpy as np
from pyspark.sql import functions as F

from pulsegrove.operators import viterbi
from pulsegrove.operators.time_normalize import normalize_times, normalized_foreign

SITES = [("OSLO", "Europe/Oslo", "DMY"), ("CHIC", "America/Chicago", "MDY"), ("SHAN", "Asia/Shanghai", "YMD"), ("FREE", "Europe/Oslo", None)]
RAW = "raw_id long, site string, start_time string, sampling_freq double, loaded_at timestamp, tz string, status string"
STIM = "stim_id long, site string, stim_start string, loaded_at timestamp, text string"
EVENTS = "event_id long, raw_id long, onset string, loaded_at timestamp, kind string"


def us(*parts, tz="UTC", fold=0):
    at = dt.datetime(*parts, tzinfo=ZoneInfo(tz), fold=fold).astimezone(dt.timezone.utc)
    return (at - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


def run(spark, raw, stim, events, **costs):
    sites = spark.createDataFrame(SITES, "site string, tz string, date_order string")
    at = lambda r: dt.datetime(2025, 1, 1) + dt.timedelta(minutes=r[0])
    frames = [spark.createDataFrame([(*r, at(r), "x", "y") for r in raw], RAW), spark.createDataFrame([(*r, at(r), "x") for r in stim], STIM), spark.createDataFrame([(*r, at(r), "x") for r in events], EVENTS)]
    out = normalize_times(*frames, sites, **costs)
    return {(r.tab, r.row_key): (r.utc_us, r.status) for r in out.collect()}, {(r.tab, r.row_key): r.utc_us for r in normalized_foreign(out).collect()}


def test_formats_zones_and_clock_changes(spark):
    cases = [
        ("OSLO", "03.04.2023 10:00:05", us(2023, 4, 3, 10, 0, 5, tz="Europe/Oslo")), ("CHIC", "03/04/2023 9:05 p.m.", us(2023, 3, 4, 21, 5, tz="America/Chicago")),
        ("CHIC", "2023-03-12 02:30:00", None), ("CHIC", "2023-03-12 02:30:00 CST", us(2023, 3, 12, 8, 30)), ("OSLO", "2023-10-29 02:30:00", None), ("OSLO", "2023-10-29T02:30:00+01:00", us(2023, 10, 29, 1, 30)),
        ("SHAN", "2024-01-02 03:04:05 CST", us(2024, 1, 1, 19, 4, 5)), ("CHIC", "2024-01-02 03:04:05 CST", us(2024, 1, 2, 9, 4, 5)), ("OSLO", "2. März 2024, 03:04:05 Uhr", us(2024, 3, 2, 2, 4, 5)),
        ("OSLO", "Tue, 05 Mar 2024 03:04:05 -0230", us(2024, 3, 5, 5, 34, 5)), ("OSLO", "2024-03-05 03:04:05.25 [America/Chicago]", us(2024, 3, 5, 9, 4, 5, 250000)), ("OSLO", "1709607845", us(2024, 3, 5, 3, 4, 5)),
        ("OSLO", "1709607845123", us(2024, 3, 5, 3, 4, 5, 123000)), ("OSLO", "20240305T030405Z", us(2024, 3, 5, 3, 4, 5)), ("OSLO", "05.03.24 03.04.05", us(2024, 3, 5, 2, 4, 5)), ("OSLO", "30.02.2024 10:00:00", None),
        ("OSLO", "2023-13-01T00:00:00", None), ("OSLO", None, None), ("OSLO", "", None), ("OSLO", "unknown", None), ("OSLO", "1" * 50_000, None), (None, "2024-03-05 03:04:05", None), ("CHIC", "05/05/2024 12:00:00", us(2024, 5, 5, 17)),
        ("OSLO", "03.04.2023 10:00:05", us(2023, 4, 3, 10, 0, 5, tz="Europe/Oslo")),
    ]
    got, found = run(spark, [], [(i, site, text) for i, (site, text, _) in enumerate(cases)], [])
    assert len(got) == len(cases)
    for i, (site, text, want) in enumerate(cases):
        value, status = got["stim_metadata", i]
        assert (value if status == "instant" else None) == want, (site, text, value, status)
        assert (("stim_metadata", i) in found) == (want is not None and not text.endswith("Z"))
    assert got["stim_metadata", 4][1] == "doubled" and got["stim_metadata", 2][1] == "none"


def test_onsets_count_from_the_start(spark):
    raw = [(1, "OSLO", "2023-03-25 23:00:00", 500.0), (2, "OSLO", None, 500.0), (3, "OSLO", "2023-10-29T00:30:00Z", None)]
    t0 = us(2023, 3, 25, 22)
    cases = [
        (1, "12.5", t0 + 12_500_000), (1, "12,5", t0 + 12_500_000), (1, "12 ms", t0 + 12_000), (1, "+01:00:00.5", t0 + 3_600_500_000), (1, "PT1M2.5S", t0 + 62_500_000), (1, "250 samples", t0 + 500_000), (1, "#250", t0 + 500_000),
        (1, "23:30:00", t0 + 1_800_000_000), (1, "01:00:00", us(2023, 3, 26, 0)), (1, "02:30:00", None), (2, "12.5", None), (2, "10:00:00", None), (3, "#250", None), (3, "02:45:00", None), (3, "03:00:00", us(2023, 10, 29, 2)),
        (9, "12.5", None), (1, None, None), (1, "n/a", None), (1, "2023-03-26T01:00:00+01:00", us(2023, 3, 26)), (None, "12.5", None),
    ]
    got, _ = run(spark, raw, [], [(i, r, text) for i, (r, text, _) in enumerate(cases)])
    for i, (r, text, want) in enumerate(cases):
        value, status = got["stim_events", i]
        assert (value if status == "instant" else None) == want, (r, text, value, status)


def test_undeclared_order_follows_its_neighbours(spark):
    stim = [(i, "FREE", f"{m}/{day}/2024 10:00:00") for i, (m, day) in enumerate([("03", "20"), ("03", "21"), ("04", "05"), ("04", "18")])]
    got, found = run(spark, [], stim, [])
    assert got["stim_metadata", 2] == (us(2024, 4, 5, 8), "inferred") and ("stim_metadata", 2) not in found
    assert got["stim_metadata", 0][1] == "instant"


def test_empty_tables(spark):
    assert run(spark, [], [], []) == ({}, {})


def test_a_run_of_neighbours_outweighs_the_declared_order(spark):
    # an American device at a site that declares DMY: only MDY reads its other dates
    stim = [(i, "OSLO", f"{m}/{day}/2024 10:00:00") for i, (m, day) in enumerate([("03", "20"), ("03", "21"), ("04", "05"), ("04", "18"), ("04", "19")])]
    got, found = run(spark, [], stim, [])
    assert found["stim_metadata", 2] == us(2024, 4, 5, 8), got
    # a lone ambiguous date among others keeps the declared order
    lone = [(0, "OSLO", "2024-03-20 10:00:00"), (1, "OSLO", "04/05/2024 10:00:00"), (2, "OSLO", "2024-05-06 10:00:00")]
    assert run(spark, [], lone, [])[1]["stim_metadata", 1] == us(2024, 5, 4, 8)
    assert run(spark, [], stim, [], switch=0.0, backward=0.0)[1]["stim_metadata", 2] == us(2024, 5, 4, 8)


def test_two_digit_parts_are_read_in_all_orders(spark):
    sites = [("OSLO", "05.03.24 10:00:00", us(2024, 3, 5, 9)), ("SHAN", "24/03/05 10:00:00", us(2024, 3, 5, 2)), ("CHIC", "03/05/24 10:00:00", us(2024, 3, 5, 16)), ("SHAN", "05/05/24 10:00:00", us(2005, 5, 24, 2))]
    got, found = run(spark, [], [(i, s, t) for i, (s, t, _) in enumerate(sites)], [])
    assert {i: found.get(("stim_metadata", i)) for i in range(4)} == {i: want for i, (_, _, want) in enumerate(sites)}, got


def test_viterbi_as_a_tree_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(viterbi, "BLOCK", 3)
    monkeypatch.setattr(viterbi, "BUNDLE", 1)
    rng = np.random.default_rng(5)
    day, quarter = viterbi.SLACK_US, 91 * 86_400_000_000
    rows = []
    for source in ("a", "b"):
        for key in range(16):
            times = rng.permutation(9)[: int(rng.integers(1, 4))]  # different, so that a reading is told by its time
            rows.append((source, key, (key // 6) * quarter + key, [(str(rng.choice(["D", "M"])), int(t) * day, float(rng.integers(0, 3))) for t in times]))
    df = spark.createDataFrame(rows, "source string, row_key long, at long, readings array<struct<fmt:string,us:bigint,cost:double>>")
    got = {(r.source, r.row_key): r for r in viterbi.cheapest_readings(df, F.col("at"), lambda x: x.cache()).collect()}

    def step(a, b):
        return (a[0] != b[0]) * viterbi.SWITCH_COST + (b[1] < a[1] - day) * viterbi.BACKWARD_COST

    for source in ("a", "b"):
        own = [r[3] for r in rows if r[0] == source]
        for k, readings in enumerate(own):
            through = []
            for fixed in readings:  # the cheapest path through each reading of record k
                costs = [0.0]
                last: list = [None]
                for j, options in enumerate([fixed] if j == k else rs for j, rs in enumerate(own)):
                    new = [min(c + (step(p, r) if p else 0) for c, p in zip(costs, last)) + r[2] for r in options]
                    costs, last = new, options
                through.append(min(costs))
            if len(readings) == 1:
                assert (source, k) not in got
                continue
            row = got[source, k]
            picked = next(i for i, r in enumerate(readings) if r[1] == row.us)
            assert through[picked] == min(through)
            others = [c for c, r in zip(through, readings) if r[0] != readings[picked][0]]
            assert row.gap == (min(others) - through[picked] if others else float("inf"))
