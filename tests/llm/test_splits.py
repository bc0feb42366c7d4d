from __future__ import annotations

import datetime as dt
from collections import Counter

import numpy as np

from pulsegrove.llm import splits

PEOPLE = "participant_key long, participant_id string, site string, former_id string, registered_at timestamp_ntz, component string"
COVERAGE = "coverage_id long, subject string, site string, stimpair string, recording_uid string, computed_at timestamp_ntz, split string"
UID = "00c8adc1-fdce-5e7c-8e4f0f70"


def frames(spark, people, rows):
    at = dt.datetime(2022, 1, 1)
    coverage = [(i, s, t, "A1-A2", u, None if n is None else at + dt.timedelta(days=n), "x") for i, (s, t, u, n) in enumerate(rows)]
    return spark.createDataFrame([(*p, at, "x") for p in people], PEOPLE), spark.createDataFrame(coverage, COVERAGE), spark.createDataFrame([("HAVN",), ("BRIX",)], "site string")


def run(spark, people, rows, until):
    p, c, s = frames(spark, people, rows)
    state = splits.members(spark, *splits.increments(p, c, s, until))
    return splits.split_rows(p, c, state), state


def test_who_belongs_together(spark):
    people = [(1, "HAVN0001", "HAVN", "brix-7"), (2, "BRIX0007", "BRIX", "n/a"), (3, "HAVN0002", "HAVN", "ZZZZ0001"), (4, "HAVN0003", "HAVN", "ZZZZ0001"), (5, "BRIX0001", "BRIX", None), (6, "BRIX0002", "BRIX", "BRIX0002"), (7, "BRIX0003", "BRIX", "")]
    rows = [
        ("P1", " havn ", UID, 1), ("BRIX-0001", "BRIX", "{00C8ADC1-FDCE-5E7C-8E4F0F70}", 2), ("sub-BRIX0002", "x", "0" * 24, 3), ("3", "BRIX", "0" * 24, 4), ("PHANTOM", "HAVN", UID, 5), ("PHANTOM", "HAVN", "CAL-2024-W26", 5),
        (None, None, None, None), ("HAVN0002", "HAVN", "n/a", 6), ("HAVN0003", "HAVN", "n/a", 6), ("P1", " havn ", UID, 1), ("y" * 50_000, "HAVN", "z" * 50_000, 7),
    ]
    for until in (["2022-01-03", None], ["2022-01-02 12:00:00", "2022-01-05", "2022-01-07", None], [None]):
        out, state = run(spark, people, rows, until)
        assert sorted((r.participant_key_a, r.participant_key_b) for r in splits.tied_pairs(state).collect()) == [(1, 2), (1, 5), (2, 5)]
        out = out.collect()
        assert len(out) == len(rows) and all(r.split for r in out)
        sides = {}
        for r in out:
            assert sides.setdefault(r.component, r.split) == r.split


def grown(spark, path, version, batch, codes=()):
    splits.increment(spark, path, version, spark.createDataFrame(batch, "entity long, uid string"), spark.createDataFrame([], "entity long"), spark.createDataFrame(list(codes), "entity long, token string"))
    return {r.entity: (r.component, r.split, r.status) for r in splits.members(spark, path, version).collect()}


def test_increments_keep_splits_quarantine_conflicts_and_follow_merges(spark, tmp_path):
    path = str(tmp_path / "state")
    # two splits at least: the larger component goes to the one that lacks most, the other to another
    first = grown(spark, path, 1, [(1, "a")] * 8 + [(2, "b")] * 2)
    assert {first[1][1], first[2][1]} <= set(splits.SPLITS) and first[1][1] != first[2][1] and first[1][2] == "new"
    second = grown(spark, path, 2, [(3, "b"), (4, "c"), (5, "c")])
    assert second[1] == (1, first[1][1], "kept") and second[2] == second[3] == (2, first[2][1], "kept") and second[4][:2] == second[5][:2] and second[4][2] == "new"
    # a row of 3 with 1's recording ties components of two splits, whose members arrived in earlier increments
    third = grown(spark, path, 3, [(3, "a"), (6, "c")])
    assert {third[k] for k in (1, 2, 3)} == {(1, "quarantine", "conflict")} and third[4][:2] == third[5][:2] == third[6][:2] and third[4][1] == second[4][1]
    # whoever joins a quarantined component is quarantined, and earlier versions stay as they were
    fourth = grown(spark, path, 4, [(7, "b"), (8, "d")], [(8, "code|x"), (2, "code|x")])
    assert fourth[7][:2] == (1, "quarantine") and fourth[8][1] in splits.SPLITS
    assert {r.entity for r in splits.members(spark, path, 2).collect()} == {1, 2, 3, 4, 5}


def test_an_increment_reads_its_rows_and_the_state_only(spark, tmp_path):
    path, jobs = str(tmp_path / "state"), []
    status = spark.sparkContext.statusTracker()
    for version in range(1, 5):
        spark.sparkContext.setJobGroup(f"increment {version}", "")
        grown(spark, path, version, [(10 * version + k, f"u{version}-{k // 2}") for k in range(10)])
        jobs.append(len(status.getJobIdsForGroup(f"increment {version}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[3] <= jobs[1] + 2, jobs


def test_components_equal_union_find_and_shares_are_kept(spark):
    rng = np.random.default_rng(4)
    n = 1500
    tokens = [(i, f"own{i}") for i in range(n)] + [(int(a), f"t{t}") for t in range(500) for a in rng.integers(0, n, 2)] + [(i, "chain%d" % (i // 2)) for i in range(60)] + [(i + 1, "chain%d" % (i // 2)) for i in range(60)]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for e, t in tokens:
        parent[find(e)] = find(by.setdefault(t, e))
    smallest = {}
    for e in range(n):
        smallest.setdefault(find(e), e)
    found = {r.entity: r.component for r in splits.components(splits.stars(spark.createDataFrame(tokens, "entity long, token string"))).collect()}
    assert {e: found.get(e, e) for e in range(n)} == {e: smallest[find(e)] for e in range(n)}
    nodes = spark.createDataFrame([(i, found.get(i, i), None, 1) for i in range(n)], "component long, root long, split string, weight long")
    errors = {}
    for large in (splits.LARGE, 2.0, 0.0):  # as it is, all in hash order, all one by one
        shares = Counter()
        for r in splits.assign(nodes, None, large).collect():
            shares[r.split] += r.weight
        errors[large] = max(abs(shares[s] / n - share) for s, share in splits.SPLITS.items())
    print("largest error of a share, as it is, in hash order, one by one:", errors)
    assert errors[splits.LARGE] < 0.01 and errors[2.0] < 0.25 and errors[0.0] < 0.01


def test_shares_of_the_given_tables(spark, data):
    import __spark_entry__ as entry

    shares = {r.split: r.share for r in entry.queries()["p5_shares"](spark, data.replace("0.001", "0.01")).collect()}
    kept = 1 - shares.get(splits.QUARANTINE, 0.0)
    assert all(abs(shares[s] / kept - share) < 0.04 for s, share in splits.SPLITS.items()), shares


def test_pairs_of_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(splits, "PAIR_BLOCK", 8)
    state = spark.createDataFrame([(i, 1) for i in range(1, 41)] + [(100, 2), (-5, 1)], "entity long, component long")
    pairs = [(r.participant_key_a, r.participant_key_b) for r in splits.tied_pairs(state).collect()]
    assert sorted(pairs) == [(a, b) for a in range(1, 41) for b in range(a + 1, 41)]


def test_empty_tables(spark):
    out, state = run(spark, [], [], ["2022-01-03", None])
    assert out.count() == 0 and splits.tied_pairs(state).count() == 0
