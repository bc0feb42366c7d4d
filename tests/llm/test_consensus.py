from __future__ import annotations

import datetime as dt

import numpy as np

from pulsegrove.llm import consensus

SCHEMA = "annotation_id long, record_id long, rater string, raw_annotation double, annotated_at timestamp, label string, w double"


def frame(spark, rows):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, r, who, None if v is None else float(v), at + dt.timedelta(days=i), "x", 1.0) for i, (r, who, v) in enumerate(rows)], SCHEMA)


def simulated(seed=1, records=900):
    rng = np.random.default_rng(seed)
    truth = rng.choice(3, records, p=[0.5, 0.3, 0.2])
    skill = {f"r{k}": r for k, r in enumerate([0.95, 0.9, 0.85, 0.8, 0.75, 0.0, 0.0])}
    rows = []
    for r in range(records):
        votes = {who: (truth[r] if rng.random() < s else rng.choice(3, p=[0.5, 0.3, 0.2])) for who, s in skill.items()}
        votes["r6"] = votes["r5"]  # one copies the other
        for who in rng.permutation(list(skill))[: rng.integers(1, 7)]:
            rows.append((r, str(who), int(votes[who])))
    return rows, truth, skill


def test_accuracies_consensus_and_unreliable_raters(spark):
    rows, truth, skill = simulated()
    annotations = frame(spark, rows)
    weighed, accuracies = consensus.prepare(annotations)
    got = {r.rater: r.accuracy for r in accuracies.collect()}
    assert all(abs(got[w] - skill[w]) < 0.1 for w in ("r0", "r1", "r2", "r3", "r4")) and got["r5"] < 0.35
    labels = {r.record_id: r for r in consensus.consensus(weighed).collect()}
    many = [r for r, x in labels.items() if x.n_raters >= 4]
    assert len(labels) == len({r for r, _, _ in rows}) and np.mean([labels[r].label == truth[r] for r in many]) > 0.95
    assert {r.rater for r in consensus.unreliable(annotations).collect()} == {"r5", "r6"}


def brute_pairs(rows):
    by_record, counts = {}, {}
    for r, who, v in rows:
        by_record.setdefault(r, {})[who] = v
    for votes in by_record.values():
        for a in votes:
            for b in votes:
                if a < b:
                    n, same, ca, cb = counts.setdefault((a, b), [0, 0, [0] * 3, [0] * 3])
                    counts[a, b][0] += 1
                    counts[a, b][1] += votes[a] == votes[b]
                    ca[votes[a]] += 1
                    cb[votes[b]] += 1
    out = {}
    for pair, (n, same, ca, cb) in counts.items():
        chance = sum(x * y for x, y in zip(ca, cb)) / n**2
        out[pair] = (n, (same / n - chance) / (1 - chance) if chance < 1 - 1e-9 else 0.0)
    return out


def test_pairs_of_records_with_many_labels_are_all_counted(spark):
    rng = np.random.default_rng(3)
    rows = [(r, f"w{k:03d}", int(rng.integers(3))) for r, size in ((1, 200), (2, 200), (3, 49), (4, 5)) for k in rng.permutation(220)[:size]]
    labels = consensus.latest_labels(frame(spark, rows))
    want = brute_pairs(rows)
    for block in (48, 7):
        got = {(r.a, r.b): (r.n, r.k) for r in consensus.pair_agreement(labels, block).collect()}
        assert got.keys() == want.keys() and all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 1e-9 for p in want)


def test_refinements_lower_the_error_where_raters_copy(spark):
    errors = {0: [], 2: []}
    for seed in (1, 2, 3):
        rows, _, skill = simulated(seed)
        pairs = consensus.pair_agreement(consensus.latest_labels(frame(spark, rows))).cache()
        for n in errors:
            got = {r.rater: r.accuracy for r in consensus.triplet_accuracies(pairs, n).collect()}
            errors[n].append(np.mean([abs(got.get(w, 0.0) - s) for w, s in skill.items()]))
    print("mean error of accuracies without and with the passes:", np.round(np.mean(errors[0]), 3), np.round(np.mean(errors[2]), 3))
    assert np.mean(errors[2]) < np.mean(errors[0]) - 0.02


def test_edge_cases(spark):
    rows = [(1, "a", 0), (1, "a", 1), (1, "b", 1), (1, "c", -1), (1, "d", None), (1, "e", float("nan")), (1, "f", 7), (2, "a", 2), (3, "a", 2), (3, "b", 1), (None, "a", 1), (4, None, 1)]
    labels = {(r.record_id, r.rater): r.label for r in consensus.latest_labels(frame(spark, rows)).collect()}
    assert labels == {(1, "a"): 1, (1, "b"): 1, (2, "a"): 2, (3, "a"): 2, (3, "b"): 1}
    weighed, _ = consensus.prepare(frame(spark, rows))
    got = {r.record_id: (r.label, r.n_raters, r.agreement) for r in consensus.consensus(weighed).collect()}
    assert got == {1: (1, 2, 1.0), 2: (2, 1, None), 3: (1, 2, 0.0)}
    report = spark.createDataFrame([("a", "b", 10, 0.5, float("nan"), "x"), ("a", "b", 10, 0.5, 0.4, "x")], "rater_a string, rater_b string, available int, agreement double, kappa double, rater string")
    assert {r.rater: r.reported_kappa for r in consensus.rater_report(frame(spark, rows), report).collect()} == {"a": 0.4, "b": 0.4}
    lone = frame(spark, [(1, "a", 0)])
    assert [(r.rater, r.reliability) for r in consensus.rater_report(lone, report.limit(0)).collect()] == [("a", None)]
    assert consensus.unreliable(frame(spark, [])).count() == 0
