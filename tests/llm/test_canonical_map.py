from __future__ import annotations

import random

from pyspark.sql import functions as F

from pulsegrove.llm import canonical_map
from pulsegrove.llm.canonical_map import map_tables, map_values, rewritten, unmatched

CATALOG = [(i, f"{lead}{n}", lead, n, name) for i, (lead, n, name) in enumerate([(x, n, y) for x, y in [("LCINA", "left anterior cingulate"), ("RCINA", "right anterior cingulate"), ("LCINP", "left posterior cingulate"), ("LINSAN", "left anterior insula"), ("RPUTAM", "right putamen")] for n in range(1, 11)])]
SCHEMA = "catalog_id long, elec_label string, lead_label string, contact_no int, anat_label string"


def test_edit_distance(spark):
    words = ["abc", "abd", "ab", "abcd", "acb", "bac", "cba", "abcde"]
    out = spark.createDataFrame([(x,) for x in words], "x string").select("x", canonical_map.edit_distance(F.lit("abc"), F.col("x")).alias("d")).collect()
    assert [r.d for r in out] == [0, 1, 1, 1, 1, 1, 2, 2]


def noisy(rng, word, edits):
    for _ in range(edits):
        i, kind, letter = rng.randrange(1, len(word)), rng.randrange(4), rng.choice("abcdefghilmnoprstuvx")
        word = word[:i] + [letter + word[i + 1 :], word[i + 1 :], letter + word[i:], word[i + 1 : i + 2] + word[i] + word[i + 2 :]][kind]
    return word


def test_threshold_and_margin_decide_on_held_out_noise(spark, data):
    rng, catalog = random.Random(7), spark.read.parquet(f"{data}/contact_catalog.parquet")
    forms = [(r.form, r.lead) for r in canonical_map.lead_forms(catalog).collect()]
    rows = {}
    for edits in (1, 2):
        for form, lead in forms:
            for _ in range(6):
                word = noisy(rng, form, edits)
                if word[:1] == form[0]:
                    rows.setdefault(f"{word[0]}|{word[1:]}", (lead, edits))
    rows |= {f"{rng.choice('lr')}|{''.join(rng.choice('qwzxjkvy') for _ in range(rng.randrange(2, 6)))}": (None, 0) for _ in range(60)}
    stems = spark.createDataFrame([(x,) for x in rows], "stem string").cache()
    found = {}
    for threshold, margin in ((canonical_map.THRESHOLD, canonical_map.MARGIN), (-1.0, canonical_map.MARGIN), (0.4, canonical_map.MARGIN), (canonical_map.THRESHOLD, 0.0), (canonical_map.THRESHOLD, 1.0)):
        got = {r.stem: r.lead for r in canonical_map.match_stems(stems, catalog, threshold, margin).collect()}
        found[threshold, margin] = got
        for edits in (1, 2):
            own = [x for x, (_, e) in rows.items() if e == edits]
            hits, right = [x for x in own if got.get(x)], [x for x in own if got.get(x) == rows[x][0]]
            print(f"threshold {threshold}, margin {margin}, {edits} edits: recall {len(right) / len(own):.3f}, precision {len(right) / max(1, len(hits)):.3f}")
            if edits == 1 and (threshold, margin) == (canonical_map.THRESHOLD, canonical_map.MARGIN):
                assert len(right) / len(own) > 0.95 and len(right) / len(hits) > 0.98
    standard = found[canonical_map.THRESHOLD, canonical_map.MARGIN]
    assert not any(standard.get(x) for x, (_, e) in rows.items() if e == 0)
    assert all(got != standard for key, got in found.items() if key != (canonical_map.THRESHOLD, canonical_map.MARGIN))


def test_values(spark):
    good = {
        "LCINA4": "LCINA4", "lcina04": "LCINA4", "POL LCINA4-Ref": "LCINA4", "EEG L CINA4-A1": "LCINA4", "CINA_L 4": "LCINA4", "left CINA-4": "LCINA4", "LCINA four": "LCINA4", "LСINА4": "LCINA4", "LCINA４": "LCINA4", "LCINA1O": "LCINA10",
        "contact 4 of left anterior cingulate": "LCINA4", "anterior cingulate L, no. 4": "LCINA4", "left anterior cingulatte 4": "LCINA4", "RPUTMA7": "RPUTAM7", "RPUTAM7 (bad)": "RPUTAM7", "LINSAN2 [2]": "LINSAN2", "PUTAM03 (right)": "RPUTAM3",
    }
    bad = ["", "n/a", None, "???", "LCINA", "LCINA1-LCINA2", "LCINA99", "CINA4", "LCINX4", "PUTAM L R 3", "LQZX4", "EKG1", "x" * 60_000 + "1", "LCINA" + "1" * 50, "123"]
    out = map_values(spark.createDataFrame([(x,) for x in [*good, *bad, "LCINA4"]], "value string"), spark.createDataFrame(CATALOG, SCHEMA))
    labels = {r[0]: r[1] for r in CATALOG}
    rows = out.collect()
    got = {r.value: labels.get(r.catalog_id) for r in rows}
    assert len(rows) == len(good) + len(bad)
    assert {x: got[x] for x in good} == good
    assert {x: got[x] for x in bad} == dict.fromkeys(bad)
    assert all(r.verdict != "accepted" for r in rows if r.value in bad)


def test_rows_reports_and_empty_tables(spark):
    catalog = spark.createDataFrame(CATALOG, SCHEMA)
    typed = spark.createDataFrame([(1, "LCINA4", "a"), (2, "lcina4", "a"), (2, "lcina4", "a"), (3, None, "a"), (4, "nope", "a")], "row_key long, value string, stem string")
    mapped = map_tables({"t": typed, "u": typed.limit(0)}, catalog)
    assert mapped.count() == 5
    assert [(r.tab, r.row_key) for r in rewritten(mapped, catalog).collect()] == [("t", 2), ("t", 2)]
    assert {(r.value, r.n_rows) for r in unmatched(mapped).collect()} == {(None, 1), ("nope", 1)}
    assert map_tables({"t": typed}, catalog.limit(0)).where("catalog_id is not null").count() == 0
    assert map_tables({"t": typed.limit(0)}, catalog).count() == 0
