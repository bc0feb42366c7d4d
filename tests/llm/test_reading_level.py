from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest

from pulsegrove.llm import reading_level as R

LEARNED = "The\nstatistical significance of the attenuated correlation presupposes an asymptotic distribution whose\nregularity conditions have not been independently established."


def cues(*texts):
    return "\n\n".join(f"{i + 1}\n00:00:{i:02d},100 --> 00:00:{i:02d},900\n{t}" for i, t in enumerate(texts))


sys.path.insert(0, str(Path(__file__).parent))
from graded_texts import GRADED  # noqa: E402  sentences graded by hand, which no training sees


@pytest.fixture(scope="module")
def ranker(spark):
    return R.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_documents_and_hand_graded_texts_are_ranked(ranker):
    vocabulary = R.Vocabulary(ranker.words)
    scored = []
    for level, texts in GRADED.items():
        for at in range(0, len(texts) - 2, 3):  # three sentences each
            parts, n = R.passages(R.sentence_sums(R.TOKEN.findall(" ".join(texts[at : at + 3]).lower()), vocabulary))
            scored.append((level, ranker.score(R.style(parts, n), parts[:, R.WEIGHT] / parts[:, R.COUNT])[0]))
    pairs = [(a, b) for a in scored for b in scored if a[0] > b[0] + 1]
    by_hand = np.mean([a[1] > b[1] for a, b in pairs])
    print("held-out pairs of documents ranked right:", ranker.accuracy, "pairs of hand-graded texts two levels apart:", by_hand)
    assert ranker.accuracy > 0.95 and by_hand > 0.9


def test_training_is_bounded_and_the_same_each_time(spark, ranker, monkeypatch):
    again = R.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert np.array_equal(again.style, ranker.style) and np.array_equal(again.words, ranker.words)
    monkeypatch.setattr(R, "SAMPLE", 200)
    assert R.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).accuracy > 0.85


def test_isotonic_never_falls():
    scores, levels = R.isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([2.0, 1.0, 3.0, 4.0]))
    assert scores.tolist() == [1, 2, 3, 4] and levels.tolist() == [1, 2.5, 2.5, 4]


def test_dialogue_only():
    lines = ["[door creaks]", "♪ soft piano ♪", "(laughs)", "Subtitles by xyz - www.xyz.example", "00:00:01,000 -> 00:00:02,000", "WEBVTT", "*sighs*"]
    assert all(not R.spoken(x).strip(" .") for x in lines)
    assert R.spoken("OSKAR: <i>Come in.</i>").split() == [".", "Come", "in."] and R.spoken("- Thanks.").split() == [".", "Thanks."]


def test_documents(spark, ranker):
    talk = ["I told you, didn't I?", "Where did you put it?", "He bought a new car."]
    rows = [
        (1, cues(*[LEARNED] * 8, "[music]")), (2, cues(*talk * 6)), (3, cues(*talk * 24, *[LEARNED] * 2)), (4, None), (5, ""), (6, "  \n "), (7, cues("[music]", "♪ la ♪")), (8, cues(*[LEARNED] * 9, "Thank you.")), (9, cues(LEARNED) * 400),
        (10, cues("Die wissenschaftliche Auseinandersetzung mit der Interpretation der Verfassung setzt eine Konzeption der Legitimität voraus, die nicht aus dem Gesetz und der Rechtsprechung abgeleitet ist.") * 3), (1, cues(*[LEARNED] * 8, "[music]")),
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, level string")
    out = R.reading_levels(frame, ranker)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows)
    assert all(got[i].level is None and got[i].learned_share == 0 for i in (4, 5, 6, 7))
    assert got[1].level > got[3].level > got[2].level
    assert sorted(r.doc_id for r in R.learned(out).collect()) == [1, 1, 8, 9]
    assert R.reading_levels(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    # too few documents to learn from: no levels, no failure
    assert {r.level for r in R.reading_levels(frame).collect()} == {None}
