"""Problem 9: the reading level of each document's dialogue.

A linear ranker is learned from pairs of graded documents of the corpus: the grade of a document is that of a published
readability formula (school years by words per sentence and syllables per word), and the weights are those of a logistic
model of which of two documents is the harder one, over syntax (sentence length, commas) and vocabulary (word lengths and
the words themselves, hashed). The sample that is graded is bounded by ``SAMPLE`` documents, drawn by a hash of the ids; the
model is trained once, and its weights are sent to the tasks. Isotonic regression on documents held out from training turns
scores into levels, again in school years. The ranker then scores every passage (whole sentences, ``PASSAGE`` words or
more) of every document: the document's level is the mean level of its words, and the share of words in passages at
university level says for how much of the dialogue that holds.

Dialogue is what is left of the text without cue numbers, time lines, markup, adverts, sound descriptions and speaker
names. Defined results: null, empty and blank texts, and texts without words, have no level and a share of 0; texts of
any length are read whole; repeated rows come out once each; an empty table gives an empty table, and without enough
graded documents (``LEAST``) no text has a level; extra columns are not carried along.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Level (school years) of a passage, and of a document as a whole, from which it counts as learned prose at university:
#: school, four years of college and two more.
UNIVERSITY = 18.0
#: Words after which a sentence's end also ends a passage.
PASSAGE = 60
#: Words at the corpus' typical level that each passage's level is averaged with, as few words say little.
TYPICAL_WORDS = 20
#: Documents that are graded to train and calibrate (a bound; half of them each), the least number, and pairs drawn from them.
SAMPLE, LEAST, PAIRS = 3000, 40, 12_000
#: Grades of a pair differ by at least this.
GAP = 1.5
#: Hashed words, and the scale of their shares: small, so that words count where style leaves a difference open.
WORDS, WORD_SCALE = 512, 0.1
KEPT = 300_000

# The commonest words of English, and of the other languages, by which a text's language is told.
ENGLISH = set("the of and to in that is was it for as with be on by at this have from or had not are but which you i he she we they what an their there been has would if about who will more no when out so can".split())
OTHER = set(
    "der die das und nicht ich sie ist ein eine zu den mit auf für dem wir ihr wie aber le la les des et est une un je tu il elle nous vous pas que qui dans pour sur avec ce ne au el los las y es en por con para se lo mi su pero como más está del al no".split()
) - ENGLISH - {"a", "no", "me"}
VOWELS = re.compile(r"[aeiouy]+")

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?…。]+|[,;:]")
TIME = re.compile(r"\d{1,2}[:;.]\d{2}[:;.]\d{2}|-->|^\W*\d[\d\s:;,.>-]*$")
ADVERT = re.compile(r"www\.|https?:|\S@\S|\.example\b|\.com\b|subtitles?\s+(?:by|from)|subtitled|synced|untertitel|sous-titres|subt[ií]tulos|субтитры|advertise|for watching|download", re.I)
MARKUP = re.compile(r"<[^<>]*>|\{[^{}]*\}|\[[^\[\]]*\]|\([^()]*\)|♪[^♪]*♪?|\*[^*]*\*|#[^#]*#|[​‌‍﻿]")
SPEAKER = re.compile(r"^[-–—\s]*[A-ZÀ-Þ][A-ZÀ-Þ .'0-9]{1,24}:\s*")
HEADER = re.compile(r"^(?:WEBVTT|NOTE|STYLE|REGION)\b")


def spoken(line: str) -> str:
    """A text line's dialogue; a turn that begins with a dash begins a sentence."""
    line = line.strip()
    if not line or HEADER.match(line) or TIME.search(line) or ADVERT.search(line):
        return ""
    line = MARKUP.sub(" ", line)
    turn = line.lstrip()[:1] in ("-", "–", "—") and bool(line)
    return (". " if turn or SPEAKER.match(line) else "") + SPEAKER.sub("", line).lstrip("-–— ")


class Spoken(dict):
    def __missing__(self, line: str) -> str:
        if len(self) >= KEPT:
            self.clear()
        self[line] = out = spoken(line)
        return out


#: Columns of a word's row: letters, whether 7 and 10 or more, syllables, the learned weight, English and foreign function words, words, commas.
LETTERS, LONG, LONGEST, SYLLABLES, WEIGHT, IN_ENGLISH, IN_OTHER, COUNT, COMMAS = range(9)
WIDTH = 9
STYLE = ("log words per sentence", "commas per word", "letters per word", "words of seven letters", "words of ten letters", "syllables per word")


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS


class Vocabulary(dict):
    """Rows of word features by word; row 0 ends a sentence, row 1 is a comma."""

    def __init__(self, weights: np.ndarray | None = None) -> None:
        super().__init__()
        self.weights = weights
        self.rows = np.zeros((4096, WIDTH), np.float32)
        self.rows[1, COMMAS] = 1
        self.used = 2

    def __missing__(self, word: str) -> int:
        if word[0] in ".!?…。":
            return 0
        if word[0] in ",;:":
            return 1
        if self.used == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        weight = self.weights[bucket(word)] if self.weights is not None else 0.0
        length = len(word)
        self.rows[self.used] = [length, length >= 7, length >= 10, max(1, len(VOWELS.findall(word))), weight, word in ENGLISH, word in OTHER, 1.0, 0.0]
        self[word] = self.used
        self.used += 1
        return self.used - 1

    def ids(self, tokens: list[str]) -> np.ndarray:
        if self.used > KEPT:
            self.clear()
            self.used = 2
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


def dialogue(text: str | None, lines: Spoken) -> list[str]:
    """The words, commas and sentence ends of a text's dialogue."""
    if not text:
        return []
    parts = [lines[x] for x in text.replace("\r", "\n").split("\n") if "-->" not in x and not x.isdigit()]
    return TOKEN.findall(" ".join(parts).lower())


def sentence_sums(tokens: list[str], vocabulary: Vocabulary) -> np.ndarray:
    """The sums of the rows of each sentence that has a word."""
    ids = vocabulary.ids(tokens)
    if not len(ids):
        return np.zeros((0, WIDTH), np.float32)
    ends = np.flatnonzero(ids == 0)
    starts = np.unique(np.r_[0, ends[ends < len(ids) - 1] + 1])
    sums = np.add.reduceat(vocabulary.rows[ids], starts, axis=0)
    return sums[sums[:, COUNT] > 0]


def passages(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of consecutive sentences with ``PASSAGE`` words or more (the last may have fewer), and their numbers of sentences."""
    if not len(sums):
        return sums, np.zeros(0)
    total, starts, since = np.cumsum(sums[:, COUNT]), [0], 0.0
    for k in range(len(sums) - 1):
        if total[k] - since >= PASSAGE:
            starts.append(k + 1)
            since = total[k]
    if len(starts) > 1 and total[-1] - since < PASSAGE:
        starts.pop()  # a short rest belongs to the passage before
    return np.add.reduceat(sums, starts, axis=0), np.diff(np.r_[starts, len(sums)]).astype(float)


def style(sums: np.ndarray, sentences: np.ndarray) -> np.ndarray:
    """The features of ``STYLE`` of each row of sums."""
    n = sums[:, COUNT]
    return np.column_stack([np.log(n / sentences), sums[:, COMMAS] / n, sums[:, LETTERS] / n, sums[:, LONG] / n, sums[:, LONGEST] / n, sums[:, SYLLABLES] / n]).astype(float)


def grade(words: float, sentences: float, syllables: float) -> float:
    """The school years that a text asks for, by Flesch and Kincaid's formula."""
    return 0.39 * words / sentences + 11.8 * syllables / words - 15.59


def is_english(english: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether a text with these shares of function words is English."""
    return (english >= 0.1) & (english > 2 * other)


def isotonic(scores: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and the levels fitted to them, never falling (pool adjacent violators)."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []
    for level in levels[order]:
        blocks.append([float(level), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            mean, n = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + mean * n) / (blocks[-1][1] + n), blocks[-1][1] + n]
    return scores[order], np.concatenate([np.full(int(n), mean) for mean, n in blocks])


@dataclass
class Ranker:
    """Weights of style and of hashed words, and the calibration of scores into levels."""

    mean: np.ndarray
    scale: np.ndarray
    style: np.ndarray
    words: np.ndarray
    scores: np.ndarray
    levels: np.ndarray
    #: Mean level of the held-out documents.
    typical: float
    #: Share of held-out pairs that the ranker puts in the right order.
    accuracy: float

    def score(self, features: np.ndarray, word_sum: np.ndarray) -> np.ndarray:
        """``word_sum``: the mean weight of the hashed words."""
        return ((features - self.mean) / self.scale) @ self.style + word_sum

    def level(self, scores: np.ndarray) -> np.ndarray:
        return np.interp(scores, self.scores, self.levels)


def graded_pairs(grades: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the harder and the easier document of pairs whose grades differ enough."""
    a, b = rng.integers(0, len(grades), (2, PAIRS))
    far = np.abs(grades[a] - grades[b]) >= GAP
    a, b = a[far], b[far]
    return np.where(grades[a] > grades[b], a, b), np.where(grades[a] > grades[b], b, a)


def fit(features: np.ndarray, words: np.ndarray, grades: np.ndarray, ridge: float = 1e-3, steps: int = 200, rate: float = 1.0) -> Ranker | None:
    """The ranker of documents with style ``features``, shares of hashed ``words`` and ``grades``; every other one calibrates."""
    if len(grades) < LEAST:
        return None
    rng, own = np.random.default_rng(9), np.arange(len(grades)) % 2 == 0
    mean, scale, spread = features[own].mean(axis=0), features[own].std(axis=0) + 1e-6, (words[own].std(axis=0) + 1e-3) / WORD_SCALE
    x = np.concatenate([(features - mean) / scale, words / spread], axis=1).astype(np.float32)
    harder, easier = graded_pairs(grades[own], rng)
    z = x[own][harder] - x[own][easier]
    w, speed = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    step = rate / max(1.0, float((z**2).sum(axis=1).mean()) / 4)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(z @ w, -30, 30)))
        speed = 0.9 * speed + step * ((z * p[:, None]).mean(axis=0) - ridge * w)
        w = w + speed
    scores = x @ w
    harder, easier = graded_pairs(grades[~own], rng)
    accuracy = float((scores[~own][harder] > scores[~own][easier]).mean())
    n = features.shape[1]
    return Ranker(mean, scale, w[:n].astype(float), (w[n:] / spread).astype(float), *isotonic(scores[~own].astype(float), grades[~own]), float(grades[~own].mean()), accuracy)


def train(documents: DataFrame) -> Ranker | None:
    """The ranker learned from a sample of at most about ``SAMPLE`` documents; the driver gets one row of features for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, vocabulary = Spoken(), Vocabulary()
        for batch in batches:
            for text, key in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                tokens = dialogue(text, lines)
                sums = sentence_sums(tokens, vocabulary)
                n = float(sums[:, COUNT].sum()) if len(sums) else 0.0
                if n < PASSAGE:
                    continue
                total = sums.sum(axis=0, keepdims=True)
                if not is_english(total[:, IN_ENGLISH] / n, total[:, IN_OTHER] / n)[0]:
                    continue
                words = np.bincount([bucket(t) for t in tokens if t[0] not in ".!?…。,;:"], minlength=WORDS) / n
                row = [float(grade(n, len(sums), float(total[0, SYLLABLES])))] + style(total, np.array([float(len(sums))]))[0].tolist() + words.tolist()
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([row], pa.list_(pa.float32()))], ["doc_id", "x"])

    n = documents.count()
    drawn = documents.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE / max(n, 1)))))
    # sorted, so that the same documents give the same model
    rows = sorted(drawn.mapInArrow(run, "doc_id long, x array<float>").collect())
    if not rows:
        return None
    x = np.array([r["x"] for r in rows], dtype=np.float32)
    return fit(x[:, 1 : 1 + len(STYLE)].astype(float), x[:, 1 + len(STYLE) :], x[:, 0].astype(float))


def read(text: str | None, lines: Spoken, vocabulary: Vocabulary, ranker: Ranker | None) -> tuple:
    """words, level, share of words at university level, share of words that are English function words, and of others'."""
    sums = sentence_sums(dialogue(text, lines), vocabulary)
    if not len(sums):
        return 0, None, 0.0, 0.0, 0.0
    whole = sums.sum(axis=0)
    total = float(whole[COUNT])
    english, other = float(whole[IN_ENGLISH]) / total, float(whole[IN_OTHER]) / total
    if ranker is None:
        return int(total), None, 0.0, english, other
    parts, sentences = passages(sums)
    n = parts[:, COUNT].astype(float)
    levels = ranker.level(ranker.score(style(parts, sentences), parts[:, WEIGHT] / n))
    levels = (levels * n + ranker.typical * TYPICAL_WORDS) / (n + TYPICAL_WORDS)
    return int(total), float((levels * n).sum() / total), float(n[levels >= UNIVERSITY].sum() / total), english, other


def reading_levels(documents: DataFrame, ranker: Ranker | None = None) -> DataFrame:
    """doc_id, words, level, learned_share, english, other of each document's dialogue, by a ranker trained on them unless given."""
    ranker = ranker or train(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, vocabulary = Spoken(), Vocabulary(ranker.words if ranker else None)
        types = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [read(x, lines, vocabulary, ranker) for x in part.column(1).to_pylist()]
                columns = [pa.array(column, kind) for column, kind in zip(zip(*found), types)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "words", "level", "learned_share", "english", "other"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, words long, level double, learned_share double, english double, other double")


def learned(levels: DataFrame) -> DataFrame:
    """doc_id of the English documents most of whose dialogue is at university level."""
    english = (F.col("english") >= 0.1) & (F.col("english") > 2 * F.col("other"))
    return levels.where((F.col("learned_share") > 0.5) & (F.col("level") >= UNIVERSITY) & english).select("doc_id")
