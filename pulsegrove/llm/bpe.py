"""Problem 7: a corpus as ids of a public byte-level BPE tokenizer.

A text is cut into lines and those into words by the tokenizer's pattern (a line with the white space before it is cut
as in its text), and each distinct word is encoded once per task by backtracking:
an Aho-Corasick automaton gives the longest token at each byte; tokens are laid one after another as long as each pair
is compatible, that is, merging them by rank would leave exactly these two; a token that fits nowhere gives way to its
longest proper prefix, or the one before it is taken back. A byte position once given up is never tried again, so the
work is linear. Decoding looks up each id's bytes in one byte string by a table of offsets.

Defined results: null and empty texts have no ids (an empty array); every other text, however long, is encoded whole;
special tokens are never made, their strings are ordinary text; repeated rows come out once each; an empty table gives
an empty table; extra columns are not carried along.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Words, and short lines, that a task keeps encoded; beyond it, the store starts anew.
KEPT, KEPT_LINE = 400_000, 120
# White space as the Unicode property has it; Python's own class also holds four control characters.
BLANK = "".join(chr(c) for c in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
#: A clock time before its fraction, whole words by the pattern wherever a digit run begins; it only saves steps.
CLOCK = r" ?[0-9]{2}:[0-9]{2}:[0-9]{2}[,.](?=[0-9])"
#: The tokenizer's pattern, and the same for texts of ASCII only.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^" + BLANK + r"\p{L}\p{N}]+|[" + BLANK + r"]+(?![^" + BLANK + r"])|[" + BLANK + r"]+"
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
WORD, ASCII_WORD = regex.compile(f"{CLOCK}|{PATTERN}"), re.compile(f"{CLOCK}|{ASCII_PATTERN}")
STRICT = regex.compile(PATTERN)
#: A line: all white space before it, then its words and the white space without line ends between them.
LINE = re.compile(f"[{BLANK}]*[^{BLANK}]+(?:[{BLANK.replace(chr(10), '')}]+[^{BLANK}]+)*")


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which the vocabulary file writes bytes: printable ones as themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    return letters | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}


class Encoder:
    """Encodes words (dict from word to ids, filled as words come)."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_alphabet()
        ids = {x: i for x, i in model["vocab"].items() if all(c in letters for c in x)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: Merges by rank, and the two parts of each token; a single byte is its own parts. Ids rise with rank.
        self.merged = {(ids[a], ids[b]): ids[a + b] for a, b in merges}
        self.parts = {i: (i, i) for i in ids.values()} | {whole: pair for pair, whole in self.merged.items()}
        self.known: dict[tuple[int, int], bool] = {}
        made = {a + b for a, b in merges}
        latin = {x: "".join(chr(letters[c]) for c in x) for x in ids if len(x) == 1 or x in made}
        self.size = {ids[x]: len(y) for x, y in latin.items()}
        self.automaton = ahocorasick.Automaton()
        by_bytes = {y: ids[x] for x, y in latin.items()}
        for y, i in by_bytes.items():
            self.automaton.add_word(y, i)
        self.automaton.make_automaton()
        self.shorter = {i: next((by_bytes[y[:k]] for k in range(len(y) - 1, 0, -1) if y[:k] in by_bytes), -1) for y, i in by_bytes.items()}

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens stay two when their bytes are merged by rank."""
        key = (left, right)
        if key in self.known:
            return self.known[key]
        bound, result = 1 << 60, None
        while result is None:
            whole = self.merged.get((left, right))
            if whole is not None and whole < bound:
                result = False
            elif left > right:
                # the later merge is undone first: the left token down to its right part
                bound, part = left, self.parts[left][1]
                if part != left:
                    left = part
                elif self.parts[right][0] == right:
                    result = True
                else:
                    bound, right = right + 1, self.parts[right][0]
            else:
                bound, part = right + 1, self.parts[right][0]
                if part != right:
                    right = part
                elif self.parts[left][1] == left:
                    result = True
                else:
                    bound, left = left, self.parts[left][1]
        self.known[key] = result
        return result

    def encode(self, word: str) -> tuple[int, ...]:
        text = word.encode("utf-8", "surrogatepass").decode("latin-1")
        longest = [-1] * (len(text) + 1)
        for end, i in self.automaton.iter(text):
            start = end + 1 - self.size[i]
            if longest[start] < 0 or self.size[i] > self.size[longest[start]]:
                longest[start] = i
        if len(longest) > 1 and self.size[longest[0]] == len(text):
            return (longest[0],)
        open_at = bytearray(b"\1") * (len(text) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(text):
            end = at + self.size[token]
            if open_at[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at, token = end, longest[end]
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                open_at[at] = 0
                token = out.pop()  # its end is closed now, so it gives way to a shorter one in turn
                at -= self.size[token]
        return tuple(out)


class Words(dict):
    """Encoded words by word."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= KEPT:
            self.clear()
        self[word] = found = tuple(chain.from_iterable(map(self.encoder.encode, STRICT.findall(word))))
        return found


class Lines(dict):
    """Encoded lines by line; long lines and those of cue times, which hardly recur, are not kept."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.words = Words(encoder)

    def __missing__(self, line: str) -> tuple[int, ...]:
        split = ASCII_WORD if line.isascii() else WORD
        found = tuple(chain.from_iterable(map(self.words.__getitem__, split.findall(line))))
        if len(line) <= KEPT_LINE and "-->" not in line:
            if len(self) >= KEPT:
                self.clear()
            self[line] = found
        return found

    def of_text(self, text: str) -> Iterator[tuple[int, ...]]:
        """The ids of a text, line by line."""
        yield from map(self.__getitem__, LINE.findall(text))
        if text[-1] in BLANK:
            yield self[text[len(text.rstrip(BLANK)) :]]


@lru_cache(maxsize=2)
def lines_of(path: str) -> Lines:
    return Lines(Encoder(path))


def encode_texts(texts: pa.Array, lines: Lines) -> pa.ListArray:
    """Each text's ids; null and empty texts have none."""
    ends, values, total = [0], [], 0
    for text in texts.to_pylist():
        if text:
            ids = np.fromiter(chain.from_iterable(lines.of_text(text)), dtype=np.int32)
            values.append(ids)
            total += len(ids)
        ends.append(total)
    joined = np.concatenate(values) if values else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(joined, pa.int32()))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in slices of few rows, so that a batch of long texts takes little memory at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, ids of each document's text."""
    path = f"{folder}/{vocabulary}.json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = lines_of(path)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), encode_texts(batch.column(1), lines)], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, tokens: the number of ids of each document's text, 0 for null and empty ones."""
    path = f"{folder}/{vocabulary}.json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = lines_of(path)
        for batch in slices(batches):
            counts = [sum(map(len, lines.of_text(x))) if x else 0 for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, tokens long")


@lru_cache(maxsize=2)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes in one array, and where each id's begin (one more entry for the end)."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    letters = byte_alphabet()
    by_id = {i: bytes(letters[c] for c in x) if all(c in letters for c in x) else x.encode() for x, i in vocabulary.items()}
    tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in tokens])]).astype(np.int64)


def decode_ids(ids: np.ndarray, blob: np.ndarray, offsets: np.ndarray) -> bytes:
    """The bytes of a sequence of ids."""
    begins, lengths = offsets[ids], offsets[ids + 1] - offsets[ids]
    before = np.cumsum(lengths) - lengths
    return blob[np.arange(lengths.sum()) + np.repeat(begins - before, lengths)].tobytes()


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, text of each document's ids; null ids give a null text, ids outside the vocabulary fail."""
    path = f"{folder}/{vocabulary}.json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, offsets = byte_table(path)
        for batch in slices(batches):
            lists = batch.column(1)
            texts = [None if x is None else decode_ids(np.asarray(x, np.int64), blob, offsets).decode("utf-8", "replace") for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
