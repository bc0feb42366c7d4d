from __future__ import annotations

import base64
import random

import pyarrow as pa
import pytest

from pulsegrove.llm import bpe

PATH = f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}.json"


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    try:
        lines = open(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}.tiktoken", "rb").read().splitlines()
    except OSError:
        pytest.skip("no vocabulary")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "Hello, it's 00:00:02,322 --> 00:00:03,886\n\n\nIt'll  work \t\n", "<|endoftext|>", " ", "\n \n", "x \n  \n y", "\x1c\x1d a \x85 b　c  \n\n d\r\n", "👍🏽" * 200, "ab" * 3000, " " * 5000 + "a", "12:34:56,7 1:22:33:44,5  \n", "00:00:01,٣", "a00:00:01,5",
    "どうして、先生はもう帰った。", "I'LL don'T 'S 's", "Ã¼berhaupt nichts​﻿", "a" * 20_000,
]


def test_ids_equal_the_public_encoder(reference):
    rng = random.Random(7)
    tokens = [t for t in (bytes(reference.decode_single_token_bytes(i)) for i in rng.sample(range(50_000), 3000))]
    mixed = [b"".join(rng.choices(tokens, k=rng.randint(1, 8))).decode("utf-8", "ignore") for _ in range(3000)]
    letters = ["".join(rng.choices("aeiou tnsr'’\n,.19é", k=rng.randint(1, 60))) for _ in range(2000)]
    texts = [x for x in TEXTS + mixed + letters if x]
    got = bpe.encode_texts(pa.array(texts), bpe.lines_of(PATH)).to_pylist()
    assert [g for g, t in zip(got, texts) if g != reference.encode_ordinary(t)] == []


def test_spark_round_trip_nulls_and_repeats(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None, "", TEXTS[0]])]
    documents = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = bpe.encode(documents)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert {i: reference.encode_ordinary(t or "") for i, t, _ in rows} == got
    assert {r.doc_id: r.text for r in bpe.decode(encoded).collect()} == {i: t or "" for i, t, _ in rows}
    assert {r.doc_id: r.tokens for r in bpe.token_counts(documents).collect()} == {i: len(x) for i, x in got.items()}
    assert bpe.encode(documents.limit(0)).count() == 0 and bpe.token_counts(documents.limit(0)).count() == 0
