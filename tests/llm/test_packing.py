from __future__ import annotations

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrove.llm.packing import best_fit, pack, pack_histogram, reduce_instance, summary


def least_containers(sizes, capacity):
    """The optimum by exhaustive search."""
    best = [len(sizes)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= sizes[k]}.values():
            place(k + 1, [*rooms[:i], rooms[i] - sizes[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best[0]


def bound_by_large_items(sizes, capacity):
    """Martello and Toth's second lower bound: items over half of a container share none, and small ones fit beside few."""
    bounds = []
    for k in range(capacity // 2 + 1):
        large = [s for s in sizes if s > capacity - k]
        middle = [s for s in sizes if capacity / 2 < s <= capacity - k]
        small = sum(s for s in sizes if k <= s <= capacity / 2)
        bounds.append(len(large) + len(middle) + max(0, -(-(small - (len(middle) * capacity - sum(middle))) // capacity)))
    return max(bounds)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_every_item_once_and_close_to_the_optimum(sizes):
    patterns = pack_histogram(dict(Counter(sizes)), 20)
    assert all(sum(p) <= 20 and n > 0 for p, n, _ in patterns)
    assert Counter(s for p, n, _ in patterns for s in p for _ in range(n)) == Counter(sizes)
    best = least_containers(sorted(sizes, reverse=True), 20)
    assert best <= sum(n for _, n, _ in patterns) <= best + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(2, 20), max_size=9))
def test_what_the_reduction_fixes_is_part_of_an_optimum(sizes):
    left = dict(Counter(sizes))
    fixed = reduce_instance(left, 30)
    assert all(sum(p) <= 30 for p, _ in fixed)
    rest = [s for s, n in left.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + least_containers(sorted(rest, reverse=True), 30) == least_containers(sorted(sizes, reverse=True), 30)


def test_triples_beat_plain_best_fit():
    sizes = Counter([16, 35, 19, 8, 10, 31])
    assert any(len(p) == 3 for p, _ in reduce_instance(dict(sizes), 60))
    assert sum(n for _, n, _ in pack_histogram(dict(sizes), 60)) == 2 < sum(n for _, n in best_fit(dict(sizes), 60)) == 3


def test_large_histogram():
    rng = np.random.default_rng(2)
    h = dict(Counter(rng.integers(1, 1000, 200_000).tolist()))
    patterns = pack_histogram(h, 1000)
    total, bound = sum(n for _, n, _ in patterns), -(-sum(s * n for s, n in h.items()) // 1000)
    assert bound <= total <= 1.01 * bound


def test_documents(spark):
    rng = np.random.default_rng(3)
    sizes = [*rng.integers(1, 100, 500).tolist(), None, 0, 100, 250, 300, 99, 1, *[40] * 300]
    out = pack(spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id long, tokens long, size string"), 100)
    rows = out.collect()
    parts: dict = {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append((r.part, r.tokens))
    assert {d: sum(t for _, t in p) for d, p in parts.items()} == {i: s or 0 for i, s in enumerate(sizes)}
    assert all(len(p) == 1 for d, p in parts.items() if (sizes[d] or 0) <= 100) and len(parts[503]) == 3 and len(parts[504]) == 3
    used = Counter()
    for r in rows:
        assert (r.container_id is None) == (r.tokens == 0)
        used[r.container_id] += r.tokens
    assert max(used.values()) <= 100
    (s,) = summary(out, 100).collect()
    pieces = [r.tokens for r in rows if r.tokens]
    # most items are large here, so much space must stay unused; the reduction costs nothing against plain best fit
    plain = sum(n for _, n in best_fit(dict(Counter(x for x in pieces if x < 100)), 100)) + pieces.count(100)
    assert s.fullest <= 100 and 0 < s.fixed_containers <= s.containers and bound_by_large_items(pieces, 100) <= s.containers <= plain


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, tokens long")
    assert pack(empty, 10).count() == 0
    assert summary(pack(empty, 10), 10).collect()[0].containers == 0
    assert pack(spark.createDataFrame([(1, 4), (1, 5), (2, 10), (3, 25)], "doc_id long, tokens long"), 10).count() == 6
