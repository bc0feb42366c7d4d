"""Whole groups of sorted Arrow batches, and random pairings of a group's values, within a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Values that a task deals anew at once.
DEALT_AT_ONCE = 1 << 20
_P = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; nulls equal nulls, NaN equals NaN."""
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    differ = pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))
    if pa.types.is_floating(column.type):
        differ = pc.and_not(differ, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return differ.to_numpy(zero_copy_only=False)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of batches sorted by ``keys``, with the rows at which groups start."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        ahead = [held[-1].slice(held[-1].num_rows - 1), table] if held else [table]
        differ = np.any([_changes(pa.concat_tables([t.select([key]) for t in ahead]).column(0).combine_chunks()) for key in keys], axis=0)
        at = np.flatnonzero(differ) + (0 if held else 1)
        if len(at):
            before = sum(t.num_rows for t in held)
            yield pa.concat_tables([*held, table.slice(0, at[-1])]), np.concatenate([[0], before + at[:-1]])
            held = []
        held.append(table.slice(at[-1]) if len(at) else table)
    if held:
        yield pa.concat_tables(held), np.zeros(1, int)


def _hashed(number: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of 32-bit numbers, from the hash so far."""
    h = (seed + _P[4] + np.uint64(4)) ^ (number.astype(np.uint64) & np.uint64(0xFFFFFFFF)) * _P[0]
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P[1] + _P[2]
    h = (h ^ (h >> np.uint64(33))) * _P[1]
    h = (h ^ (h >> np.uint64(29))) * _P[2]
    return h ^ (h >> np.uint64(32))


def pairings(n: int, draws: np.ndarray, seed: int) -> np.ndarray:
    """For each draw, which of ``n`` values each of ``n`` places gets: the order of xxhash64(number from 1, draw, seed)."""
    first = _hashed(np.arange(1, n + 1), np.full(n, 42, np.uint64))
    each = _hashed(np.asarray(draws)[:, None], first[None, :])
    return np.argsort(_hashed(np.full(each.shape, seed), each).view(np.int64), axis=1, kind="stable")


def steeper_draws(batches: Iterator[pa.RecordBatch], keys: list[str], y: str, xs: list[str], limit: str, draws: int, seed: int) -> Iterator[pa.RecordBatch]:
    """keys, hits: in how many draws y, dealt anew to a group's rows in their order, has a least-squares gradient over ``xs`` of at least ``limit``."""
    for table, starts in whole_groups(batches, keys):
        table = table.combine_chunks()
        columns = {c: table.column(c).to_numpy() for c in (y, *xs, limit)}
        hits = []
        for start, stop in zip(starts, [*starts[1:], table.num_rows]):
            n, own = int(stop - start), slice(start, stop)
            with np.errstate(all="ignore"):
                x = np.stack([columns[c][own] for c in xs])
                x, level = x - x.mean(axis=1, keepdims=True), columns[y][own] - columns[y][own].mean()
                try:
                    solver = np.linalg.solve(x @ x.T, x)
                except np.linalg.LinAlgError:
                    solver = np.linalg.pinv(x).T
                found, some = 0, max(1, DEALT_AT_ONCE // n)
                for at in range(1, draws + 1, some):
                    dealt = level[pairings(n, np.arange(at, min(draws + 1, at + some)), seed)]
                    steep = np.sqrt(((dealt @ solver.T) ** 2).sum(axis=1))
                    found += int(((steep >= columns[limit][start]) | np.isnan(steep)).sum())
            hits.append(found)
        names = [table.column(k).combine_chunks().take(pa.array(starts)) for k in keys]
        yield pa.RecordBatch.from_arrays([*names, pa.array(hits, pa.int64())], names=[*keys, "hits"])
