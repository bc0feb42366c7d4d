"""Moments of channels and their lags, laid out and summed up within tasks; only one row per pair of channels leaves a task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from pulsegrove.operators.in_tasks import whole_groups

#: Number, means and sums of centred products.
Moments = tuple[int, np.ndarray, np.ndarray]
#: Pairs whose moments a task holds at once, steps that it lays out at once, and channels of blocks that share a layout.
PAIRS_HELD, STEPS_HELD, CHANNELS_SHARED = 20_000, 1 << 18, 16


def together(a: Moments | None, b: Moments) -> Moments:
    if a is None:
        return b
    n, off = a[0] + b[0], b[1] - a[1]
    return n, a[1] + off * (b[0] / n), a[2] + b[2] + np.outer(off, off) * (a[0] * (b[0] / n))


def merged_moments(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    """The moments of one pair from those of its few parts."""
    size = len(parts["m"].iloc[0])
    each = ((int(n), np.asarray(m, float), np.asarray(s, float).reshape(size, size)) for n, m, s in zip(parts["n"], parts["m"], parts["s"]))
    n, m, s = reduce(together, each, None)
    return pd.DataFrame([[*key, n, m, s.ravel()]], columns=["source", "target", "n", "m", "s"])


def lagged_moments(batches: Iterator[pa.RecordBatch], order: int, length: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """source, target, n, m, s: moments of the target's value, its ``order`` lags and those of the source, over sorted blocks of lines.

    A step counts where the source has a row, and the target's value and all lags are there.
    """
    held: dict[tuple[int, int], Moments] = {}
    codes: dict[object, int] = {}

    def out() -> pa.RecordBatch:
        names = pa.array(list(codes), kind)
        sides = [names.take(pa.array([pair[side] for pair in held], pa.int64())) for side in (0, 1)]
        sums = [pa.array([m[0] for m in held.values()], pa.int64()), *(pa.array([m[i].ravel() for m in held.values()], pa.list_(pa.float64())) for i in (1, 2))]
        held.clear()
        return pa.RecordBatch.from_arrays([*sides, *sums], names=["source", "target", "n", "m", "s"])

    for table, starts in whole_groups(batches, ["trial", "block"]):
        named = table.column("channel").combine_chunks().dictionary_encode()
        code = np.array([codes.setdefault(c, len(codes)) for c in named.dictionary.to_pylist()])[named.indices.to_numpy()]
        block, first, k, k_before, value, before = (_numbers(table.column(c)) for c in ("block", "first", "k", "k_before", "value", "value_before"))
        low, high = np.maximum(first, block * length - order), np.minimum(k, (block + 1) * length - 1)
        base = np.minimum.reduceat(low, starts)
        height = np.maximum.reduceat(high, starts) - base + 1 + order
        ends = np.append(starts[1:], len(k))
        shared = len(np.unique(code)) <= CHANNELS_SHARED
        group = 0
        while group < len(starts):
            last = group + 1
            while shared and last < len(starts) and height[group : last + 1].sum() <= STEPS_HELD:
                last += 1
            rows = slice(starts[group], ends[last - 1])
            channels, own = np.unique(code[rows], return_inverse=True)
            top = np.cumsum(height[group:last]) - height[group:last]
            at, wide = np.repeat(np.arange(last - group), ends[group:last] - starts[group:last]), int(height[group:last].sum())
            values, there = np.full((len(channels), wide), np.nan), np.zeros((len(channels), wide), bool)
            many = high[rows] - low[rows] + 1
            line = np.repeat(np.arange(len(many)), many)
            step = low[rows][line] + np.arange(len(line)) - np.repeat(np.cumsum(many) - many, many)
            a, b, x, y = (z[rows][line] for z in (k_before, k, before, value))
            with np.errstate(all="ignore"):
                y = np.where(step == b, y, x + (y - x) * (step - a) / (b - a))
            spot = (top - base[group:last] + order)[at][line] + step
            values[own[line], spot], there[own[line], spot] = y, True
            fresh = np.arange(wide) - np.repeat(top - base[group:last] + order + block[starts[group:last]] * length, height[group:last]) >= 0
            for pair, moments in pair_moments(values, there, fresh, order):
                to = (int(channels[pair[0]]), int(channels[pair[1]]))
                held[to] = together(held.get(to), moments)
            if len(held) > PAIRS_HELD:
                yield out()
            group = last
    yield out()


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """A column as numbers; null times are 0, null values NaN."""
    whole = column.combine_chunks()
    return (pc.fill_null(whole, float("nan")) if pa.types.is_floating(whole.type) else pc.fill_null(whole, 0)).to_numpy(zero_copy_only=False)


def pair_moments(values: np.ndarray, there: np.ndarray, fresh: np.ndarray, order: int) -> Iterator[tuple[tuple[int, int], Moments]]:
    """(source, target) and moments of each two rows of ``values`` that have a step in common; the first ``order`` steps are lags only."""
    wide = values.shape[1] - order
    known = ~np.isnan(values)
    lagged = np.ones((len(values), wide), bool)
    for i in range(1, order + 1):
        lagged &= known[:, order - i : order - i + wide]
    targets, sources = lagged & known[:, order:] & fresh[order:], lagged & there[:, order:]
    some = sources.any(axis=1)
    for t in np.flatnonzero(targets.any(axis=1)):
        for s in np.flatnonzero(some):
            if s == t or not len(on := np.flatnonzero(targets[t] & sources[s])):
                continue
            z = np.stack([values[t][on + order - i] for i in range(order + 1)] + [values[s][on + order - i] for i in range(1, order + 1)])
            with np.errstate(all="ignore"):
                mean = z.mean(axis=1)
                z -= mean[:, None]
                yield (int(s), int(t)), (len(on), mean, z @ z.T)
