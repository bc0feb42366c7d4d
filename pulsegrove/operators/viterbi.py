"""The cheapest sequence of readings along each source's record order (Viterbi), for sources of any size.

A record with one reading fixes the path there, so a source falls into independent runs of ambiguous records between
fixed ones. Records are cut into blocks along their order; within a block the records that can matter (ambiguous ones,
their fixed neighbours, the block's ends) are solved together. Costs add up along a path, so a block is summed up by the
matrix of cheapest costs from each reading of its first record to each of its last. Neighbouring matrices combine into
one, so blocks are gathered into bundles, and bundles into sources, as a tree; on the way back down each block gets the
cheapest costs of everything before and after it. With those, a block gives for each of its records the cheapest path
through each reading: the least one is picked, and how much worse the best path through another order would be is its gap.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Records that one task solves together; blocks in a bundle.
BLOCK, BUNDLE = 1 << 15, 1 << 12
SWITCH_COST, BACKWARD_COST = 1.0, 2.0
#: A step back in time counts only beyond this; records of one batch are written in any order.
SLACK_US = 3 * 86_400_000_000


Step = Callable[[tuple, tuple], np.ndarray]


def steps(switch: float, backward: float) -> Step:
    """The costs of each pair of readings (formats, instants) of two consecutive records."""

    def costs(a: tuple, b: tuple) -> np.ndarray:
        return switch * (a[0][:, None] != b[0][None, :]) + backward * (b[1][None, :] < a[1][:, None] - SLACK_US)

    return costs


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    return list(zip(pdf["fmts"], pdf["instants"], pdf["costs"]))


def ends_of(pdf: pd.DataFrame, end: str) -> list[tuple]:
    return list(zip(pdf[f"{end}_fmts"], pdf[f"{end}_instants"]))


def segment(pdf: pd.DataFrame, key: str, matrix: np.ndarray, first: tuple, last: tuple) -> pd.DataFrame:
    """One row that sums up a run of records: its matrix, and the readings of its first and last record."""
    out = {"source": [pdf["source"].iloc[0]], key: [pdf[key].iloc[0]], "matrix": [matrix.ravel()]}
    return pd.DataFrame(out | {f"{end}_{name}": [x[at]] for end, x in (("first", first), ("last", last)) for at, name in enumerate(("fmts", "instants"))})


def summarize(pdf: pd.DataFrame, step: Step) -> pd.DataFrame:
    """One block's segment."""
    rows = rows_of(pdf.sort_values(["at", "row_key"]))
    cost = np.where(np.eye(len(rows[0][2]), dtype=bool), rows[0][2], np.inf)
    for a, b in zip(rows, rows[1:]):
        cost = (cost[:, :, None] + step(a, b)).min(axis=1) + b[2]
    return segment(pdf, "block", cost, rows[0], rows[-1])


def matrices_of(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.asarray(m, dtype=float).reshape(len(f), len(z)) for m, f, z in zip(pdf["matrix"], pdf["first_fmts"], pdf["last_fmts"])]


def gather(pdf: pd.DataFrame, step: Step) -> pd.DataFrame:
    """The segment of a bundle of consecutive blocks."""
    pdf = pdf.sort_values("block")
    matrices, firsts, lasts = matrices_of(pdf), ends_of(pdf, "first"), ends_of(pdf, "last")
    cost = matrices[0]
    for k in range(1, len(matrices)):
        across = (cost[:, :, None] + step(lasts[k - 1], firsts[k])).min(axis=1)
        cost = (across[:, :, None] + matrices[k][None, :, :]).min(axis=1)
    return segment(pdf, "bundle", cost, firsts[0], lasts[-1])


def hand_down(pdf: pd.DataFrame, key: str, step: Step) -> pd.DataFrame:
    """The costs before (``into``, by reading of the first record) and after (``beyond``, by reading of the last) each segment.

    The first row's ``into`` and the last row's ``beyond``, if there are such columns, come from the level above.
    """
    pdf = pdf.sort_values(key)
    matrices, firsts, lasts = matrices_of(pdf), ends_of(pdf, "first"), ends_of(pdf, "last")
    n = len(matrices)
    into = [np.asarray(pdf["into"].iloc[0], float) if "into" in pdf else np.zeros(len(firsts[0][0]))]
    beyond = [np.asarray(pdf["beyond"].iloc[0], float) if "beyond" in pdf else np.zeros(len(lasts[-1][0]))]
    for k in range(1, n):
        reached = (into[-1][:, None] + matrices[k - 1]).min(axis=0)
        into.append((reached[:, None] + step(lasts[k - 1], firsts[k])).min(axis=0))
        left = n - 1 - k
        ahead = (matrices[left + 1] + beyond[-1][None, :]).min(axis=1)
        beyond.append((step(lasts[left], firsts[left + 1]) + ahead[None, :]).min(axis=1))
    return pd.DataFrame({"source": pdf["source"], key: pdf[key], "into": into, "beyond": beyond[::-1]})


def decode(pdf: pd.DataFrame, step: Step) -> pd.DataFrame:
    """The reading of each ambiguous record of a block that the cheapest path takes, and its gap."""
    pdf = pdf.sort_values(["at", "row_key"])
    rows = rows_of(pdf)
    ahead = [np.asarray(pdf["into"].iloc[0], float) + rows[0][2]]
    for a, b in zip(rows, rows[1:]):
        ahead.append((ahead[-1][:, None] + step(a, b)).min(axis=0) + b[2])
    after = [np.asarray(pdf["beyond"].iloc[0], float)]
    for a, b in zip(rows[-2::-1], rows[:0:-1]):
        after.append((step(a, b) + (after[-1] + b[2])[None, :]).min(axis=1))
    found = []
    for (fmts, instants, costs), x, y in zip(rows, ahead, reversed(after)):
        through = x + y
        k = int(through.argmin())
        others = through[fmts != fmts[k]]
        found.append((instants[k], costs[k], int((fmts == fmts[k]).sum()), others.min() - through[k] if len(others) else np.inf, len(fmts)))
    out = pdf[["source", "row_key"]].assign(**dict(zip(("us", "cost", "same", "gap", "n"), zip(*found))))
    return out[out["n"] > 1].drop(columns="n")


def cheapest_readings(records: DataFrame, at: Column, materialize: Callable[[DataFrame], DataFrame], switch: float = SWITCH_COST, backward: float = BACKWARD_COST) -> DataFrame:
    """source, row_key, us, cost, same, gap of the records with at least two readings: the reading on the cheapest path, its
    own cost, how many readings have its format, and how much dearer the cheapest path through another format is (infinite
    if there is none).

    ``records`` has source string (not null), row_key long (unique in a source) and readings
    array<struct<fmt, us, cost>> without empty arrays; the record order is ``at`` (microseconds), then row_key. Quarters of
    a year, and within them chunks of ids, follow each other, so that no source is sorted as a whole. ``materialize``
    stores the few records that can matter, because two passes read them.
    """
    # records are small but costly, so the number of tasks follows the cluster and not the bytes
    step = steps(switch, backward)
    tasks = 4 * max(records.sparkSession.sparkContext.defaultParallelism, 2)
    span = (F.floor(F.coalesce("at", F.lit(0)) / (91 * 86_400_000_000)) * (1 << 20) + F.shiftright("row_key", 22)).alias("span")
    within = Window.partitionBy("source", "span").orderBy("at", "row_key")
    many = F.size("readings") > 1
    doubtful = records.where(many).select("source").distinct()
    ordered = records.withColumn("at", F.coalesce(at, F.lit(0)).cast("long")).join(doubtful, "source", "left_semi").select("source", "row_key", "at", "readings", span)
    flagged = ordered.select(
        "*", F.coalesce(F.lag(many).over(within), F.lit(True)).alias("_after"), F.coalesce(F.lead(many).over(within), F.lit(True)).alias("_ahead"),
        (F.col("span") * (1 << 8) + F.floor((F.row_number().over(within) - 1) / BLOCK)).alias("block"),
    )
    part = lambda name, value: F.transform("readings", value).alias(name)
    matter = materialize(
        flagged.where(many | F.col("_after") | F.col("_ahead")).select("source", "block", "row_key", "at", part("fmts", lambda r: F.hash(r["fmt"])), part("instants", lambda r: r["us"]), part("costs", lambda r: r["cost"]))
    )
    ends = ", ".join(f"{end}_fmts array<int>, {end}_instants array<bigint>" for end in ("first", "last"))
    blocks = matter.repartition(tasks, "source", "block").groupBy("source", "block").applyInPandas(lambda pdf: summarize(pdf, step), f"source string, block long, matrix array<double>, {ends}")
    blocks = materialize(blocks.withColumn("bundle", F.floor(F.col("block") / ((1 << 8) * BUNDLE))))
    bundles = blocks.groupBy("source", "bundle").applyInPandas(lambda pdf: gather(pdf, step), f"source string, bundle long, matrix array<double>, {ends}")
    costs = "into array<double>, beyond array<double>"
    outer = bundles.groupBy("source").applyInPandas(lambda pdf: hand_down(pdf, "bundle", step), f"source string, bundle long, {costs}")
    inner = blocks.join(outer, ["source", "bundle"]).groupBy("source", "bundle").applyInPandas(lambda pdf: hand_down(pdf, "block", step), f"source string, block long, {costs}")
    told = matter.join(inner, ["source", "block"]).repartition(tasks, "source", "block")
    return told.groupBy("source", "block").applyInPandas(lambda pdf: decode(pdf, step), "source string, row_key long, us long, cost double, same int, gap double")
