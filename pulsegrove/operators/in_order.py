"""Neighbours and running values in an order, for keys that may hold a third of all rows.

No window spans more than one block of a key: each works within blocks, and a second window over one row per block
carries on from block to block. ``block`` must rise with the order. Ties in ``order`` are up to the caller, who adds a
unique column where the result would depend on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, where null keys meet null keys; the keys are those of ``left``."""
    renamed = right.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = left[k].eqNullSafe(renamed[f"_k{i}"]) & same
    return left.join(renamed, same, how).drop(*(f"_k{i}" for i in range(len(keys))))


def _carry(rows: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with their block's row of ``ends``."""
    return meet(rows, ends, [*keys, "_block"], "left")


def with_previous(df: DataFrame, key: str | list[str], block: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the ``value`` of the row before; null at a key's first row."""
    keys = [key] if isinstance(key, str) else key
    df = df.withColumn("_block", block).withColumn("_value", F.struct(value.alias("v")))
    by = [F.col(x) for x in order]
    rows = df.withColumn("_ahead", F.lag("_value").over(Window.partitionBy(*keys, "_block").orderBy(*by)))
    ends = df.groupBy(*keys, "_block").agg(F.max_by("_value", F.struct(*by)).alias("_last"))
    ends = ends.withColumn("_entry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block"))).drop("_last")
    return _carry(rows, ends, keys).withColumn(name, F.coalesce("_ahead", "_entry")["v"]).drop("_block", "_value", "_ahead", "_entry")


def with_last_known(df: DataFrame, key: str | list[str], block: Column, order: list[str], value: Column, name: str, descending: bool = False) -> DataFrame:
    """``df`` with the latest value that is not null up to and including each row (from each row on, if ``descending``)."""
    keys = [key] if isinstance(key, str) else key
    df = df.withColumn("_block", block).withColumn("_value", value)
    by = [F.col(x).desc() if descending else F.col(x).asc() for x in order]
    along = F.col("_block").desc() if descending else F.col("_block").asc()
    rows = df.withColumn("_within", F.last("_value", True).over(Window.partitionBy(*keys, "_block").orderBy(*by)))
    pick = F.min_by if descending else F.max_by
    ends = df.groupBy(*keys, "_block").agg(pick("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_entry", F.last("_last", True).over(before)).drop("_last")
    return _carry(rows, ends, keys).withColumn(name, F.coalesce("_within", "_entry")).drop("_block", "_value", "_within", "_entry")


def with_running_sum(df: DataFrame, key: str | list[str], block: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to and including each row."""
    keys = [key] if isinstance(key, str) else key
    df = df.withColumn("_block", block).withColumn("_value", value)
    rows = df.withColumn("_within", F.sum("_value").over(Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    ends = df.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    ends = ends.withColumn("_entry", F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    return _carry(rows, ends, keys).withColumn(name, F.col("_within") + F.col("_entry")).drop("_block", "_value", "_within", "_entry")
