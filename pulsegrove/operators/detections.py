"""Long tables of decisions (one row per unit and method): consensus, patterns and matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def consensus(decisions: DataFrame, unit: str, method: str, call: str, least: int) -> DataFrame:
    """Per unit: methods that decided, methods that called, consensus (null if none decided), and the callers joined by +.

    A null call is a method that was not available; it is neither for nor against.
    """
    one = decisions.groupBy(unit, method).agg(F.bool_or(call).alias("_call"))
    called = F.sum(F.col("_call").cast("long"))
    out = one.groupBy(unit).agg(F.count("_call").alias("n_available"), F.coalesce(called, F.lit(0)).alias("n_called"), F.array_sort(F.collect_list(F.when(F.col("_call"), F.col(method)))).alias("_who"))
    return out.select(unit, "n_available", "n_called", F.when(F.col("n_available") > 0, F.col("n_called") >= least).alias("consensus"), F.when(F.size("_who") > 0, F.concat_ws("+", "_who")).otherwise("none").alias("pattern"))


def matrix(decisions: DataFrame, unit: str, method: str, call: str, methods: list[str]) -> DataFrame:
    """One row per unit and one boolean column per method of a short list; without a row false."""
    return decisions.groupBy(unit).pivot(method, methods).agg(F.bool_or(call)).na.fill(False)


def cells(decisions: DataFrame, unit: str, method: str, call: str, methods: DataFrame) -> DataFrame:
    """unit, method, call: ``matrix`` in long form over all of ``methods``, a fixed table of one column; without a row false."""
    who = decisions.groupBy(unit).agg(F.collect_set(F.when(F.col(call), F.col(method))).alias("_who"))
    return who.crossJoin(F.broadcast(methods.select(method))).select(unit, method, F.array_contains("_who", F.col(method)).alias(call))


def availability(calls: DataFrame, unit: str, call: str, run: str) -> DataFrame:
    """``calls`` with a reason why a nullable call is missing: not_run, method_unavailable, or nothing."""
    return calls.withColumn("reason", F.when(~F.coalesce(run, F.lit(False)), "not_run").when(F.col(call).isNull(), "method_unavailable").otherwise(""))
