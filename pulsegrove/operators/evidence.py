"""Tables around detections (identity, method, call, metric): collapsing, counting, choosing, gating, and auditing them.

Every operator is one or two grouped aggregates; ties go to the smaller method, so that results do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrove.operators.in_order import meet
from pulsegrove.operators.windows import medians, value_counts


def counts_by_method(detections: DataFrame, method: str, call: str) -> DataFrame:
    """method, n (rows), n_called, n_unavailable (null calls)."""
    return detections.groupBy(method).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col(call), F.lit(False)).cast("long")).alias("n_called"), F.sum(F.col(call).isNull().cast("long")).alias("n_unavailable"))


def collapsed(detections: DataFrame, identity: list[str], method: str, metric: str) -> DataFrame:
    """identity, method (the first), metric (the median), n_rows, methods (all, joined by ;): one row per identity."""
    out = detections.groupBy(*identity).agg(F.min(method).alias(method), F.count("*").alias("n_rows"), F.concat_ws(";", F.array_sort(F.collect_set(F.col(method).cast("string")))).alias("methods"))
    middle = medians(value_counts(detections, identity, metric), identity, metric)
    return meet(out, middle, identity, "left").select(*identity, method, metric, "n_rows", "methods")


def first_by(detections: DataFrame, identity: list[str], order: list[str], kept: list[str]) -> DataFrame:
    """identity and ``kept`` of each identity's first row by ``order`` (nulls last)."""
    key = F.struct(*(F.struct(F.col(c).isNull().alias("null"), F.col(c).alias("value")).alias(c) for c in order))
    return detections.groupBy(*identity).agg(F.min_by(F.struct(*kept), key).alias("_r")).select(*identity, *(F.col(f"_r.{c}").alias(c) for c in kept))


def first_known(detections: DataFrame, method: str, order: list[str], columns: list[str]) -> DataFrame:
    """method and, for each column, its first value that is not null by ``order``."""
    key = F.struct(*order)
    return detections.groupBy(method).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), key)).alias(c) for c in columns))


def extremes(detections: DataFrame, group: list[str], unit: str, metric: str) -> DataFrame:
    """group, highest and lowest unit by ``metric`` (the smaller unit of equals), with the values."""
    known = detections.where(F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double")))
    top, low = F.min_by(F.struct(unit, metric), F.struct(-F.col(metric), F.col(unit))), F.min_by(F.struct(unit, metric), F.struct(metric, unit))
    return known.groupBy(*group).agg(top.alias("t"), low.alias("l")).select(*group, F.col(f"t.{unit}").alias("highest"), F.col(f"t.{metric}").alias("most"), F.col(f"l.{unit}").alias("lowest"), F.col(f"l.{metric}").alias("least"))


def primary_rows(detections: DataFrame, identity: list[str], method: str, primary, passed: Column) -> DataFrame:
    """The rows that passed and are of the primary method, or, for identities without one, their first row by method."""
    good = detections.where(F.coalesce(passed, F.lit(False)))
    key = F.struct((F.col(method) != primary).alias("other"), F.col(method).alias("m"), *(F.col(c).alias(f"_{c}") for c in detections.columns if c not in identity))
    return good.groupBy(*identity).agg(F.min_by(F.struct(*(c for c in detections.columns if c not in identity)), key).alias("_r")).select(*identity, "_r.*")


def with_defaults(rows: DataFrame, facts: DataFrame, key: list[str], defaults: dict[str, object]) -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row per key) named in ``defaults``, which stand where there is no fact."""
    joined = rows.join(facts.select(*key, *defaults), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def without_contacts(detections: DataFrame, pair: str, channel: str) -> DataFrame:
    """The rows whose channel is no contact of their stimulated pair ``LEAD_a_b``; rows without a pair stay."""
    parts = F.regexp_extract_all(F.upper(F.col(pair)), F.lit(r"([A-Z]+|[0-9]+)"), 1)
    ends = F.transform(F.slice(parts, 2, 2), lambda n: F.concat(F.get(parts, F.lit(0)), F.regexp_replace(n, "^0+", "")))
    label = F.regexp_replace(F.upper(F.col(channel)), "^([A-Z]+)0*([0-9]+)$", "$1$2")
    return detections.where(~F.coalesce(F.array_contains(ends, label), F.lit(False)))


def borderline(value: Column, threshold: float, share: float = 0.2) -> Column:
    """Whether a value lies within ``share`` of a threshold, ends included; null for no value."""
    return value.between(threshold * (1 - share), threshold * (1 + share))


def audit_summary(trials: DataFrame, unit: list[str], bad: Column, hard: Column) -> DataFrame:
    """unit, n_trials, n_bad, n_hard, n_clean (neither), fractions, and whether there is anything to review."""
    b, h = F.coalesce(bad, F.lit(False)), F.coalesce(hard, F.lit(False))
    out = trials.groupBy(*unit).agg(F.count("*").alias("n_trials"), F.sum(b.cast("long")).alias("n_bad"), F.sum(h.cast("long")).alias("n_hard"), F.sum((~b & ~h).cast("long")).alias("n_clean"))
    return out.withColumns({"bad_fraction": F.col("n_bad") / F.col("n_trials"), "hard_fraction": F.col("n_hard") / F.col("n_trials"), "review": (F.col("n_bad") > 0) | (F.col("n_hard") > 0)})


def review_reasons(rows: DataFrame, rules: dict[str, tuple[Column, int]]) -> DataFrame:
    """``rows`` with reasons (joined by ;, in the rules' order) and priority (the greatest of those that hold, 0 if none)."""
    held = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, (rule, _) in rules.items())))
    worst = F.greatest(F.lit(0), *(F.when(rule, F.lit(weight)).otherwise(0) for rule, weight in rules.values()))
    return rows.withColumns({"reasons": F.concat_ws(";", held), "priority": worst})


def common_mode(channels: DataFrame, group: list[str], start: str, drift: str, early: Column, least: int, share: float, start_floor: float, drift_floor: float) -> DataFrame:
    """group, n_channels, early_fraction, median_start, median_drift, common_mode: whether nearly all channels respond at once.

    All four must hold: enough channels, an early share, and medians of the absolute start and drift.
    """
    plain = channels.groupBy(*group).agg(F.count("*").alias("n_channels"), F.avg(F.coalesce(early, F.lit(False)).cast("double")).alias("early_fraction"))
    for column, name in ((start, "median_start"), (drift, "median_drift")):
        plain = meet(plain, medians(value_counts(channels.withColumn("_abs", F.abs(column)), group, "_abs"), group, name), group, "left")
    flag = (F.col("n_channels") >= least) & (F.col("early_fraction") >= share) & (F.col("median_start") >= start_floor) & (F.col("median_drift") >= drift_floor)
    return plain.withColumn("common_mode", F.coalesce(flag, F.lit(False)))
