"""Quality of channels and trials: features, reasons, summaries, gates and rejection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrove.operators.in_order import with_running_sum
from pulsegrove.operators.windows import medians, robust_scores, robust_stats, value_counts, with_robust_score
from pulsegrove.session import cut

# Cut-offs of the gate; a fraction at its cut-off fails.
MAX_BAD, MAX_HARD, MIN_CLEAN = 0.25, 0.10, 8
HARD_REASONS = ("onset_spike", "rail_contact", "saturation", "plateau")


def channel_features(samples: DataFrame) -> DataFrame:
    """Per channel: std, peak to peak, share of missing samples, median of absolute values."""
    plain = samples.groupBy("channel").agg(F.stddev_samp("value").alias("std"), (F.max("value") - F.min("value")).alias("ptp"), F.avg(F.col("value").isNull().cast("double")).alias("missing"))
    middle = medians(value_counts(samples.withColumn("_abs", F.abs("value")), ["channel"], "_abs"), ["channel"], "median_abs")
    return plain.join(middle, "channel", "left")


def bad_channels(samples: DataFrame, limit: float = 5.0) -> DataFrame:
    """``channel_features`` with the robust score of each channel's log spread among all channels, and ``bad``."""
    features = channel_features(samples).withColumn("_all", F.lit(1)).withColumn("log_std", F.log(F.col("std") + 1e-12))
    scored = robust_scores(features, ["_all"], "log_std", "std_score").drop("_all", "log_std")
    return scored.withColumn("bad", (F.abs("std_score") > limit) | (F.col("missing") > 0.25) | (F.col("ptp") == 0))


def trial_features(epoched: DataFrame) -> DataFrame:
    """Per trial and channel: peak, peak to peak, largest step, share of missing, and the share of its modal value."""
    trial = Window.partitionBy("epoch", "channel").orderBy("offset")
    stepped = epoched.withColumn("_step", F.abs(F.col("value") - F.lag("value").over(trial)))
    modal = epoched.where("value is not null").groupBy("epoch", "channel", F.bround("value", 1).alias("_v")).agg(F.count("*").alias("_c")).groupBy("epoch", "channel").agg((F.max("_c") / F.sum("_c")).alias("saturation"))
    features = stepped.groupBy("epoch", "channel").agg(
        F.max(F.abs("value")).alias("peak_abs"), (F.max("value") - F.min("value")).alias("ptp"), F.max("_step").alias("max_step"), F.avg(F.col("value").isNull().cast("double")).alias("missing")
    )
    return features.join(modal, ["epoch", "channel"], "left")


def with_reasons(features: DataFrame, limit: float) -> DataFrame:
    """Trial features with robust scores within the channel, ``reasons`` (array) and ``bad_response``."""
    # stored, as each score reads its input many times: a score of a scored table would read it as often for each of those
    features = scored = cut(features)
    for column in ("peak_abs", "ptp", "max_step"):
        scored = with_robust_score(scored, cut(robust_stats(features, ["channel"], column)), ["channel"], column, f"{column}_score")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("peak_abs_score") > limit, "amplitude"), F.when(F.col("ptp_score") > limit, "range"), F.when(F.col("max_step_score") > limit, "step"),
            F.when(F.col("saturation") >= 0.8, "saturation"), F.when(F.col("missing") > 0.2, "missing"),
        )
    )
    return scored.withColumn("reasons", reasons).withColumn("bad_response", F.size("reasons") > 0)


def artifact_totals(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: trials, bad and hard trials, clean ones and fractions, the greatest saturation, and all reasons in order."""
    n, bad, hard = F.sum("n_epochs"), F.sum("n_bad_response"), F.sum("n_hard_artifact_response")
    each = summary.select(*keys, F.explode(F.split("artifact_reasons", ";")).alias("reason")).where("reason <> ''").distinct()
    listed = each.groupBy(*keys).agg(F.concat_ws(";", F.array_sort(F.collect_list("reason"))).alias("reasons"))
    totals = summary.groupBy(*keys).agg(
        n.alias("n_epochs"), bad.alias("n_bad"), hard.alias("n_hard"), F.sum("n_clean_response").alias("n_clean"), (bad / n).alias("bad_fraction"), (hard / n).alias("hard_fraction"), F.max("max_saturation_fraction").alias("max_saturation")
    )
    return totals.join(listed, keys, "left").withColumn("reasons", F.coalesce("reasons", F.lit("")))


def gated(totals: DataFrame) -> DataFrame:
    """``totals`` with ``qc_pass``: below both fractions and enough clean trials."""
    return totals.withColumn("qc_pass", F.coalesce((F.col("bad_fraction") < MAX_BAD) & (F.col("hard_fraction") < MAX_HARD) & (F.col("n_clean") >= MIN_CLEAN), F.lit(False)))


def reject(epoched: DataFrame, bad: DataFrame, mode: str) -> DataFrame:
    """Epochs without the bad responses (epoch, channel): their values null (``null``), their epochs gone and renumbered from 0
    where at least a quarter of the channels is bad (``epoch``), or their channels gone where over a quarter of the epochs is (``channel``)."""
    bad = bad.select("epoch", "channel").distinct()
    if mode == "null":
        return epoched.join(bad.withColumn("_bad", F.lit(True)), ["epoch", "channel"], "left").withColumn("value", F.when(F.col("_bad").isNull(), F.col("value"))).drop("_bad")
    unit, other = ("epoch", "channel") if mode == "epoch" else ("channel", "epoch")
    total = epoched.groupBy(unit).agg(F.count_distinct(other).alias("n"))
    share = bad.groupBy(unit).agg(F.count("*").alias("b")).join(total, unit).withColumn("share", F.col("b") / F.col("n"))
    kept = epoched.join(share.where(F.col("share") >= MAX_BAD if mode == "epoch" else F.col("share") > MAX_BAD), unit, "left_anti")
    if mode == "channel":
        return kept
    # numbers by block, as there may be as many epochs as events
    each = kept.select("epoch").distinct().withColumn("_all", F.lit(1))
    numbers = with_running_sum(each, "_all", F.floor(F.col("epoch") / 4096), ["epoch"], F.lit(1), "_new").drop("_all")
    return kept.join(numbers, "epoch").withColumn("epoch", F.col("_new") - 1).drop("_new")
