"""Standard scores, ranks, adjusted p-values, runs, onsets and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrove.operators.in_order import meet, with_previous, with_running_sum
from pulsegrove.session import cut

#: Turns a median absolute deviation into a standard deviation of normal data.
MAD_SCALE = 1.4826


def group_moments(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the standard score of ``value`` in its group; null where the group has no spread.

    Mean and deviation are aggregated first and joined back, so no group is sorted or held as a whole.
    """
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))
    return df.join(stats, keys).withColumn(name, F.when(F.col("_std") > 0, (F.col(value) - F.col("_mean")) / F.col("_std"))).drop("_mean", "_std")


def dense_rank_desc(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the dense rank, 1 for the greatest, of ``value`` in its group; null values have no rank.

    Only the distinct values of a group are ranked.
    """
    distinct = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    ranked = distinct.withColumn(name, F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col(value).desc())))
    return df.join(ranked, [*keys, value], "left")


#: Blocks into which a group's range of values is cut to find its median.
MEDIAN_BLOCKS = 4096


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, _v, _n: each group's distinct values (as doubles, without null and NaN) with their counts."""
    number = F.col(value).cast("double")
    return df.where(F.col(value).isNotNull() & ~F.isnan(number)).groupBy(*keys, number.alias("_v")).agg(F.count("*").alias("_n"))


def medians(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, ``name``: the exact median of each group of ``value_counts``, the mean of the two middle values of an even number.

    A group's range is cut into equal blocks; sums by block say in which block the middle lies, and only that block's
    distinct values are put in order. So no group is sorted or held as a whole, whatever its size.
    """
    total = counts.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_m"))
    share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    blocks = meet(counts, total, keys).withColumn("_b", F.when(F.col("_hi") > F.col("_lo"), F.floor(share * MEDIAN_BLOCKS)).otherwise(0))
    sums = blocks.groupBy(*keys, "_b", "_m").agg(F.sum("_n").alias("_s"))
    sums = sums.withColumn("_before", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s"))
    low, high = F.floor((F.col("_m") - 1) / 2), F.floor(F.col("_m") / 2)  # ranks from 0
    middle = sums.where((F.col("_before") <= high) & (F.col("_before") + F.col("_s") > low)).select(*keys, "_b", "_before")
    ranked = meet(blocks, middle, [*keys, "_b"]).withColumn("_at", F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda rank: F.min(F.when(F.col("_at") > rank, F.col("_v")))
    return ranked.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias(name))


def median_and_spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, _med, _mad: each group's median and the median distance from it."""
    counts = value_counts(df, keys, value)
    middle = medians(counts, keys, "_med")
    off = meet(counts, middle, keys).groupBy(*keys, F.abs(F.col("_v") - F.col("_med")).alias("_v")).agg(F.sum("_n").alias("_n"))
    return meet(middle, medians(off, keys, "_mad"), keys)


def robust_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, _med, _mad, _std of each group: what ``robust_scores`` takes from it."""
    return meet(median_and_spread(df, keys, value), df.groupBy(*keys).agg(F.stddev_samp(value).alias("_std")), keys)


def with_robust_score(df: DataFrame, stats: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``df`` with its score by ``robust_stats``."""
    scale = F.when(F.col("_mad") > 0, F.col("_mad") * MAD_SCALE).when(F.col("_std") > 0, F.col("_std")).otherwise(1.0)
    return meet(df, stats, keys, "left").withColumn(name, (F.col(value) - F.col("_med")) / scale).drop("_med", "_std", "_mad")


def robust_scores(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``df`` with (value - median) / (MAD * 1.4826); without spread the standard deviation, then 1, takes its place."""
    return with_robust_score(df, robust_stats(df, keys, value), keys, value, name)


def adjusted_p(df: DataFrame, family: list[str], p: str, name: str, blocks: int = 1024) -> DataFrame:
    """``df`` with Benjamini-Hochberg adjusted p-values within each family; null and NaN stay null and do not count.

    Equal p-values share one row, and a family is cut along p into blocks, so that it is never sorted as a whole:
    ranks come from running counts, and the smallest value further up from each block and the blocks after it.
    """
    finite = F.when(~F.isnan(p), F.col(p))
    counts = df.select(*family, finite.alias("_p")).where("_p is not null").groupBy(*family, "_p").agg(F.count("*").alias("_n"))
    block = F.floor(F.least(F.greatest(F.col("_p"), F.lit(0.0)), F.lit(1.0)) * blocks)
    ranked = with_running_sum(counts, family, block, ["_p"], F.col("_n"), "_rank").join(counts.groupBy(*family).agg(F.sum("_n").alias("_m")), family)
    raw = ranked.withColumn("_block", block).withColumn("_raw", F.col("_p") * F.col("_m") / F.col("_rank"))
    up = Window.partitionBy(*family, "_block").orderBy(F.col("_p").desc())
    ends = raw.groupBy(*family, "_block").agg(F.min("_raw").alias("_least"))
    later = Window.partitionBy(*family).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_later", F.min("_least").over(later)).drop("_least")
    q = F.least(F.lit(1.0), F.min("_raw").over(up), F.coalesce("_later", F.lit(1.0)))
    solved = raw.join(ends, [*family, "_block"]).select(*family, "_p", q.alias(name))
    return df.withColumn("_p", finite).join(solved, [*family, "_p"], "left").drop("_p")


def onsets(df: DataFrame, key: str, block: Column, order: list[str], active: Column) -> DataFrame:
    """``df`` with ``edge``: rising where ``active`` begins, falling where it ends, else null. Before the first row nothing is active."""
    marked = with_previous(df.withColumn("_active", F.coalesce(active, F.lit(False))), key, block, order, F.col("_active"), "_was")
    was = F.coalesce("_was", F.lit(False))
    return marked.withColumn("edge", F.when(F.col("_active") & ~was, "rising").when(~F.col("_active") & was, "falling")).drop("_active", "_was")


def clusters(df: DataFrame, key: str, at: str, tie: str, gap: int, block: Column) -> DataFrame:
    """``df`` with ``cluster``: rows of a key whose times follow each other by at most ``gap``, numbered from 1 in order."""
    marked = with_previous(df, key, block, [at, tie], F.col(at), "_before")
    fresh = F.when(F.col("_before").isNull() | (F.col(at) - F.col("_before") > gap), 1).otherwise(0)
    return with_running_sum(marked.withColumn("_fresh", fresh), key, block, [at, tie], F.col("_fresh"), "cluster").drop("_before", "_fresh")


def longest_runs(df: DataFrame, key: str, k: str, active: Column) -> DataFrame:
    """key, longest: the most consecutive steps k in which ``active`` holds, 0 if none.

    A run is told by k minus its rank; ranks come from running sums, so a key of any size is split into blocks.
    """
    held = with_running_sum(df.where(active).select(key, k), key, F.floor(F.col(k) / 4096), [k], F.lit(1), "_rank")
    runs = held.groupBy(key, (F.col(k) - F.col("_rank")).alias("_run")).agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("longest"))
    return df.select(key).distinct().join(runs, key, "left").select(key, F.coalesce("longest", F.lit(0)).alias("longest"))


def gradient(df: DataFrame, key: list[str], k: str, value: str) -> DataFrame:
    """``df`` with central differences over consecutive rows, one-sided at the ends. Keys are trials, so short."""
    w = Window.partitionBy(*key).orderBy(k)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return df.withColumn("gradient", F.when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2))


def rolling_mean(df: DataFrame, key: list[str], block: Column, order: list[str], value: str, n: int, name: str) -> DataFrame:
    """``df`` with the mean of the last ``n`` rows, fewer at a key's start.

    Rows are numbered by running counts of blocks and cut into runs of equal length; the last rows of a run are lent to the
    next one, so no window spans a whole key.
    """
    size = max(4096, 4 * n)
    numbered = with_running_sum(df, key, block, order, F.lit(1), "_at").withColumn("_run", F.floor((F.col("_at") - 1) / size))
    lent = numbered.where(F.pmod(F.col("_at") - 1, F.lit(size)) >= size - (n - 1)).withColumns({"_run": F.col("_run") + 1, "_lent": F.lit(True)})
    window = Window.partitionBy(*key, "_run").orderBy("_at").rowsBetween(1 - n, 0)
    both = numbered.withColumn("_lent", F.lit(False)).unionByName(lent).withColumn(name, F.avg(value).over(window))
    return both.where(~F.col("_lent")).drop("_at", "_run", "_lent")


def boxcar(df: DataFrame, key: list[str], k: str, value: str, half: int, name: str) -> DataFrame:
    """``df`` with the mean of ``half`` rows to each side; beyond a trial's ends its end values go on. Keys are trials, so short."""
    whole = Window.partitionBy(*key).orderBy(k).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near, at = Window.partitionBy(*key).orderBy(k).rowsBetween(-half, half), F.row_number().over(Window.partitionBy(*key).orderBy(k))
    left, right = F.greatest(half + 1 - at, F.lit(0)), F.greatest(at + half - F.count("*").over(whole), F.lit(0))
    return df.withColumn(name, (F.sum(value).over(near) + left * F.first(value).over(whole) + right * F.last(value).over(whole)) / (2 * half + 1))


def longest_constant(df: DataFrame, key: list[str], k: str, value: str, eps: float) -> DataFrame:
    """key, longest: the most consecutive rows of a trial whose values differ by at most ``eps`` from one to the next (1 if none do)."""
    w = Window.partitionBy(*key).orderBy(k)
    step = df.withColumn("_new", F.when(F.abs(F.col(value) - F.lag(value).over(w)) <= eps, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return step.groupBy(*key, "_run").agg(F.count("*").alias("n")).groupBy(*key).agg(F.max("n").alias("longest"))


def latest(df: DataFrame, key: list[str], k: str, n: int) -> DataFrame:
    """The last ``n`` rows of each trial."""
    return df.withColumn("_back", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(k).desc()))).where(F.col("_back") <= n).drop("_back")


def compare_sites(df: DataFrame, site: str, unit: str, metrics: list[str], p: str) -> DataFrame:
    """site, unit, z of each metric within its site, log_p (-log10), composite (the greatest of them in size) and its dense rank in the site."""
    scored = df
    for m in metrics:
        scored = group_moments(scored, [site], m, f"{m}_z")
    scored = scored.withColumn("log_p", F.when(F.col(p) > 0, -F.log10(p)))
    scored = scored.withColumn("composite", F.greatest(*(F.abs(f"{m}_z") for m in metrics), F.col("log_p"))).select(site, unit, *(f"{m}_z" for m in metrics), "log_p", "composite")
    return dense_rank_desc(scored, [site], "composite", "rank")


def first_settled(df: DataFrame, key: list[str], k: str, calm: Column, n: int) -> DataFrame:
    """key, settled_at: the first k from which ``n`` rows in a row are calm, null if there is none."""
    ahead = Window.partitionBy(*key).orderBy(k).rowsBetween(0, n - 1)
    flag = F.coalesce(calm, F.lit(False)).cast("int")
    marked = df.withColumn("_run", F.sum(flag).over(ahead))
    return marked.groupBy(*key).agg(F.min(F.when(F.col("_run") == n, F.col(k))).alias("settled_at"))


def threshold_events(samples: DataFrame, z: float, floor: float, ceiling: float, block: Column) -> DataFrame:
    """channel, k: where |value - median| first rises to min(ceiling, max(floor, z scaled MADs)) on each channel."""
    off = samples.join(cut(median_and_spread(samples, ["channel"], "value")), "channel")  # stored, as the runs below read it again and again
    limit = F.least(F.lit(ceiling), F.greatest(F.lit(floor), z * F.col("_mad") * MAD_SCALE))
    marked = off.withColumn("_on", F.abs(F.col("value") - F.col("_med")) >= limit)
    return onsets(marked, "channel", block, ["k"], F.col("_on")).where("edge = 'rising'").select("channel", "k")


def consensus_events(events: DataFrame, gap: int, least: int, block: Column) -> DataFrame:
    """k, n_channels: clusters of events of any channel within ``gap``, at their rounded median, if ``least`` channels take part."""
    own = cut(clusters(cut(events.withColumn("_all", F.lit(1))), "_all", "k", "channel", gap, block))
    middle = medians(value_counts(own, ["cluster"], "k"), ["cluster"], "_k")
    grouped = own.groupBy("cluster").agg(F.count_distinct("channel").alias("n_channels")).where(F.col("n_channels") >= least)
    return grouped.join(middle, "cluster").select(F.bround("_k").cast("long").alias("k"), "n_channels")
