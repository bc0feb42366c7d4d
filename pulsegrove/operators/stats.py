"""Comparisons of groups, dependence between channels, fits along leads, and resampling tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrove.operators.in_order import meet, with_running_sum
from pulsegrove.operators.in_tasks import steeper_draws
from pulsegrove.operators.windows import adjusted_p, value_counts
from pulsegrove.session import cut


#: Buckets of groups that are compared with each other.
GROUP_BUCKETS = 8


def group_pairs(groups: DataFrame, group: str) -> DataFrame:
    """Every pair of rows of ``groups`` (one row per group), the columns of the smaller group with _a, of the other with _b.

    Groups are hashed into buckets, and each two buckets meet by an equi-join, so no side is broadcast and no task gets all pairs.
    """
    own = groups.withColumn("_own", F.pmod(F.xxhash64(group), F.lit(GROUP_BUCKETS)))
    every = F.explode(F.sequence(F.lit(0), F.lit(GROUP_BUCKETS - 1)))
    a = own.select(*(F.col(c).alias(f"{c}_a") for c in groups.columns), F.col("_own").alias("_i"), every.alias("_j"))
    b = own.select(*(F.col(c).alias(f"{c}_b") for c in groups.columns), every.alias("_i"), F.col("_own").alias("_j"))
    return a.join(b, ["_i", "_j"]).where(F.col(f"{group}_a") < F.col(f"{group}_b")).drop("_i", "_j")


def compare_groups(df: DataFrame, group: str, value: str) -> DataFrame:
    """All pairs of groups: sizes, means, difference, Cohen's d, Welch's t and its degrees of freedom.

    Only each group's moments meet, one row per group.
    """
    moments = df.where(F.col(value).isNotNull()).groupBy(F.col(group).cast("string").alias("g")).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    pairs = group_pairs(moments, "g")
    sa, sb = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    diff = F.col("m_a") - F.col("m_b")
    df_ = (sa + sb) * (sa + sb) / (sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1))
    return pairs.select(
        F.col("g_a").alias("group_a"), F.col("g_b").alias("group_b"), "n_a", "n_b", F.col("m_a").alias("mean_a"), F.col("m_b").alias("mean_b"), diff.alias("difference"),
        (diff / F.sqrt((F.col("v_a") + F.col("v_b")) / 2)).alias("cohen_d"), (diff / F.sqrt(sa + sb)).alias("t"), df_.alias("df"),
    )


def rank_sums(df: DataFrame, group: str, value: str) -> DataFrame:
    """All pairs of groups: sizes, Mann-Whitney's U of the first group, its z with ties corrected, and the rank-biserial size.

    Pairs meet on distinct values: for each value, how many of the other group lie below and at it come from running counts.
    """
    counts = value_counts(df.withColumn("_g", F.col(group).cast("string")), ["_g"], value)
    sizes = counts.groupBy("_g").agg(F.sum("_n").alias("_size"))
    pairs = group_pairs(sizes, "_g").select("_g_a", "_g_b", F.col("_size_a").alias("na"), F.col("_size_b").alias("nb"))
    own = pairs.join(counts.withColumnRenamed("_g", "_g_a"), "_g_a").select("_g_a", "_g_b", "_v", F.col("_n").alias("a"), F.lit(0).cast("long").alias("b"))
    other = pairs.join(counts.withColumnRenamed("_g", "_g_b"), "_g_b").select("_g_a", "_g_b", "_v", F.lit(0).cast("long").alias("a"), F.col("_n").alias("b"))
    cells = own.unionByName(other).groupBy("_g_a", "_g_b", "_v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    spans = counts.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    block = F.floor((F.col("_v") - spans.select("_lo").scalar()) / F.greatest(spans.select("_hi").scalar() - spans.select("_lo").scalar(), F.lit(1e-300)) * 256)
    below = with_running_sum(cells.withColumn("_block_of", block), ["_g_a", "_g_b"], F.col("_block_of"), ["_v"], F.col("b"), "_upto")
    u = F.sum(F.col("a") * (F.col("_upto") - F.col("b") / 2))
    ties = F.sum(F.pow((F.col("a") + F.col("b")).cast("double"), F.lit(3)) - (F.col("a") + F.col("b")))
    out = below.groupBy("_g_a", "_g_b").agg(u.alias("u"), ties.alias("ties")).join(pairs, ["_g_a", "_g_b"])
    n = (F.col("na") + F.col("nb")).cast("double")
    spread = F.sqrt(F.col("na") * F.col("nb") / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return out.select(
        F.col("_g_a").alias("group_a"), F.col("_g_b").alias("group_b"), F.col("na").alias("n_a"), F.col("nb").alias("n_b"), "u",
        F.when(spread > 0, (F.col("u") - F.col("na") * F.col("nb") / 2) / spread).alias("z"), (2 * F.col("u") / (F.col("na") * F.col("nb")) - 1).alias("biserial"),
    )


def beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    total = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d)
            c = 1 + top / c
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-values of t statistics; null where either is missing."""
    return pd.Series([beta_tail(n / 2, 0.5, n / (n + x * x)) if pd.notna(x) and pd.notna(n) and n > 0 else None for x, n in zip(t, df)], dtype=float)


def correlations(samples: DataFrame) -> DataFrame:
    """a, b, n, r: Pearson's correlation of each pair of channels over the steps that both have.

    Channels meet on k; there are as many pairs per step as the few channels make.
    """
    a = samples.where("value is not null").select("k", F.col("channel").alias("a"), F.col("value").alias("x"))
    b = samples.where("value is not null").select("k", F.col("channel").alias("b"), F.col("value").alias("y"))
    return a.join(b, "k").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))


def mutual_information(samples: DataFrame, bins: int) -> DataFrame:
    """a, b, mi: mutual information (nats) of each pair of channels over equal bins of each channel's range, last edge closed."""
    ranges = samples.where("value is not null").groupBy("channel").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    cell = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    binned = samples.where("value is not null").join(ranges, "channel").select("k", "channel", cell.alias("cell"))
    a, b = binned.select("k", F.col("channel").alias("a"), F.col("cell").alias("i")), binned.select("k", F.col("channel").alias("b"), F.col("cell").alias("j"))
    joint = a.join(b, "k").where("a < b").groupBy("a", "b", "i", "j").agg(F.count("*").alias("n"))
    rows, cols, all_ = joint.groupBy("a", "b", "i").agg(F.sum("n").alias("ni")), joint.groupBy("a", "b", "j").agg(F.sum("n").alias("nj")), joint.groupBy("a", "b").agg(F.sum("n").alias("m"))
    full = joint.join(rows, ["a", "b", "i"]).join(cols, ["a", "b", "j"]).join(all_, ["a", "b"])
    return full.groupBy("a", "b").agg(F.sum(F.col("n") / F.col("m") * F.log(F.col("n") * F.col("m") / (F.col("ni") * F.col("nj")))).alias("mi"))


def lead_fits(contacts: DataFrame, keys: list[str]) -> DataFrame:
    """Per lead of ``keys``: slope and intercept of each coordinate over the contact number, and the worst RMS error.

    Only leads of at least four localised contacts with more than one number.
    """
    aggs = [f(x, "number").alias(f"{name}_{x}") for x in ("mni_x", "mni_y", "mni_z") for name, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept))]
    errors = [F.sqrt(F.greatest(F.regr_syy(x, "number") - F.regr_sxy(x, "number") * F.regr_sxy(x, "number") / F.regr_sxx(x, "number"), F.lit(0.0)) / F.count("*")) for x in ("mni_x", "mni_y", "mni_z")]
    located = contacts.where("mni_x is not null and mni_y is not null and mni_z is not null and not isnan(mni_x) and not isnan(mni_y) and not isnan(mni_z)")
    return located.groupBy(*keys, "lead").agg(F.count("*").alias("n"), F.min("number").alias("lowest"), F.max("number").alias("highest"), *aggs, F.greatest(*errors).alias("rmse")).where("n >= 4 and highest > lowest")


#: Values up to which every pattern of signs is tried, and random patterns of larger groups.
EXACT, DRAWS = 16, 5000
#: Values of a group that one task adds up for all its draws.
DRAWN_PART = 1 << 16


def sign_flips(df: DataFrame, keys: list[str], value: str, unit: str, exact: int = EXACT, draws: int = DRAWS, seed: int = 42, part: int = DRAWN_PART) -> DataFrame:
    """keys, n, mean, p: two-sided sign-flip test of each group's mean.

    Groups of up to ``exact`` values try every pattern of signs. Larger ones take ``draws`` random patterns and count the
    observed one among them: the sign of a value in a draw is a bit of a hash of ``unit`` (which tells a group's values
    apart), the draw and the seed. A task adds up a group's signed values for all draws and returns one row, the number of
    draws that reach the observed sum; only groups over ``part`` values are cut into parts whose sums by draw meet in a shuffle.
    """
    values = df.where(F.col(value).isNotNull()).select(*keys, F.xxhash64(F.col(unit), F.lit(seed)).alias("_unit"), F.col(value).cast("double").alias("x"))
    sizes = values.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.sum(F.abs("x")).alias("size"))
    limit = F.abs(F.col("mean") * F.col("n")) - 1e-12 * F.greatest(F.col("size"), F.lit(1.0))
    small = values.join(sizes.where(F.col("n") <= exact).select(*keys), keys, "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    tried = small.select(*keys, exact_sign_flip("xs").alias("exact"))
    large = values.join(sizes.where(F.col("n") > exact).select(*keys, limit.alias("_limit"), F.ceil(F.col("n") / part).alias("_parts")), keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in large.schema.fields if f.name in keys)
    spread = large.withColumn("_part", F.pmod("_unit", "_parts")).repartition(*keys, "_part").sortWithinPartitions(*keys, "_part")
    partial = spread.mapInPandas(lambda batches: signed_sums(batches, keys, draws), f"{schema}, _limit double, hits long, s array<double>")
    sums = partial.select(*keys, "_limit", "hits", F.posexplode_outer("s").alias("_draw", "_s")).groupBy(*keys, "_limit", "_draw").agg(F.sum("hits").alias("hits"), F.sum("_s").alias("_s"))
    met = sums.groupBy(*keys).agg(F.sum(F.coalesce("hits", (F.abs("_s") >= F.col("_limit")).cast("long"))).alias("hits"))
    drawn = met.select(*keys, ((1 + F.col("hits")) / F.lit(1.0 + draws)).alias("drawn"))
    return sizes.join(tried, keys, "left").join(drawn, keys, "left").select(*keys, "n", "mean", F.coalesce("exact", "drawn").alias("p"))


def signed_sums(batches: Iterator[pd.DataFrame], keys: list[str], draws: int) -> Iterator[pd.DataFrame]:
    """keys, _limit, hits, s of batches sorted by group and part: how many draws' sums reach the limit, or of a group of several parts the part's sums."""
    words = (np.arange(1, -(-draws // 64) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]

    def row(last: tuple) -> list:
        *key, _, limit, parts, total = last
        return [*key, limit, None, total] if parts > 1 else [*key, limit, int((np.abs(total) >= limit).sum()), None]

    last = None
    for pdf in batches:
        rows = []
        for key, own in pdf.groupby([*keys, "_part"], dropna=False, sort=False):
            x, unit, total = own["x"].to_numpy(float), own["_unit"].to_numpy().astype(np.uint64), np.zeros(draws)
            for at in range(0, len(x), 512):
                # the finaliser of a well-known 64-bit mixing function (splitmix)
                h = unit[at : at + 512, None] + words
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                bits = np.unpackbits((h ^ (h >> np.uint64(31))).view(np.uint8), axis=1)[:, :draws]
                total += x[at : at + 512].sum() - 2 * (x[at : at + 512] @ bits)
            if last is not None and all(a == b or (a != a and b != b) for a, b in zip(last, key)):
                last[-1][:] += total  # the group goes on from the batch before
                continue
            if last is not None:
                rows.append(row(last))
            last = (*key, own["_limit"].iloc[0], own["_parts"].iloc[0], total)
        yield pd.DataFrame(rows, columns=[*keys, "_limit", "hits", "s"]).astype({"hits": "Int64"})
    if last is not None:
        yield pd.DataFrame([row(last)], columns=[*keys, "_limit", "hits", "s"]).astype({"hits": "Int64"})


@F.pandas_udf(T.DoubleType())
def exact_sign_flip(xs: pd.Series) -> pd.Series:
    """The share of sign patterns whose mean is at least as far from 0 as the one observed."""

    def patterns(x: np.ndarray) -> np.ndarray:
        sums = np.zeros(1)
        for v in x:
            sums = np.concatenate([sums + v, sums - v])
        return sums

    def one(x: np.ndarray) -> float:
        x = np.asarray(x, float)
        # a pattern and its opposite are equally far, so the first sign stays
        sums = np.abs(x[0] + patterns(x[1:]))
        return float((sums >= abs(x.sum()) - 1e-12 * max(1.0, np.abs(x).sum())).mean())

    return xs.map(one).astype(float)


@F.pandas_udf(T.DoubleType())
def _erfc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.erfc(v) if pd.notna(v) else None).astype(float)


def normal_cdf(z):
    return 1 - _erfc(z / math.sqrt(2)) / 2


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(moments: pd.Series) -> pd.Series:
    """Coefficients of least squares from the flattened normal equations [X'X | X'y], null where they are singular."""

    def one(flat) -> list[float] | None:
        flat = np.asarray(flat, float)
        size = int(round((math.sqrt(1 + 4 * len(flat)) - 1) / 2))
        table = flat.reshape(size, size + 1)
        if not np.isfinite(table).all() or np.linalg.matrix_rank(table[:, :-1]) < size:
            return None
        return np.linalg.solve(table[:, :-1], table[:, -1]).tolist()

    return moments.map(one)


def linear_fit(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """keys, n, intercept, a slope per x and rss (residual sum of squares): least squares by each group's sums of products."""
    full = df.where(" and ".join(f"{c} is not null and not isnan({c})" for c in [y, *xs]))
    means = full.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"_m_{c}") for c in [y, *xs]))
    centred = full.join(means, keys)
    less = {c: F.col(c) - F.col(f"_m_{c}") for c in [y, *xs]}
    sums = centred.groupBy(*keys, "n", *(f"_m_{c}" for c in [y, *xs])).agg(F.array(*(F.sum(less[a] * less[b]) for a in xs for b in [*xs, y])).alias("_sums"), F.sum(less[y] * less[y]).alias("_syy"))
    return fit_of_sums(sums, keys, y, xs)


def fit_of_sums(sums: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """``linear_fit`` of rows of keys, n, a mean _m_.. of y and each x, _syy and the flattened _sums of centred products [X'X | X'y]."""
    solved = sums.withColumn("_b", _solve("_sums"))
    slopes = [F.get("_b", F.lit(i)) for i in range(len(xs))]
    explained = sum((b * F.get("_sums", F.lit(i * (len(xs) + 1) + len(xs))) for i, b in enumerate(slopes)), F.lit(0.0))
    rss = F.greatest(F.col("_syy") - explained, F.lit(0.0))
    intercept = F.col(f"_m_{y}") - sum((b * F.col(f"_m_{x}") for b, x in zip(slopes, xs)), F.lit(0.0))
    return solved.select(*keys, "n", intercept.alias("intercept"), *(b.alias(f"slope_{x}") for b, x in zip(slopes, xs)), rss.alias("rss"))


def bootstrap_interval(df: DataFrame, cluster: str, value: str, draws: int, seed: int, level: float = 0.95) -> DataFrame:
    """estimate, low, high, n_clusters: the mean over clusters of their means, and percentiles over draws of clusters.

    Every cluster enters a draw as often as a Poisson variable of mean 1 says, which a hash of cluster, draw and seed
    decides, so draws need no shuffle of the rows: only one row per cluster is spread over the draws.
    """
    means = df.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.avg(value).alias("m"))
    u = (F.pmod(F.xxhash64(cluster, "draw", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    edges, total, term = [], 0.0, math.exp(-1)
    for k in range(12):
        total += term
        edges.append(total)
        term /= k + 1
    times = sum(((u > e).cast("int") for e in edges), F.lit(0))
    drawn = means.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", times).groupBy("draw").agg((F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("x"))
    ends = drawn.agg(F.percentile("x", (1 - level) / 2).alias("low"), F.percentile("x", (1 + level) / 2).alias("high"))
    return means.agg(F.avg("m").alias("estimate"), F.count("*").alias("n_clusters")).select("estimate", ends.select("low").scalar().alias("low"), ends.select("high").scalar().alias("high"), "n_clusters")


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson's interval of a rate; nulls where n is 0."""
    p = hits / n
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.when(n > 0, (middle - half) / scale), F.when(n > 0, (middle + half) / scale)


def dealt_anew(rows: DataFrame, base: DataFrame, keys: list[str], unit: list[str], y: str, xs: list[str], limit: Column, draws: int, seed: int) -> DataFrame:
    """``base`` with hits: in how many draws y, paired anew with ``xs`` within a group, is as steep as ``limit`` says; null where that is null.

    ``unit`` tells a group's rows apart. A pairing matches the rows' order by one hash with their order by another, drawn
    anew for each draw. A group is dealt within one task, which returns one row, whatever the number of draws. Neither rows
    nor groups are broadcast through the driver.
    """
    asked = meet(rows, base.select(*keys, limit.alias("_limit")).where("_limit is not null").hint("merge"), keys).select(*keys, *unit, *(F.col(c).cast("double").alias(c) for c in (y, *xs)), "_limit")
    schema = ", ".join(f"`{k}` {asked.schema[k].dataType.simpleString()}" for k in keys)
    order = asked.repartition(*keys).sortWithinPartitions(*keys, F.xxhash64(*unit, F.lit(seed)), *unit)
    hits = order.select(*keys, y, *xs, "_limit").mapInArrow(lambda batches: steeper_draws(batches, keys, y, xs, "_limit", draws, seed), f"{schema}, hits long")
    return meet(base, hits.hint("merge"), keys, "left")


def slope_permutation(df: DataFrame, keys: list[str], unit: list[str], x: str, y: str, draws: int, seed: int) -> DataFrame:
    """keys, n, slope, r2, p: the slope of y over x, and how often a random pairing of the two is as steep."""
    whole = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    units = [f"_u{i}" for i in range(len(unit))]
    rows = whole.select(*keys, *(F.col(u).alias(name) for u, name in zip(unit, units)), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = cut(rows)  # read by the fit and by the draws
    base = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"))
    counted = dealt_anew(rows, base, keys, units, "y", ["x"], F.abs("slope") - 1e-12, draws, seed)
    return counted.select(*keys, "n", "slope", "r2", ((1 + F.col("hits")) / F.lit(1.0 + draws)).alias("p"))


def latency_permutation(df: DataFrame, keys: list[str], unit: list[str], latency: str, axes: list[str], draws: int, seed: int) -> DataFrame:
    """keys, n, gradient, p, q: how often latencies dealt anew to the places have as steep a gradient, adjusted over all keys."""
    columns = [latency, *axes]
    units = [f"_u{i}" for i in range(len(unit))]
    rows = df.where(" and ".join(f"{c} is not null and not isnan({c})" for c in columns)).select(*keys, *(F.col(u).alias(name) for u, name in zip(unit, units)), *columns)
    rows = cut(rows)  # read by the fit and by the draws
    gradient = F.sqrt(sum((F.pow(F.col(f"slope_{a}"), F.lit(2)) for a in axes), F.lit(0.0)))
    base = cut(linear_fit(rows, keys, latency, axes).where(F.col("n") >= len(axes) + 2).select(*keys, "n", gradient.alias("gradient")))
    counted = dealt_anew(rows, base, keys, units, latency, axes, F.col("gradient") - 1e-12, draws, seed)
    out = counted.select(*keys, "n", "gradient", ((1 + F.col("hits")) / F.lit(1.0 + draws)).alias("p"))
    return adjusted_p(out.withColumn("_family", F.lit(1)), ["_family"], "p", "q").drop("_family")


def in_regions(label: Column, pattern: str) -> Column:
    """Whether an anatomical label matches, without case; a missing label does not."""
    return F.coalesce(label.rlike(f"(?i){pattern}"), F.lit(False))


def latency_gradient(df: DataFrame, keys: list[str], latency: str, axes: list[str]) -> DataFrame:
    """keys, n, slopes, gradient (latency per unit of space), speed (1 / gradient), unit vector and status of a plane wave.

    Status: ok, too_few (under one row more than there are unknowns), flat (no single plane fits).
    """
    fit = linear_fit(df, keys, latency, axes)
    size = F.sqrt(sum((F.col(f"slope_{a}") * F.col(f"slope_{a}") for a in axes), F.lit(0.0)))
    few = F.col("n") < len(axes) + 2
    status = F.when(few, "too_few").when(size.isNull() | (size == 0), "flat").otherwise("ok")
    keep = lambda x: F.when(status == "ok", x)
    return fit.select(*keys, "n", *(keep(F.col(f"slope_{a}")).alias(f"slope_{a}") for a in axes), keep(size).alias("gradient"), keep(1 / F.nullif(size, F.lit(0.0))).alias("speed"), *(keep(F.col(f"slope_{a}") / F.nullif(size, F.lit(0.0))).alias(f"unit_{a}") for a in axes), status.alias("status"))
