"""References between channels: common ones, pairs of neighbours, and weighted neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrove.operators.windows import MAD_SCALE

OUTLIER = 8.0


def common_reference(samples: DataFrame, at: list[str], method: str = "mean") -> DataFrame:
    """``samples`` with ``value`` less the mean, median or robust mean of all channels at each point.

    The robust mean leaves out values further than 8 scaled MADs from the median; with fewer than min(4, n) left it is
    the median. Points hold one row per channel, so the groups are as large as there are channels.
    """
    if method == "mean":
        reference = samples.groupBy(*at).agg(F.avg("value").alias("_ref"))
    else:
        reference = samples.groupBy(*at).agg(F.median("value").alias("_ref"))
    if method == "robust_mean":
        off = F.abs(F.col("value") - F.col("_ref"))
        spread = samples.join(reference, at).groupBy(*at).agg(F.median(off).alias("_mad"), F.first("_ref").alias("_med"))
        keep = F.abs(F.col("value") - F.col("_med")) <= OUTLIER * MAD_SCALE * F.col("_mad")
        sums = samples.join(spread, at).groupBy(*at).agg(F.avg(F.when(keep, F.col("value"))).alias("_mean"), F.count(F.when(keep, F.col("value"))).alias("_k"), F.count("value").alias("_n"), F.first("_med").alias("_med"))
        reference = sums.select(*at, F.when(F.col("_k") >= F.least(F.lit(4), F.col("_n")), F.col("_mean")).otherwise(F.col("_med")).alias("_ref"))
    return samples.join(reference, at).withColumn("value", F.col("value") - F.col("_ref")).drop("_ref")


def bipolar(samples: DataFrame, at: list[str]) -> DataFrame:
    """at.., channel, value: each contact (lead, number) less its next neighbour on the same lead, as A-B."""
    a = samples.select(*at, "lead", "number", "value")
    b = samples.select(*at, "lead", (F.col("number") - 1).alias("number"), F.col("value").alias("_other"))
    pairs = a.join(b, [*at, "lead", "number"])
    name = F.concat("lead", F.col("number").cast("string"), F.lit("-"), "lead", (F.col("number") + 1).cast("string"))
    return pairs.select(*at, name.alias("channel"), (F.col("value") - F.col("_other")).alias("value"))


def laplacian(samples: DataFrame, at: list[str]) -> DataFrame:
    """``samples`` with ``value`` less the mean of the neighbours (number one lower and one higher on the lead) that are there.

    Weights that fall off with the distance are equal for two neighbours one contact away, so the mean is plain.
    """
    near = samples.select(*at, "lead", F.explode(F.array(F.col("number") - 1, F.col("number") + 1)).alias("number"), "value")
    mean = near.groupBy(*at, "lead", "number").agg(F.avg("value").alias("_near"))
    return samples.join(mean, [*at, "lead", "number"], "left").withColumn("value", F.col("value") - F.coalesce("_near", F.lit(0.0))).drop("_near")


def completed_contacts(contacts: DataFrame, fits: DataFrame, keys: list[str], max_rmse: float = 2.5, step: tuple[float, float] = (0.5, 15.0)) -> DataFrame:
    """``contacts`` with missing coordinates filled from their lead's linear fit (``stats.lead_fits``) and ``filled``.

    A lead's fit counts if its RMS error is at most ``max_rmse`` and its step between contacts lies in ``step``; only
    contacts at most one number outside the localised ones are filled, to 6 decimals.
    """
    length = F.sqrt(sum((F.col(f"slope_{x}") * F.col(f"slope_{x}") for x in ("mni_x", "mni_y", "mni_z")), F.lit(0.0)))
    good = fits.where((F.col("rmse") <= max_rmse) & length.between(*step)).drop("n", "rmse")
    joined = contacts.join(good, [*keys, "lead"], "left")
    missing = F.col("mni_x").isNull() | F.col("mni_y").isNull() | F.col("mni_z").isNull()
    near = missing & F.col("number").between(F.col("lowest") - 1, F.col("highest") + 1)
    out = joined.withColumn("filled", F.coalesce(near, F.lit(False)))
    return out.withColumns({x: F.when(F.col("filled"), F.round(F.col(f"intercept_{x}") + F.col(f"slope_{x}") * F.col("number"), 6)).otherwise(F.col(x)) for x in ("mni_x", "mni_y", "mni_z")}).select(*contacts.columns, "filled")


def with_label_match(rows: DataFrame, reference: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """``rows`` with ``value`` of the reference row of the same keys and label: letter for letter, else by ``label_key``.

    A key of several reference rows that disagree gives no value.
    """
    one = lambda df, on, name: df.groupBy(*keys, on.alias("_on")).agg(F.when(F.count_distinct(value) <= 1, F.min(value)).alias(name))
    exact, loose = one(reference, F.col(label), "_exact"), one(reference, label_key(F.col(label)), "_loose")
    first = rows.withColumn("_on", F.col(label)).join(exact, [*keys, "_on"], "left").drop("_on")
    return first.withColumn("_on", label_key(F.col(label))).join(loose, [*keys, "_on"], "left").withColumn(value, F.coalesce("_exact", "_loose")).drop("_on", "_exact", "_loose")


def label_key(label: Column) -> Column:
    """A channel label without amplifier prefix, reference, signs and leading zeros of its numbers, in upper case."""
    bare = F.regexp_replace(F.regexp_replace(label, r"^(?i)pol\s+", ""), r"(?i)[-/_ ]*ref$", "")
    return F.regexp_replace(F.regexp_replace(F.upper(bare), "[^A-Z0-9]", ""), "(^|[^0-9])0+([0-9])", "$1$2")
