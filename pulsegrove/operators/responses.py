"""Which channels respond: energy and reproducibility of single trials, combined, and adjusted over the family.

Trials are rows of epoch, channel, offset and value (baseline-centred). Every statistic is an aggregate; the tests are
``stats.sign_flips``, exact for few trials.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrove.operators.stats import sign_flips
from pulsegrove.operators.windows import adjusted_p
from pulsegrove.session import cut

EPS = 1e-12


def energy_changes(epoched: DataFrame, base: tuple[int, int], reply: tuple[int, int]) -> DataFrame:
    """epoch, channel, change: log RMS of the response less that of the baseline, each about its own mean."""
    inside = lambda span: F.when(F.col("offset").between(*span), F.col("value"))
    rms = lambda span: F.sqrt(F.var_pop(inside(span)))
    out = epoched.groupBy("epoch", "channel").agg(rms(reply).alias("r"), rms(base).alias("b"))
    return out.select("epoch", "channel", (F.log(F.col("r") + EPS) - F.log(F.col("b") + EPS)).alias("change"))


def cross_projections(epoched: DataFrame, reply: tuple[int, int]) -> DataFrame:
    """epoch, channel, projection: each trial's response, scaled to length 1, projected on the mean of the channel's other trials.

    The sum of all trials at each offset stands for the pairs: a trial's products with all others are its product with
    that sum less itself.
    """
    inside = epoched.where(F.col("offset").between(*reply) & F.col("value").isNotNull())
    sums = inside.groupBy("channel", "offset").agg(F.sum("value").alias("s"), F.count("*").alias("m"))
    joined = inside.join(sums, ["channel", "offset"]).where("m > 1")
    dot = F.sum(F.col("value") * (F.col("s") - F.col("value")) / (F.col("m") - 1))
    length = F.sqrt(F.sum(F.col("value") * F.col("value")))
    return joined.groupBy("epoch", "channel").agg(F.when(length > 0, dot / length).otherwise(0.0).alias("projection"))


def calls(epoched: DataFrame, base: tuple[int, int], reply: tuple[int, int], level: float = 0.05, least: int = 8) -> DataFrame:
    """channel, n, p_energy, p_reproducible, p_joint (the greater), q over all evaluable channels, and a class.

    Classes: insufficient_data, reproducible_energetic, reproducible_low_energy, energetic_inconsistent, no_response.
    """
    epoched = cut(epoched)  # read by both tests
    energy = sign_flips(energy_changes(epoched, base, reply), ["channel"], "change", "epoch").select("channel", "n", F.col("mean").alias("energy"), F.col("p").alias("p_energy"))
    steady = sign_flips(cross_projections(epoched, reply), ["channel"], "projection", "epoch").select("channel", F.col("mean").alias("projection"), F.col("p").alias("p_reproducible"))
    both = energy.join(steady, "channel", "left")
    # one-sided: more energy, and trials alike
    one = lambda p, x: F.when(F.col(x) > 0, F.col(p) / 2).otherwise(1 - F.col(p) / 2)
    both = both.withColumns({"p_energy": one("p_energy", "energy"), "p_reproducible": one("p_reproducible", "projection")})
    both = both.withColumn("p_joint", F.when((F.col("n") >= least) & F.col("p_reproducible").isNotNull(), F.greatest("p_energy", "p_reproducible"))).withColumn("family", F.lit(1))
    out = adjusted_p(both, ["family"], "p_joint", "q").drop("family")
    e, r = F.col("p_energy") <= level, F.col("p_reproducible") <= level
    kind = F.when(F.col("p_joint").isNull(), "insufficient_data").when(e & r, "reproducible_energetic").when(r, "reproducible_low_energy").when(e, "energetic_inconsistent").otherwise("no_response")
    return out.withColumn("class", kind).withColumn("significant", F.coalesce(F.col("q") <= level, F.lit(False)))


def over_windows(tested: DataFrame, unit: list[str], windows: int, p: str) -> DataFrame:
    """unit, p_any: the smallest p over a fixed bank of ``windows``, times their number, at most 1; a missing window counts as 1."""
    return tested.groupBy(*unit).agg(F.least(F.lit(1.0), windows * F.coalesce(F.min(p), F.lit(1.0))).alias("p_any"))


def early_late_z(waveform: DataFrame, base: tuple[int, int], early: tuple[int, int], late: tuple[int, int], level: float = 6.0) -> DataFrame:
    """channel, early_z, late_z, reversal, significant: the largest deviations of the mean response (channel, offset, mean)
    from its baseline mean, in baseline deviations; significant if either reaches ``level`` and the response changes sign."""
    prior = F.col("offset").between(*base)
    stats = waveform.groupBy("channel").agg(F.avg(F.when(prior, F.col("mean"))).alias("_m"), (F.stddev_samp(F.when(prior, F.col("mean"))) + EPS).alias("_s"))
    z = waveform.join(stats, "channel").withColumn("z", (F.col("mean") - F.col("_m")) / F.col("_s"))
    inside = lambda span: F.max(F.when(F.col("offset").between(*span), F.abs("z")))
    both = F.when(F.col("offset").between(early[0], late[1]), F.col("z"))
    out = z.groupBy("channel").agg(inside(early).alias("early_z"), inside(late).alias("late_z"), F.coalesce((F.min(both) <= -1) & (F.max(both) >= 1), F.lit(False)).alias("reversal"))
    return out.withColumn("significant", F.coalesce((F.greatest("early_z", "late_z") >= level) & F.col("reversal"), F.lit(False)))


def zero_artifacts(envelope: DataFrame, base: tuple[int, int], level: float = 6.0) -> DataFrame:
    """epoch, z, artifact: the envelope (epoch, offset, envelope) at offset 0 in robust deviations of its baseline."""
    prior = envelope.where(F.col("offset").between(*base))
    middle = prior.groupBy("epoch").agg(F.median("envelope").alias("_m"))
    spread = prior.join(middle, "epoch").groupBy("epoch").agg(F.median(F.abs(F.col("envelope") - F.col("_m"))).alias("_d"))
    at = envelope.where("offset = 0").join(middle, "epoch").join(spread, "epoch")
    z = (F.col("envelope") - F.col("_m")) / F.when(F.col("_d") > 1e-9, F.col("_d") * 1.4826).otherwise(1.0)
    return at.select("epoch", z.alias("z"), (z >= level).alias("artifact"))
