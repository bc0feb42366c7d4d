"""Canonical responses of channels, post-artifact anchors, matched energy tests, and features of negative peaks.

Trials are rows of epoch, channel, offset and value (baseline-centred). What grows with the number of trials is aggregated;
arrays hold one window of samples, so their size is that of the window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrove.operators.in_order import with_running_sum
from pulsegrove.operators.windows import boxcar

EPS = 1e-12


def whole_trials(epoched: DataFrame, start: int, stop: int) -> DataFrame:
    """epoch, channel, offset, value within the window, of the trials that have a finite value at each of its samples."""
    inside = epoched.where(F.col("offset").between(start, stop) & F.col("value").isNotNull() & ~F.isnan("value")).select("epoch", "channel", "offset", "value")
    full = inside.groupBy("epoch", "channel").agg(F.count("*").alias("n")).where(F.col("n") == stop - start + 1).select("epoch", "channel")
    return inside.join(full, ["epoch", "channel"], "left_semi")


def projection_profile(trials: DataFrame, first: int) -> DataFrame:
    """channel, duration, n, profile: for each duration of at least ``first`` samples the mean over ordered pairs of trials of
    one trial's response projected on the other one's direction.

    Prefix sums along each trial: of squares, and of products with the sum of the other trials, which stands for all pairs.
    """
    sums = trials.groupBy("channel", "offset").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy("epoch", "channel").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("value")
    along = trials.join(sums, ["channel", "offset"]).select("channel", "n", F.count("*").over(w).alias("duration"), F.sum(v * v).over(w).alias("q"), F.sum(v * (F.col("s") - v)).over(w).alias("d"))
    part = F.col("d") / F.greatest(F.sqrt("q"), F.lit(EPS))
    return along.where((F.col("duration") >= first) & (F.col("n") > 1)).groupBy("channel", "duration").agg(F.max("n").alias("n"), (F.sum(part) / (F.max("n") * (F.max("n") - 1))).alias("profile"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def leading_vector(gram: pd.Series) -> pd.Series:
    """The unit vector of the greatest eigenvalue of a flattened symmetric matrix, its size that of the window."""

    def one(flat) -> list[float] | None:
        a = np.asarray(flat, float)
        n = int(round(len(a) ** 0.5))
        values, vectors = np.linalg.eigh(a.reshape(n, n))
        return vectors[:, -1].tolist() if values[-1] > EPS else None

    return gram.map(one)


def canonical_response(trials: DataFrame, first: int, start: int) -> DataFrame:
    """channel, n, duration, profile, canonical (array), alpha, explained (means over trials), residual_rms, t: the canonical response.

    ``trials`` begin at offset ``start``. The duration is that of the greatest profile (the shortest of equals). The
    canonical shape is the leading direction of the trials' samples, taken from their sums of products by pair of samples,
    and points along the mean. t compares the mean of all ordered pairs' projections with 0, for half as many independent
    values, as each pair counts once; its variance follows from the same sums, so no pair of trials is ever formed.
    """
    profile = projection_profile(trials, first)
    best = profile.groupBy("channel").agg(F.max_by(F.struct("duration", "profile", "n"), F.struct("profile", -F.col("duration"))).alias("b")).select("channel", "b.*")
    kept = trials.join(best.select("channel", "duration"), "channel").where(F.col("offset") < start + F.col("duration")).select("channel", "epoch", (F.col("offset") - start).alias("i"), F.col("value").alias("x"), "duration")
    packed = kept.groupBy("channel", "epoch", "duration").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("y"))
    cells = packed.select("channel", "duration", "y", F.posexplode("y").alias("i", "a")).select("channel", "duration", "i", "a", F.posexplode("y").alias("j", "b"))
    gram = cells.groupBy("channel", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("g")).groupBy("channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "g"))), lambda c: c["g"]).alias("gram"))
    means = kept.groupBy("channel", "i").agg(F.avg("x").alias("m")).groupBy("channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda c: c["m"]).alias("mean"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    shape = gram.withColumn("c", leading_vector("gram")).where("c is not null").join(means, "channel").join(best, "channel")
    shape = shape.withColumn("canonical", F.when(dot("c", "mean") < 0, F.transform("c", lambda x: -x)).otherwise(F.col("c"))).select("channel", "canonical", "gram", "n", "duration", "profile")
    fit = packed.drop("duration").join(shape, "channel").withColumns({"alpha": dot("y", "canonical"), "energy": dot("y", "y")})
    # sum over j of (x_i . x_j) squared is x_i' G x_i; with its own term taken off, by the length of x_i
    through = F.transform(F.sequence(F.lit(0), F.col("duration").cast("int") - 1), lambda i: F.aggregate(F.zip_with(F.slice("gram", i * F.col("duration").cast("int") + 1, F.col("duration").cast("int")), "y", lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z))
    fit = fit.withColumn("square", (dot("y", through) - F.col("energy") * F.col("energy")) / F.greatest("energy", F.lit(EPS)))
    residual = F.greatest(F.col("energy") - F.col("alpha") * F.col("alpha"), F.lit(0.0))
    out = fit.groupBy("channel", "n", "duration", "profile", "canonical").agg(
        F.avg(F.col("alpha") / F.sqrt("duration")).alias("alpha"), F.avg(1 - residual / F.greatest("energy", F.lit(EPS))).alias("explained"), F.avg(F.sqrt(residual / F.col("duration"))).alias("residual_rms"), F.sum("square").alias("_square")
    )
    pairs, m = F.col("n") * (F.col("n") - 1), F.col("n") * (F.col("n") - 1) / 2
    spread = F.sqrt(F.greatest(F.col("_square") / pairs - F.col("profile") * F.col("profile"), F.lit(0.0)) * m / (m - 1))
    return out.select("channel", "n", "duration", "profile", "canonical", "alpha", "explained", "residual_rms", F.when((m > 1) & (spread > 0), F.col("profile") / (spread / F.sqrt(m))).alias("t"))


def sliding_weights(epoched: DataFrame, shapes: DataFrame) -> DataFrame:
    """channel, start, n, weight: the mean over trials of each window's product with the channel's canonical shape, over the root of its length.

    ``shapes``: channel, canonical, duration. Windows with a missing sample do not count.
    """
    steps = shapes.select("channel", "duration", F.posexplode("canonical").alias("i", "c"))
    met = epoched.where("value is not null").join(steps, "channel").select("channel", "epoch", "duration", (F.col("offset") - F.col("i")).alias("start"), (F.col("value") * F.col("c")).alias("p"))
    whole = met.groupBy("channel", "epoch", "duration", "start").agg(F.count("*").alias("n"), (F.sum("p") / F.sqrt("duration")).alias("w")).where("n = duration")
    return whole.groupBy("channel", "start").agg(F.count("*").alias("n"), F.avg("w").alias("weight"))


def post_artifact_anchors(envelope: DataFrame, base: tuple[int, int], search: tuple[int, int], least: int, half: int = 1, settle: float = 2.0, slope: float = 2.0, run: int = 2) -> DataFrame:
    """epoch, peak_at, peak_z, anchor, method: where each trial's artifact (epoch, offset, envelope) has settled.

    The envelope is smoothed and put in robust deviations of its baseline; the peak is the greatest in ``search``. The anchor
    is the first offset past it, from ``least`` on, from which ``run`` samples in a row are low and flat (settled); else the
    first low one (amplitude); else the quietest (quietest); else the sample after the peak (neighbour). Groups are trials.
    """
    trial = Window.partitionBy("epoch").orderBy("offset")
    smooth = boxcar(envelope, ["epoch"], "offset", "envelope", half, "_e")
    prior = smooth.where(F.col("offset").between(*base))
    middle = prior.groupBy("epoch").agg(F.median("_e").alias("_m"), F.stddev_pop("_e").alias("_sd"))
    spread = prior.join(middle, "epoch").groupBy("epoch").agg(F.median(F.abs(F.col("_e") - F.col("_m"))).alias("_d"))
    mad = F.col("_d") * 1.4826
    scale = F.when(mad > 1e-12, mad).when(F.col("_sd") > 1e-12, F.col("_sd")).otherwise(1.0)
    before, after = F.lag("_e").over(trial), F.lead("_e").over(trial)
    step = F.when(before.isNull(), after - F.col("_e")).when(after.isNull(), F.col("_e") - before).otherwise((after - before) / 2)
    scored = smooth.withColumn("_step", step).join(middle, "epoch").join(spread, "epoch").select("epoch", "offset", ((F.col("_e") - F.col("_m")) / scale).alias("z"), (F.abs("_step") / scale).alias("flat"))
    peaks = scored.where(F.col("offset").between(*search)).groupBy("epoch").agg(F.max_by(F.struct("offset", "z"), F.struct("z", -F.col("offset"))).alias("p"))
    past = scored.join(peaks, "epoch").where((F.col("offset") >= F.greatest(F.lit(least), F.col("p.offset") + 1)) & (F.col("offset") <= search[1]))
    low = F.col("z") <= settle
    ahead = Window.partitionBy("epoch").orderBy("offset").rowsBetween(0, run - 1)
    marked = past.withColumn("_ok", F.sum((low & (F.col("flat") <= slope)).cast("int")).over(ahead))
    found = marked.groupBy("epoch").agg(F.min(F.when(F.col("_ok") == run, F.col("offset"))).alias("a"), F.min(F.when(low, F.col("offset"))).alias("b"), F.min_by("offset", F.struct("z", "offset")).alias("c"))
    out = peaks.join(found, "epoch", "left")
    method = F.when(F.col("a").isNotNull(), "settled").when(F.col("b").isNotNull(), "amplitude").when(F.col("c").isNotNull(), "quietest").otherwise("neighbour")
    return out.select("epoch", F.col("p.offset").alias("peak_at"), F.col("p.z").alias("peak_z"), F.coalesce("a", "b", "c", F.col("p.offset") + 1).alias("anchor"), method.alias("method"))


def zeroed_after(epoched: DataFrame, anchors: DataFrame, window: int) -> DataFrame:
    """``epoched`` less each trial and channel's mean over ``window`` samples from the anchor that all trials share, the rounded
    mean of theirs."""
    common = anchors.agg(F.bround(F.avg("anchor")).cast("int").alias("a")).scalar()
    inside = F.when((F.col("offset") >= common) & (F.col("offset") < common + window), F.col("value"))
    return epoched.withColumn("value", F.col("value") - F.coalesce(F.avg(inside).over(Window.partitionBy("epoch", "channel")), F.lit(0.0)))


def matched_rms(epoched: DataFrame, base_stop: int, reply: tuple[int, int], least: int = 3) -> DataFrame:
    """channel, n, median-free summary of paired RMS: mean_reply, mean_base, mean_change, w, z of the one-sided signed-rank test.

    Each trial's response is set against as many samples at the end of its baseline (up to ``base_stop``), each about its own
    mean. Changes of 0 do not count; equal sizes share their mean rank. Ranks come from running counts over distinct sizes,
    so no channel's trials are sorted as a whole; z is the normal limit with ties corrected.
    """
    size = reply[1] - reply[0] + 1
    inside = lambda lo, hi: F.when(F.col("offset").between(lo, hi), F.col("value"))
    replies, bases = inside(*reply), inside(base_stop - size + 1, base_stop)
    trials = epoched.groupBy("epoch", "channel").agg(F.count(replies).alias("_a"), F.count(bases).alias("_b"), F.sqrt(F.var_pop(replies)).alias("reply"), F.sqrt(F.var_pop(bases)).alias("base")).where((F.col("_a") == size) & (F.col("_b") == size))
    changes = trials.withColumn("d", F.col("reply") - F.col("base"))
    plain = changes.groupBy("channel").agg(F.count("*").alias("n"), F.avg("reply").alias("mean_reply"), F.avg("base").alias("mean_base"), F.avg("d").alias("mean_change")).where(F.col("n") >= least)
    sizes = changes.where("d <> 0").groupBy("channel", F.abs("d").alias("s")).agg(F.count("*").alias("c"), F.sum((F.col("d") > 0).cast("long")).alias("up"))
    ranked = with_running_sum(sizes, "channel", F.floor(F.log1p("s") * 64), ["s"], F.col("c"), "upto")
    rank = F.col("upto") - (F.col("c") - 1) / 2
    ties = F.sum(F.pow(F.col("c").cast("double"), F.lit(3)) - F.col("c"))
    tested = ranked.groupBy("channel").agg(F.sum(F.col("up") * rank).alias("w"), F.sum("c").cast("double").alias("m"), ties.alias("ties"))
    m = F.col("m")
    z = (F.col("w") - m * (m + 1) / 4) / F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48)
    return plain.join(tested, "channel", "left").select("channel", "n", "mean_reply", "mean_base", "mean_change", "w", z.alias("z"))


def negative_peaks(waveform: DataFrame, base: tuple[int, int], reply: tuple[int, int]) -> DataFrame:
    """channel, noise, peak, latency, peak_z, prominence, area_fraction, preceding_positive_z, rms_z of mean responses (channel, offset, mean).

    The peak is the strongest interior local minimum below 0 in the window (the first of equals), null if there is none; its
    prominence is how far it lies below the higher of the two saddles towards deeper values or the window's ends.
    """
    noise = waveform.where(F.col("offset").between(*base)).groupBy("channel").agg(F.stddev_samp("mean").alias("noise")).where("noise > 0")
    inside = waveform.where(F.col("offset").between(*reply)).select("channel", "offset", F.col("mean").alias("y"))
    w = Window.partitionBy("channel").orderBy("offset")
    dips = inside.withColumns({"_l": F.lag("y").over(w), "_r": F.lead("y").over(w)}).where("y < 0 and y < _l and y < _r")
    peak = dips.groupBy("channel").agg(F.min_by(F.struct("offset", "y"), F.struct("y", "offset")).alias("p"))
    sums = inside.groupBy("channel").agg(F.sum(F.greatest(-F.col("y"), F.lit(0.0))).alias("_neg"), F.sum(F.abs("y")).alias("_all"), F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("_rms"))
    around = inside.join(peak, "channel")
    deeper = around.groupBy("channel").agg(F.max(F.when((F.col("offset") < F.col("p.offset")) & (F.col("y") < F.col("p.y")), F.col("offset"))).alias("_lo"), F.min(F.when((F.col("offset") > F.col("p.offset")) & (F.col("y") < F.col("p.y")), F.col("offset"))).alias("_hi"))
    left = F.max(F.when((F.col("offset") < F.col("p.offset")) & (F.col("offset") > F.coalesce("_lo", F.lit(reply[0] - 1))), F.col("y")))
    right = F.max(F.when((F.col("offset") > F.col("p.offset")) & (F.col("offset") < F.coalesce("_hi", F.lit(reply[1] + 1))), F.col("y")))
    before = F.max(F.when(F.col("offset") < F.col("p.offset"), F.col("y")))
    shape = around.join(deeper, "channel").groupBy("channel", "p").agg(left.alias("_left"), right.alias("_right"), before.alias("_before"))
    out = noise.join(sums, "channel").join(shape, "channel", "left")
    return out.select(
        "channel", "noise", F.col("p.y").alias("peak"), F.col("p.offset").alias("latency"), (-F.col("p.y") / F.col("noise")).alias("peak_z"), (F.least("_left", "_right") - F.col("p.y")).alias("prominence"),
        F.when(F.col("_all") > 0, F.col("_neg") / F.col("_all")).otherwise(0.0).alias("area_fraction"), (F.greatest(F.col("_before"), F.lit(0.0)) / F.col("noise")).alias("preceding_positive_z"), (F.col("_rms") / F.col("noise")).alias("rms_z"),
    )


def gated_family(features: DataFrame, p: str, factor: float = 3.4, floor: float = 50.0) -> DataFrame:
    """``features`` with gate (the peak's size reaches ``factor`` times the greater of noise and ``floor``) and screened p: p where
    the gate holds, 1 where it does not, null where there is no p."""
    gate = F.coalesce(-F.col("peak") >= factor * F.greatest(F.col("noise"), F.lit(floor)), F.lit(False))
    return features.withColumn("gate", gate).withColumn("screened", F.when(F.col(p).isNotNull(), F.when(F.col("gate"), F.col(p)).otherwise(1.0)))
