"""Problem 4: a consensus of annotators who disagree, without knowing the right labels.

Triplet moment method. If raters err independently, the chance-corrected agreement of two raters is the product of their
chance-corrected accuracies, so for three raters k_ij * k_ik / k_jk = r_i squared; each rater's moment sums numerator
and denominator over all triplets it takes part in, and two least-squares passes over its pairs refine it. Votes are then combined with log-odds weights of those accuracies,
and a rater's reliability is its chance-corrected agreement with the consensus of the others.

Rates come from all pairs of raters on one record. The raters of a record are cut into blocks of about ``BLOCK_LABELS``
by hash, and every block meets every block of its record in a group of its own, so that no group grows with the record
and no pair is left out; a record with that many labels or fewer is one group.
Triplets are found along edges directed from fewer to more partners, so a rater who shares records with all others does
not multiply.

Defined results: -1, null, NaN and unknown labels are none; of several labels of a rater on a record the latest counts
(then the greater annotation_id); a record with one label has that label and no agreement measure; ties go to the
smaller label; a rater none of whose partners is in a triplet has no accuracy and the weight of accuracy 0.5; a rater none of whose records has another label has no reliability; empty
tables give empty tables; extra columns are not carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrove.session import cut

LABELS = (0, 1, 2)
#: Labels of a record that one group compares; a record with more is compared in several groups.
BLOCK_LABELS = 48
RELIABLE = 0.4
#: Least-squares passes over the pairs after the triplets.
REFINEMENTS = 2


def latest_labels(annotations: DataFrame) -> DataFrame:
    """record_id, rater, label: one valid label per rater and record."""
    valid = annotations.where(F.col("raw_annotation").isin([float(x) for x in LABELS]) & F.col("rater").isNotNull() & F.col("record_id").isNotNull())
    last = F.max(F.struct(F.coalesce("annotated_at", F.lit("1900-01-01").cast("timestamp")).alias("at"), "annotation_id", F.col("raw_annotation").cast("int").alias("label")))
    return valid.groupBy("record_id", "rater").agg(last.alias("x")).select("record_id", "rater", F.col("x.label").alias("label"))


def kappa(n: Column, agree: Column, chance: Column) -> Column:
    """Agreement corrected for chance; 0 where chance alone explains everything."""
    po, pe = agree / n, chance / (n * n)
    return F.when(pe < 1 - 1e-9, (po - pe) / (1 - pe)).otherwise(F.lit(0.0))


def pair_agreement(labels: DataFrame, block_labels: int = BLOCK_LABELS) -> DataFrame:
    """a, b, n, k: raters (a before b) with their number of shared records and chance-corrected agreement."""
    sizes = labels.groupBy("record_id").agg(F.count("*").alias("size")).where(F.col("size") > 1).select("record_id", F.ceil(F.col("size") / block_labels).cast("int").alias("blocks"))
    spread = labels.join(sizes, "record_id").withColumn("own", F.pmod(F.xxhash64("record_id", "rater"), F.col("blocks")).cast("int"))
    # a label goes to the groups (i, j), i <= j, of its block with each block of the record
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    spread = spread.select("record_id", F.explode(others).alias("g"), F.struct("rater", "label", "own").alias("x"))
    sets = spread.groupBy("record_id", "g").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    later = lambda i: F.slice("xs", i + 2, F.greatest(F.size("xs") - i - 1, F.lit(0)))
    pairs = sets.select("g", F.explode(F.flatten(F.transform("xs", lambda x, i: F.transform(later(i), lambda y: F.struct(x.alias("p"), y.alias("q")))))).alias("pq"))
    # two raters of one block meet in that block's own group only
    pairs = pairs.where((F.col("g.i") == F.col("g.j")) | (F.col("pq.p.own") != F.col("pq.q.own")))
    pairs = pairs.select(F.col("pq.p.rater").alias("a"), F.col("pq.q.rater").alias("b"), F.col("pq.p.label").alias("la"), F.col("pq.q.label").alias("lb"))
    is_ = lambda c, v: F.sum((F.col(c) == v).cast("long"))
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum((F.col("la") == F.col("lb")).cast("long")).alias("agree"), *(is_(c, v).alias(f"{c}{v}") for c in ("la", "lb") for v in LABELS))
    chance = sum((F.col(f"la{v}") * F.col(f"lb{v}") for v in LABELS), F.lit(0))
    return counts.select("a", "b", "n", kappa(F.col("n"), F.col("agree"), chance).alias("k"))


def triplet_accuracies(pairs: DataFrame, refinements: int = REFINEMENTS) -> DataFrame:
    """rater, accuracy: chance-corrected, between -1 and 1."""
    both = pairs.select(F.col("a").alias("i"), F.col("b").alias("j"), "n", "k").unionByName(pairs.select(F.col("b").alias("i"), F.col("a").alias("j"), "n", "k"))
    degree = both.groupBy("i").agg(F.count("*").alias("d"))
    ranked = pairs.join(degree.select(F.col("i").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("i").alias("b"), F.col("d").alias("db")), "b")
    forth = F.struct("da", "a") < F.struct("db", "b")
    edges = ranked.select(F.when(forth, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(forth, F.col("b")).otherwise(F.col("a")).alias("v"), "n", "k")
    first = edges.select("u", F.col("v").alias("x"), F.col("n").alias("n1"), F.col("k").alias("k1"))
    second = edges.select("u", F.col("v").alias("y"), F.col("n").alias("n2"), F.col("k").alias("k2"))
    closing = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("n").alias("n3"), F.col("k").alias("k3"))
    triangles = first.join(second, "u").where(F.col("x") < F.col("y")).join(closing, ["x", "y"])
    weight, product = F.least("n1", "n2", "n3").cast("double"), F.col("k1") * F.col("k2") * F.col("k3")
    moment = lambda who, opposite: F.struct(F.col(who).alias("rater"), (weight * product).alias("num"), (weight * F.col(opposite) * F.col(opposite)).alias("den"))
    moments = triangles.select(F.explode(F.array(moment("u", "k3"), moment("x", "k2"), moment("y", "k1"))).alias("m")).groupBy("m.rater").agg(F.sum("m.num").alias("num"), F.sum("m.den").alias("den"))
    size = moments.where(F.col("den") > 0).select(F.col("rater").alias("j"), F.sqrt(F.greatest(F.col("num") / F.col("den"), F.lit(0.0))).alias("r"))
    # raters who copy each other pull down the moments of all who meet both; weighing each pair by the partner's own
    # accuracy takes that back, gives the sign, and reaches raters without a triplet
    for _ in range(refinements):
        fitted = both.join(size, "j").groupBy(F.col("i").alias("j")).agg(F.sum(F.col("n") * F.col("k") * F.col("r")).alias("up"), F.sum(F.col("n") * F.col("r") * F.col("r")).alias("down"))
        fit = F.col("up") / F.col("down")
        # where all partners are too low by a factor, the fit is too high by it: their geometric mean is right
        damped = F.signum(fit) * F.sqrt(F.abs(fit) * F.coalesce(F.abs("r"), F.abs(fit)))
        size = fitted.where(F.col("down") > 0).join(size, "j", "left").select("j", F.greatest(F.least(damped, F.lit(1.0)), F.lit(-1.0)).alias("r"))
    return size.select(F.col("j").alias("rater"), F.col("r").alias("accuracy"))


def log_odds(accuracy: Column) -> Column:
    """The weight of a vote: log-odds of being right against any one other label; none for a rater at or below chance."""
    share = 1.0 / len(LABELS)
    right = F.least(accuracy, F.lit(0.98)) * (1 - share) + share
    return F.when(accuracy > 0, F.log(right * (len(LABELS) - 1) / (1 - right))).otherwise(0.0)


def weigh(labels: DataFrame, accuracies: DataFrame) -> DataFrame:
    """``labels`` with the weight w of each vote."""
    weights = accuracies.select("rater", log_odds(F.col("accuracy")).alias("w"))
    return labels.join(weights, "rater", "left").select("record_id", "rater", "label", F.coalesce("w", log_odds(F.lit(0.5))).alias("w"))


def votes(weighed: DataFrame) -> DataFrame:
    """record_id, n, n0.., s0..: number and weight of the votes for each label."""
    counts = [F.sum((F.col("label") == v).cast("long")).alias(f"n{v}") for v in LABELS]
    return weighed.groupBy("record_id").agg(F.count("*").alias("n"), *counts, *(F.sum(F.when(F.col("label") == v, F.col("w")).otherwise(0.0)).alias(f"s{v}") for v in LABELS))


def winner(scores: list[Column], counts: list[Column]) -> Column:
    """The label of the greatest weight, then of the most votes, then the smallest."""
    return -F.greatest(*(F.struct(F.round(s, 9).alias("s"), c.alias("c"), F.lit(-v).alias("v")) for v, s, c in zip(LABELS, scores, counts)))["v"]


def consensus(weighed: DataFrame) -> DataFrame:
    """record_id, label, n_raters, confidence (posterior of the label), agreement (share of agreeing pairs of raters)."""
    tally = votes(weighed)
    s = [F.col(f"s{v}") for v in LABELS]
    total = sum((F.exp(x - F.greatest(*s)) for x in s), F.lit(0.0))
    pairs = sum((F.col(f"n{v}") * (F.col(f"n{v}") - 1) for v in LABELS), F.lit(0))
    return tally.select("record_id", winner(s, [F.col(f"n{v}") for v in LABELS]).alias("label"), F.col("n").alias("n_raters"), (1 / total).alias("confidence"), F.when(F.col("n") > 1, pairs / (F.col("n") * (F.col("n") - 1))).alias("agreement"))


def reliabilities(weighed: DataFrame) -> DataFrame:
    """rater, n_labels, n_compared, reliability: chance-corrected agreement with the consensus of the others."""
    others = weighed.join(votes(weighed), "record_id")
    left = [F.col(f"s{v}") - F.when(F.col("label") == v, F.col("w")).otherwise(0.0) for v in LABELS]
    counts = [F.col(f"n{v}") - (F.col("label") == v).cast("long") for v in LABELS]
    judged = others.select("rater", "label", F.when(F.col("n") > 1, winner(left, counts)).alias("right"))
    is_ = lambda c, v: F.sum((F.col("right").isNotNull() & (F.col(c) == v)).cast("long")).alias(f"{c}{v}")
    sums = judged.groupBy("rater").agg(F.count("*").alias("n_labels"), F.count("right").alias("n"), F.sum((F.col("label") == F.col("right")).cast("long")).alias("agree"), *(is_(c, v) for c in ("label", "right") for v in LABELS))
    chance = sum((F.col(f"label{v}") * F.col(f"right{v}") for v in LABELS), F.lit(0))
    return sums.select("rater", "n_labels", F.col("n").alias("n_compared"), F.when(F.col("n") > 0, kappa(F.col("n"), F.col("agree"), chance)).alias("reliability"))


def prepare(annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The weighed labels and the accuracies, both stored, as several results read them."""
    labels = cut(latest_labels(annotations))
    accuracies = cut(triplet_accuracies(cut(pair_agreement(labels))))
    return weigh(labels, accuracies), accuracies


def rater_report(annotations: DataFrame, reported: DataFrame) -> DataFrame:
    """rater, n_labels, n_compared, accuracy, reliability, reported_kappa (mean of the older report, by its records)."""
    weighed, accuracies = prepare(annotations)
    sides = [reported.select(F.col(c).alias("rater"), "available", "kappa") for c in ("rater_a", "rater_b")]
    usable = sides[0].unionByName(sides[1]).where(F.col("kappa").isNotNull() & ~F.isnan("kappa") & (F.col("available") > 0))
    older = usable.groupBy("rater").agg((F.sum(F.col("kappa") * F.col("available")) / F.sum("available")).alias("reported_kappa"))
    out = reliabilities(weighed).join(accuracies, "rater", "left").join(older, "rater", "left")
    return out.select("rater", "n_labels", "n_compared", "accuracy", "reliability", "reported_kappa")


def unreliable(annotations: DataFrame) -> DataFrame:
    """The raters whose reliability is under ``RELIABLE``."""
    weighed, _ = prepare(annotations)
    return reliabilities(weighed).where(F.col("reliability") < RELIABLE).select("rater")
