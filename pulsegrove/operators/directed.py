"""Directed, weighted edges: collapse, reciprocity, strengths, adjacency, ranks and how targets share over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrove.operators.epoching import asof
from pulsegrove.operators.in_order import with_previous
from pulsegrove.operators.montage import label_key
from pulsegrove.operators.windows import medians, value_counts
from pulsegrove.session import cut


def collapse(edges: DataFrame, keys: list[str]) -> DataFrame:
    """One row per source and target (and keys): mean, median and total weight, and the number of edges."""
    by = [*keys, "source", "target"]
    # the median comes from counts by weight
    counts = value_counts(edges, by, "weight")
    sums = edges.groupBy(*by).agg(F.avg("weight").alias("mean_weight"), F.sum("weight").alias("weight"), F.count("*").alias("n_edges"))
    return sums.join(medians(counts, by, "median_weight"), by, "left").select(*by, "mean_weight", "median_weight", "weight", "n_edges")


def both_ways(edges: DataFrame, keys: list[str], floor: float = 0.0) -> DataFrame:
    """Pairs with weight over ``floor`` in both directions, smaller node first: both weights, mean, log2 ratio and the stronger way."""
    one = edges.where(F.col("weight") > floor).select(*keys, "source", "target", "weight")
    back = one.select(*keys, F.col("target").alias("source"), F.col("source").alias("target"), F.col("weight").alias("back"))
    pairs = one.where("source < target").join(back, [*keys, "source", "target"])
    stronger = F.when(F.col("weight") >= F.col("back"), F.concat("source", F.lit("->"), "target")).otherwise(F.concat("target", F.lit("->"), "source"))
    return pairs.select(*keys, "source", "target", F.col("weight").alias("forth"), "back", ((F.col("weight") + F.col("back")) / 2).alias("mean"), F.log2(F.col("weight") / F.col("back")).alias("asymmetry"), stronger.alias("dominant"))


def reciprocity(tested: DataFrame, keys: list[str]) -> DataFrame:
    """Per key over pairs tested in both directions (source, target, responds): tested, any, both, reciprocity (both / any, null if none)."""
    one = tested.groupBy(*keys, "source", "target").agg(F.bool_or("responds").alias("forth"))
    back = one.select(*keys, F.col("target").alias("source"), F.col("source").alias("target"), F.col("forth").alias("back"))
    pairs = one.where("source < target").join(back, [*keys, "source", "target"])
    any_, both = F.sum((F.col("forth") | F.col("back")).cast("long")), F.sum((F.col("forth") & F.col("back")).cast("long"))
    return pairs.groupBy(*keys).agg(F.count("*").alias("tested"), any_.alias("any_response"), both.alias("both_respond"), F.when(any_ > 0, both / any_).alias("reciprocity"))


def strengths(edges: DataFrame) -> DataFrame:
    """Per node: degrees, strengths, shares of all weight, and (out - in) / (out + in)."""
    out = edges.groupBy(F.col("source").alias("node")).agg(F.count_distinct("target").alias("out_degree"), F.sum("weight").alias("out_strength"))
    in_ = edges.groupBy(F.col("target").alias("node")).agg(F.count_distinct("source").alias("in_degree"), F.sum("weight").alias("in_strength"))
    zero = {"out_degree": 0, "out_strength": 0.0, "in_degree": 0, "in_strength": 0.0}
    nodes = out.join(in_, "node", "full").na.fill(zero)
    total = edges.agg(F.sum("weight").alias("_all")).scalar()
    both = F.col("out_strength") + F.col("in_strength")
    return nodes.select(
        "node", *zero, both.alias("strength"), (F.col("out_strength") / total).alias("out_share"), (F.col("in_strength") / total).alias("in_share"),
        F.when(both > 0, (F.col("out_strength") - F.col("in_strength")) / both).alias("sender_receiver"),
    )


def strongest(edges: DataFrame, n: int) -> DataFrame:
    """The ``n`` strongest edges of each source; equals by target."""
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.col("weight").desc(), "target"))).where(F.col("rank") <= n)


def adjacency(edges: DataFrame, nodes: list[str]) -> DataFrame:
    """One row per source and one column per node of the given short list: mean weights, 0 where there is no edge."""
    return edges.groupBy("source").pivot("target", nodes).agg(F.avg("weight")).na.fill(0.0)


def adjacency_cells(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """source, target, weight: ``adjacency`` in long form over all of ``nodes``, a fixed table of column node."""
    pairs = edges.select("source").distinct().crossJoin(F.broadcast(nodes.select(F.col("node").alias("target"))))
    return pairs.join(edges.groupBy("source", "target").agg(F.avg("weight").alias("weight")), ["source", "target"], "left").na.fill(0.0, ["weight"])


def page_rank(edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """node, rank by ``rounds`` of weighted PageRank; nodes without outgoing weight hand theirs to all.

    Every round is a join on the source and a sum by target. Lineage is cut every fifth round, or every round if there
    are nodes without outgoing weight, whose sum would otherwise repeat the rounds before.
    """
    weights = edges.groupBy("source", "target").agg(F.sum("weight").alias("weight")).where("weight > 0")
    totals = weights.groupBy("source").agg(F.sum("weight").alias("total"))
    moves = cut(weights.join(totals, "source").select("source", "target", (F.col("weight") / F.col("total")).alias("share")))
    nodes = cut(edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct().join(totals.select(F.col("source").alias("node"), F.lit(False).alias("dangling")), "node", "left").na.fill({"dangling": True}))
    n, loose_ends = nodes.count(), nodes.where("dangling").count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    ranks = nodes.select("node", "dangling", F.lit(1.0 / n).alias("rank"))
    for round_ in range(1, rounds + 1):
        loose = ranks.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose")).scalar() if loose_ends else F.lit(0.0)
        given = moves.join(ranks.select(F.col("node").alias("source"), "rank"), "source").groupBy(F.col("target").alias("node")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        ranks = nodes.join(given, "node", "left").select("node", "dangling", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + loose / n)).alias("rank"))
        if loose_ends or round_ % 5 == 0:
            ranks = cut(ranks)
    return ranks.select("node", "rank")


def target_shares(edges: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Per key and time: total weight, active targets, participation among the key's targets, normalised entropy, effective number."""
    by_target = edges.groupBy(*keys, time, "target").agg(F.sum("weight").alias("w"))
    known = edges.groupBy(*keys).agg(F.count_distinct("target").alias("_targets"))
    total = by_target.groupBy(*keys, time).agg(F.sum("w").alias("_total"))
    p = F.col("w") / F.col("_total")
    entropy = -F.sum(F.when(F.col("w") > 0, p * F.log(p)).otherwise(0.0))
    joined = by_target.join(total, [*keys, time]).where("_total > 0").groupBy(*keys, time).agg(F.first("_total").alias("total"), F.sum((F.col("w") > 0).cast("long")).alias("active"), entropy.alias("_h"))
    return joined.join(known, keys).select(
        *keys, time, "total", "active", (F.col("active") / F.col("_targets")).alias("participation"), F.when(F.col("_targets") > 1, F.col("_h") / F.log(F.col("_targets"))).otherwise(0.0).alias("entropy"), F.exp("_h").alias("effective_targets")
    )


def hubs_authorities(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """node, hub, authority (each summing to 1) by ``rounds`` of mutual reinforcement over weighted edges.

    Weights are relative to the greatest one, and scores are scaled every fourth round, where lineage is cut.
    """
    summed = cut(edges.groupBy("source", "target").agg(F.sum("weight").alias("weight")).where("weight > 0"))
    weights = summed.withColumn("weight", F.col("weight") / summed.agg(F.max("weight")).scalar())

    def authorities_of(hubs: DataFrame) -> DataFrame:
        return weights.join(hubs, "source").groupBy("target").agg(F.sum(F.col("weight") * F.col("h")).alias("a"))

    def scaled(scores: DataFrame, node: str, score: str) -> DataFrame:
        stored = cut(scores)
        return stored.select(node, (F.col(score) / stored.agg(F.sum(score)).scalar()).alias(score))

    hubs = summed.select("source").distinct().withColumn("h", F.lit(1.0))
    for round_ in range(1, rounds + 1):
        hubs = weights.join(authorities_of(hubs), "target").groupBy("source").agg(F.sum(F.col("weight") * F.col("a")).alias("h"))
        if round_ % 4 == 0 or round_ == rounds:
            hubs = scaled(hubs, "source", "h")
    authorities = scaled(authorities_of(hubs), "target", "a").select(F.col("target").alias("node"), F.col("a").alias("authority"))
    return hubs.select(F.col("source").alias("node"), F.col("h").alias("hub")).join(authorities, "node", "full").na.fill(0.0)


def canonical_edges(edges: DataFrame, undirected: str, paired: list[str]) -> DataFrame:
    """``edges`` with the ends of undirected rows in order (whatever their case), and their ``paired`` columns
    (source_x and target_x) swapped along; directed rows stay."""
    swap = F.col(undirected) & (F.lower("source") > F.lower("target"))
    names = [("source", "target"), *((f"source_{p}", f"target_{p}") for p in paired)]
    return edges.withColumns({k: v for a, b in names for k, v in ((a, F.when(swap, F.col(b)).otherwise(F.col(a))), (b, F.when(swap, F.col(a)).otherwise(F.col(b))))})


def same_region(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """``edges`` with ``same_region``: both ends in one region of ``regions`` (node, region), or neither known."""
    place = regions.groupBy("node").agg(F.min("region").alias("region"))
    a, b = place.select(F.col("node").alias("source"), F.col("region").alias("_a"), F.lit(True).alias("_ka")), place.select(F.col("node").alias("target"), F.col("region").alias("_b"), F.lit(True).alias("_kb"))
    joined = edges.join(a, "source", "left").join(b, "target", "left")
    unknown = F.col("_ka").isNull() & F.col("_kb").isNull()
    return joined.withColumn("same_region", unknown | F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).drop("_a", "_b", "_ka", "_kb")


def strongest_over_time(edges: DataFrame, time: str, n: int) -> DataFrame:
    """source, target, time, weight, rank: the ``n`` strongest targets of each source at each time; equals by target."""
    summed = edges.groupBy("source", time, "target").agg(F.sum("weight").alias("weight"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("source", time).orderBy(F.col("weight").desc(), "target")))
    return ranked.where(F.col("rank") <= n)


def target_divergence(edges: DataFrame, keys: list[str], time: str, block: Column | None = None) -> DataFrame:
    """keys, time, jsd: how far (Jensen-Shannon, base 2) each time's shares of the targets lie from those of the time before.

    Only times with a positive total count; ``block`` rises with the time and cuts a key of many times. The shares of a time and of the one before meet by target.
    """
    by_target = edges.groupBy(*keys, time, "target").agg(F.sum("weight").alias("w"))
    totals = by_target.groupBy(*keys, time).agg(F.sum("w").alias("_t")).where("_t > 0")
    before = with_previous(totals, keys, F.lit(0) if block is None else block, [time], F.col(time), "_prev").where("_prev is not null").select(*keys, time, "_prev")
    shares = by_target.join(totals, [*keys, time]).select(*keys, time, "target", (F.col("w") / F.col("_t")).alias("p"))
    now = shares.join(before.select(*keys, time), [*keys, time]).select(*keys, time, "target", F.col("p").alias("a"), F.lit(0.0).alias("b"))
    then = shares.withColumnRenamed(time, "_prev").join(before, [*keys, "_prev"]).select(*keys, time, "target", F.lit(0.0).alias("a"), F.col("p").alias("b"))
    both = now.unionByName(then).groupBy(*keys, time, "target").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    m = (F.col("a") + F.col("b")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)
    return both.groupBy(*keys, time).agg((F.sum(part("a") + part("b")) / 2).alias("jsd"))


def node_summaries(metric: DataFrame, node: str, time: str, value: str) -> DataFrame:
    """node, least, most, mean, last (by time), absmax (the value of greatest size, the greater of equals) of a metric over time."""
    known = metric.where(F.col(value).isNotNull() & ~F.isnan(value))
    return known.groupBy(node).agg(
        F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.max_by(value, F.struct(time, value)).alias("last"), F.max_by(value, F.struct(F.abs(value), F.col(value))).alias("absmax")
    )


def centroids(places: DataFrame, region: str, axes: list[str]) -> DataFrame:
    """region, n and the mean of each axis over its fully located rows."""
    located = places.where(" and ".join(f"{a} is not null and not isnan({a})" for a in axes) + f" and {region} is not null")
    return located.groupBy(region).agg(F.count("*").alias("n"), *(F.avg(a).alias(a) for a in axes))


def frame_totals(edges: DataFrame, time: str, gate: float) -> DataFrame:
    """time, node, magnitude (of all its edges, both ends), n_active (edges of at least ``gate`` times the greatest weight of the time)."""
    ends = edges.select(time, F.abs("weight").alias("w"), F.explode(F.array("source", "target")).alias("node"))
    peak = edges.groupBy(time).agg(F.max(F.abs("weight")).alias("_peak"))
    return ends.join(peak, time).groupBy(time, "node").agg(F.sum("w").alias("magnitude"), F.sum((F.col("w") >= gate * F.col("_peak")).cast("long")).alias("n_active"))


def strongest_of_all(edges: DataFrame, per_source: int, n: int) -> DataFrame:
    """The ``n`` edges of greatest size among the ``per_source`` strongest of each source; equals by source, then target."""
    return strongest(edges, per_source).drop("rank").orderBy(F.abs("weight").desc(), "source", "target").limit(n)


def frames(edges: DataFrame, time: str, block: Column, at: DataFrame) -> DataFrame:
    """source, target, frame, nearest (the edge's time nearest to the frame's, the earlier of equals), weight.

    ``at``: frame, a time each as a whole number, few of them; each frame meets each edge's two neighbouring times by an
    as-of match in either direction.
    """
    own = edges.withColumn("edge", F.concat_ws(">", "source", "target"))
    wanted = own.select("edge", "source", "target").distinct().crossJoin(F.broadcast(at.select("frame"))).withColumn(time, F.col("frame"))
    before = asof(wanted, own.select("edge", time, "weight"), "edge", time, "weight", block)
    before = before.select("edge", "source", "target", "frame", time, F.col("matched_at").alias("_t0"), F.col("matched_weight").alias("_w0"))
    both = asof(before, own.select("edge", time, "weight"), "edge", time, "weight", block, forward=True)
    earlier = F.col("matched_at").isNull() | (F.col("frame") - F.col("_t0") <= F.col("matched_at") - F.col("frame"))
    pick = lambda a, b: F.when(F.col("_t0").isNotNull() & earlier, F.col(a)).otherwise(F.col(b))
    return both.select("source", "target", "frame", pick("_t0", "matched_at").alias("nearest"), pick("_w0", "matched_weight").alias("weight"))


def located_edges(edges: DataFrame, places: DataFrame, n: int) -> DataFrame:
    """The ``n`` edges of greatest size whose both ends are in ``places`` (node)."""
    known = places.select("node").distinct()
    kept = edges.join(known.withColumnRenamed("node", "source"), "source", "left_semi").join(known.withColumnRenamed("node", "target"), "target", "left_semi")
    return kept.select("source", "target", "weight").orderBy(F.abs("weight").desc(), "source", "target").limit(n)


def natural_key(label: Column) -> Column:
    """A text that sorts labels naturally: runs of digits by their number, letters without case."""
    return F.regexp_replace(F.regexp_replace(F.upper(label), "([0-9]+)", "0000000000$1"), "0*([0-9]{10})(?![0-9])", "$1")


def detection_edges(detections: DataFrame, electrodes: DataFrame, keys: list[str], pair: str, channel: str, method: str, metric: str) -> DataFrame:
    """keys, source, target (label keys), weight, source_region, target_region, distance: directed edges from the first contact of
    a stimulated pair ``LEAD1-LEAD2`` or ``LEAD_1_2`` to the channel that responds.

    Of several methods the first counts; a channel that is a contact of the pair makes no edge. Both ends meet
    ``electrodes`` (keys, label, region, mni_x..; the first region by name and mean coordinates of repeats) by their keys.
    """
    parts = F.regexp_extract_all(F.upper(F.col(pair)), F.lit("([A-Z]+|[0-9]+)"), 1)
    lead, numbers = F.get(parts, F.lit(0)), F.filter(parts, lambda x: x.rlike("^[0-9]+$"))
    contacts = F.transform(numbers, lambda x: F.concat(lead, F.regexp_replace(x, "^0+(?=[0-9])", "")))
    rows = detections.where(F.col(pair).isNotNull() & F.col(channel).isNotNull()).select(*keys, contacts.alias("_c"), label_key(F.col(channel)).alias("target"), F.col(method).alias("_m"), F.col(metric).alias("weight"))
    rows = rows.where((F.size("_c") == 2) & ~F.array_contains("_c", F.col("target"))).withColumn("source", F.get("_c", F.lit(0)))
    one = rows.groupBy(*keys, "source", "target").agg(F.min_by("weight", F.struct("_m", "weight")).alias("weight"))
    axes = ("mni_x", "mni_y", "mni_z")
    place = electrodes.where("label is not null").groupBy(*keys, label_key(F.col("label")).alias("node")).agg(F.min("region").alias("region"), *(F.avg(F.when(~F.isnan(a), F.col(a))).alias(a) for a in axes))
    for end in ("source", "target"):
        one = one.join(place.select(*keys, F.col("node").alias(end), F.col("region").alias(f"{end}_region"), *(F.col(a).alias(f"_{end}_{a}") for a in axes)), [*keys, end], "left")
    distance = F.sqrt(sum((F.pow(F.col(f"_source_{a}") - F.col(f"_target_{a}"), F.lit(2)) for a in axes), F.lit(0.0)))
    return one.select(*keys, "source", "target", "weight", "source_region", "target_region", distance.alias("distance"))
