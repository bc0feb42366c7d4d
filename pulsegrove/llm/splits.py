"""Problem 5: train, validation and test splits that keep related records together, increment by increment.

The state is a persisted, versioned table in three parts: tokens (a code or recording with one of the entities that have
it), members (entity and the component it entered) and components (component, the component it was merged into, split,
status and weight). An increment brings new rows and participants and reads nothing but them and the state. Ties between
entities (an earlier code of the same person, a shared recording) are tokens in common; every token is contracted to a star
around one entity, so a recording shared by many makes no pairs. Entities that the state knows stand for their component, so
only touched components meet: roots are hooked onto each other with pointer jumping, and merged components point to their
new root. A component with one earlier split keeps it, new components fill the splits' deficits, and a merge of components
of different splits is quarantined. Tokens and members are appended, components are written anew, each under its version.

Large new components (at most 1 / ``LARGE`` of them, by weight) go one by one to the split that lacks most; the rest are
laid out in hash order along the remaining deficits, their running weight summed within hash buckets.

Defined results: null and placeholder subjects, codes and recordings tie nothing; a subject that is no participant is an
entity of its own (negative key) per site and spelling, split like the others; repeated rows tie once; rows of one
subject are on one side whatever their stimpair; rows without a time belong to the last increment; empty tables give empty
tables; extra columns are not carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrove.session import cut, shared_folder

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}
QUARANTINE = "quarantine"
LARGE = 0.01
BUCKETS = 1024

CODE = r"^(?:sub[-_ ]?)?([a-z]{4})[-_ ]?(\d{1,12})$"
NUMBER = r"^(?:sub[-_ ]?)?p?[-_ ]?(\d{1,12})$"


def parsed_code(text: Column, site: Column | None = None) -> Column:
    """The code SITE|number that a text means, its number perhaps alone within ``site``; null if it means none."""
    low = F.lower(F.trim(text))
    whole = F.when(low.rlike(CODE), F.concat(F.upper(F.regexp_extract(low, CODE, 1)), F.lit("|"), F.regexp_extract(low, CODE, 2).try_cast("long").cast("string")))
    if site is None:
        return whole
    alone = F.when(low.rlike(NUMBER), F.concat(F.upper(F.trim(site)), F.lit("|"), F.regexp_extract(low, NUMBER, 1).try_cast("long").cast("string")))
    return F.coalesce(whole, alone)


def recording(uid: Column) -> Column:
    """A recording's identity: 24 hexadecimal digits, not all alike, however they are written; null for anything else."""
    digits = F.lower(F.regexp_replace(uid, r"[^0-9A-Za-z]", ""))
    return F.when(digits.rlike(r"^[0-9a-f]{24}$") & ~digits.rlike(r"^(.)\1*$"), digits)


def subjects(participants: DataFrame, coverage: DataFrame) -> DataFrame:
    """coverage_id, entity, uid: each coverage row's participant key, or a negative key of its subject and site."""
    codes = participants.groupBy(parsed_code(F.col("participant_id")).alias("code")).agg(F.min("participant_key").alias("participant_key")).where("code is not null")
    rows = coverage.select("coverage_id", parsed_code(F.col("subject"), F.col("site")).alias("code"), F.upper(F.trim("subject")).alias("s"), F.upper(F.trim("site")).alias("t"), recording(F.col("recording_uid")).alias("uid"))
    own = -(F.xxhash64("s", "t").bitwiseAND(F.lit((1 << 62) - 1)) + 1)
    return rows.join(codes, "code", "left").select("coverage_id", F.coalesce("participant_key", own).alias("entity"), F.when(F.col("participant_key").isNotNull(), F.col("uid")).alias("uid"))


def code_tokens(participants: DataFrame, sites: DataFrame) -> DataFrame:
    """entity, token: each participant's own and former code; codes of unknown sites are placeholders."""
    known = F.broadcast(sites.select(F.upper(F.trim("site")).alias("site")).distinct())
    own = participants.select(F.col("participant_key").alias("entity"), parsed_code(F.col("participant_id")).alias("code"))
    former = participants.select(F.col("participant_key").alias("entity"), parsed_code(F.col("former_id")).alias("code"))
    both = own.unionByName(former).where("code is not null").withColumn("site", F.split("code", r"\|")[0])
    return both.join(known, "site", "left_semi").select("entity", F.concat(F.lit("code|"), "code").alias("token"))


def stars(tokens: DataFrame) -> DataFrame:
    """u, v: an edge from each entity to the smallest one with the same token."""
    held = tokens.distinct()
    centre = held.groupBy("token").agg(F.min("entity").alias("v"), F.count("*").alias("n")).where("n > 1").select("token", "v")
    return held.join(centre, "token").where("entity <> v").select(F.col("entity").alias("u"), "v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """entity, component (the smallest entity connected) of the entities on edges u, v."""
    edges = cut(edges)
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("f"))
    while True:
        labels = cut(labels)
        # what each entity and its neighbours are labelled with; roots hook onto the smallest label that any of theirs saw
        seen = both.join(labels.select(F.col("u").alias("v"), "f"), "v").select("u", "f").unionByName(labels)
        near = labels.join(seen.groupBy("u").agg(F.min("f").alias("g")), "u")
        hooks = near.groupBy("f").agg(F.min("g").alias("h"))
        # pointer jumping: everyone takes the label of its label's label
        jumps = hooks.join(hooks.select(F.col("f").alias("h"), F.col("h").alias("j")), "h", "left").select("f", F.least("h", F.coalesce("j", "h")).alias("to"))
        moved = Observation()
        jumped = near.join(jumps, "f").select("u", F.least("g", "to").alias("f"), (F.least("g", "to") != F.col("f")).alias("moved"))
        done = cut(jumped.observe(moved, F.coalesce(F.bool_or("moved"), F.lit(False)).alias("any")))
        if not moved.get["any"]:
            return done.select(F.col("u").alias("entity"), F.col("f").alias("component"))
        labels = done.select("u", "f")


STATE = {
    "tokens": "token string, entity long", "members": "entity long, component long", "components": "component long, root long, split string, status string, weight long",
}


def new_state(spark: SparkSession) -> str:
    """The folder of an empty state, in the folder that all executors share."""
    return f"{shared_folder(spark)}/splits-{uuid.uuid4().hex}"


def load(spark: SparkSession, path: str, version: int) -> dict[str, DataFrame]:
    """The parts of the state as of a version; version 0 is empty. A component's ``root`` is itself unless it was merged."""
    if not version:
        # empty in a way that the optimizer sees
        return {name: spark.range(1).select(*(F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in schema.split(", "))).where(F.lit(False)) for name, schema in STATE.items()}
    appended = {name: spark.read.schema(STATE[name]).parquet(*(f"{path}/{name}/version={v:06d}" for v in range(1, version + 1))) for name in ("tokens", "members")}
    return appended | {"components": spark.read.schema(STATE["components"]).parquet(f"{path}/components/version={version:06d}")}


def save(path: str, version: int, **parts: DataFrame) -> None:
    """Writes what a version adds; a version is written whole or not at all, and never again. Its components come last."""
    for name in ("tokens", "members", "components"):
        parts[name].write.mode("errorifexists").parquet(f"{path}/{name}/version={version:06d}")


def increment(spark: SparkSession, path: str, version: int, batch: DataFrame, arrived: DataFrame, codes: DataFrame, shares: dict[str, float] | None = None) -> None:
    """Writes version ``version`` of the state at ``path`` from the one before and what is new.

    ``batch``: entity and uid of the new rows; ``arrived``: entity of participants that are new though no row may name them;
    ``codes``: entity and token of the participants' codes, of which only those of new entities are used.
    """
    state = load(spark, path, version - 1)
    weights = batch.groupBy("entity").agg(F.count("*").alias("weight"))
    present = weights.unionByName(arrived.select("entity", F.lit(0).cast("long").alias("weight"))).groupBy("entity").agg(F.sum("weight").alias("weight"))
    held = state["members"].join(state["components"].select("component", "root"), "component").select("entity", F.col("root").alias("old"))
    present = cut(present.join(held, "entity", "left"))
    fresh = present.where("old is null").select("entity")
    shared = batch.where("uid is not null").select("entity", F.concat(F.lit("uid|"), "uid").alias("token"))
    tokens = cut(shared.unionByName(codes.join(fresh, "entity", "left_semi").select("entity", "token")).distinct())
    # whom the state knows by these tokens, as the component that they are in by now
    known = state["tokens"].join(tokens.select("token").distinct(), "token", "left_semi")
    seen = known.join(held, "entity").select("token", F.col("old").alias("entity"))
    own = tokens.join(present.select("entity", "old"), "entity").select("token", F.coalesce("old", "entity").alias("entity"))
    found = components(stars(own.unionByName(seen)))
    # each touched entity or root, its new root, and what it brings: weight of new rows, or a component's own weight and split
    brought = present.groupBy(F.coalesce("old", "entity").alias("component")).agg(F.sum("weight").alias("weight"))
    roots = state["components"].where("component = root").select("component", "split", F.col("weight").alias("was"))
    merged = found.select(F.col("entity").alias("component"), F.col("component").alias("root"))
    nodes = roots.join(brought, "component", "full").join(merged, "component", "left")
    nodes = cut(nodes.select("component", F.coalesce("root", "component").alias("root"), "split", (F.coalesce("was", F.lit(0)) + F.coalesce("weight", F.lit(0))).alias("weight")))
    placed = assign(nodes, shares)
    # merged components point to their new root, also those that were merged before
    moved = nodes.where("component <> root").select("component", F.col("root").alias("to"))
    earlier = state["components"].select("component", "root").where("component <> root").join(moved.select(F.col("component").alias("root"), "to"), "root", "left").select("component", F.coalesce("to", "root").alias("root"))
    pointers = earlier.unionByName(nodes.select("component", "root")).join(placed, "root")
    table = pointers.select("component", "root", "split", "status", F.when(F.col("component") == F.col("root"), F.col("weight")).otherwise(0).alias("weight"))
    entered = present.where("old is null").select("entity", F.col("entity").alias("component"))
    fresh_tokens = tokens.join(state["tokens"].select("token"), "token", "left_anti").groupBy("token").agg(F.min("entity").alias("entity"))
    save(path, version, tokens=fresh_tokens, members=entered, components=table)


def assign(nodes: DataFrame, shares: dict[str, float] | None = None, large_share: float = LARGE) -> DataFrame:
    """root, split, status (kept, new or conflict), weight of each component after merges.

    ``nodes``: component, root, split (null if new) and weight, a row for each component before them.
    """
    shares = shares or SPLITS
    groups = cut(
        nodes.groupBy(F.col("root").alias("component")).agg(F.sum("weight").alias("weight"), F.min("split").alias("first"), F.max("split").alias("last"))
        .withColumn("status", F.when(F.col("first").isNull(), "new").when((F.col("first") == F.col("last")) & (F.col("first") != QUARANTINE), "kept").otherwise("conflict"))
    )
    # a handful of sums: what each split holds, and the weight of all
    held = {r["first"]: r["w"] for r in groups.where("status = 'kept'").groupBy("first").agg(F.sum("weight").alias("w")).collect()}
    fresh = groups.where("status = 'new'").agg(F.sum("weight").alias("w")).first()["w"] or 0
    total = sum(held.values()) + fresh
    lacks = {s: max(0.0, share * total - held.get(s, 0)) for s, share in shares.items()}
    large = groups.where((F.col("status") == "new") & (F.col("weight") > large_share * max(total, 1))).select("component", "weight").collect()
    placed = []
    for row in sorted(large, key=lambda r: (-r["weight"], r["component"])):
        to = max(lacks, key=lambda s: lacks[s])
        lacks[to] -= row["weight"]
        placed.append((row["component"], to))
    spark = nodes.sparkSession
    chosen = F.broadcast(spark.createDataFrame(placed, "component long, split string"))
    rest = groups.where("status = 'new'").join(chosen, "component", "left_anti").select("component", "weight", F.xxhash64("component").alias("h")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    sums = rest.groupBy("bucket").agg(F.sum("weight").alias("n"))
    sums = sums.select("bucket", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("bucket")) - F.col("n")).alias("before"))
    running = F.sum("weight").over(Window.partitionBy("bucket").orderBy("h", "component").rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight") / 2
    left = {s: max(0.0, x) for s, x in lacks.items()}
    scale = sum(left.values()) or 1.0
    rest_weight = max(fresh - sum(r["weight"] for r in large), 0)
    at, edge, choice = F.col("at"), 0.0, None
    for s, x in left.items():
        edge += x / scale * rest_weight
        choice = F.when(at < edge, s) if choice is None else choice.when(at < edge, s)
    spread = rest.withColumn("run", running).join(sums, "bucket").withColumn("at", F.col("before") + F.col("run")).select("component", choice.otherwise(max(shares, key=shares.get)).alias("split"))
    old = groups.where("status <> 'new'").select("component", F.when(F.col("status") == "kept", F.col("first")).otherwise(QUARANTINE).alias("split"))
    splits = spread.unionByName(chosen).unionByName(old)
    return groups.select("component", "status", "weight").join(splits, "component").select(F.col("component").alias("root"), "split", "status", "weight")


def increments(participants: DataFrame, coverage: DataFrame, sites: DataFrame, until: list[str | None]) -> tuple[str, int]:
    """Path and version of a new state built in increments that end at each time of ``until`` (None: the rest)."""
    spark = participants.sparkSession
    path, codes, after = new_state(spark), code_tokens(participants, sites), None
    for version, end in enumerate(until, 1):

        def new(table: DataFrame, at: str) -> DataFrame:
            # a row without a time belongs to the last increment
            late = F.lit(True) if after is None else F.col(at) >= F.lit(after).cast("timestamp_ntz")
            return table.where(late & (F.col(at) < F.lit(end).cast("timestamp_ntz"))) if end else table.where(F.col(at).isNull() | late)

        batch = cut(subjects(participants, new(coverage, "computed_at")).select("entity", "uid"))
        increment(spark, path, version, batch, new(participants, "registered_at").select(F.col("participant_key").alias("entity")), codes)
        after = end
    return path, len(until)


def members(spark: SparkSession, path: str, version: int) -> DataFrame:
    """entity, component (its root), split, status of everyone in the state."""
    state = load(spark, path, version)
    return state["members"].join(state["components"].drop("weight"), "component").select("entity", F.col("root").alias("component"), "split", "status")


def split_rows(participants: DataFrame, coverage: DataFrame, state: DataFrame) -> DataFrame:
    """coverage_id, entity, component, split, status of each coverage row; ``state`` as by ``members``."""
    rows = subjects(participants, coverage).select("coverage_id", "entity")
    return rows.join(state, "entity", "left").select("coverage_id", "entity", "component", "split", "status")


#: Members of a component that one group pairs; of a larger component, every block of members meets every other.
PAIR_BLOCK = 256


def tied_pairs(state: DataFrame) -> DataFrame:
    """participant_key_a, participant_key_b: all pairs of participants of one component, smaller first."""
    people = state.where("entity > 0").select("component", "entity")
    several = people.groupBy("component").agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    own = people.join(several, "component").withColumn("own", F.pmod(F.xxhash64("entity"), F.col("blocks")).cast("int"))
    a = own.select("component", F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.col("entity").alias("participant_key_a"))
    b = own.select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.col("own").alias("j"), F.col("entity").alias("participant_key_b"))
    return a.join(b, ["component", "i", "j"]).where("participant_key_a < participant_key_b").select("participant_key_a", "participant_key_b")
