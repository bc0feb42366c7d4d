"""Problem 6: files of JSON records whose schema drifts within a stream.

Each file has a schema: the names its records use, with the JSON types of their values. Its fingerprint is a hash of
that schema; a stream's files in order of export make its versions, a new one wherever the fingerprint changes. Each
version has explicit steps from the version before (added, removed, renamed, retyped) and its routing: renames into the
project's fields, defaults for fields it has not, and casts. ``versions`` is that table; the changes are its steps, and
records are migrated by the routing of their file's version.

A name stands for a field if it is one of the field's known names. A name that is not known is resolved along the chain of
versions: it has the field of the same name in the version before, or, where it appears as a name of the version before
disappears, of that name if the evidence speaks for a rename (JSON types in common, alike names, values in common; each
the other's best match). So a chain of renames ends in the field that it started from. A name that leads to no field of
the project stands for itself.

Defined results: a payload that is null or no JSON object names no field and gives a row of defaults with ``readable``
false; a field that is only null has a name but no type, so it is never retyped; repeated lines come out once each by
row_id; files without rows have an empty schema; a record with two names of one field gives the greater of the texts; a
number in an unknown unit is null; files exported at one time are ordered by file_id; rows of unknown files have no kind
and are in no table; files without a stream are streams of their own each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrove.functions.field_names import ALIASES, CASTS, UNITS, alias_table, bare
from pulsegrove.operators.in_order import with_previous, with_running_sum
from pulsegrove.session import cut
from pulsegrove.sources.tables import stim_pair

NUMBER_TYPE = r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL.*|FLOAT|DOUBLE)$"


def record_fields(rows: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """row_id, file_id, ``kept``, name, type (null for a null value), value: a row for each name in each readable payload."""
    kept = kept or []
    spark = rows.sparkSession
    kind = F.schema_of_variant("value")
    named = rows.select("row_id", "file_id", *kept, F.try_parse_json("payload").alias("_v")).lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
    named = named.where(F.col("key").isNotNull())
    json_type = F.when(kind.rlike(NUMBER_TYPE), "number").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
    return named.select("row_id", "file_id", *kept, F.col("key").alias("name"), json_type.alias("type"), F.col("value").cast("string").alias("value"))


#: A rename's evidence: names this alike count alone, less alike ones with this share of the new values seen before.
SURE_NAME, LIKELY_NAME, SEEN_VALUES = 0.5, 0.2, 0.5


def ordered_files(files: DataFrame) -> DataFrame:
    """file_id, stream_id, kind, exported_at, before: each file with the one before it in its stream."""
    own = files.select("file_id", F.coalesce("stream_id", F.concat(F.lit("file "), F.col("file_id").cast("string"))).alias("stream_id"), "kind", "exported_at")
    return with_previous(own, "stream_id", F.date_trunc("month", "exported_at"), ["exported_at", "file_id"], F.col("file_id"), "before")


def trigrams(name: Column) -> Column:
    framed = F.concat(F.lit("^^"), bare(name), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(framed) - 2), lambda i: F.substring(framed, i, F.lit(3))))


def alikeness(a: Column, b: Column) -> Column:
    """How alike two names are: the share of their trigrams that both have, from 0 to 1."""
    return 2 * F.size(F.array_intersect(trigrams(a), trigrams(b))) / (F.size(trigrams(a)) + F.size(trigrams(b)))


def rename_pairs(fields: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, before, name, old_name, alike: unknown names that appear in a file, with names of the file before that they may replace.

    ``fields``: file_id, name, known (the alias's field or null), types. Pairs are compared within two neighbouring files,
    by as many names as appear and disappear there.
    """
    steps = files.where("before is not null").select("file_id", "before")
    now = fields.join(steps, "file_id")
    gone_in = fields.join(steps.select(F.col("file_id").alias("after"), F.col("before").alias("file_id")), "file_id").select(F.col("after").alias("file_id"), "name", "known", "types")
    fresh = now.where("known is null").join(gone_in.select("file_id", "name"), ["file_id", "name"], "left_anti").select("file_id", "before", "name", "types")
    # a field that the file still names, by any known name, was not renamed into something else
    held = now.where("known is not null").select(F.col("file_id").alias("_file"), F.col("known").alias("_held"))
    gone = gone_in.join(fields.select("file_id", "name"), ["file_id", "name"], "left_anti")
    gone = gone.join(held, (F.col("file_id") == F.col("_file")) & (F.col("known") == F.col("_held")), "left_anti").select("file_id", F.col("name").alias("old_name"), F.col("types").alias("old_types"))
    pairs = fresh.join(gone, "file_id").where(F.arrays_overlap("types", "old_types") | (F.size("types") == 0) | (F.size("old_types") == 0))
    return pairs.withColumn("alike", alikeness(F.col("name"), F.col("old_name"))).where(F.col("alike") >= LIKELY_NAME).select("file_id", "before", "name", "old_name", "alike")


def rename_evidence(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """file_id, name, old_name: the pairs whose evidence speaks for a rename, each the other's best."""
    values = named.where("value is not null").select("file_id", "name", F.xxhash64("value").alias("v")).distinct()
    own = pairs.join(values, ["file_id", "name"]).select("file_id", "before", "name", "old_name", "v")
    seen = own.join(values.select(F.col("file_id").alias("before"), F.col("name").alias("old_name"), "v", F.lit(1).alias("hit")), ["before", "old_name", "v"], "left")
    shares = seen.groupBy("file_id", "name", "old_name").agg((F.count("hit") / F.count("*")).alias("seen"))
    scored = pairs.join(shares, ["file_id", "name", "old_name"], "left").withColumn("seen", F.coalesce("seen", F.lit(0.0)))
    good = scored.where((F.col("alike") >= SURE_NAME) | (F.col("seen") >= SEEN_VALUES)).withColumn("score", F.col("alike") + F.col("seen"))
    best = lambda other: F.max_by(F.struct("name", "old_name"), F.struct("score", other)).alias("p")
    by_new, by_old = (good.groupBy("file_id", one).agg(best(two)).select("file_id", F.col("p.name").alias("name"), F.col("p.old_name").alias("old_name")) for one, two in (("name", "old_name"), ("old_name", "name")))
    return by_new.intersect(by_old)


def chained(fields: DataFrame, evidence: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, name, field: the field of the project that each unknown name leads to along its chain, if any.

    Pointers go to the name in the file before and double in length each round.
    """
    steps = files.where("before is not null").select("file_id", "before")
    same = fields.where("known is null").select("file_id", "name").join(steps, "file_id").join(fields.select(F.col("file_id").alias("before"), "name"), ["before", "name"]).select("file_id", "name", F.col("before").alias("to_file"), F.col("name").alias("to_name"))
    renamed = evidence.join(steps, "file_id").select("file_id", "name", F.col("before").alias("to_file"), F.col("old_name").alias("to_name"))
    pointers = cut(same.unionByName(renamed))
    while True:
        ahead = pointers.select(F.col("file_id").alias("to_file"), F.col("name").alias("to_name"), F.col("to_file").alias("far_file"), F.col("to_name").alias("far_name"))
        jumped = pointers.join(ahead, ["to_file", "to_name"], "left")
        moved = cut(jumped.select("file_id", "name", F.coalesce("far_file", "to_file").alias("to_file"), F.coalesce("far_name", "to_name").alias("to_name"), F.col("far_file").isNotNull().alias("moved")))
        pointers = moved.drop("moved")
        if moved.where("moved").limit(1).count() == 0:
            break
    roots = fields.where("known is not null").select(F.col("file_id").alias("to_file"), F.col("name").alias("to_name"), F.col("known").alias("field"))
    return pointers.join(roots, ["to_file", "to_name"]).select("file_id", "name", "field")


def file_fields(rows: DataFrame, ordered: DataFrame) -> DataFrame:
    """file_id, kind, name, types, field: what each of the ``ordered_files`` names; field is the project's name, else the name as written."""
    named = record_fields(rows)
    schemas = named.groupBy("file_id", "name").agg(F.array_sort(F.collect_set("type")).alias("types"))
    aliases = F.broadcast(alias_table(rows.sparkSession))
    known = schemas.join(ordered.select("file_id", "kind"), "file_id").withColumn("bare_name", bare(F.col("name"))).join(aliases, ["kind", "bare_name"], "left")
    known = cut(known.select("file_id", "kind", "name", "types", F.col("field").alias("known")))
    plain = known.select("file_id", "kind", "name", "types", F.coalesce("known", "name").alias("field"))
    # values are read again only for files in which a name may have been replaced
    pairs = cut(rename_pairs(known, ordered))
    if pairs.limit(1).count() == 0:
        return plain
    touched = pairs.select("file_id").union(pairs.select("before")).distinct()
    evidence = cut(rename_evidence(pairs, record_fields(rows.join(touched, "file_id", "left_semi"))))
    if evidence.limit(1).count() == 0:
        return plain
    led = chained(known, evidence, ordered)
    # a field that the file also has under a known name keeps only that one
    taken = known.where("known is not null").select("file_id", F.col("known").alias("field"))
    led = led.join(taken, ["file_id", "field"], "left_anti").select("file_id", "name", F.col("field").alias("led"))
    return cut(known.join(led, ["file_id", "name"], "left").select("file_id", "kind", "name", "types", F.coalesce("known", "led", "name").alias("field")))


STEP = "array<struct<field:string,change:string,old_names:array<string>,new_names:array<string>,old_types:array<string>,new_types:array<string>>>"


def versions(rows: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, stream_id, kind, exported_at, version, fingerprint, steps, renames, defaults, casts.

    version counts the stream's fingerprints from 1; steps lead from the version before (none within a version);
    renames maps each name to its field; defaults are the kind's fields that the file has not; casts maps each of the
    kind's fields to the type that its values are cast to.
    """
    ordered = cut(ordered_files(files))
    fields = file_fields(rows, ordered)
    per_field = fields.groupBy("file_id", "field").agg(F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("types"))
    per_file = fields.groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.struct("name", "types"))).alias("schema"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "field")))).alias("renames"), F.collect_set("field").alias("present")
    )
    none = F.array().cast("array<string>")
    known = ordered.join(per_file, "file_id", "left").withColumn("fingerprint", F.xxhash64(F.coalesce(F.col("schema").cast("string"), F.lit(""))))
    before = known.select(F.col("file_id").alias("before"), F.col("fingerprint").alias("_fingerprint"))
    known = cut(known.join(before, "before", "left").withColumn("fresh", ~F.col("fingerprint").eqNullSafe(F.col("_fingerprint"))))
    steps = known.where("before is not null and fresh").select("file_id", "before")
    now = per_field.join(steps.select("file_id"), "file_id", "left_semi").select("file_id", "field", "names", "types", F.lit(True).alias("now"))
    then = per_field.join(steps.select(F.col("before").alias("file_id"), F.col("file_id").alias("after")), "file_id").select(F.col("after").alias("file_id"), "field", "names", "types", F.lit(False).alias("now"))
    of = lambda column, side: F.max(F.when(F.col("now") == side, F.col(column)))
    both = now.unionByName(then).groupBy("file_id", "field").agg(of("names", True).alias("n1"), of("names", False).alias("n0"), of("types", True).alias("t1"), of("types", False).alias("t0"))
    step = lambda change, when: F.when(when, F.struct("field", F.lit(change).alias("change"), F.col("n0").alias("old_names"), F.col("n1").alias("new_names"), F.col("t0").alias("old_types"), F.col("t1").alias("new_types")))
    found = F.array_compact(
        F.array(
            step("added", F.col("n0").isNull()), step("removed", F.col("n1").isNull()), step("renamed", F.col("n0") != F.col("n1")),
            step("retyped", (F.size("t0") > 0) & (F.size("t1") > 0) & (F.col("t0") != F.col("t1"))),
        )
    )
    taken = both.groupBy("file_id").agg(F.array_sort(F.flatten(F.collect_list(found))).alias("steps"))
    own, casts = F.when(F.lit(False), none), F.when(F.lit(False), F.create_map().cast("map<string,string>"))
    for kind, names in ALIASES.items():
        own = own.when(F.col("kind") == kind, F.array(*map(F.lit, names)))
        casts = casts.when(F.col("kind") == kind, F.create_map(*(F.lit(x) for f in names for x in (f, CASTS.get(f, "text")))))
    out = known.join(taken, "file_id", "left").withColumns(
        {"steps": F.coalesce("steps", F.array().cast(STEP)), "renames": F.coalesce("renames", F.create_map().cast("map<string,string>")), "defaults": F.array_except(F.coalesce(own, none), F.coalesce("present", none)), "casts": casts}
    )
    counted = with_running_sum(out.withColumn("_new", F.col("fresh").cast("int")), "stream_id", F.date_trunc("month", "exported_at"), ["exported_at", "file_id"], F.col("_new"), "version")
    return counted.select("file_id", "stream_id", "kind", "exported_at", "version", "fingerprint", "steps", "renames", "defaults", "casts")


def changes(versioned: DataFrame) -> DataFrame:
    """file_id, field_name, change_kind: the steps of each version, at the file that brings it."""
    return versioned.select("file_id", F.explode("steps").alias("s")).select("file_id", F.col("s.field").alias("field_name"), F.col("s.change").alias("change_kind"))


def migrate(rows: DataFrame, versioned: DataFrame, kind: str) -> DataFrame:
    """row_id, file_id, line_no, readable, the kind's fields and ``others``: each record of one kind through the routing of its
    file's version: rename, default (null) and cast.

    ``others`` maps the names of the record that stand for none of the kind's fields to their values as texts, as written;
    null values stay in it as nulls, and a record without such names has an empty map.
    """
    fields = list(ALIASES[kind])
    routes = versioned.where(F.col("kind") == kind).select("file_id", "renames")
    own = rows.join(routes, "file_id")
    renamed = record_fields(own, ["renames"]).withColumn("field", F.try_element_at("renames", F.col("name")))
    renamed = renamed.groupBy("row_id", "name", "field").agg(F.max("value").alias("value"))  # repeated lines
    others = F.map_from_entries(F.array_sort(F.collect_list(F.when(~F.col("field").isin(fields), F.struct("name", "value")))))
    one = renamed.groupBy("row_id").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields), others.alias("others"))
    base = own.select("row_id", "file_id", "line_no", (F.coalesce(F.schema_of_variant(F.try_parse_json("payload")), F.lit("")).startswith("OBJECT")).alias("readable"))
    return base.join(one, "row_id", "left").select("row_id", "file_id", "line_no", "readable", *(cast_field(f).alias(f) for f in fields), F.coalesce("others", F.create_map().cast("map<string,string>")).alias("others"))


def cast_field(field: str):
    """A field's text as its one type: units and wrapping objects fall away."""
    text, rule = F.col(field), CASTS.get(field)
    if rule == "number":
        low, number = F.regexp_replace(F.lower(text), "[µμ]", "u"), r"([-+]?\d+(?:\.\d+)?(?:e[-+]?\d+)?)\s*([a-z]*)"
        # the unit stands right after the number or, as in an object, elsewhere as a word of its own
        after, names = F.regexp_extract(low, number, 2), "|".join(sorted(filter(None, UNITS[field]), key=len, reverse=True))
        unit = F.when(after != "", after).otherwise(F.regexp_extract(low, f"(?<![a-z])({names})(?![a-z])", 1))
        factors = F.create_map(*(F.lit(x) for pair in UNITS[field].items() for x in pair))
        return F.regexp_extract(low, number, 1).try_cast("double") * F.try_element_at(factors, unit)
    if rule == "flag":
        low = F.lower(F.trim(text))
        return F.when(low.isin("1", "true", "yes", "y", "bad", "x"), True).when(low.isin("0", "false", "no", "n", "good", "ok"), False)
    if rule in ("pair", "label"):
        parts = F.regexp_extract_all(text, F.lit(r'(?<=[\[{,:])\s*"?([A-Za-z]+[0-9]*|[0-9]+)"?(?=\s*[,}\]])'), 1)
        # an object's keys are in no order: a lead's name goes before its contact's number, a pair's anode comes first by key
        joined = F.array_join(F.reverse(F.array_sort(parts)), "") if rule == "label" else F.array_join(parts, "-")
        plain = F.when(text.rlike(r"^[\[{]"), joined).otherwise(F.nullif(F.trim(text), F.lit("")))
        return stim_pair(plain) if rule == "pair" else plain
    if rule == "time":
        # seconds since 1970 as the same kind of text as the other times; other numbers count from a start and stay
        since = F.expr(f"timestampadd(SECOND, try_cast({field} AS bigint), timestamp_ntz'1970-01-01 00:00:00')")
        return F.when(text.rlike(r"^\s*\d{10}\s*$"), F.regexp_replace(since.cast("string"), " ", "T")).otherwise(F.nullif(F.trim(text), F.lit("")))
    return F.nullif(F.trim(text), F.lit(""))
