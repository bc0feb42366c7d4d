"""Queries of this package's problems over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrove.llm import bpe, canonical_map, consensus, packing, reading_level, splits
from pulsegrove.llm import contacts as _contacts  # noqa: F401  registers its queries with the engine's
from pulsegrove.session import table


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    tables = {
        "electrode_metadata": table(spark, d, "electrode_metadata").select(F.col("entry_id").alias("row_key"), F.col("elec_label").alias("value")),
        "artifact_summary": table(spark, d, "artifact_summary").select(F.col("summary_id").alias("row_key"), F.col("channel").alias("value")),
    }
    return canonical_map.map_tables(tables, table(spark, d, "contact_catalog"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical_map.rewritten(_mapped(spark, d), table(spark, d, "contact_catalog"))


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return canonical_map.unmatched(_mapped(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.unreliable(table(spark, d, "annotations"))


def p4_raters(spark: SparkSession, d: str) -> DataFrame:
    return consensus.rater_report(table(spark, d, "annotations"), table(spark, d, "interrater_agreement"))


def p4_agreement(spark: SparkSession, d: str) -> DataFrame:
    """a, b, n, k of all pairs of raters who share a record."""
    pairs = consensus.pair_agreement(consensus.latest_labels(table(spark, d, "annotations")))
    return pairs.withColumn("k", F.round(F.round("k", 9), 6))


def p4_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(consensus.prepare(table(spark, d, "annotations"))[0])


def _split_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "participants"), table(spark, d, "family_coverage"), table(spark, d, "sites")


def _splits(spark: SparkSession, d: str) -> DataFrame:
    """The splits' members after two increments: the earlier half of the time that the rows span, then the rest."""
    participants, coverage, sites = _split_tables(spark, d)
    at = F.unix_micros(F.col("computed_at").cast("timestamp"))
    middle = coverage.agg(F.timestamp_micros(F.min(at) + F.floor((F.max(at) - F.min(at)) / 2)).cast("timestamp_ntz").cast("string").alias("at")).first()["at"]
    path, version = splits.increments(participants, coverage, sites, [middle, None] if middle else [None])
    return splits.members(spark, path, version)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.tied_pairs(_splits(spark, d))


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    participants, coverage, _ = _split_tables(spark, d)
    return splits.split_rows(participants, coverage, _splits(spark, d))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """split, n_rows, n_components, share of all rows."""
    rows = p5_splits(spark, d).groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("component").alias("n_components"))
    return rows.select("split", "n_rows", "n_components", (F.col("n_rows") / rows.agg(F.sum("n_rows")).scalar()).alias("share"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, same: whether decoding the ids gives the text again."""
    documents = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("before"))
    return bpe.decode(bpe.encode(table(spark, d, "documents"))).join(documents, "doc_id").select("doc_id", (F.col("text") == F.col("before")).alias("same"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(bpe.token_counts(table(spark, d, "documents")))


def p8_summary(spark: SparkSession, d: str) -> DataFrame:
    return packing.summary(p8_containers(spark, d))


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.reading_levels(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.learned(p9_levels(spark, d))


QUERIES = {x.__name__: x for x in (p3_found, p3_unmatched, p4_found, p4_raters, p4_agreement, p4_consensus, p5_found, p5_splits, p5_shares, p7_ids, p7_roundtrip, p8_containers, p8_summary, p9_found, p9_levels)}


def _code_sql(text: str, site: str | None = None) -> str:
    """SITE|number of a subject or code, as ``splits.parsed_code`` reads it."""
    low, code, number = f"lower(trim({text}))", "'^(?:sub[-_ ]?)?([a-z]{4})[-_ ]?([0-9]{1,12})$'", "'^(?:sub[-_ ]?)?p?[-_ ]?([0-9]{1,12})$'"
    whole = f"WHEN regexp_matches({low}, {code}) THEN upper(regexp_extract({low}, {code}, 1)) || '|' || CAST(regexp_extract({low}, {code}, 2) AS BIGINT)"
    alone = f"WHEN regexp_matches({low}, {number}) THEN upper(trim({site})) || '|' || CAST(regexp_extract({low}, {number}, 1) AS BIGINT)" if site else ""
    return f"CASE {whole} {alone} END"


ORACLES: dict[str, str] = {
    "p4_agreement": """WITH l AS (SELECT record_id, rater, arg_max(CAST(raw_annotation AS INTEGER), struct_pack(t := coalesce(annotated_at, TIMESTAMP '1900-01-01'), i := annotation_id)) AS v FROM annotations WHERE raw_annotation IN (0, 1, 2) AND rater IS NOT NULL AND record_id IS NOT NULL GROUP BY 1, 2),
p AS (SELECT a.rater AS a, b.rater AS b, count(*) AS n, count(*) FILTER (WHERE a.v = b.v) AS g, count(*) FILTER (WHERE a.v = 0) * count(*) FILTER (WHERE b.v = 0) + count(*) FILTER (WHERE a.v = 1) * count(*) FILTER (WHERE b.v = 1) + count(*) FILTER (WHERE a.v = 2) * count(*) FILTER (WHERE b.v = 2) AS c
FROM l a JOIN l b ON a.record_id = b.record_id AND a.rater < b.rater GROUP BY 1, 2), k AS (SELECT *, g / n AS po, c / (n * n) AS pe FROM p)
SELECT a, b, n, CAST(CAST(CAST(CASE WHEN pe < 1 - 1e-9 THEN (po - pe) / (1 - pe) ELSE 0 END AS DECIMAL(38, 9)) AS DECIMAL(38, 6)) AS DOUBLE) AS k FROM k""",
    "p7_roundtrip": "SELECT doc_id, true AS same FROM documents",
    "p5_found": f"""WITH RECURSIVE own AS (SELECT participant_key AS k, {_code_sql("participant_id")} AS code FROM participants),
former AS (SELECT participant_key AS k, {_code_sql("former_id")} AS code FROM participants),
uses AS (SELECT {_code_sql("subject", "site")} AS code, lower(regexp_replace(recording_uid, '[^0-9A-Za-z]', '', 'g')) AS uid FROM family_coverage),
tok AS (SELECT k, 'c' || code AS t FROM own UNION SELECT k, 'c' || code FROM former WHERE split_part(code, '|', 1) IN (SELECT upper(trim(site)) FROM sites)
UNION SELECT k, 'u' || uid FROM uses JOIN own USING (code) WHERE regexp_matches(uid, '^[0-9a-f]{{24}}$') AND uid <> repeat(uid[1], 24)),
e AS (SELECT DISTINCT x.k AS a, y.k AS b FROM tok x JOIN tok y ON x.t = y.t AND x.k <> y.k), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS participant_key_a, b AS participant_key_b FROM r WHERE a < b""",
}
