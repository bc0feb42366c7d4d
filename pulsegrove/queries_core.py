"""Queries of the general problems over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrove.functions.field_names import ALIASES
from pulsegrove.functions.units import FACTORS, PREFIXES, VOLT
from pulsegrove.operators import schema_drift, time_normalize, unit_normalize
from pulsegrove.session import table


def p1_peaks(spark: SparkSession, d: str) -> DataFrame:
    return unit_normalize.normalize_peaks(table(spark, d, "artifact_summary"), table(spark, d, "raw_metadata"), table(spark, d, "n1_models"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return unit_normalize.foreign_units(p1_peaks(spark, d))


def p2_times(spark: SparkSession, d: str) -> DataFrame:
    return time_normalize.normalize_times(*(table(spark, d, x) for x in ("raw_metadata", "stim_metadata", "stim_events", "sites")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return time_normalize.normalized_foreign(p2_times(spark, d))


def p6_versions(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.versions(table(spark, d, "metadata_rows"), table(spark, d, "metadata_files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(p6_versions(spark, d))


def _migrated(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return schema_drift.migrate(table(spark, d, "metadata_rows"), p6_versions(spark, d), kind)


def p6_raw(spark: SparkSession, d: str) -> DataFrame:
    return _migrated(spark, d, "raw")


def p6_stim(spark: SparkSession, d: str) -> DataFrame:
    return _migrated(spark, d, "stim")


def p6_electrode(spark: SparkSession, d: str) -> DataFrame:
    return _migrated(spark, d, "electrode")


QUERIES = {x.__name__: x for x in (p1_found, p1_peaks, p2_found, p2_times, p6_found, p6_versions, p6_raw, p6_stim, p6_electrode)}


def _unit_sql(text: str) -> str:
    """The picovolts of a unit that makes up a whole field."""
    low = f"replace(lower(trim({text})), 'µ', 'μ')"
    cases = " ".join(f"WHEN regexp_matches({low}, '^({'|'.join(prefixes)})[-_ ]?({'|'.join(VOLT)})$') THEN {FACTORS[code]}" for code, prefixes in PREFIXES.items())
    return f"CASE {cases} END"


NUMBER_SQL = "'^\\s*([-+]?(?:[0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)(?:[eE][-+]?[0-9]+)?)(.*)$'"
PEAKS_SQL = f"""p AS (SELECT summary_id, try_cast(replace(regexp_extract(max_peak_abs, {NUMBER_SQL}, 1), ',', '.') AS DOUBLE) AS x, {_unit_sql(f"regexp_extract(max_peak_abs, {NUMBER_SQL}, 2)")} AS t, {_unit_sql("a.voltage_unit")} AS f,
CASE WHEN value_scale_to_uv > 0 AND NOT isnan(value_scale_to_uv) THEN CAST(round(value_scale_to_uv * 1e6) AS BIGINT) END AS c, {_unit_sql("signal_units")} AS g, {_unit_sql("m.voltage_unit")} AS m
FROM artifact_summary a LEFT JOIN raw_metadata USING (raw_id) LEFT JOIN n1_models m ON m.model_id = a.model_id),
peaks AS (SELECT summary_id, CASE WHEN NOT isnan(x) THEN x END AS recorded, CAST(coalesce(t, f, c, g, m) AS BIGINT) AS unit_pv,
CASE WHEN t IS NOT NULL THEN 'text' WHEN f IS NOT NULL THEN 'field' WHEN c IS NOT NULL THEN 'scale' WHEN g IS NOT NULL THEN 'signal' WHEN m IS NOT NULL THEN 'model' END AS unit_from FROM p)"""
ALIASES_SQL = ", ".join(f"('{kind}', '{x}', '{field}')" for kind, fields in ALIASES.items() for field, names in fields.items() for x in [field.replace("_", ""), *names])

ORACLES: dict[str, str] = {
    "p1_peaks": f"""WITH {PEAKS_SQL} SELECT *, recorded * (unit_pv / 1e6) AS peak_uv, CASE WHEN recorded IS NULL THEN 'unreadable' WHEN unit_pv IS NULL THEN 'no_unit' ELSE 'converted' END AS status FROM peaks""",
    "p1_found": f"""WITH {PEAKS_SQL} SELECT summary_id, unit_pv FROM peaks WHERE recorded IS NOT NULL AND unit_pv <> 1000000""",
    "p6_found": f"""WITH al(kind, bare, field) AS (VALUES {ALIASES_SQL}), k AS (SELECT r.file_id, kind, payload, unnest(json_keys(payload)) AS name FROM metadata_rows r JOIN metadata_files f ON f.file_id = r.file_id),
t AS (SELECT file_id, kind, name, json_type(json_extract(payload, '$."' || name || '"')) AS ty FROM k),
n AS (SELECT file_id, coalesce(field, name) AS field, name, CASE ty WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS ty
FROM t LEFT JOIN al ON al.kind = t.kind AND al.bare = lower(regexp_replace(name, '[^0-9A-Za-z]', '', 'g'))),
g AS (SELECT file_id, field, list_sort(list(DISTINCT name)) AS names, coalesce(list_sort(list(DISTINCT ty) FILTER (WHERE ty IS NOT NULL)), []) AS types FROM n GROUP BY 1, 2),
o AS (SELECT file_id, lag(file_id) OVER (PARTITION BY stream_id ORDER BY exported_at, file_id) AS prev FROM metadata_files),
p AS (SELECT o.file_id, o.prev, g.field FROM o JOIN g ON g.file_id = o.file_id OR g.file_id = o.prev WHERE o.prev IS NOT NULL GROUP BY 1, 2, 3),
j AS (SELECT p.file_id, p.field, a.names AS n1, b.names AS n0, a.types AS t1, b.types AS t0 FROM p LEFT JOIN g a ON a.file_id = p.file_id AND a.field = p.field LEFT JOIN g b ON b.file_id = p.prev AND b.field = p.field)
SELECT file_id, field AS field_name, 'added' AS change_kind FROM j WHERE n0 IS NULL UNION ALL SELECT file_id, field, 'removed' FROM j WHERE n1 IS NULL UNION ALL SELECT file_id, field, 'renamed' FROM j WHERE n0 <> n1
UNION ALL SELECT file_id, field, 'retyped' FROM j WHERE len(t0) > 0 AND len(t1) > 0 AND t0 <> t1""",
}
