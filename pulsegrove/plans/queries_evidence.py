"""Queries of the operators around detections, trains, canonical responses and edges over the given tables, with their SQL."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrove.operators import canonical, connectivity, directed, epoching, evidence, quality, spectral, stats, trains, windows
from pulsegrove.plans import tables as P
from pulsegrove.plans.queries import query
from pulsegrove.session import cut, table
from pulsegrove.sources import tables as source_tables

SUMMARY = "artifact_summary"


def _detections(spark: SparkSession, d: str) -> DataFrame:
    """The artifact summaries as detections: a model calls a channel of a recording bad."""
    return table(spark, d, SUMMARY).withColumn("call", F.col("bad_response_fraction") > 0.2)


@query("""SELECT model_id, count(*) AS n, count(*) FILTER (WHERE bad_response_fraction > 0.2) AS n_called, count(*) FILTER (WHERE bad_response_fraction IS NULL) AS n_unavailable FROM artifact_summary GROUP BY 1""")
def method_counts(spark: SparkSession, d: str) -> DataFrame:
    return evidence.counts_by_method(_detections(spark, d), "model_id", "call")


@query("""SELECT raw_id, channel, min(model_id) AS model_id, round(median(max_ptp), 6) AS max_ptp, count(*) AS n_rows, coalesce(string_agg(DISTINCT CAST(model_id AS VARCHAR), ';' ORDER BY CAST(model_id AS VARCHAR)), '') AS methods FROM artifact_summary GROUP BY 1, 2""")
def collapsed_detections(spark: SparkSession, d: str) -> DataFrame:
    return evidence.collapsed(_detections(spark, d), ["raw_id", "channel"], "model_id", "max_ptp")


@query("""SELECT raw_id, channel, model_id, summary_id FROM (SELECT *, row_number() OVER (PARTITION BY raw_id, channel ORDER BY model_id NULLS LAST, summary_id) AS r FROM artifact_summary) WHERE r = 1""")
def first_detections(spark: SparkSession, d: str) -> DataFrame:
    return evidence.first_by(_detections(spark, d), ["raw_id", "channel"], ["model_id", "summary_id"], ["model_id", "summary_id"])


@query("""SELECT model_id, arg_min(voltage_unit, summary_id) AS voltage_unit, round(arg_min(max_plateau_run_s, summary_id), 6) AS max_plateau_run_s FROM artifact_summary GROUP BY 1""")
def first_parameters(spark: SparkSession, d: str) -> DataFrame:
    return evidence.first_known(_detections(spark, d), "model_id", ["summary_id"], ["voltage_unit", "max_plateau_run_s"])


@query("""WITH k AS (SELECT raw_id, summary_id, max_ptp AS v FROM artifact_summary WHERE max_ptp IS NOT NULL AND NOT isnan(max_ptp)), h AS (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY v DESC, summary_id) AS a, row_number() OVER (PARTITION BY raw_id ORDER BY v, summary_id) AS b FROM k)
SELECT raw_id, any_value(summary_id) FILTER (WHERE a = 1) AS highest, round(max(v), 6) AS most, any_value(summary_id) FILTER (WHERE b = 1) AS lowest, round(min(v), 6) AS least FROM h GROUP BY 1""")
def recording_extremes(spark: SparkSession, d: str) -> DataFrame:
    return evidence.extremes(_detections(spark, d), ["raw_id"], "summary_id", "max_ptp")


@query("""WITH g AS (SELECT raw_id, channel, model_id, summary_id, row_number() OVER (PARTITION BY raw_id, channel ORDER BY CASE WHEN model_id IS NULL THEN 0 WHEN model_id = 1 THEN 1 ELSE 2 END, model_id, summary_id) AS r FROM artifact_summary
WHERE bad_response_fraction < 0.25 AND hard_artifact_fraction < 0.1 AND n_clean_response >= 8) SELECT raw_id, channel, model_id, summary_id FROM g WHERE r = 1""")
def primary_detections(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, SUMMARY)
    passed = (F.col("bad_response_fraction") < 0.25) & (F.col("hard_artifact_fraction") < 0.1) & (F.col("n_clean_response") >= 8)
    kept = rows.where(passed).select("raw_id", "channel", "model_id", "summary_id")
    return evidence.primary_rows(kept, ["raw_id", "channel"], "model_id", 1, F.lit(True))


@query("""WITH t AS (SELECT raw_id, CAST(sum(n_bad_response) AS BIGINT) AS n_bad, max(bad_response_fraction) AS worst FROM artifact_summary GROUP BY 1) SELECT r.raw_id, coalesce(n_bad, 0) AS n_bad, round(coalesce(worst, 0), 6) AS worst FROM raw_metadata r LEFT JOIN t ON t.raw_id = r.raw_id""")
def recordings_with_defaults(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, SUMMARY).groupBy("raw_id").agg(F.sum("n_bad_response").alias("n_bad"), F.max("bad_response_fraction").alias("worst"))
    return evidence.with_defaults(table(spark, d, "raw_metadata").select("raw_id"), facts, ["raw_id"], {"n_bad": 0, "worst": 0.0})


@query("""SELECT annotation_id FROM annotations WHERE NOT coalesce(list_contains([regexp_extract(upper(stimpair), '^[^A-Z0-9]*([A-Z]+)', 1) || ltrim(x, '0') FOR x IN regexp_extract_all(upper(stimpair), '[0-9]+')],
regexp_replace(upper(channel), '^([A-Z]+)0*([0-9]+)$', '\\1\\2')), false)""")
def responses_elsewhere(spark: SparkSession, d: str) -> DataFrame:
    pair = F.concat_ws("_", F.regexp_extract(F.upper("stimpair"), "([A-Z]+)", 1), F.array_join(F.regexp_extract_all(F.upper("stimpair"), F.lit("([0-9]+)"), 1), "_"))
    return evidence.without_contacts(table(spark, d, "annotations").withColumn("pair", pair), "pair", "channel").select("annotation_id")


@query("""SELECT summary_id, bad_response_fraction BETWEEN 0.25 * (1 - 0.2) AND 0.25 * (1 + 0.2) AS near_bad, hard_artifact_fraction BETWEEN 0.1 * (1 - 0.2) AND 0.1 * (1 + 0.2) AS near_hard FROM artifact_summary""")
def borderline_gates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, SUMMARY).select("summary_id", evidence.borderline(F.col("bad_response_fraction"), 0.25).alias("near_bad"), evidence.borderline(F.col("hard_artifact_fraction"), 0.1).alias("near_hard"))


@query("""WITH t AS (SELECT raw_id, coalesce(n_bad_response > 0, false) AS b, coalesce(n_hard_artifact_response > 0, false) AS h FROM artifact_summary)
SELECT raw_id, count(*) AS n_trials, count(*) FILTER (WHERE b) AS n_bad, count(*) FILTER (WHERE h) AS n_hard, count(*) FILTER (WHERE NOT b AND NOT h) AS n_clean, round(count(*) FILTER (WHERE b) / count(*), 6) AS bad_fraction,
round(count(*) FILTER (WHERE h) / count(*), 6) AS hard_fraction, bool_or(b OR h) AS review FROM t GROUP BY 1""")
def audit_by_recording(spark: SparkSession, d: str) -> DataFrame:
    return evidence.audit_summary(table(spark, d, SUMMARY), ["raw_id"], F.col("n_bad_response") > 0, F.col("n_hard_artifact_response") > 0)


@query("""SELECT summary_id, concat_ws(';', CASE WHEN n_clean_response < 10 THEN 'few_clean' END, CASE WHEN bad_response_fraction >= 0.25 THEN 'many_bad' END, CASE WHEN hard_artifact_fraction >= 0.1 THEN 'many_hard' END,
CASE WHEN max_saturation_fraction > 0.02 THEN 'saturated' END, CASE WHEN max_ptp >= 1000 THEN 'large' END) AS reasons, CAST(greatest(0, CASE WHEN n_clean_response < 10 THEN 1 ELSE 0 END, CASE WHEN bad_response_fraction >= 0.25 THEN 2 ELSE 0 END,
CASE WHEN hard_artifact_fraction >= 0.1 THEN 3 ELSE 0 END, CASE WHEN max_saturation_fraction > 0.02 THEN 2 ELSE 0 END, CASE WHEN max_ptp >= 1000 THEN 1 ELSE 0 END) AS INTEGER) AS priority FROM artifact_summary""")
def review_list(spark: SparkSession, d: str) -> DataFrame:
    rules = {
        "few_clean": (F.col("n_clean_response") < 10, 1), "many_bad": (F.col("bad_response_fraction") >= 0.25, 2), "many_hard": (F.col("hard_artifact_fraction") >= 0.1, 3), "saturated": (F.col("max_saturation_fraction") > 0.02, 2),
        "large": (F.col("max_ptp") >= 1000, 1),
    }
    return evidence.review_reasons(table(spark, d, SUMMARY), rules).select("summary_id", "reasons", "priority")


@query("""SELECT raw_id, count(*) AS n_channels, round(avg(CASE WHEN bad_response_fraction > 0.1 THEN 1.0 ELSE 0.0 END), 6) AS early_fraction, round(median(abs(max_ptp)), 6) AS median_start, round(median(abs(max_plateau_run_s)), 6) AS median_drift,
coalesce(count(*) >= 20 AND avg(CASE WHEN bad_response_fraction > 0.1 THEN 1.0 ELSE 0.0 END) >= 0.5 AND median(abs(max_ptp)) >= 25 AND median(abs(max_plateau_run_s)) >= 0.001, false) AS common_mode FROM artifact_summary GROUP BY 1""")
def common_mode(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, SUMMARY)
    return evidence.common_mode(rows, ["raw_id"], "max_ptp", "max_plateau_run_s", F.col("bad_response_fraction") > 0.1, 20, 0.5, 25.0, 0.001)


@query("""WITH s AS (SELECT raw_id, avg(max_ptp) AS pm, stddev_samp(max_ptp) AS ps, avg(max_saturation_fraction) AS sm, stddev_samp(max_saturation_fraction) AS ss FROM artifact_summary WHERE raw_id IS NOT NULL GROUP BY 1),
z AS (SELECT a.raw_id, summary_id, CASE WHEN ps > 0 THEN (max_ptp - pm) / ps END AS pz, CASE WHEN ss > 0 THEN (max_saturation_fraction - sm) / ss END AS sz, CASE WHEN hard_artifact_fraction > 0 THEN -log10(hard_artifact_fraction) END AS lp FROM artifact_summary a JOIN s ON s.raw_id = a.raw_id),
c AS (SELECT *, greatest(abs(pz), abs(sz), lp) AS c FROM z)
SELECT raw_id, summary_id, round(pz, 6) AS max_ptp_z, round(sz, 6) AS max_saturation_fraction_z, round(lp, 6) AS log_p, round(c, 6) AS composite FROM c""")
def site_comparison(spark: SparkSession, d: str) -> DataFrame:
    return windows.compare_sites(table(spark, d, SUMMARY).where("raw_id is not null"), "raw_id", "summary_id", ["max_ptp", "max_saturation_fraction"], "hard_artifact_fraction").drop("rank")


@query("""WITH p AS (SELECT p_brand AS g, p_retailprice AS v FROM part WHERE p_retailprice IS NOT NULL), g AS (SELECT g, count(*) AS n FROM p GROUP BY 1), c AS (SELECT g, v, count(*) AS n FROM p GROUP BY 1, 2), k AS (SELECT a.g AS ga, b.g AS gb, a.n AS na, b.n AS nb FROM g a JOIN g b ON a.g < b.g),
x AS (SELECT ga, gb, v, sum(a) AS a, sum(b) AS b FROM (SELECT ga, gb, v, n AS a, 0 AS b FROM k JOIN c ON c.g = ga UNION ALL SELECT ga, gb, v, 0, n FROM k JOIN c ON c.g = gb) GROUP BY ALL),
y AS (SELECT *, sum(b) OVER (PARTITION BY ga, gb ORDER BY v ROWS UNBOUNDED PRECEDING) AS upto FROM x), u AS (SELECT ga, gb, CAST(sum(a * (upto - b / 2)) AS DOUBLE) AS u, CAST(sum(pow(a + b, 3) - (a + b)) AS DOUBLE) AS t FROM y GROUP BY 1, 2)
SELECT ga AS group_a, gb AS group_b, na AS n_a, nb AS n_b, round(u, 6) AS u, round((u - na * nb / 2) / sqrt(na * nb / 12.0 * (na + nb + 1 - t / ((na + nb) * (na + nb - 1)))), 6) AS z, round(2 * u / (na * nb) - 1, 6) AS biserial FROM u JOIN k USING (ga, gb)""")
def group_rank_sums(spark: SparkSession, d: str) -> DataFrame:
    return stats.rank_sums(table(spark, d, "part"), "p_brand", "p_retailprice")


# ---- trials


@query(f"""WITH {P.SQL_EPOCHED}, w AS (SELECT *, row_number() OVER t AS i, count(*) OVER (PARTITION BY channel, epoch) AS n, first_value(value) OVER u AS f, last_value(value) OVER u AS l, sum(value) OVER (PARTITION BY channel, epoch ORDER BY "offset" ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM epoched
WINDOW t AS (PARTITION BY channel, epoch ORDER BY "offset"), u AS (PARTITION BY channel, epoch ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT channel, epoch, "offset", round((s + greatest(2 - i, 0) * f + greatest(i + 1 - n, 0) * l) / 3, 6) AS smooth FROM w""", users=P.BY_USER)
def smoothed_trials(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    return windows.boxcar(roles.epoched(spark, d), ["channel", "epoch"], "offset", "value", 1, "smooth").select("channel", "epoch", "offset", "smooth")


@query(f"""WITH {P.SQL_EPOCHED}, s AS (SELECT channel, epoch, "offset", CASE WHEN abs(value - lag(value) OVER w) <= 5 THEN 0 ELSE 1 END AS f FROM epoched WINDOW w AS (PARTITION BY channel, epoch ORDER BY "offset")),
r AS (SELECT *, sum(f) OVER (PARTITION BY channel, epoch ORDER BY "offset" ROWS UNBOUNDED PRECEDING) AS run FROM s), n AS (SELECT channel, epoch, run, count(*) AS n FROM r GROUP BY 1, 2, 3) SELECT channel, epoch, max(n) AS longest FROM n GROUP BY 1, 2""", users=P.BY_USER)
def constant_runs(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    return windows.longest_constant(roles.epoched(spark, d), ["channel", "epoch"], "offset", "value", 5.0)


@query(f"""WITH {P.SQL_EPOCHED} SELECT channel, epoch, "offset" FROM (SELECT *, row_number() OVER (PARTITION BY channel, epoch ORDER BY "offset" DESC) AS r FROM epoched WHERE "offset" < 0) WHERE r <= 3""", users=P.BY_USER)
def latest_baseline(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    return windows.latest(roles.epoched(spark, d).where("offset < 0"), ["channel", "epoch"], "offset", 3).select("channel", "epoch", "offset")


SQL_WHOLE = """inside AS (SELECT epoch, channel, "offset" AS o, value AS v FROM epoched WHERE "offset" BETWEEN 1 AND 12 AND value IS NOT NULL), whole AS (SELECT i.* FROM inside i JOIN (SELECT epoch, channel FROM inside GROUP BY 1, 2 HAVING count(*) = 12) f ON f.epoch = i.epoch AND f.channel = i.channel),
sums AS (SELECT channel, o, sum(v) AS s, count(*) AS n FROM whole GROUP BY 1, 2), along AS (SELECT w.channel, n, count(*) OVER t AS duration, sum(v * v) OVER t AS q, sum(v * (s - v)) OVER t AS d FROM whole w JOIN sums USING (channel, o) WINDOW t AS (PARTITION BY w.epoch, w.channel ORDER BY o ROWS UNBOUNDED PRECEDING)),
profile AS (SELECT channel, duration, max(n) AS n, sum(d / greatest(sqrt(q), 1e-12)) / (max(n) * (max(n) - 1)) AS profile FROM along WHERE duration >= 2 AND n > 1 GROUP BY 1, 2)"""


@query(f"""WITH {P.SQL_EPOCHED}, {SQL_WHOLE} SELECT channel, duration, n, round(profile, 6) AS profile FROM profile""", users=P.BY_USER)
def projection_profile(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    return canonical.projection_profile(canonical.whole_trials(roles.epoched(spark, d), 1, P.AFTER), 2)


@query(f"""WITH {P.SQL_EPOCHED}, {SQL_WHOLE}, best AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY profile DESC, duration) AS r FROM profile) SELECT channel, n, duration, round(profile, 6) AS profile FROM best WHERE r = 1""", users=P.BY_USER)
def response_duration(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    shapes = canonical.canonical_response(canonical.whole_trials(roles.epoched(spark, d), 1, P.AFTER), 2, 1)
    return shapes.select("channel", "n", "duration", "profile")


def _shapes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    trials = cut(P.bridged_epoched(spark, d))
    return trials, canonical.canonical_response(canonical.whole_trials(trials, 1, P.AFTER), 2, 1)


@query()
def canonical_responses(spark: SparkSession, d: str) -> DataFrame:
    return _shapes(spark, d)[1].drop("canonical")


@query()
def canonical_weights(spark: SparkSession, d: str) -> DataFrame:
    return canonical.sliding_weights(*_shapes(spark, d))


SQL_ENVELOPE = """env AS (SELECT epoch, "offset" AS o, CASE WHEN count(value) > 2 THEN quantile_cont(abs(value), 0.95) ELSE max(abs(value)) END AS e FROM epoched GROUP BY 1, 2)"""


@query(f"""WITH {P.SQL_EPOCHED}, {SQL_ENVELOPE}, w AS (SELECT *, row_number() OVER t AS i, count(*) OVER (PARTITION BY epoch) AS n, first_value(e) OVER u AS f, last_value(e) OVER u AS l, sum(e) OVER (PARTITION BY epoch ORDER BY o ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM env
WINDOW t AS (PARTITION BY epoch ORDER BY o), u AS (PARTITION BY epoch ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), m AS (SELECT epoch, o, (s + greatest(2 - i, 0) * f + greatest(i + 1 - n, 0) * l) / 3 AS e FROM w),
c AS (SELECT epoch, median(e) AS c, stddev_pop(e) AS sd FROM m WHERE o BETWEEN -6 AND -1 GROUP BY 1), k AS (SELECT m.epoch, 1.4826 * median(abs(e - c)) AS mad FROM m JOIN c USING (epoch) WHERE o BETWEEN -6 AND -1 GROUP BY 1),
g AS (SELECT epoch, o, e, lag(e) OVER x AS a, lead(e) OVER x AS b FROM m WINDOW x AS (PARTITION BY epoch ORDER BY o)),
z AS (SELECT epoch, o, (e - c) / (CASE WHEN mad > 1e-12 THEN mad WHEN sd > 1e-12 THEN sd ELSE 1 END) AS z, abs(CASE WHEN a IS NULL THEN b - e WHEN b IS NULL THEN e - a ELSE (b - a) / 2 END) / (CASE WHEN mad > 1e-12 THEN mad WHEN sd > 1e-12 THEN sd ELSE 1 END) AS flat FROM g JOIN c USING (epoch) JOIN k USING (epoch)),
p AS (SELECT epoch, o AS peak_at, z AS peak_z FROM (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY z DESC, o) AS r FROM z WHERE o BETWEEN -1 AND 6) WHERE r = 1),
q AS (SELECT z.*, sum(CASE WHEN z <= 2 AND flat <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY epoch ORDER BY o ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS ok, row_number() OVER (PARTITION BY epoch ORDER BY z, o) AS r FROM z JOIN p USING (epoch) WHERE o >= greatest(1, peak_at + 1) AND o <= 6),
f AS (SELECT epoch, min(o) FILTER (WHERE ok = 2) AS a, min(o) FILTER (WHERE z <= 2) AS b, any_value(o) FILTER (WHERE r = 1) AS c FROM q GROUP BY 1)
SELECT epoch, peak_at, round(peak_z, 6) AS peak_z, CAST(coalesce(a, b, c, peak_at + 1) AS INTEGER) AS anchor, CASE WHEN a IS NOT NULL THEN 'settled' WHEN b IS NOT NULL THEN 'amplitude' WHEN c IS NOT NULL THEN 'quietest' ELSE 'neighbour' END AS method FROM p LEFT JOIN f USING (epoch)""", users=P.BY_USER)
def artifact_anchors(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    return canonical.post_artifact_anchors(epoching.artifact_envelope(roles.epoched(spark, d)), (-6, -1), (-1, 6), 1)


@query()
def anchor_report(spark: SparkSession, d: str) -> DataFrame:
    """method, n, mean_anchor, earliest and latest anchor of the trials."""
    anchors = canonical.post_artifact_anchors(epoching.artifact_envelope(P.session_epoched(spark, d)), (-6, -1), (-1, 6), 1)
    return anchors.groupBy("method").agg(F.count("*").alias("n"), F.avg("anchor").alias("mean_anchor"), F.min("anchor").alias("earliest"), F.max("anchor").alias("latest"))


@query()
def zeroed_after_anchor(spark: SparkSession, d: str) -> DataFrame:
    trials = cut(P.session_epoched(spark, d))
    anchors = canonical.post_artifact_anchors(epoching.artifact_envelope(trials), (-6, -1), (-1, 6), 1)
    return canonical.zeroed_after(trials, anchors, 2).select("epoch", "channel", "offset", "value")


@query(f"""WITH {P.SQL_EPOCHED}, t AS (SELECT epoch, channel, count(value) FILTER (WHERE "offset" BETWEEN 1 AND 4) AS a, count(value) FILTER (WHERE "offset" BETWEEN -4 AND -1) AS b, sqrt(var_pop(value) FILTER (WHERE "offset" BETWEEN 1 AND 4)) AS r, sqrt(var_pop(value) FILTER (WHERE "offset" BETWEEN -4 AND -1)) AS s FROM epoched GROUP BY 1, 2),
d AS (SELECT *, r - s AS d FROM t WHERE a = 4 AND b = 4), p AS (SELECT channel, count(*) AS n, avg(r) AS mr, avg(s) AS mb, avg(d) AS md FROM d GROUP BY 1 HAVING count(*) >= 3),
g AS (SELECT channel, abs(d) AS s, count(*) AS c, count(*) FILTER (WHERE d > 0) AS up FROM d WHERE d <> 0 GROUP BY 1, 2), k AS (SELECT *, sum(c) OVER (PARTITION BY channel ORDER BY s ROWS UNBOUNDED PRECEDING) - (c - 1) / 2 AS rk FROM g),
w AS (SELECT channel, CAST(sum(up * rk) AS DOUBLE) AS w, CAST(sum(c) AS DOUBLE) AS m, CAST(sum(pow(c, 3) - c) AS DOUBLE) AS ties FROM k GROUP BY 1)
SELECT channel, n, round(mr, 6) AS mean_reply, round(mb, 6) AS mean_base, round(md, 6) AS mean_change, round((w - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48), 6) AS z FROM p LEFT JOIN w USING (channel)""", users=P.BY_USER)
def matched_rms(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    return canonical.matched_rms(roles.epoched(spark, d), -1, (1, 4)).drop("w")


@query(f"""WITH {P.SQL_EPOCHED}, m AS (SELECT channel, "offset" AS o, avg(value) AS y FROM epoched GROUP BY 1, 2), b AS (SELECT channel, stddev_samp(y) AS noise FROM m WHERE o BETWEEN -6 AND -1 GROUP BY 1 HAVING stddev_samp(y) > 0), i AS (SELECT * FROM m WHERE o BETWEEN 1 AND 12),
x AS (SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS c FROM i WINDOW w AS (PARTITION BY channel ORDER BY o)), p AS (SELECT channel, o AS po, y AS py FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY y, o) AS r FROM x WHERE y < 0 AND y < a AND y < c) WHERE r = 1),
s AS (SELECT channel, sum(greatest(-y, 0)) AS neg, sum(abs(y)) AS tot, sqrt(avg(y * y)) AS rms FROM i GROUP BY 1), e AS (SELECT i.channel, max(o) FILTER (WHERE o < po AND y < py) AS lo, min(o) FILTER (WHERE o > po AND y < py) AS hi FROM i JOIN p USING (channel) GROUP BY 1),
f AS (SELECT i.channel, max(y) FILTER (WHERE o < po AND o > coalesce(lo, 0)) AS l, max(y) FILTER (WHERE o > po AND o < coalesce(hi, 13)) AS r, max(y) FILTER (WHERE o < po) AS bf FROM i JOIN p USING (channel) JOIN e USING (channel) GROUP BY 1)
SELECT b.channel, round(noise, 6) AS noise, round(py, 6) AS peak, po AS latency, round(-py / noise, 6) AS peak_z, round(least(l, r) - py, 6) AS prominence, round(CASE WHEN tot > 0 THEN neg / tot ELSE 0 END, 6) AS area_fraction, round(CASE WHEN py IS NOT NULL THEN greatest(bf, 0) / noise END, 6) AS preceding_positive_z, round(rms / noise, 6) AS rms_z
FROM b JOIN s USING (channel) LEFT JOIN p USING (channel) LEFT JOIN f USING (channel)""", users=P.BY_USER)
def negative_peaks(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    out = canonical.negative_peaks(epoching.mean_waveform(roles.epoched(spark, d)), (-6, -1), (1, 12))
    return out.withColumn("preceding_positive_z", F.when(F.col("peak").isNotNull(), F.col("preceding_positive_z")))


@query()
def gated_peaks(spark: SparkSession, d: str) -> DataFrame:
    """The negative peaks behind an amplitude gate, with the adjusted p of their channel's signed-rank test."""
    trials = cut(P.bridged_epoched(spark, d))
    peaks = canonical.negative_peaks(epoching.mean_waveform(trials), (-6, -1), (1, 12))
    tested = canonical.matched_rms(trials, -1, (1, 4)).select("channel", (1 - stats.normal_cdf(F.col("z"))).alias("p"))
    gated = canonical.gated_family(peaks.join(tested, "channel", "left"), "p", 1.5, 1.0).withColumn("family", F.lit(1))
    return windows.adjusted_p(gated, ["family"], "screened", "q").select("channel", "peak", "noise", "gate", "p", "screened", "q")


# ---- trains


SQL_TRAINS = """t AS (SELECT user_id, event_type, epoch(ts) AS k FROM events), s AS (SELECT *, k - lag(k) OVER (PARTITION BY user_id, event_type ORDER BY k) AS d FROM t), e AS (SELECT *, CASE WHEN d > 0 THEN abs(d / greatest(round_even(d / 21600.0, 0), 1) - 21600) / 21600 END AS e FROM s),
r AS (SELECT user_id, event_type, count(*) AS n, avg(e) AS ce, avg(CASE WHEN e IS NOT NULL THEN CASE WHEN e <= 0.12 THEN 1.0 ELSE 0.0 END END) AS rg, median(d) FILTER (WHERE d > 0) AS mi FROM e GROUP BY 1, 2)"""


def _trains(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("k"), F.lit(21600.0).alias("step"))
    return trains.regularity(events, ["user_id", "event_type"], "k", "step")


@query(f"""WITH {SQL_TRAINS} SELECT user_id, event_type, n, round(mi, 6) AS median_interval, round(ce, 6) AS cadence_error, round(rg, 6) AS regular FROM r""")
def train_regularity(spark: SparkSession, d: str) -> DataFrame:
    return _trains(spark, d)


@query(f"""WITH {SQL_TRAINS}, c AS (SELECT *, abs(n - 10) / 10 + 0.25 * coalesce(ce, 0) + 0.05 AS score, coalesce(mi / 21600 BETWEEN 0.65 AND 1.5, true) AND (n < 4 OR rg >= 0.65) AND n BETWEEN 5 AND 16 AS ok FROM r)
SELECT user_id, event_type, n, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score, event_type) AS r FROM c WHERE ok) WHERE r = 1""")
def best_trains(spark: SparkSession, d: str) -> DataFrame:
    found = _trains(spark, d).withColumns({"step": F.lit(21600.0), "expected": F.lit(10.0)})
    return trains.best_candidates(trains.candidate_scores(found, "event_type", "step", "expected"), ["user_id"], "event_type").select("user_id", "event_type", "n", "score")


@query("""SELECT user_id, ts, min(event_type) AS event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS number FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""")
def numbered_events(spark: SparkSession, d: str) -> DataFrame:
    return trains.from_times(table(spark, d, "events"), "user_id", "ts", "event_type").withColumn("number", F.col("number").cast("long"))


@query()
def trigger_events(spark: SparkSession, d: str) -> DataFrame:
    return trains.triggers(P.sessions(spark, d), F.floor(F.col("k") / 4096), 3)


@query("""WITH w AS (SELECT user_id, min(epoch(ts)) AS a, max(epoch(ts)) AS b FROM events WHERE event_type = 'error' GROUP BY 1) SELECT event_id FROM events e JOIN w ON w.user_id = e.user_id AND epoch(ts) BETWEEN a - 3600 AND b + 7200""")
def processing_window(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("k"))
    around = events.where("event_type = 'error'").groupBy("user_id").agg((F.min("k") - 3_600_000_000).alias("a"), (F.max("k") + 7_200_000_000).alias("b"))
    return events.join(around, "user_id").where(F.col("k").between(F.col("a"), F.col("b"))).select("event_id")


@query("""SELECT DISTINCT e.event_id FROM events e JOIN events s ON s.user_id = e.user_id AND s.event_type = 'purchase' AND epoch_us(e.ts) BETWEEN epoch_us(s.ts) + 3600000000 AND epoch_us(s.ts) + 7200000000""")
def rest_after_purchases(spark: SparkSession, d: str) -> DataFrame:
    from pulsegrove.operators import intervals

    events = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("k"))
    rest = events.where("event_type = 'purchase'").select("user_id", (F.col("k") + 3_600_000_000).alias("start"), (F.col("k") + 7_200_000_000).alias("stop"))
    return intervals.within(events.select("event_id", "user_id", "k"), rest, "user_id", "k", "start", "stop", 3_600_000_000).select("event_id").distinct()


# ---- edges


SQL_MONTHLY = P.SQL_TRADE + ", monthly AS (SELECT source, target, month, sum(weight) AS w FROM trade GROUP BY 1, 2, 3)"


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    return P.trade(spark, d).groupBy("source", "target", "month").agg(F.sum("weight").alias("weight"))


@query(f"""WITH {SQL_MONTHLY}, m AS (SELECT source AS node, month, sum(w) AS v FROM monthly GROUP BY 1, 2) SELECT node, round(min(v), 4) AS least, round(max(v), 4) AS most, round(avg(v), 4) AS mean, round(arg_max(v, month), 4) AS last, round(max(v), 4) AS absmax FROM m GROUP BY 1""")
def node_summaries(spark: SparkSession, d: str) -> DataFrame:
    sums = _monthly(spark, d).groupBy(F.col("source").alias("node"), "month").agg(F.sum("weight").alias("v"))
    out = directed.node_summaries(sums, "node", "month", "v")
    return out.select("node", *(F.round(F.round(c, 7), 4).alias(c) for c in ("least", "most", "mean", "last", "absmax")))


@query("""SELECT anat_label, count(*) AS n, round(avg(mni_x), 6) AS mni_x, round(avg(mni_y), 6) AS mni_y, round(avg(mni_z), 6) AS mni_z FROM electrode_metadata WHERE anat_label IS NOT NULL AND mni_x IS NOT NULL AND mni_y IS NOT NULL AND mni_z IS NOT NULL AND NOT isnan(mni_x) AND NOT isnan(mni_y) AND NOT isnan(mni_z) GROUP BY 1""")
def region_centroids(spark: SparkSession, d: str) -> DataFrame:
    return directed.centroids(table(spark, d, "electrode_metadata"), "anat_label", ["mni_x", "mni_y", "mni_z"])


@query(f"""WITH {SQL_MONTHLY}, p AS (SELECT month, max(abs(w)) AS pk FROM monthly GROUP BY 1), e AS (SELECT month, abs(w) AS w, unnest([source, target]) AS node FROM monthly)
SELECT CAST(month AS DATE) AS month, node, round(sum(w), 4) AS magnitude, count(*) FILTER (WHERE w >= 0.5 * pk) AS n_active FROM e JOIN p USING (month) GROUP BY 1, 2""")
def frame_totals(spark: SparkSession, d: str) -> DataFrame:
    return directed.frame_totals(_monthly(spark, d), "month", 0.5).withColumn("magnitude", F.round(F.round("magnitude", 7), 4))


@query(f"""WITH {P.SQL_TRADE}, e AS (SELECT source, target, sum(weight) AS w FROM trade GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY w DESC, target) AS r FROM e) SELECT source, target, round(w, 4) AS weight FROM r WHERE r <= 3 ORDER BY w DESC, source, target LIMIT 20""")
def strongest_of_all(spark: SparkSession, d: str) -> DataFrame:
    return directed.strongest_of_all(directed.collapse(P.trade(spark, d), []), 3, 20).select("source", "target", F.round(F.round("weight", 7), 4).alias("weight"))


@query(f"""WITH {SQL_MONTHLY}, f AS (SELECT source, target, unnest([9000, 9500, 10000]) AS frame FROM (SELECT DISTINCT source, target FROM monthly)), k AS (SELECT source, target, CAST(epoch(month) / 86400 AS INTEGER) AS t, w FROM monthly),
n AS (SELECT f.source, f.target, frame, t, w, row_number() OVER (PARTITION BY f.source, f.target, frame ORDER BY abs(t - frame), t) AS r FROM f JOIN k ON k.source = f.source AND k.target = f.target) SELECT source, target, frame, t AS nearest, round(w, 4) AS weight FROM n WHERE r = 1""")
def edge_frames(spark: SparkSession, d: str) -> DataFrame:
    edges = _monthly(spark, d).withColumn("day", F.unix_date("month"))
    at = spark.createDataFrame([(9000,), (9500,), (10000,)], "frame int")
    out = directed.frames(edges, "day", F.floor(F.col("day") / 365), at)
    return out.withColumn("weight", F.round(F.round("weight", 7), 4))


@query(f"""SELECT elec_label, row_number() OVER (ORDER BY k, elec_label) AS place FROM (SELECT DISTINCT elec_label, regexp_replace(regexp_replace(upper(elec_label), '([0-9]+)', '0000000000\\1', 'g'), '0*([0-9]{{10}})($|[^0-9])', '\\1\\2', 'g') AS k FROM contact_catalog)""")
def natural_order(spark: SparkSession, d: str) -> DataFrame:
    # the catalog is a fixed table
    from pyspark.sql import Window

    labels = table(spark, d, "contact_catalog").select("elec_label", directed.natural_key(F.col("elec_label")).alias("k")).distinct()
    return labels.select("elec_label", F.row_number().over(Window.orderBy("k", "elec_label")).cast("long").alias("place"))


@query(f"""WITH keyed AS (SELECT *, {P.sql_label_key("elec_label")} AS node FROM electrode_metadata WHERE elec_label IS NOT NULL), place AS (SELECT upper(regexp_replace(patient_id, '^(?i)sub-', '')) AS subject, node, min(anat_label) AS region FROM keyed GROUP BY 1, 2),
r AS (SELECT subject, rater, raw_annotation, regexp_extract(upper(stimpair), '([A-Z]+)', 1) AS lead, [CAST(x AS BIGINT)::VARCHAR FOR x IN regexp_extract_all(upper(stimpair), '[0-9]+')] AS nums, {P.sql_label_key("channel")} AS target FROM annotations WHERE stimpair IS NOT NULL AND channel IS NOT NULL AND raw_annotation > 0 AND NOT isnan(raw_annotation)),
k AS (SELECT subject, lead || nums[1] AS source, target, arg_min(raw_annotation, struct_pack(m := rater, w := raw_annotation)) AS weight FROM r WHERE len(nums) = 2 AND target NOT IN (lead || nums[1], lead || nums[2]) GROUP BY 1, 2, 3)
SELECT k.subject, source, target, weight, a.region AS source_region, b.region AS target_region FROM k LEFT JOIN place a ON a.subject = k.subject AND a.node = source LEFT JOIN place b ON b.subject = k.subject AND b.node = target""")
def detection_edges(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "annotations").where("raw_annotation > 0 and not isnan(raw_annotation)")
    electrodes = table(spark, d, "electrode_metadata").select(F.upper(F.regexp_replace("patient_id", r"^(?i)sub-", "")).alias("subject"), F.col("elec_label").alias("label"), F.col("anat_label").alias("region"), "mni_x", "mni_y", "mni_z")
    return directed.detection_edges(found, electrodes, ["subject"], "stimpair", "channel", "rater", "raw_annotation").drop("distance")


# ---- dependence between channels, sources


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors as signals: channel = label, a recording for each eight of them."""
    return table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 8).alias("recording"), F.col("label").cast("string").alias("channel"), F.transform("embedding", lambda x: x.cast("double")).alias("y"))


RATE = 64.0


@query()
def phase_phase(spark: SparkSession, d: str) -> DataFrame:
    return connectivity.phase_phase(_vectors(spark, d), "channel", RATE, (3.0, 7.0), (6.0, 14.0), 2, 1)


@query()
def comodulogram(spark: SparkSession, d: str) -> DataFrame:
    return connectivity.comodulogram(_vectors(spark, d), "channel", RATE, [(2.0, 4.0), (4.0, 8.0)], [(10.0, 16.0), (16.0, 24.0)])


def _one_each(spark: SparkSession, d: str) -> DataFrame:
    """One vector per recording and channel."""
    return _vectors(spark, d).groupBy("recording", "channel").agg(F.min_by("y", "vec_id").alias("y"))


@query()
def locking_over_samples(spark: SparkSession, d: str) -> DataFrame:
    return connectivity.locking_over_samples(spectral.bandpassed(_one_each(spark, d), 4.0, 12.0, RATE, 2), "recording", "channel")


@query()
def continuous_coherence(spark: SparkSession, d: str) -> DataFrame:
    return connectivity.continuous_coherence(_one_each(spark, d), "recording", "channel", RATE, 16, 4.0, 20.0)


@query()
def wavelet_locking(spark: SparkSession, d: str) -> DataFrame:
    return connectivity.wavelet_locking(_one_each(spark, d), "recording", "channel", RATE, [8.0, 16.0])


@query("""SELECT patient_id, elec_label, coalesce(regexp_matches(anat_label, '(?i)(frontal|thalam|putamen|cingulate)'), false) AS scaffold FROM (SELECT DISTINCT patient_id, elec_label, anat_label FROM electrode_metadata)""")
def scaffold_contacts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "electrode_metadata").select("patient_id", "elec_label", "anat_label").distinct()
    return rows.select("patient_id", "elec_label", stats.in_regions(F.col("anat_label"), "(frontal|thalam|putamen|cingulate)").alias("scaffold"))


@query("""SELECT entry_id, CASE WHEN r = 1 THEN elec_label ELSE elec_label || '_' || r END AS label FROM (SELECT entry_id, elec_label, row_number() OVER (PARTITION BY patient_id, elec_label ORDER BY entry_id) AS r FROM electrode_metadata WHERE elec_label IS NOT NULL)""")
def unique_labels(spark: SparkSession, d: str) -> DataFrame:
    return source_tables.unique_labels(table(spark, d, "electrode_metadata").where("elec_label is not null"), "patient_id", "elec_label", "entry_id", "label").select("entry_id", "label")


@query("""WITH e AS (SELECT patient_id, elec_label AS name, min(anat_label) AS place FROM electrode_metadata WHERE elec_label IS NOT NULL AND anat_label IS NOT NULL GROUP BY 1, 2), c AS (SELECT DISTINCT patient_id, channel AS name FROM artifact_summary WHERE channel IS NOT NULL)
SELECT patient_id, name, place FROM e UNION ALL SELECT c.patient_id, c.name, NULL FROM c LEFT JOIN e ON e.patient_id IS NOT DISTINCT FROM c.patient_id AND e.name = c.name WHERE e.name IS NULL""")
def contacts_of_two_tables(spark: SparkSession, d: str) -> DataFrame:
    electrodes = table(spark, d, "electrode_metadata").where("anat_label is not null").select("patient_id", F.col("elec_label").alias("name"), F.col("anat_label").alias("place"))
    channels = table(spark, d, "artifact_summary").select("patient_id", F.col("channel").alias("name"), F.lit(None).cast("string").alias("place"))
    return source_tables.contacts_table(electrodes, channels, "patient_id", "name")


@query()
def bad_channels(spark: SparkSession, d: str) -> DataFrame:
    return quality.bad_channels(P.traces(spark, d))
