"""Queries of the engine's own operators over the given tables, with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrove.operators import connectivity, detections, directed, epoching, intervals, montage, quality, responses, spectral, stats, windows
from pulsegrove.plans import pipeline
from pulsegrove.plans import tables as P
from pulsegrove.session import table
from pulsegrove.sources import tables as source_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Decimals kept of doubles on both sides, as sums in another order differ in the last ones. Three more are rounded first, so
#: that a value half-way between two roundings is not decided by those last ones.
DECIMALS, MORE = 6, 3


def _round(column: str, decimals: int = DECIMALS) -> Column:
    return F.round(F.round(F.col(f"`{column}`"), decimals + MORE), decimals)


def rounding(sql: str) -> str:
    """``sql`` with each ``round(x, n)`` as the same two roundings, on decimals."""
    at = sql.find("round(")
    if at < 0:
        return sql
    depth, end, comma = 1, at + 6, 0
    while depth:
        depth += {"(": 1, ")": -1}.get(sql[end], 0)
        comma = end if sql[end] == "," and depth == 1 else comma
        end += 1
    inner, n = sql[at + 6 : comma], int(sql[comma + 1 : end - 1])
    return f"{sql[:at]}CAST(CAST(CAST({rounding(inner)} AS DECIMAL(38, {n + MORE})) AS DECIMAL(38, {n})) AS DOUBLE){rounding(sql[end:])}"


def query(sql: str | None = None, users: SimpleNamespace | None = None) -> Callable:
    """Registers a query and its SQL. ``users``: also ``.._by_user``, the same over each user's own readings instead of all
    users' hourly means, whose size is fixed; the function then takes the signal roles as its third argument."""

    def register(f: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def under(name: str, text: str | None, *roles: SimpleNamespace) -> Callable[[SparkSession, str], DataFrame]:
            def rounded(spark: SparkSession, d: str) -> DataFrame:
                df = f(spark, d, *roles)
                return df.select(*(_round(c).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes))

            QUERIES[name] = rounded
            if text:
                ORACLES[name] = rounding(text)
            return rounded

        if users:
            under(f"{f.__name__}_by_user", users.sql(sql), users)
            return under(f.__name__, sql, P.HOURLY)
        return under(f.__name__, sql)

    return register


def _day(name: str = "k"):
    return F.floor(F.col(name) / 24)


@query(f"""WITH {P.SQL_EPOCHED} SELECT channel, "offset", count(value) AS n_trials, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
round(stddev_samp(value) / sqrt(count(value)), 6) AS sem FROM epoched GROUP BY 1, 2""", users=P.BY_USER)
def epoch_mean_waveform(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    return epoching.mean_waveform(roles.epoched(spark, d))


@query(f"""WITH {P.SQL_EPOCHED}, m AS (SELECT channel, "offset", avg(value) AS mean FROM epoched GROUP BY 1, 2),
b AS (SELECT channel, avg(mean) AS bm, stddev_samp(mean) + 1e-12 AS bs FROM m WHERE "offset" BETWEEN -6 AND -1 GROUP BY 1),
p AS (SELECT channel, mean AS peak, "offset" AS latency, row_number() OVER (PARTITION BY channel ORDER BY abs(mean) DESC, "offset") AS r FROM m WHERE "offset" BETWEEN 1 AND 12),
a AS (SELECT channel, sqrt(avg(mean * mean)) AS rms, sum(abs(mean)) AS area FROM m WHERE "offset" BETWEEN 1 AND 12 GROUP BY 1)
SELECT p.channel, round(peak, 6) AS peak, latency, round(rms, 6) AS rms, round(area, 6) AS area, round(abs(peak - bm) / bs, 6) AS z, abs(peak - bm) / bs >= 3 AS significant
FROM p JOIN a USING (channel) JOIN b USING (channel) WHERE r = 1""", users=P.BY_USER)
def epoch_responses(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    return epoching.responses(epoching.mean_waveform(roles.epoched(spark, d)), (-P.BEFORE, -1), (1, P.AFTER), 3.0)


def _asof(spark: SparkSession, d: str, kind: str, forward: bool) -> DataFrame:
    events = table(spark, d, "events").withColumn("t", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))"))
    left = events.where(F.col("event_type") == "click").select("event_id", "user_id", "t")
    right = events.where(F.col("event_type") == kind).select("user_id", "t", "value")
    hit = epoching.asof(left, right, "user_id", "t", "value", F.floor(F.col("t") / 86_400_000_000), forward)
    return hit.select("event_id", F.col("matched_at").alias("at_us"), F.col("matched_value").alias("value"))


@query("""WITH e AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'error' GROUP BY 1, 2)
SELECT c.event_id, epoch_us(e.ts) AS at_us, round(e.value, 6) AS value FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN e ON c.user_id = e.user_id AND c.ts >= e.ts""")
def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, "error", False)


@query("""WITH e AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT c.event_id, epoch_us(e.ts) AS at_us, round(e.value, 6) AS value FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN e ON c.user_id = e.user_id AND c.ts <= e.ts""")
def asof_forward(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, "purchase", True)


@query(f"""WITH {P.SQL_HOURLY}, r AS (SELECT channel, min(k) AS lo, max(k) AS hi FROM hourly GROUP BY 1), g AS (SELECT channel, unnest(generate_series(lo, hi)) AS k FROM r),
f AS (SELECT g.channel, g.k, value FROM g LEFT JOIN hourly USING (channel, k)),
w AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN k END IGNORE NULLS) OVER b AS k0, last_value(value IGNORE NULLS) OVER b AS v0,
first_value(CASE WHEN value IS NOT NULL THEN k END IGNORE NULLS) OVER a AS k1, first_value(value IGNORE NULLS) OVER a AS v1 FROM f
WINDOW b AS (PARTITION BY channel ORDER BY k ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY channel ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT channel, k, round(value, 6) AS value, round(coalesce(value, v0 + (v1 - v0) * (k - k0) / (k1 - k0)), 6) AS filled FROM w""", users=P.BY_TRACE)
def signal_interpolated(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    signal = roles.signal(spark, d)
    grid = signal.groupBy("channel").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).select("channel", F.explode(F.sequence("lo", "hi")).alias("k"))
    return epoching.interpolated(grid.join(signal, ["channel", "k"], "left"), _day())


@query("""WITH s AS (SELECT raw_id, avg(max_ptp) AS m, stddev_samp(max_ptp) AS s FROM artifact_summary GROUP BY 1)
SELECT summary_id, round(CASE WHEN s > 0 THEN (max_ptp - m) / s END, 6) AS z FROM artifact_summary JOIN s USING (raw_id)""")
def score_within_recording(spark: SparkSession, d: str) -> DataFrame:
    return windows.group_moments(table(spark, d, "artifact_summary"), ["raw_id"], "max_ptp", "z").select("summary_id", "z")


@query("""SELECT summary_id, CASE WHEN n_bad_response IS NOT NULL THEN dense_rank() OVER (PARTITION BY raw_id ORDER BY n_bad_response DESC NULLS LAST) END AS rank FROM artifact_summary WHERE raw_id IS NOT NULL""")
def rank_within_recording(spark: SparkSession, d: str) -> DataFrame:
    ranked = windows.dense_rank_desc(table(spark, d, "artifact_summary").where("raw_id is not null"), ["raw_id"], "n_bad_response", "rank")
    return ranked.select("summary_id", F.col("rank").cast("long").alias("rank"))


@query("""WITH a AS (SELECT l_returnflag, median(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem GROUP BY 1),
b AS (SELECT l_returnflag, median(abs(l_extendedprice - m)) AS d FROM lineitem JOIN a USING (l_returnflag) GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, round((l_extendedprice - m) / CASE WHEN d > 0 THEN d * 1.4826 WHEN s > 0 THEN s ELSE 1 END, 6) AS score FROM lineitem JOIN a USING (l_returnflag) JOIN b USING (l_returnflag)""")
def robust_score(spark: SparkSession, d: str) -> DataFrame:
    return windows.robust_scores(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "score").select("l_orderkey", "l_linenumber", "l_partkey", "score")


@query("""WITH p AS (SELECT summary_id, model_id, hard_artifact_fraction AS p FROM artifact_summary WHERE model_id IS NOT NULL),
r AS (SELECT *, p * count(*) OVER (PARTITION BY model_id) / row_number() OVER (PARTITION BY model_id ORDER BY p, summary_id) AS raw,
row_number() OVER (PARTITION BY model_id ORDER BY p, summary_id) AS i FROM p WHERE p IS NOT NULL AND NOT isnan(p)),
q AS (SELECT summary_id, least(1.0, min(raw) OVER (PARTITION BY model_id ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)
SELECT summary_id, round(q, 6) AS q FROM p LEFT JOIN q USING (summary_id)""")
def adjusted_p(spark: SparkSession, d: str) -> DataFrame:
    return windows.adjusted_p(table(spark, d, "artifact_summary").where("model_id is not null"), ["model_id"], "hard_artifact_fraction", "q").select("summary_id", "q")


def _timed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("k", epoching.sample_index("ts", "SECOND"))


@query("""WITH w AS (SELECT event_id, event_type, value > 60 AS a, lag(value > 60, 1, false) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS b FROM events)
SELECT event_type, event_id, CASE WHEN a AND NOT b THEN 'rising' ELSE 'falling' END AS edge FROM w WHERE a <> b""")
def onsets(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    marked = windows.onsets(events, "event_type", F.to_date("ts"), ["ts", "event_id"], F.col("value") > 60)
    return marked.where("edge is not null").select("event_type", "event_id", "edge")


@query("""WITH t AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS k FROM events), l AS (SELECT *, k - lag(k) OVER (PARTITION BY user_id ORDER BY k, event_id) AS gap FROM t),
c AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY k, event_id ROWS UNBOUNDED PRECEDING) AS cluster FROM l)
SELECT user_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, min(k) AS start, max(k) AS stop FROM c GROUP BY 1, 2""")
def gap_clusters(spark: SparkSession, d: str) -> DataFrame:
    grouped = windows.clusters(_timed(spark, d), "user_id", "k", "event_id", 21600, F.floor(F.col("k") / 604800))
    return grouped.groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.min("k").alias("start"), F.max("k").alias("stop"))


@query(f"""WITH {P.SQL_HOURLY}, r AS (SELECT channel, k - row_number() OVER (PARTITION BY channel ORDER BY k) AS run FROM hourly WHERE value > 50),
n AS (SELECT channel, count(*) AS n FROM r GROUP BY channel, run) SELECT h.channel, coalesce(max(n.n), 0) AS longest FROM (SELECT DISTINCT channel FROM hourly) h LEFT JOIN n USING (channel) GROUP BY 1""", users=P.BY_TRACE)
def longest_runs(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    return windows.longest_runs(roles.signal(spark, d), "channel", "k", F.col("value") > 50)


@query(f"""WITH {P.SQL_EPOCHED}, m AS (SELECT channel, "offset", avg(value) AS mean FROM epoched GROUP BY 1, 2),
l AS (SELECT *, lag(mean) OVER w AS a, lead(mean) OVER w AS b FROM m WINDOW w AS (PARTITION BY channel ORDER BY "offset"))
SELECT channel, "offset", round(CASE WHEN a IS NULL THEN b - mean WHEN b IS NULL THEN mean - a ELSE (b - a) / 2 END, 6) AS gradient FROM l""", users=P.BY_USER)
def waveform_gradient(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    return windows.gradient(epoching.mean_waveform(roles.epoched(spark, d)), ["channel"], "offset", "mean").select("channel", "offset", "gradient")


@query(f"""WITH {P.SQL_EPOCHED}, w AS (SELECT channel, epoch, "offset", sum(CASE WHEN abs(value) <= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY channel, epoch ORDER BY "offset" ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS c FROM epoched WHERE "offset" >= 0)
SELECT channel, epoch, min("offset") FILTER (WHERE c = 3) AS settled_at FROM w GROUP BY 1, 2""", users=P.BY_USER)
def settled_trials(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    return windows.first_settled(roles.epoched(spark, d).where("offset >= 0"), ["channel", "epoch"], "offset", F.abs("value") <= 40, 3)


@query("""SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS smoothed FROM orders""")
def rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    return windows.rolling_mean(table(spark, d, "orders"), ["o_custkey"], F.trunc("o_orderdate", "year"), ["o_orderdate", "o_orderkey"], "o_totalprice", 5, "smoothed").select("o_orderkey", "smoothed")


@query(f"""WITH {P.SQL_HOURLY} SELECT channel, round(stddev_samp(value), 6) AS std, round(max(value) - min(value), 6) AS ptp, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing, round(median(abs(value)), 6) AS median_abs FROM hourly GROUP BY 1""", users=P.BY_TRACE)
def channel_features(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    return quality.channel_features(roles.signal(spark, d))


@query(f"""WITH {P.SQL_EPOCHED}, s AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY epoch, channel ORDER BY "offset")) AS step FROM epoched),
f AS (SELECT epoch, channel, max(abs(value)) AS peak_abs, max(value) - min(value) AS ptp, max(step) AS max_step, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS missing FROM s GROUP BY 1, 2)
SELECT epoch, channel, round(peak_abs, 6) AS peak_abs, round(ptp, 6) AS ptp, round(max_step, 6) AS max_step, round(missing, 6) AS missing FROM f""", users=P.BY_USER)
def trial_features(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    return quality.trial_features(roles.epoched(spark, d)).drop("saturation")


@query()
def trial_reasons(spark: SparkSession, d: str) -> DataFrame:
    return quality.with_reasons(quality.trial_features(P.session_epoched(spark, d)), 3.0).select("epoch", "channel", F.concat_ws(";", "reasons").alias("reasons"), "bad_response")


SQL_TOTALS = """t AS (SELECT raw_id, sum(n_epochs) AS n, sum(n_bad_response) AS b, sum(n_hard_artifact_response) AS h, sum(n_clean_response) AS c, max(max_saturation_fraction) AS s FROM artifact_summary GROUP BY 1),
x AS (SELECT raw_id, string_agg(reason, ';' ORDER BY reason) AS reasons FROM (SELECT DISTINCT raw_id, unnest(string_split(artifact_reasons, ';')) AS reason FROM artifact_summary) WHERE reason <> '' GROUP BY 1)"""


@query(f"""WITH {SQL_TOTALS} SELECT t.raw_id, CAST(n AS BIGINT) AS n_epochs, CAST(b AS BIGINT) AS n_bad, CAST(h AS BIGINT) AS n_hard, CAST(c AS BIGINT) AS n_clean, round(b / n, 6) AS bad_fraction, round(h / n, 6) AS hard_fraction, round(s, 6) AS max_saturation,
coalesce(reasons, '') AS reasons, coalesce(b / n < 0.25 AND h / n < 0.10 AND c >= 8, false) AS qc_pass FROM t LEFT JOIN x USING (raw_id)""")
def recording_gate(spark: SparkSession, d: str) -> DataFrame:
    return quality.gated(quality.artifact_totals(table(spark, d, "artifact_summary"), ["raw_id"]))


def _bad(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    return quality.trial_features(roles.epoched(spark, d)).where("peak_abs > 60")


SQL_BAD = """bad AS (SELECT epoch, channel FROM epoched GROUP BY 1, 2 HAVING max(abs(value)) > 60)"""


@query(f"""WITH {P.SQL_EPOCHED}, {SQL_BAD} SELECT e.epoch, e.channel, e."offset", round(CASE WHEN bad.epoch IS NULL THEN value END, 6) AS value FROM epoched e LEFT JOIN bad USING (epoch, channel)""", users=P.BY_USER)
def rejected_values(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    return quality.reject(roles.epoched(spark, d), _bad(spark, d, roles), "null").select("epoch", "channel", "offset", "value")


@query(f"""WITH {P.SQL_EPOCHED}, {SQL_BAD}, n AS (SELECT epoch, count(DISTINCT channel) AS n FROM epoched GROUP BY 1), b AS (SELECT epoch FROM bad JOIN n USING (epoch) GROUP BY epoch HAVING count(*) / any_value(n) >= 0.25),
k AS (SELECT * FROM epoched WHERE epoch NOT IN (SELECT epoch FROM b)) SELECT dense_rank() OVER (ORDER BY epoch) - 1 AS epoch, channel, "offset", round(value, 6) AS value FROM k""", users=P.BY_USER)
def rejected_epochs(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    return quality.reject(roles.epoched(spark, d), _bad(spark, d, roles), "epoch").select(F.col("epoch").cast("long").alias("epoch"), "channel", "offset", "value")


@query(f"""WITH {P.SQL_HOURLY} SELECT channel, k, round(value - avg(value) OVER (PARTITION BY k), 6) AS value FROM hourly""", users=P.BY_USER)
def reference_mean(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    return montage.common_reference(roles.signal(spark, d), ["k"], "mean").select("channel", "k", "value")


@query(f"""WITH {P.SQL_HOURLY}, m AS (SELECT k, median(value) AS m FROM hourly GROUP BY 1), a AS (SELECT k, any_value(m) AS m, median(abs(value - m)) AS d, count(*) AS n FROM hourly JOIN m USING (k) GROUP BY 1),
r AS (SELECT k, CASE WHEN count(*) FILTER (WHERE abs(value - m) <= 8 * 1.4826 * d) >= least(4, any_value(n)) THEN avg(value) FILTER (WHERE abs(value - m) <= 8 * 1.4826 * d) ELSE any_value(m) END AS ref FROM hourly JOIN a USING (k) GROUP BY 1)
SELECT channel, k, round(value - ref, 6) AS value FROM hourly JOIN r USING (k)""", users=P.BY_USER)
def reference_robust(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    return montage.common_reference(roles.signal(spark, d), ["k"], "robust_mean").select("channel", "k", "value")


@query(f"""WITH {P.SQL_CONTACTS} SELECT a.patient, a.lead || a.number || '-' || a.lead || (a.number + 1) AS channel, round(a.mni_x - b.mni_x, 6) AS value FROM contacts a JOIN contacts b ON a.patient = b.patient AND a.lead = b.lead AND b.number = a.number + 1""")
def bipolar(spark: SparkSession, d: str) -> DataFrame:
    return montage.bipolar(P.contacts(spark, d).withColumn("value", F.col("mni_x")), ["patient"])


@query(f"""WITH {P.SQL_CONTACTS} SELECT a.patient, a.lead, a.number, round(a.mni_x - coalesce(avg(b.mni_x), 0), 6) AS value FROM contacts a LEFT JOIN contacts b ON a.patient = b.patient AND a.lead = b.lead AND abs(b.number - a.number) = 1 GROUP BY 1, 2, 3, a.mni_x""")
def laplacian(spark: SparkSession, d: str) -> DataFrame:
    return montage.laplacian(P.contacts(spark, d).withColumn("value", F.col("mni_x")), ["patient"]).select("patient", "lead", "number", "value")


@query(f"""WITH {P.SQL_CONTACTS}, f AS (SELECT patient, lead, count(*) AS n, min(number) AS lowest, max(number) AS highest, regr_slope(mni_x, number) AS slope_mni_x, regr_intercept(mni_x, number) AS intercept_mni_x,
regr_slope(mni_y, number) AS slope_mni_y, regr_intercept(mni_y, number) AS intercept_mni_y, regr_slope(mni_z, number) AS slope_mni_z, regr_intercept(mni_z, number) AS intercept_mni_z FROM contacts
WHERE mni_x IS NOT NULL AND mni_y IS NOT NULL AND mni_z IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 4 AND max(number) > min(number))
SELECT patient, lead, n, lowest, highest, round(slope_mni_x, 6) AS slope_mni_x, round(intercept_mni_x, 6) AS intercept_mni_x, round(slope_mni_y, 6) AS slope_mni_y, round(intercept_mni_y, 6) AS intercept_mni_y, round(slope_mni_z, 6) AS slope_mni_z, round(intercept_mni_z, 6) AS intercept_mni_z FROM f""")
def lead_fits(spark: SparkSession, d: str) -> DataFrame:
    return stats.lead_fits(P.contacts(spark, d), ["patient"]).drop("rmse")


@query(f"""WITH {P.SQL_TRADE} SELECT source, target, round(avg(weight), 6) AS mean_weight, round(median(weight), 6) AS median_weight, round(sum(weight), 4) AS weight, count(*) AS n_edges FROM trade GROUP BY 1, 2""")
def edges_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return directed.collapse(P.trade(spark, d), []).withColumn("weight", _round("weight", 4))


@query(f"""WITH {P.SQL_TRADE}, e AS (SELECT source, target, sum(weight) AS w FROM trade GROUP BY 1, 2)
SELECT a.source, a.target, round(a.w, 4) AS forth, round(b.w, 4) AS back, round((a.w + b.w) / 2, 4) AS mean, round(log2(a.w / b.w), 6) AS asymmetry,
CASE WHEN a.w >= b.w THEN a.source || '->' || a.target ELSE a.target || '->' || a.source END AS dominant FROM e a JOIN e b ON a.source = b.target AND a.target = b.source AND a.source < a.target""")
def edges_both_ways(spark: SparkSession, d: str) -> DataFrame:
    pairs = directed.both_ways(directed.collapse(P.trade(spark, d), []), [])
    return pairs.withColumns({c: _round(c, 4) for c in ("forth", "back", "mean")})


@query(f"""WITH {P.SQL_TRADE}, e AS (SELECT month, source, target, bool_or(weight > 60000) AS r FROM trade GROUP BY 1, 2, 3),
p AS (SELECT a.month, a.r AS x, b.r AS y FROM e a JOIN e b ON a.month = b.month AND a.source = b.target AND a.target = b.source AND a.source < a.target)
SELECT CAST(month AS DATE) AS month, count(*) AS tested, count(*) FILTER (WHERE x OR y) AS any_response, count(*) FILTER (WHERE x AND y) AS both_respond, round(CASE WHEN count(*) FILTER (WHERE x OR y) > 0 THEN count(*) FILTER (WHERE x AND y) / count(*) FILTER (WHERE x OR y) END, 6) AS reciprocity FROM p GROUP BY 1""")
def edges_reciprocity(spark: SparkSession, d: str) -> DataFrame:
    return directed.reciprocity(P.trade(spark, d).withColumn("responds", F.col("weight") > 60000), ["month"])


@query(f"""WITH {P.SQL_TRADE}, o AS (SELECT source AS node, count(DISTINCT target) AS od, sum(weight) AS os FROM trade GROUP BY 1), i AS (SELECT target AS node, count(DISTINCT source) AS id, sum(weight) AS s FROM trade GROUP BY 1),
b AS (SELECT node, coalesce(od, 0) AS od, coalesce(os, 0) AS os, coalesce(id, 0) AS id, coalesce(s, 0) AS s FROM o FULL JOIN i USING (node))
SELECT node, od AS out_degree, round(os, 4) AS out_strength, id AS in_degree, round(s, 4) AS in_strength, round(os + s, 4) AS strength, round(os / sum(os) OVER (), 6) AS out_share, round(s / sum(s) OVER (), 6) AS in_share, round((os - s) / (os + s), 6) AS sender_receiver FROM b""")
def node_strengths(spark: SparkSession, d: str) -> DataFrame:
    return directed.strengths(P.trade(spark, d)).withColumns({c: _round(c, 4) for c in ("out_strength", "in_strength", "strength")})


@query(f"""WITH {P.SQL_TRADE}, e AS (SELECT source, target, sum(weight) AS weight FROM trade GROUP BY 1, 2)
SELECT source, target, round(weight, 4) AS weight, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY weight DESC, target) AS INTEGER) AS rank FROM e) WHERE rank <= 3""")
def strongest_edges(spark: SparkSession, d: str) -> DataFrame:
    return directed.strongest(directed.collapse(P.trade(spark, d), []), 3).select("source", "target", _round("weight", 4).alias("weight"), "rank")


#: All of the fixed table of nations.
NODES = [f"NATION_{i}" for i in range(25)]


@query(f"""WITH {P.SQL_TRADE} SELECT source, """ + ", ".join(f"round(coalesce(avg(weight) FILTER (WHERE target = '{n}'), 0), 6) AS {n}" for n in NODES) + " FROM trade GROUP BY 1")
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return directed.adjacency(P.trade(spark, d), NODES)


@query(f"""WITH {P.SQL_TRADE}, e AS (SELECT source, target, avg(weight) AS w FROM trade GROUP BY 1, 2), p AS (SELECT DISTINCT t.source, n_name AS target FROM trade t CROSS JOIN nation)
SELECT source, target, round(coalesce(w, 0), 6) AS weight FROM p LEFT JOIN e USING (source, target)""")
def adjacency_cells(spark: SparkSession, d: str) -> DataFrame:
    return directed.adjacency_cells(P.trade(spark, d), table(spark, d, "nation").select(F.col("n_name").alias("node")))


@query()
def page_rank(spark: SparkSession, d: str) -> DataFrame:
    return directed.page_rank(P.trade(spark, d))


@query(f"""WITH {P.SQL_TRADE}, w AS (SELECT source, month, target, sum(weight) AS w FROM trade GROUP BY 1, 2, 3), t AS (SELECT source, month, sum(w) AS t FROM w GROUP BY 1, 2), n AS (SELECT source, count(DISTINCT target) AS n FROM trade GROUP BY 1),
h AS (SELECT source, month, any_value(t) AS total, count(*) AS active, -sum(w / t * ln(w / t)) AS h FROM w JOIN t USING (source, month) GROUP BY 1, 2)
SELECT source, CAST(month AS DATE) AS month, round(total, 4) AS total, active, round(active / n, 6) AS participation, round(h / ln(n), 6) AS entropy, round(exp(h), 6) AS effective_targets FROM h JOIN n USING (source)""")
def target_shares(spark: SparkSession, d: str) -> DataFrame:
    return directed.target_shares(P.trade(spark, d), ["source"], "month").withColumn("total", _round("total", 4))


@query(f"""WITH {P.SQL_DECISIONS}, o AS (SELECT record_id, rater, bool_or(call) AS c FROM decisions GROUP BY 1, 2)
SELECT record_id, count(c) AS n_available, count(*) FILTER (WHERE c) AS n_called, CASE WHEN count(c) > 0 THEN count(*) FILTER (WHERE c) >= 2 END AS consensus, coalesce(string_agg(rater, '+' ORDER BY rater) FILTER (WHERE c), 'none') AS pattern FROM o GROUP BY 1""")
def decision_consensus(spark: SparkSession, d: str) -> DataFrame:
    return detections.consensus(P.decisions(spark, d), "record_id", "rater", "call", 2)


@query("""SELECT raw_id, """ + ", ".join(f"coalesce(bool_or(bad_response_fraction > 0.2) FILTER (WHERE model_id = {m}), false) AS \"{m}\"" for m in range(1, 13)) + " FROM artifact_summary GROUP BY 1")
def decision_matrix(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "artifact_summary").withColumn("call", F.col("bad_response_fraction") > 0.2)
    return detections.matrix(calls, "raw_id", "model_id", "call", list(range(1, 13)))


@query("""SELECT raw_id, m.model_id, coalesce(bool_or(bad_response_fraction > 0.2) FILTER (WHERE a.model_id = m.model_id), false) AS call FROM artifact_summary a CROSS JOIN n1_models m GROUP BY 1, 2""")
def decision_cells(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "artifact_summary").withColumn("call", F.col("bad_response_fraction") > 0.2)
    return detections.cells(calls, "raw_id", "model_id", "call", table(spark, d, "n1_models"))


@query("""WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS k FROM events)
SELECT a.event_id, count(*) AS n, round(sum(b.value), 6) AS total FROM e a JOIN e b ON a.user_id = b.user_id AND b.k BETWEEN a.k - 7200 AND a.k + 7200 WHERE a.event_type = 'error' GROUP BY 1""")
def events_near_errors(spark: SparkSession, d: str) -> DataFrame:
    events = _timed(spark, d)
    around = events.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", (F.col("k") - 7200).alias("start"), (F.col("k") + 7200).alias("stop"))
    hits = intervals.within(events.select("user_id", "k", "value"), around, "user_id", "k", "start", "stop", 14400)
    return hits.groupBy(F.col("error_id").alias("event_id")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("""WITH RECURSIVE t AS (SELECT DISTINCT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS k FROM events),
f AS (SELECT event_type, min(k) AS k FROM t GROUP BY 1 UNION ALL SELECT f.event_type, (SELECT min(t.k) FROM t WHERE t.event_type = f.event_type AND t.k >= f.k + 7200) FROM f WHERE f.k IS NOT NULL)
SELECT event_type, k FROM f WHERE k IS NOT NULL""")
def thinned_events(spark: SparkSession, d: str) -> DataFrame:
    return intervals.thinned(_timed(spark, d), "event_type", "k", 7200)


@query("""WITH m AS (SELECT p_brand AS g, count(*) AS n, avg(p_retailprice) AS m, var_samp(p_retailprice) AS v FROM part GROUP BY 1)
SELECT a.g AS group_a, b.g AS group_b, a.n AS n_a, b.n AS n_b, round(a.m, 6) AS mean_a, round(b.m, 6) AS mean_b, round(a.m - b.m, 6) AS difference, round((a.m - b.m) / sqrt((a.v + b.v) / 2), 6) AS cohen_d,
round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round((a.v / a.n + b.v / b.n) * (a.v / a.n + b.v / b.n) / (a.v / a.n * a.v / a.n / (a.n - 1) + b.v / b.n * b.v / b.n / (b.n - 1)), 6) AS df FROM m a JOIN m b ON a.g < b.g""")
def group_comparison(spark: SparkSession, d: str) -> DataFrame:
    return stats.compare_groups(table(spark, d, "part"), "p_brand", "p_retailprice")


@query()
def group_p_values(spark: SparkSession, d: str) -> DataFrame:
    pairs = stats.compare_groups(table(spark, d, "part"), "p_brand", "p_retailprice").withColumn("p", stats.t_p_value("t", "df"))
    return windows.adjusted_p(pairs.withColumn("family", F.lit(1)), ["family"], "p", "q").select("group_a", "group_b", "p", "q")


@query(f"""WITH {P.SQL_HOURLY} SELECT a.channel AS a, b.channel AS b, count(*) AS n, round(corr(a.value, b.value), 6) AS r FROM hourly a JOIN hourly b USING (k) WHERE a.channel < b.channel GROUP BY 1, 2""", users=P.BY_USER)
def channel_correlation(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    return stats.correlations(roles.signal(spark, d))


@query(f"""WITH {P.SQL_HOURLY}, r AS (SELECT channel, min(value) AS lo, max(value) AS hi FROM hourly GROUP BY 1), c AS (SELECT k, channel, least(floor((value - lo) / (hi - lo) * 8), 7) AS cell FROM hourly JOIN r USING (channel)),
j AS (SELECT a.channel AS a, b.channel AS b, a.cell AS i, b.cell AS j, count(*) AS n FROM c a JOIN c b USING (k) WHERE a.channel < b.channel GROUP BY a.channel, b.channel, a.cell, b.cell),
x AS (SELECT *, sum(n) OVER (PARTITION BY a, b, i) AS ni, sum(n) OVER (PARTITION BY a, b, j) AS nj, sum(n) OVER (PARTITION BY a, b) AS m FROM j)
SELECT a, b, round(sum(n / m * ln(n * m / (ni * nj))), 6) AS mi FROM x GROUP BY 1, 2""", users=P.BY_USER)
def mutual_information(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    return stats.mutual_information(roles.signal(spark, d), 8)


@query()
def sign_flips(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "artifact_summary").select("raw_id", "summary_id", (F.col("bad_response_fraction") - 0.15).alias("x"))
    return stats.sign_flips(values, ["raw_id"], "x", "summary_id")


@query("""SELECT elec_label, regexp_replace(regexp_replace(upper(regexp_replace(regexp_replace(elec_label, '^(?i)pol\\s+', ''), '(?i)[-/_ ]*ref$', '')), '[^A-Z0-9]', '', 'g'), '(^|[^0-9])0+([0-9])', '\\1\\2', 'g') AS label_key, count(*) AS n
FROM electrode_metadata WHERE elec_label IS NOT NULL GROUP BY 1, 2""")
def label_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "electrode_metadata").where("elec_label is not null").groupBy("elec_label", montage.label_key(F.col("elec_label")).alias("label_key")).agg(F.count("*").alias("n"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("channel"), F.transform("embedding", lambda x: x.cast("double")).alias("y"))


#: Samples a second that the vectors are taken to have.
RATE = 64.0


@query()
def power_spectra(spark: SparkSession, d: str) -> DataFrame:
    return spectral.power_spectra(_packed(spark, d), "channel", RATE, 32)


@query()
def band_power(spark: SparkSession, d: str) -> DataFrame:
    return spectral.band_power(spectral.power_spectra(_packed(spark, d), "channel", RATE, 32), "channel", {"low": (1.0, 8.0), "middle": (8.0, 16.0), "high": (16.0, 32.0)})


@query()
def wavelet_power(spark: SparkSession, d: str) -> DataFrame:
    return spectral.wavelet_power(_packed(spark, d), "channel", RATE, [8.0, 12.0, 20.0])


@query()
def phase_locking(spark: SparkSession, d: str) -> DataFrame:
    trials = spectral.packed(P.bridged_epoched(spark, d), ["epoch", "channel"], "offset", "value").where(F.size("y") == P.BEFORE + P.AFTER + 1)
    return spectral.phase_locking(spectral.bandpassed(trials, 0.05, 0.3, 1.0, 2), "epoch", "channel")


@query()
def response_calls(spark: SparkSession, d: str) -> DataFrame:
    return responses.calls(P.bridged_epoched(spark, d), (-P.BEFORE, -1), (1, P.AFTER))


@query()
def clustered_interval(spark: SparkSession, d: str) -> DataFrame:
    return stats.bootstrap_interval(table(spark, d, "artifact_summary"), "patient_id", "bad_response_fraction", 400, 17)


@query(f"""WITH {P.SQL_HOURLY}, m AS (SELECT channel, median(value) AS med FROM hourly GROUP BY 1), o AS (SELECT channel, k, abs(value - med) AS off FROM hourly JOIN m USING (channel)), s AS (SELECT channel, median(off) * 1.4826 AS mad FROM o GROUP BY 1),
a AS (SELECT channel, k, off >= least(60.0, greatest(10.0, 2 * mad)) AS x FROM o JOIN s USING (channel)), r AS (SELECT channel, k FROM (SELECT *, lag(x, 1, false) OVER (PARTITION BY channel ORDER BY k) AS y FROM a) WHERE x AND NOT y),
g AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 1 THEN 1 ELSE 0 END) OVER (ORDER BY k, channel ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, k - lag(k) OVER (ORDER BY k, channel) AS d FROM r))
SELECT CAST(round_even(median(k), 0) AS BIGINT) AS k, count(DISTINCT channel) AS n_channels FROM g GROUP BY c HAVING count(DISTINCT channel) >= 2""", users=P.BY_TRACE)
def consensus_events(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    return windows.consensus_events(windows.threshold_events(roles.signal(spark, d), 2.0, 10.0, 60.0, _day()), 1, 2, F.floor(F.col("k") / 4096))


@query(f"""WITH {P.SQL_HOURLY}, a AS (SELECT DISTINCT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h FROM events WHERE event_type = 'error' AND value > 80), x AS (SELECT DISTINCT unnest([h, h + 1]) AS k FROM a),
f AS (SELECT channel, k, CASE WHEN x.k IS NULL THEN value END AS value FROM hourly LEFT JOIN x USING (k)),
w AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN k END IGNORE NULLS) OVER b AS k0, last_value(value IGNORE NULLS) OVER b AS v0, first_value(CASE WHEN value IS NOT NULL THEN k END IGNORE NULLS) OVER c AS k1, first_value(value IGNORE NULLS) OVER c AS v1 FROM f
WINDOW b AS (PARTITION BY channel ORDER BY k ROWS UNBOUNDED PRECEDING), c AS (PARTITION BY channel ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT channel, k, round(coalesce(value, v0 + (v1 - v0) * (k - k0) / (k1 - k0), v0, v1), 6) AS filled FROM w""", users=P.BY_TRACE)
def artifact_blanking(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    return epoching.blanked(roles.signal(spark, d), roles.pulses(spark, d), 0, 1, _day()).select("channel", "k", "filled")


@query(f"""WITH {P.SQL_EPOCHED} SELECT epoch, "offset", round(CASE WHEN count(value) > 2 THEN quantile_cont(abs(value), 0.95) ELSE max(abs(value)) END, 6) AS envelope FROM epoched GROUP BY 1, 2""", users=P.BY_USER)
def artifact_envelope(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    return epoching.artifact_envelope(roles.epoched(spark, d))


@query(f"""WITH {P.SQL_TRADE}, e AS (SELECT source, target, count(*) AS n FROM trade GROUP BY 1, 2) SELECT least(source, target) AS source, greatest(source, target) AS target, sum(n)::BIGINT AS n FROM e GROUP BY 1, 2""")
def undirected_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = P.trade(spark, d).groupBy("source", "target").agg(F.count("*").alias("n")).withColumn("undirected", F.lit(True))
    return directed.canonical_edges(edges, "undirected", []).groupBy("source", "target").agg(F.sum("n").alias("n"))


@query(f"""WITH {P.SQL_TRADE}, r AS (SELECT n_name AS node, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey), e AS (SELECT source, target, count(*) AS n FROM trade GROUP BY 1, 2)
SELECT source, target, n, a.region = b.region AS same_region FROM e JOIN r a ON a.node = source JOIN r b ON b.node = target""")
def same_region(spark: SparkSession, d: str) -> DataFrame:
    regions = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("node"), F.col("r_name").alias("region"))
    return directed.same_region(P.trade(spark, d).groupBy("source", "target").agg(F.count("*").alias("n")), regions)


@query("""WITH t AS (SELECT model_id, count(*) AS n, count(*) FILTER (WHERE n_hard_artifact_response > 0) AS hits FROM artifact_summary GROUP BY 1), p AS (SELECT *, hits / n AS p, 1.959963984540054 AS z FROM t)
SELECT model_id, n, hits, round(p, 6) AS rate, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM p""")
def artifact_rates(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "artifact_summary").groupBy("model_id").agg(F.count("*").alias("n"), F.sum((F.col("n_hard_artifact_response") > 0).cast("long")).alias("hits"))
    low, high = stats.wilson(F.col("hits"), F.col("n"))
    return counts.select("model_id", "n", "hits", (F.col("hits") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


@query()
def coherence(spark: SparkSession, d: str) -> DataFrame:
    trials = spectral.packed(P.bridged_epoched(spark, d), ["epoch", "channel"], "offset", "value").where(F.size("y") == P.BEFORE + P.AFTER + 1)
    return connectivity.coherence(trials, "epoch", "channel", 1.0, 0.05, 0.3)


@query()
def granger(spark: SparkSession, d: str) -> DataFrame:
    return connectivity.granger_over_lines(P.lines(spark, d), "session", 2)


@query()
def phase_amplitude(spark: SparkSession, d: str) -> DataFrame:
    return connectivity.phase_amplitude(_packed(spark, d), "channel", RATE, (3.0, 7.0), (14.0, 28.0))


@query()
def hubs_authorities(spark: SparkSession, d: str) -> DataFrame:
    return directed.hubs_authorities(P.trade(spark, d), 8)


@query(f"""WITH {P.SQL_EPOCHED}, m AS (SELECT channel, "offset", avg(value) AS mean FROM epoched GROUP BY 1, 2), b AS (SELECT channel, avg(mean) AS bm, stddev_samp(mean) + 1e-12 AS bs FROM m WHERE "offset" BETWEEN -6 AND -1 GROUP BY 1),
z AS (SELECT channel, "offset", (mean - bm) / bs AS z FROM m JOIN b USING (channel)), r AS (SELECT channel, max(abs(z)) FILTER (WHERE "offset" BETWEEN 1 AND 3) AS e, max(abs(z)) FILTER (WHERE "offset" BETWEEN 3 AND 12) AS l,
coalesce(min(z) FILTER (WHERE "offset" BETWEEN 1 AND 12) <= -1 AND max(z) FILTER (WHERE "offset" BETWEEN 1 AND 12) >= 1, false) AS reversal FROM z GROUP BY 1)
SELECT channel, round(e, 6) AS early_z, round(l, 6) AS late_z, reversal, greatest(e, l) >= 2 AND reversal AS significant FROM r""", users=P.BY_USER)
def early_late_z(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    return responses.early_late_z(epoching.mean_waveform(roles.epoched(spark, d)), (-6, -1), (1, 3), (3, 12), 2.0)


@query(f"""WITH {P.SQL_EPOCHED}, e AS (SELECT epoch, "offset", CASE WHEN count(value) > 2 THEN quantile_cont(abs(value), 0.95) ELSE max(abs(value)) END AS v FROM epoched GROUP BY 1, 2),
m AS (SELECT epoch, median(v) AS m FROM e WHERE "offset" BETWEEN -6 AND -1 GROUP BY 1), s AS (SELECT epoch, median(abs(v - m)) AS d FROM e JOIN m USING (epoch) WHERE "offset" BETWEEN -6 AND -1 GROUP BY 1),
z AS (SELECT epoch, (v - m) / CASE WHEN d > 1e-9 THEN d * 1.4826 ELSE 1 END AS z FROM e JOIN m USING (epoch) JOIN s USING (epoch) WHERE "offset" = 0) SELECT epoch, round(z, 6) AS z, z >= 6 AS artifact FROM z""", users=P.BY_USER)
def zero_artifacts(spark: SparkSession, d: str, roles: SimpleNamespace) -> DataFrame:
    return responses.zero_artifacts(epoching.artifact_envelope(roles.epoched(spark, d)), (-6, -1))


@query(f"""WITH {P.SQL_TRADE}, e AS (SELECT source, month, target, sum(weight) AS weight FROM trade GROUP BY 1, 2, 3)
SELECT source, CAST(month AS DATE) AS month, target, round(weight, 4) AS weight, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source, month ORDER BY weight DESC, target) AS INTEGER) AS rank FROM e) WHERE rank <= 2""")
def strongest_over_time(spark: SparkSession, d: str) -> DataFrame:
    return directed.strongest_over_time(P.trade(spark, d), "month", 2).withColumn("weight", _round("weight", 4))


@query(f"""WITH {P.SQL_TRADE}, w AS (SELECT source, month, target, sum(weight) AS w FROM trade GROUP BY 1, 2, 3), t AS (SELECT source, month, sum(w) AS t FROM w GROUP BY 1, 2), b AS (SELECT *, lag(month) OVER (PARTITION BY source ORDER BY month) AS prev FROM t),
p AS (SELECT source, month, target, w / t AS p FROM w JOIN t USING (source, month)), k AS (SELECT b.source, b.month, b.prev, x.target FROM b JOIN p x ON x.source = b.source AND x.month IN (b.month, b.prev) WHERE prev IS NOT NULL GROUP BY ALL),
j AS (SELECT k.source, k.month, coalesce(a.p, 0) AS a, coalesce(c.p, 0) AS c FROM k LEFT JOIN p a ON a.source = k.source AND a.month = k.month AND a.target = k.target LEFT JOIN p c ON c.source = k.source AND c.month = k.prev AND c.target = k.target)
SELECT source, CAST(month AS DATE) AS month, round(sum(CASE WHEN a > 0 THEN a * log2(a / ((a + c) / 2)) ELSE 0 END + CASE WHEN c > 0 THEN c * log2(c / ((a + c) / 2)) ELSE 0 END) / 2, 6) AS jsd FROM j GROUP BY 1, 2""")
def target_divergence(spark: SparkSession, d: str) -> DataFrame:
    return directed.target_divergence(P.trade(spark, d), ["source"], "month", F.trunc("month", "year"))


@query()
def decimated_vectors(spark: SparkSession, d: str) -> DataFrame:
    out, name = pipeline.run(_packed(spark, d), [("bandpass", {"low": 1.0, "high": 20.0}), ("decimate", {"factor": 2})], RATE)
    return out.select("vec_id", F.lit(name).alias("pipeline"), F.posexplode("y").alias("k", "value"))


@query("""SELECT stim_pair AS written, CASE WHEN regexp_matches(stim_pair, '^\\s*([A-Za-z]+)0*([0-9]+)\\s*[-_/ ]\\s*([A-Za-z]*)0*([0-9]+)\\s*$') AND regexp_extract(stim_pair, '^\\s*([A-Za-z]+)0*([0-9]+)\\s*[-_/ ]\\s*([A-Za-z]*)0*([0-9]+)\\s*$', 3) IN ('', regexp_extract(stim_pair, '^\\s*([A-Za-z]+)', 1))
THEN regexp_replace(stim_pair, '^\\s*([A-Za-z]+)0*([0-9]+)\\s*[-_/ ]\\s*([A-Za-z]*)0*([0-9]+)\\s*$', '\\1_\\2_\\4') ELSE trim(stim_pair) END AS stim_pair, count(*) AS n FROM stim_metadata WHERE stim_pair IS NOT NULL GROUP BY 1, 2""")
def stim_pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stim_metadata").where("stim_pair is not null").groupBy(F.col("stim_pair").alias("written"), source_tables.stim_pair(F.col("stim_pair")).alias("stim_pair")).agg(F.count("*").alias("n"))
