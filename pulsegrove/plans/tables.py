"""How the given tables play the engine's roles: signals, epochs, contacts and edges."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrove.operators import epoching, montage
from pulsegrove.session import table

BEFORE, AFTER = 6, 12
#: Hours between the sessions of neighbouring users where they share one axis: more than any window or span of a session.
SESSION = 1 << 24


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """channel, k, value: the hourly mean of each kind of event."""
    return epoching.regular_grid(table(spark, d, "events"), "event_type", epoching.sample_index("ts"), "value")


def anchors(spark: SparkSession, d: str) -> DataFrame:
    """k: the hours with an error event."""
    return table(spark, d, "events").where("event_type = 'error'").select(epoching.sample_index("ts").alias("k")).distinct()


def epoched(spark: SparkSession, d: str) -> DataFrame:
    return epoching.baseline_centered(epoching.epochs(hourly(spark, d), anchors(spark, d), BEFORE, AFTER), -BEFORE, -1)


def _session_hour():
    """Hours on one axis for all users: no window around an hour reaches another user's hours."""
    return F.col("user_id") * SESSION + epoching.sample_index("ts")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """channel, k, value: the hourly mean of each kind of event of each user, nearly always a single reading."""
    return epoching.regular_grid(table(spark, d, "events"), "event_type", _session_hour(), "value")


def traces(spark: SparkSession, d: str) -> DataFrame:
    """``sessions`` with a channel for each user and kind of event."""
    named = table(spark, d, "events").withColumn("trace", F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type"))
    return epoching.regular_grid(named, "trace", _session_hour(), "value")


def session_anchors(spark: SparkSession, d: str) -> DataFrame:
    """k: the hours with an error event of each user."""
    return table(spark, d, "events").where("event_type = 'error'").select(_session_hour().alias("k")).distinct()


def _in_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(spark, d).withColumn("session", F.floor(F.col("k") / SESSION))


def bridged(spark: SparkSession, d: str) -> DataFrame:
    """``sessions`` with the hours between two readings of a user's channel filled linearly, for operators that need whole trials."""
    return epoching.bridged(_in_sessions(spark, d), "session", F.floor(F.col("k") / 168))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """The ends of the lines that ``bridged`` fills, a row per reading."""
    return epoching.lines(_in_sessions(spark, d), "session", F.floor(F.col("k") / 168))


def session_epoched(spark: SparkSession, d: str) -> DataFrame:
    return epoching.baseline_centered(epoching.epochs(sessions(spark, d), session_anchors(spark, d), BEFORE, AFTER, F.floor(F.col("k") / SESSION)), -BEFORE, -1)


def bridged_epoched(spark: SparkSession, d: str) -> DataFrame:
    return epoching.baseline_centered(epoching.epochs(bridged(spark, d), session_anchors(spark, d), BEFORE, AFTER, F.floor(F.col("k") / SESSION), table(spark, d, "events").select(_session_hour().alias("k"))), -BEFORE, -1)


LEAD = r"^([A-Z]+)([0-9]{1,3})$"


def contacts(spark: SparkSession, d: str) -> DataFrame:
    """patient, lead, number, mni_x.. of all entries whose label, by its key, is a lead and a number; repeats averaged."""
    rows = table(spark, d, "electrode_metadata").withColumn("_key", montage.label_key(F.col("elec_label"))).where(F.col("_key").rlike(LEAD))
    patient = F.upper(F.regexp_replace("patient_id", r"^(?i)sub-", ""))
    real = lambda c: F.avg(F.when(~F.isnan(c), F.col(c))).alias(c)
    named = rows.select(patient.alias("patient"), F.regexp_extract("_key", LEAD, 1).alias("lead"), F.regexp_extract("_key", LEAD, 2).cast("int").alias("number"), "mni_x", "mni_y", "mni_z")
    return named.groupBy("patient", "lead", "number").agg(*map(real, ("mni_x", "mni_y", "mni_z")))


def trade(spark: SparkSession, d: str) -> DataFrame:
    """source, target, month, weight: what suppliers' nations ship to customers' nations."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.trunc("l_shipdate", "month").alias("month"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("weight"))
    buyers = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    sellers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    # the nations are a fixed table of 25 rows
    names = F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_name"))
    edges = lines.join(buyers, "l_orderkey").join(sellers, "l_suppkey")
    edges = edges.join(names.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("source")), "s_nationkey")
    return edges.join(names.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("target")), "c_nationkey").select("source", "target", "month", "weight")


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """record_id, rater, call: whether a rater saw a response; null for no label."""
    label = F.when(~F.isnan("raw_annotation") & (F.col("raw_annotation") >= 0), F.col("raw_annotation") > 0)
    return table(spark, d, "annotations").select("record_id", "rater", label.alias("call"))


#: What tells recordings apart on the axis k: nothing, or the user.
SQL_PART = "CAST(0 * k AS BIGINT)"
#: The same roles in SQL, put before an oracle's own text.
SQL_HOURLY = """hourly AS (SELECT event_type AS channel, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS k, avg(value) AS value FROM events GROUP BY 1, 2)"""
SQL_EPOCHED = SQL_HOURLY + f""", anchors AS (SELECT DISTINCT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h FROM events WHERE event_type = 'error'),
spans AS (SELECT {SQL_PART} AS part, min(k) AS lo, max(k) AS hi FROM hourly GROUP BY 1), inner_anchors AS (SELECT h FROM (SELECT h, h AS k FROM anchors) a JOIN spans ON part = {SQL_PART} AND h - {BEFORE} >= lo AND h + {AFTER} <= hi),
raw_epochs AS (SELECT h AS epoch, channel, CAST(k - h AS INTEGER) AS "offset", value FROM inner_anchors JOIN hourly ON k BETWEEN h - {BEFORE} AND h + {AFTER}),
epoched AS (SELECT epoch, channel, "offset", value - avg(value) FILTER (WHERE "offset" BETWEEN -{BEFORE} AND -1) OVER (PARTITION BY epoch, channel) AS value FROM raw_epochs)"""
def sql_label_key(label: str) -> str:
    bare = f"regexp_replace(regexp_replace({label}, '^(?i)pol\\s+', ''), '(?i)[-/_ ]*ref$', '')"
    return f"regexp_replace(regexp_replace(upper({bare}), '[^A-Z0-9]', '', 'g'), '(^|[^0-9])0+([0-9])', '\\1\\2', 'g')"


SQL_CONTACTS = f"""keyed AS (SELECT *, {sql_label_key("elec_label")} AS label_key FROM electrode_metadata),
contacts AS (SELECT upper(regexp_replace(patient_id, '^(?i)sub-', '')) AS patient, regexp_extract(label_key, '^([A-Z]+)([0-9]+)$', 1) AS lead,
CAST(regexp_extract(label_key, '^([A-Z]+)([0-9]+)$', 2) AS INTEGER) AS number, avg(mni_x) FILTER (WHERE NOT isnan(mni_x)) AS mni_x, avg(mni_y) FILTER (WHERE NOT isnan(mni_y)) AS mni_y,
avg(mni_z) FILTER (WHERE NOT isnan(mni_z)) AS mni_z FROM keyed WHERE regexp_matches(label_key, '^[A-Z]+[0-9]{{1,3}}$') GROUP BY 1, 2, 3)"""
SQL_TRADE = """trade AS (SELECT s.n_name AS source, t.n_name AS target, date_trunc('month', l_shipdate) AS month, l_extendedprice * (1 - l_discount) AS weight FROM lineitem
JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation s ON s.n_nationkey = s_nationkey JOIN nation t ON t.n_nationkey = c_nationkey)"""
SQL_DECISIONS = """decisions AS (SELECT record_id, rater, CASE WHEN NOT isnan(raw_annotation) AND raw_annotation >= 0 THEN raw_annotation > 0 END AS call FROM annotations)"""


SQL_HOUR, SQL_CHANNEL = "CAST(floor(epoch(ts) / 3600) AS BIGINT)", "event_type AS channel"


def _pulses(hour):
    return lambda spark, d: table(spark, d, "events").where("event_type = 'error' and value > 80").select(hour().alias("k")).distinct()


#: The signal roles: of all users' hourly means, of each user's readings, and of those with a channel per user.
HOURLY = SimpleNamespace(signal=hourly, epoched=epoched, pulses=_pulses(lambda: epoching.sample_index("ts")), sql=lambda sql: sql)
BY_USER = SimpleNamespace(signal=sessions, epoched=session_epoched, pulses=_pulses(_session_hour), sql=lambda sql: sql.replace(SQL_HOUR, f"(user_id * {SESSION} + {SQL_HOUR})").replace(SQL_PART, f"k // {SESSION}"))
BY_TRACE = SimpleNamespace(signal=traces, epoched=None, pulses=_pulses(_session_hour), sql=lambda sql: BY_USER.sql(sql).replace(SQL_CHANNEL, "user_id || ':' || event_type AS channel"))
