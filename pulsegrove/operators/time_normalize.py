"""Problem 2: times written in many formats and zones, brought to one UTC instant each.

Every text gives the array of all its valid readings (``functions.times``): date orders, clock changes and zones make
none, one or several. A Viterbi pass over each source's records, in the order in which they were loaded, decides among
several, penalising a change of format and a step back in time; a reading against the order that the site declares costs
as much as three changes of format beforehand, so a consistent run of neighbours outweighs it. A date is certain (status
``instant``) if every path through another reading of it costs at least ``GAP`` more, the site declares an order and its
local time exists once; the others keep the picked instant with a status that says what is open.

Statuses: ``instant``; ``doubled`` (a local time that the clock change shows twice, best guess given); ``inferred``
(the order of the date is only inferred: no order is declared, only another than the declared one gives a date, or the
paths cost nearly the same); ``none`` (missing, impossible or skipped by the clock change, no instant).
Defined results: null, blank and placeholder texts give ``none``; events without their recording, or whose recording
has no certain start, give ``none`` for relative onsets and clock times; repeated rows come out once each by their ids;
very long texts match no layout; empty tables give empty tables; extra columns are not carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrove.functions import times as T
from pulsegrove.operators.viterbi import BACKWARD_COST, SWITCH_COST, cheapest_readings
from pulsegrove.session import cut

SECONDS = r"^\s*(\d{1,9})(?:[.,](\d+))?\s*(?:s|sec|secs|second|seconds)?\s*$"
MILLIS = r"^\s*(\d{1,15})(?:[.,](\d+))?\s*(?:ms|msec|msecs|millisecond|milliseconds)\s*$"
SAMPLES = r"^\s*(?:(?:#|smp|samp|sample|samples|n=)\s*(\d{1,15})|(\d{1,15})\s*(?:smp|samp|sample|samples))\s*$"
ELAPSED = r"^\s*\+(\d{1,6}):(\d{2}):(\d{2})(?:[.,](\d+))?\s*$"
DURATION = r"^\s*\+?PT(?=\d)(?:(\d{1,6})H)?(?:(\d{1,8})M)?(?:(\d{1,9})(?:[.,](\d+))?S)?\s*$"
CLOCK_ONLY = r"^\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?\s*([AaPp]\.?[Mm]\.?)?\s*$"


#: What a path through another reading must cost more for a date to be certain; half a change of format.
GAP = 0.5


def resolve(records: DataFrame, switch: float = SWITCH_COST, backward: float = BACKWARD_COST) -> DataFrame:
    """source, row_key, text, utc_us, status for records of source, row_key, text, tz, date_order, at (when they were loaded)."""
    read = T.with_readings(records, "text", "tz", "date_order", "readings")
    read = cut(read.select("source", "row_key", "text", "at", F.col("date_order").isNotNull().alias("declared"), "readings"))
    plain = read.where(F.size("readings") <= 1).select(
        "source", "row_key", "text", F.get("readings", F.lit(0))["us"].alias("utc_us"),
        # the only valid reading counts as certain unless the site declares another order for it
        F.when(F.size("readings") == 0, "none").when(F.get("readings", F.lit(0))["cost"] > 0, "inferred").otherwise("instant").alias("status"),
    )
    picked = cheapest_readings(read.where(F.size("readings") > 0), F.col("at"), cut, switch, backward)
    texts = read.where(F.size("readings") > 1).select("source", "row_key", "text", "declared")
    status = F.when((F.col("gap") < GAP) | (~F.col("declared") & (F.col("gap") < float("inf"))), "inferred").when(F.col("same") > 1, "doubled").otherwise("instant")
    settled = picked.join(texts, ["source", "row_key"]).select("source", "row_key", "text", F.col("us").alias("utc_us"), status.alias("status"))
    return plain.unionByName(settled)


#: Layouts of an onset that counts from the recording's start, each rewritten into kind|hours|minutes|seconds|fraction.
RELATIVE = (
    (SECONDS, "S|||$1|$2"), (MILLIS, "K|||$1|$2"), (SAMPLES, "N|||$1$2|"), (ELAPSED, "H|$1|$2|$3|$4"), (DURATION, "D|$1|$2|$3|$4"), (CLOCK_ONLY, "C|$1|$2|$3|$4|$5"),
)


def is_relative(text: Column) -> Column:
    """Whether a text is a relative onset or a clock time alone; null is none."""
    return F.coalesce(text.rlike("|".join(f"(?:{pattern})" for pattern, _ in RELATIVE)), F.lit(False))


def with_onset(events: DataFrame) -> DataFrame:
    """``events`` (text, sampling_freq, start_us, tz) with kind, shift (microseconds from the start) and of_day (of a clock time).

    kind is null if the text is no relative onset.
    """
    rewritten = F.col("text")
    for pattern, to in RELATIVE:
        rewritten = F.regexp_replace(rewritten, pattern, to)
    kept = [F.col(x) for x in events.columns]
    at = lambda i: F.get("_f", F.lit(i))
    split = events.withColumn("_f", T.once(F.when(rewritten.rlike(r"^[SKNHDC]\|"), F.split(rewritten, r"\|"))))
    parts = split.select(
        *kept, at(0).alias("kind"), *(F.coalesce(T.number(at(k)), F.lit(0)).alias(f"_{k}") for k in (1, 2, 3)), T.fraction_us(at(4)).alias("_us"),
        *T.clock_parts(*(at(k) for k in range(1, 6))),
    ).withColumn("of_day", F.when(F.col("kind") == "C", T.clock_us(*map(F.col, T.CLOCK_COLUMNS))))
    whole = ((F.col("_1") * 60 + F.col("_2")) * 60 + F.col("_3")) * 1_000_000 + F.col("_us")
    freq = F.when((F.col("sampling_freq") > 0) & ~F.isnan("sampling_freq"), F.col("sampling_freq"))
    shift = (
        F.when(F.col("kind").isin("S", "D"), whole).when((F.col("kind") == "H") & (F.col("_2") < 60) & (F.col("_3") < 60), whole)
        .when(F.col("kind") == "K", F.col("_3") * 1000 + F.floor(F.col("_us") / 1000)).when(F.col("kind") == "N", F.round(F.col("_3").cast("double") / freq * 1e6).cast("long"))
    )
    return parts.select(*kept, "kind", T.once(shift.cast("long")).alias("shift"), T.once(F.col("of_day")).alias("of_day"))


def with_clock_instants(events: DataFrame) -> DataFrame:
    """The instants (array hits) at which the clock time ``of_day`` is first shown from ``start_us`` on.

    None if the clock change skips it on its first day, two if it doubles it after the start.
    """
    local = T.wall_us(F.col("start_us"), F.col("tz"))
    days = events.withColumn("_wall", local).withColumn("_today", F.col("_wall") - F.pmod(F.col("_wall"), F.lit(T.DAY_US)) + F.col("of_day"))
    days = T.with_instants(days.withColumn("_next", F.col("_today") + T.DAY_US), "_today", "tz", "_on_day")
    days = T.with_instants(days, "_next", "tz", "_on_next")
    days = days.withColumn("_ahead", F.filter("_on_day", lambda u: u >= F.col("start_us")))
    hits = F.when((F.col("_today") >= F.col("_wall")) | (F.size("_ahead") > 0), F.col("_ahead")).otherwise(F.col("_on_next"))
    return days.select(*events.columns, T.once(hits).alias("hits"))


def normalize_times(recordings: DataFrame, trains: DataFrame, events: DataFrame, sites: DataFrame, switch: float = SWITCH_COST, backward: float = BACKWARD_COST) -> DataFrame:
    """tab, row_key, text, utc_us, status for each start_time, stim_start and onset.

    ``sites`` is the fixed reference table of sites (a dozen rows), so it is broadcast.
    """
    site = F.upper(F.trim("site"))
    sites = F.broadcast(sites.groupBy(site.alias("_site")).agg(F.min("tz").alias("tz"), F.upper(F.min("date_order")).alias("date_order")))
    loaded = F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("at")
    source = lambda name: F.concat(F.lit(f"{name}|"), F.coalesce("_site", F.lit(""))).alias("source")
    placed = recordings.select("raw_id", F.col("start_time").alias("text"), "sampling_freq", site.alias("_site"), loaded).join(sites, "_site", "left")
    logged = trains.select("stim_id", F.col("stim_start").alias("text"), site.alias("_site"), loaded).join(sites, "_site", "left")
    of_recording = placed.select("raw_id", "_site", "tz", "date_order", "sampling_freq")
    heard = events.select("event_id", "raw_id", F.col("onset").alias("text"), loaded).join(of_recording, "raw_id", "left")
    heard = heard.withColumn("counted", is_relative(F.col("text")))
    # one pass over all texts that are full times, whatever their table
    full = placed.select(source("raw"), F.col("raw_id").alias("row_key"), "text", "tz", "date_order", "at")
    full = full.unionByName(logged.select(source("stim"), F.col("stim_id").alias("row_key"), "text", "tz", "date_order", "at"))
    full = full.unionByName(heard.where(~F.col("counted")).select(source("event"), F.col("event_id").alias("row_key"), "text", "tz", "date_order", "at"))
    dated = cut(resolve(full, switch, backward))
    starts = dated.where(F.col("source").startswith("raw|") & (F.col("status") == "instant")).select(F.col("row_key").alias("raw_id"), F.col("utc_us").alias("start_us"))
    relative = with_clock_instants(with_onset(heard.where("counted").join(starts, "raw_id", "left")))
    clock = F.col("kind") == "C"
    from_start = relative.select(
        F.lit("stim_events").alias("tab"), F.col("event_id").alias("row_key"), "text", T.once(F.when(clock, F.get("hits", F.lit(0))).otherwise(F.col("start_us") + F.col("shift"))).alias("utc_us"), (clock & (F.size("hits") > 1)).alias("twice")
    )
    from_start = from_start.select("tab", "row_key", "text", "utc_us", F.when(F.col("utc_us").isNull(), "none").when(F.col("twice"), "doubled").otherwise("instant").alias("status"))
    tab = F.when(F.col("source").startswith("raw|"), "raw_metadata").when(F.col("source").startswith("stim|"), "stim_metadata").otherwise("stim_events")
    return dated.select(tab.alias("tab"), "row_key", "text", "utc_us", "status").unionByName(from_start)


def normalized_foreign(times: DataFrame) -> DataFrame:
    """tab, row_key, utc_us of the certain instants whose texts are not already ISO 8601 in UTC."""
    return times.where((F.col("status") == "instant") & ~F.col("text").rlike(T.ISO_UTC)).select("tab", "row_key", "utc_us")
