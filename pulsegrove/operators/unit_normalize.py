"""Problem 1: one quantity recorded in many units.

``normalize_peaks`` finds the unit of each peak with the alias automaton of ``functions.units`` in the peak's own text,
then in the row's unit field, then in what the recording and the model say, and converts to microvolts with a broadcast
table of factors (its size is that of ``FACTORS``).

Defined results: a null, blank or placeholder peak, and one with more digits after its number (``1,234.5``), has no number and status ``unreadable``; a number that no field gives
a unit has status ``no_unit`` and a null value; the unit may stand before the number; repeated rows come out once each; of several rows of one
recording or model the least values count; unknown recordings and models count as
silent; extra columns are not carried along, so their names cannot clash; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrove.functions.units import factor_table, find_unit, number_of, rest_of


def normalize_peaks(peaks: DataFrame, recordings: DataFrame, models: DataFrame) -> DataFrame:
    """summary_id, recorded double, unit_pv long, unit_from, peak_uv double, status: a row for each of ``peaks``."""
    factors = F.broadcast(factor_table(peaks.sparkSession))
    rows = peaks.select(
        "summary_id",
        "raw_id",
        "model_id",
        number_of(F.col("max_peak_abs")).alias("recorded"),
        find_unit(rest_of(F.col("max_peak_abs"))).alias("text_unit"),
        find_unit(F.col("voltage_unit")).alias("field_unit"),
    )
    by_recording = recordings.groupBy("raw_id").agg(
        F.min(F.when((F.col("value_scale_to_uv") > 0) & ~F.isnan("value_scale_to_uv") & (F.col("value_scale_to_uv") < 1e12), F.round(F.col("value_scale_to_uv") * 1e6).cast("long"))).alias("scale_pv"),
        F.min("signal_units").alias("signal_units"),
    )
    by_recording = by_recording.select("raw_id", F.when(F.col("scale_pv") > 0, F.col("scale_pv")).alias("scale_pv"), find_unit(F.col("signal_units")).alias("signal_unit"))
    by_model = models.groupBy("model_id").agg(F.min("voltage_unit").alias("u")).select("model_id", find_unit(F.col("u")).alias("model_unit"))
    named = rows.join(by_recording, "raw_id", "left").join(by_model, "model_id", "left")
    named = named.withColumn("unit", F.coalesce("text_unit", "field_unit", F.when(F.col("scale_pv").isNull(), F.coalesce("signal_unit", "model_unit"))))
    out = named.join(factors, "unit", "left").select(
        "summary_id",
        "recorded",
        F.when(F.col("unit").isNull(), F.col("scale_pv")).otherwise(F.col("unit_pv")).alias("unit_pv"),
        F.when(F.col("text_unit").isNotNull(), "text").when(F.col("field_unit").isNotNull(), "field").when(F.col("scale_pv").isNotNull(), "scale").when(F.col("signal_unit").isNotNull(), "signal").when(F.col("model_unit").isNotNull(), "model").alias("unit_from"),
    )
    finite = F.col("recorded").isNotNull() & ~F.isnan("recorded")
    return out.select(
        "summary_id",
        F.when(finite, F.col("recorded")).alias("recorded"),
        "unit_pv",
        "unit_from",
        F.when(finite, F.col("recorded") * (F.col("unit_pv") / F.lit(1e6))).alias("peak_uv"),
        F.when(~finite, "unreadable").when(F.col("unit_pv").isNull(), "no_unit").otherwise("converted").alias("status"),
    )


def foreign_units(normalized: DataFrame) -> DataFrame:
    """summary_id, unit_pv of the readable peaks that were not recorded in microvolts."""
    return normalized.where((F.col("status") == "converted") & (F.col("unit_pv") != 10**6)).select("summary_id", "unit_pv")
