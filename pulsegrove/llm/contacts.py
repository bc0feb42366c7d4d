"""Queries over the contacts of all entries, whatever their spelling, by problem 3's mapping to the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrove.llm import canonical_map
from pulsegrove.operators import montage, stats
from pulsegrove.plans.queries import query
from pulsegrove.session import table


def contacts(entries: DataFrame, catalog: DataFrame) -> DataFrame:
    """patient, lead, number, mni_x.. of the entries; repeats averaged.

    Lead and number are the catalog's. An entry that has none there keeps those of its label if that is a lead and a
    number letter for letter, else it is no contact.
    """
    mapped = canonical_map.map_values(entries.select(F.col("elec_label").alias("value")).where("value is not null"), catalog).where("catalog_id is not null").select(F.col("value").alias("elec_label"), "catalog_id")
    known = catalog.select("catalog_id", F.upper(F.trim("lead_label")).alias("_lead"), F.col("contact_no").alias("_number"))
    rows = entries.where("elec_label is not null").join(mapped.join(known, "catalog_id"), "elec_label", "left")
    written = lambda part: F.nullif(F.regexp_extract("elec_label", r"^([A-Z]{4,7})([0-9]{1,2})$", part), F.lit(""))
    patient = F.upper(F.regexp_replace("patient_id", r"^(?i)sub-", ""))
    named = rows.select(patient.alias("patient"), F.coalesce("_lead", written(1)).alias("lead"), F.coalesce(F.col("_number"), written(2).cast("int")).alias("number"), "mni_x", "mni_y", "mni_z")
    real = lambda c: F.avg(F.when(~F.isnan(c), F.col(c))).alias(c)
    return named.where("lead is not null").groupBy("patient", "lead", "number").agg(*map(real, ("mni_x", "mni_y", "mni_z")))


def _contacts(spark: SparkSession, d: str) -> DataFrame:
    return contacts(table(spark, d, "electrode_metadata"), table(spark, d, "contact_catalog"))


@query()
def bipolar_mapped(spark: SparkSession, d: str) -> DataFrame:
    return montage.bipolar(_contacts(spark, d).withColumn("value", F.col("mni_x")), ["patient"])


@query()
def laplacian_mapped(spark: SparkSession, d: str) -> DataFrame:
    return montage.laplacian(_contacts(spark, d).withColumn("value", F.col("mni_x")), ["patient"]).select("patient", "lead", "number", "value")


@query()
def lead_fits_mapped(spark: SparkSession, d: str) -> DataFrame:
    return stats.lead_fits(_contacts(spark, d), ["patient"]).drop("rmse")


@query()
def lead_directions(spark: SparkSession, d: str) -> DataFrame:
    return stats.linear_fit(_contacts(spark, d).withColumn("number", F.col("number").cast("double")), ["patient"], "number", ["mni_x", "mni_y", "mni_z"])


@query()
def distance_gradients(spark: SparkSession, d: str) -> DataFrame:
    return stats.slope_permutation(_contacts(spark, d), ["patient"], ["lead", "number"], "number", "mni_x", 199, 5)


@query()
def completed_contacts(spark: SparkSession, d: str) -> DataFrame:
    found = _contacts(spark, d)
    return montage.completed_contacts(found, stats.lead_fits(found, ["patient"]), ["patient"])


@query()
def latency_gradient(spark: SparkSession, d: str) -> DataFrame:
    return stats.latency_gradient(_contacts(spark, d).withColumn("number", F.col("number").cast("double")), ["patient"], "number", ["mni_x", "mni_y", "mni_z"])


@query()
def wave_permutation(spark: SparkSession, d: str) -> DataFrame:
    return stats.latency_permutation(_contacts(spark, d).withColumn("number", F.col("number").cast("double")), ["patient"], ["lead", "number"], "number", ["mni_x", "mni_y", "mni_z"], 99, 7)
