from __future__ import annotations

import re

from pulsegrove.llm import contacts

CATALOG = [(i, f"{lead}{n}", lead, n, name) for i, (lead, name, n) in enumerate((lead, name, n) for lead, name in (("LORBLT", "left lateral orbitofrontal"), ("ROPPAR", "right opercular part"), ("LCINA", "left anterior cingulate")) for n in range(1, 9))]


def test_contacts_of_any_spelling(spark):
    catalog = spark.createDataFrame(CATALOG, "catalog_id long, elec_label string, lead_label string, contact_no int, anat_label string")
    labels = ["lorblt4", "LORBLT4", "R-OPPAR.7", "POL LCINA7-Ref", "LCINA12", "n/a", None]
    entries = spark.createDataFrame([("sub-x1" if i % 2 else "X1", x, float(i), float("nan"), None) for i, x in enumerate(labels)], "patient_id string, elec_label string, mni_x double, mni_y double, mni_z double")
    got = {(r.patient, r.lead, r.number): (r.mni_x, r.mni_y) for r in contacts.contacts(entries, catalog).collect()}
    # LCINA12 is not in the catalog and stays as written
    assert got == {("X1", "LORBLT", 4): (0.5, None), ("X1", "ROPPAR", 7): (2.0, None), ("X1", "LCINA", 7): (3.0, None), ("X1", "LCINA", 12): (4.0, None)}


def test_more_contacts_and_pairs_than_letter_for_letter(spark, data):
    import __spark_entry__ as entry
    from pulsegrove.plans import tables

    queries = entry.queries()
    plain, mapped = tables.contacts(spark, data), queries["laplacian_mapped"](spark, data)
    assert mapped.count() > plain.count()
    assert queries["completed_contacts"](spark, data).count() == mapped.count()


def test_spelled_values_are_not_broadcast(spark, data):
    out = contacts.contacts(*(spark.read.parquet(f"{data}/{name}.parquet") for name in ("electrode_metadata", "contact_catalog")))
    joins = [line for line in out._jdf.queryExecution().sparkPlan().toString().split("\n") if re.search(r"Join \[stem#\d+\], \[stem#\d+\]", line)]
    # the optimizer takes what Python returns to be as small as the column of the file
    assert joins and not any("Broadcast" in line for line in joins)
