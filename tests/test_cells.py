"""Long forms of the matrices hold every model and every nation."""

from __future__ import annotations

import __spark_entry__ as entry


def test_all_models_and_nations(spark, data):
    queries = entry.queries()
    assert queries["decision_cells"](spark, data).select("model_id").distinct().count() == spark.read.parquet(f"{data}/n1_models.parquet").count()
    assert queries["adjacency_cells"](spark, data).select("target").distinct().count() == 25
