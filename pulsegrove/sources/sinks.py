"""Writing results: partitioned Parquet for samples and epochs, one CSV folder per small report, with a manifest."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pipeline_id(steps: list[tuple[str, dict]]) -> str:
    """A short hash of an ordered list of steps and their parameters."""
    return hashlib.sha1(json.dumps(steps, sort_keys=True, default=str).encode()).hexdigest()[:12]


def write_epochs(epochs: DataFrame, path: str, steps: list[tuple[str, dict]], by: str) -> None:
    """Epochs as Parquet below their pipeline's id, a folder per value of ``by``; writing again replaces this pipeline's files only."""
    target = f"{path}/pipeline={pipeline_id(steps)}"
    epochs.repartition(by).sortWithinPartitions(by).write.mode("overwrite").partitionBy(by).option("compression", "zstd").parquet(target)


def read_epochs(spark, path: str, steps: list[tuple[str, dict]]) -> DataFrame | None:
    """The epochs that ``write_epochs`` stored for these steps, None if there are none."""
    try:
        return spark.read.parquet(f"{path}/pipeline={pipeline_id(steps)}")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def write_reports(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Each table as CSV with a header (arrays joined by ;) below ``path``, and table, n_rows and a hash of the rows in any order."""
    manifest = None
    for name, df in tables.items():
        flat = df.select(*(F.concat_ws(";", F.col(f"`{c}`").cast("array<string>")).alias(c) if kind.startswith("array") else F.col(f"`{c}`") for c, kind in df.dtypes))
        flat.write.mode("overwrite").csv(f"{path}/{name}", header=True, nullValue="n/a")
        rows = F.xxhash64(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in flat.columns))
        line = flat.agg(F.lit(name).alias("table"), F.count("*").alias("n_rows"), F.coalesce(F.bit_xor(rows), F.lit(0)).alias("hash"))
        manifest = line if manifest is None else manifest.unionByName(line)
    return manifest
