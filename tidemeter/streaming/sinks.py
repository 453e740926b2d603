"""Tables that are computed again in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame


def replace_parts(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Write rows by ``keys``: parts of the table that rows have are replaced as a whole, all others stay."""
    rows.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
