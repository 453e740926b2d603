"""Logins over time, and states turned into events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import around


def login_intervals(logins: DataFrame) -> DataFrame:
    """(config_dir, account_id, from_ms): a row whenever a directory's account changes; the first holds from 0."""
    w = Window.partitionBy("config_dir").orderBy("ts_unix_ms", "event_id")
    before = F.lag("account_id").over(w)
    changed = logins.withColumns({"_b": before, "_n": F.row_number().over(w)}).where("_n = 1 or account_id <> _b")
    return changed.select("config_dir", "account_id", F.when(F.col("_n") == 1, 0).otherwise(F.col("ts_unix_ms")).alias("from_ms"))


def as_of(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """rows (config_dir, ts_unix_ms, ...) with the account whose interval holds: the last that began by then, or else the first; 1 where there is none.

    The first interval of a directory begins at 0, so the first behind a row matters only for times before that.
    """
    marks = intervals.select("config_dir", F.col("from_ms").alias("ts_unix_ms"), F.col("account_id").alias("mark"))
    found = around(rows, marks, ["config_dir"])
    return found.withColumn("resolved", F.coalesce("_back.mark", "_ahead.mark", F.lit(1).cast("bigint"))).drop("_back", "_ahead")


def merged_accounts(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """rows with each placeholder's account_id replaced by the account it turned out to be (merges: from_id, to_id). Derived tables are computed again, not moved."""
    known = rows.join(merges.select(F.col("from_id").alias("account_id"), "to_id"), "account_id", "left")
    return known.withColumn("account_id", F.coalesce("to_id", "account_id")).select(*rows.columns)


def level_edges(readings: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Changes of a keyed state: the first counts if it is not 'unknown', later ones if they differ."""
    before = F.lag("state").over(Window.partitionBy(*keys).orderBy(*order))
    edges = readings.withColumn("previous", F.coalesce(before, F.lit("unknown")))
    return edges.where(F.col("state") != F.col("previous"))
