"""Lookups of the last mark before and the first mark behind a row's time, without ordering a key's rows as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


def around(rows: DataFrame, marks: DataFrame, keys: list[str], slot_ms: int = HOUR_MS) -> DataFrame:
    """rows (keys, ts_unix_ms, ...) with structs ``_back`` and ``_ahead``: of the marks (keys, ts_unix_ms, mark) the last at or before a row's time and the first at or behind it.

    Rows and marks meet in slots of time, so a key of any size is spread over its slots. What is ordered by key is a row a slot, which carries
    the last mark before it and the first one behind it. Of marks at one time the greatest stands behind, the least ahead.
    """
    slot = F.floor(F.col("ts_unix_ms") / slot_ms).cast("bigint")
    at = F.struct("ts_unix_ms", "mark")
    own = marks.select(*keys, slot.alias("_slot"), "ts_unix_ms", at.alias("_m"))
    asked = rows.withColumn("_slot", slot)
    held = own.groupBy(*keys, "_slot").agg(F.max("_m").alias("_last"), F.min("_m").alias("_first"))
    some = held.unionByName(asked.select(*keys, "_slot").distinct(), allowMissingColumns=True).groupBy(*keys, "_slot").agg(F.max("_last").alias("_last"), F.min("_first").alias("_first"))
    by, before = Window.partitionBy(*keys), (Window.unboundedPreceding, -1)
    carried = some.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slot").alias("_ks"),
        F.last("_last", ignorenulls=True).over(by.orderBy("_slot").rowsBetween(*before)).alias("_b"), F.last("_first", ignorenulls=True).over(by.orderBy(F.desc("_slot")).rowsBetween(*before)).alias("_a"),
    )
    both = own.withColumn("_o", F.lit(0)).unionByName(asked.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    inside, past = Window.partitionBy(*keys, "_slot"), (Window.unboundedPreceding, 0)
    both = both.withColumns({
        "_back": F.last("_m", ignorenulls=True).over(inside.orderBy("ts_unix_ms", "_o", "_m").rowsBetween(*past)),
        "_ahead": F.last("_m", ignorenulls=True).over(inside.orderBy(F.desc("ts_unix_ms"), "_o", F.desc("_m")).rowsBetween(*past)),
    })
    same = F.col("_slot").eqNullSafe(F.col("_ks"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    found = both.where("_o = 1").join(carried, same, "left")
    return found.select(*rows.columns, F.coalesce("_back", "_b").alias("_back"), F.coalesce("_ahead", "_a").alias("_ahead"))
