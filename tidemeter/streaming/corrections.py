"""Flags of meter readings kept up as readings arrive, late ones too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import meter
from ..sources import versions
from ..sources.shared import settled

SERIES, DAY_MS = ("account_id", "bucket"), 86_400_000
#: What a day's flags are stored by.
KEYS = [*SERIES, "day"]


def apply(spark: SparkSession, root: str, batch: DataFrame, parts: int = versions.PARTS) -> int:
    """Take a batch of readings (those of fixtures.meter; a known id in a series replaces its reading) into the flags under ``root``; returns how many rows were computed anew.

    Per series the last reset is sought that neither the batch nor anything later than its first reading can
    change: it and all before it are decided by earlier readings. From there on flags are computed again, as a reset
    forgets what was before it, and only days from there on are written. A batch that is tried again changes nothing.
    """
    batch = settled(batch.dropDuplicates([*SERIES, "id"]))
    if batch.isEmpty():
        return 0
    columns = batch.columns
    held = versions.read(spark, root, "flags")
    touched = batch.groupBy(*SERIES).agg(F.min("ts_unix_ms").alias("from_ms"))
    if held is None:
        rows = batch.withColumn("resumed", F.lit(False))
        kept = None
    else:
        # a reading that is replaced changes what follows its old time as well
        old = held.join(batch.select(*SERIES, "id"), [*SERIES, "id"]).groupBy(*SERIES).agg(F.min("ts_unix_ms").alias("old_ms"))
        touched = touched.join(old, [*SERIES], "left").select(*SERIES, F.least("from_ms", "old_ms").alias("from_ms"))
        before = held.join(touched, [*SERIES]).where("ts_unix_ms < from_ms")
        open_ = before.groupBy(*SERIES).agg(F.min(F.when(F.coalesce(F.col("decided_ms") >= F.col("from_ms"), F.lit(True)), F.col("ts_unix_ms"))).alias("open_ms"))
        safe = before.join(open_, [*SERIES]).where("reset_detected and pct is not null and ts_unix_ms < coalesce(open_ms, from_ms)")
        since = settled(touched.select(*SERIES).join(safe.groupBy(*SERIES).agg(F.max(F.struct("ts_unix_ms", "id")).alias("since")), [*SERIES], "left"))
        at = F.struct("ts_unix_ms", "id")
        later = F.col("since").isNull() | (at >= F.col("since"))
        tail = held.select(*columns).join(batch.select(*SERIES, "id"), [*SERIES, "id"], "left_anti").unionByName(batch).join(since, [*SERIES])
        rows = tail.where(later).select(*columns, F.col("since").isNotNull().alias("resumed"))
        day = F.floor(F.col("since.ts_unix_ms") / DAY_MS).cast("bigint")
        kept = held.join(batch.select(*SERIES, "id"), [*SERIES, "id"], "left_anti").join(since, [*SERIES]).where(~later & (F.col("day") >= day)).select(*held.columns)
        gone = held.join(since, [*SERIES]).where(day.isNull() | (F.col("day") >= day)).select(*KEYS)
    new = settled(meter.resumed_flags(rows).withColumn("day", F.floor(F.col("ts_unix_ms") / DAY_MS).cast("bigint")))
    keys = new.select(*KEYS)
    versions.replace(spark, root, {"flags": new if kept is None else new.unionByName(kept)}, keys if kept is None else keys.unionByName(gone), KEYS, parts)
    return new.count()


def writer(root: str, counts: list | None = None, parts: int = versions.PARTS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: apply() to each micro-batch; counts, if given, gets the rows computed anew."""

    def write(batch: DataFrame, number: int) -> None:
        n = apply(batch.sparkSession, root, batch, parts)
        if counts is not None:
            counts.append(n)

    return write


def flags(spark: SparkSession, root: str) -> DataFrame:
    """The flags as the newest version has them, as meter.usage_flags() gives them."""
    return versions.read(spark, root, "flags").drop("day", "decided_ms")
