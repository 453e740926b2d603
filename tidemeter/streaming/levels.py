"""Streaming forms: changes of a keyed level, for ever or for a time, and the latest row of each key."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.rollups import latest


def level_edges(readings: DataFrame, key: str, order: str) -> DataFrame:
    """Stream of (key, order, state, previous) whenever a key's state changes; the state is the last level seen.

    Readings of a batch are taken in order; a key that is absent keeps its level.
    """
    kinds = dict(readings.dtypes)

    def run(keys, batches, held: GroupState):
        level = held.get[0] if held.exists else "unknown"
        rows = pd.concat([*batches]).sort_values(order)
        out = []
        for at, state in zip(rows[order], rows["state"], strict=True):
            if state != level:
                out.append((keys[0], at, state, level))
                level = state
        held.update((level,))
        yield pd.DataFrame(out, columns=[key, order, "state", "previous"])

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, state string, previous string"
    return readings.select(key, order, "state").groupBy(key).applyInPandasWithState(run, schema, "level string", "append", GroupStateTimeout.NoTimeout)


#: How long the level of a key that is silent is kept.
TTL = timedelta(days=14)


class Levels(StatefulProcessor):
    """A key's level as long as it is young; a key that was silent for longer begins at 'unknown' again."""

    def __init__(self, key: str, order: str, ttl: timedelta):
        self.columns, self.order, self.ttl = [key, order, "state", "previous"], order, int(ttl.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", "state string", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        held = self.level.get() if self.level.exists() else None
        level, out = held[0] if held else "unknown", []
        pdf = pd.concat([*rows]).sort_values(self.order)
        for at, state in zip(pdf[self.order], pdf["state"], strict=True):
            if state != level:
                out.append((key[0], at, state, level))
                level = state
        self.level.update((level,))
        yield pd.DataFrame(out, columns=self.columns)


def level_edges_for(readings: DataFrame, key: str, order: str, ttl: timedelta = TTL) -> DataFrame:
    """level_edges() whose levels are forgotten ``ttl`` after a key's last reading, by the state store itself. Needs the RocksDB state store provider."""
    kinds = dict(readings.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, state string, previous string"
    return readings.select(key, order, "state").groupBy(key).transformWithStateInPandas(Levels(key, order, ttl), schema, "append", "processingTime")


def upsert_latest(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keep the newest row of each key in a table, one folder a batch, so that a batch that is tried again writes the same."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch if number == 0 else batch.unionByName(spark.read.parquet(f"{path}/batch={number - 1}"))
        latest(own, keys, [own[c].desc() for c in order]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
