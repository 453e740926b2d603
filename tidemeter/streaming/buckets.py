"""Five-hour buckets anchored at the first turn, in a stream.

Needs ``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "account_id long, start_ms long, end_ms long, raw_tokens long, cw_tokens double"


class Greedy(StatefulProcessor):
    """An account's open bucket, and its turns that the watermark has not passed.

    A turn is placed once no earlier one can come; equal times are summed. A bucket
    comes out once the watermark passes its end, by a timer if no turn comes.
    """

    def __init__(self, span_ms: int):
        self.span = span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts long", "raw long, c long")
        self.open = handle.getValueState("open", "start long, raw long, c long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for ts, own in pdf.groupby("ts_unix_ms"):
                raw, c = int(own["raw_tokens"].sum()), int(own["cw100"].sum())
                if self.waiting.containsKey((int(ts),)):
                    held = self.waiting.getValue((int(ts),))
                    raw, c = raw + held[0], c + held[1]
                self.waiting.updateValue((int(ts),), (raw, c))
        yield self.settle(key[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.settle(key[0], timerValues.getCurrentWatermarkInMs())

    def settle(self, account: int, watermark: int) -> pd.DataFrame:
        done, held = [], self.open.get() if self.open.exists() else None
        held = [*held] if held else None
        passed = sorted((k[0], v[0], v[1]) for k, v in self.waiting.iterator() if k[0] <= watermark)
        for ts, raw, c in passed:
            if held and ts < held[0] + self.span:
                held[1] += raw
                held[2] += c
            else:
                done += [held] if held else []
                held = [ts, raw, c]
            self.waiting.removeKey((ts,))
        if held and held[0] + self.span <= watermark:
            done.append(held)
            held = None
        if held:
            self.open.update(tuple(held))
            self.handle.registerTimer(held[0] + self.span)
        elif self.open.exists():
            self.open.clear()
        # what waits is looked at once the watermark reaches it
        for k in self.waiting.keys():
            self.handle.registerTimer(k[0])
        return pd.DataFrame([(account, s, s + self.span, raw, c / 100.0) for s, raw, c in done], columns=["account_id", "start_ms", "end_ms", "raw_tokens", "cw_tokens"])


def fixed_buckets(turns: DataFrame, span_ms: int, late: str = "1 hour") -> DataFrame:
    """Stream of the closed buckets of meter.fixed_buckets() for a stream of turns (account_id, ts_unix_ms, raw_tokens, cw100); turns later than ``late`` are dropped, others may come in any order."""
    own = turns.select("account_id", "ts_unix_ms", "raw_tokens", "cw100", F.timestamp_millis("ts_unix_ms").alias("at")).withWatermark("at", late)
    return own.groupBy("account_id").transformWithStateInPandas(Greedy(span_ms), SCHEMA, "append", "eventTime")
