"""The event log as a stream with a cursor: a Python data source whose offsets are event ids."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.policy import glob

SCHEMA = "event_id long, ts_unix_ms long, kind string, session_uuid string, cwd string, account_id long"
COLUMNS = ("event_id", "ts_unix_ms", "kind", "session_uuid", "cwd", "account_id")


@dataclass
class Page(InputPartition):
    """Events with after < event_id <= to."""

    after: int
    to: int


class EventLog(DataSource):
    """``event_log``: events of a folder of Parquet files that grows.

    Options: path (in a file system that driver and executors share); since, the id behind which to begin (0);
    page, the ids of a task (10000); kinds, globs joined by commas; session_uuid, cwd, account_id, until_ms. What a batch has read is in the
    query's checkpoint, so a restart goes on behind the last id and no event comes twice or is lost.
    """

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(self.options)


class Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.since, self.page = options["path"], int(options.get("since", 0)), int(options.get("page", 10_000))
        self.globs = [glob(g) for g in options.get("kinds", "").split(",") if g]
        self.equal = {c: int(options[c]) if c == "account_id" else options[c] for c in ("session_uuid", "cwd", "account_id") if options.get(c)}
        self.until = int(options["until_ms"]) if options.get("until_ms") else None

    def files(self):
        """The log as it is now; Spark's own folders of unfinished writes are not looked at."""
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")
        return ds.dataset(path, filesystem=system, format="parquet", ignore_prefixes=["_", "."])

    def initialOffset(self) -> dict:
        return {"event_id": self.since}

    def latestOffset(self) -> dict:
        """The largest id, by the files' own statistics."""
        found = [g.statistics["event_id"]["max"] for f in self.files().get_fragments() for g in f.row_groups if g.statistics and "event_id" in g.statistics]
        return {"event_id": max([self.since, *found])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Page(a, min(a + self.page, end["event_id"])) for a in range(start["event_id"], end["event_id"], self.page)]

    def read(self, partition: Page) -> Iterator[tuple]:
        import pyarrow.compute as pc

        where = (pc.field("event_id") > partition.after) & (pc.field("event_id") <= partition.to)
        for c, v in self.equal.items():
            where = where & (pc.field(c) == v)
        if self.until is not None:
            where = where & (pc.field("ts_unix_ms") <= self.until)
        globs = [re.compile(g) for g in self.globs]
        for batch in self.files().to_batches(columns=[*COLUMNS], filter=where):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not globs or any(g.match(row[2] or "") for g in globs):
                    yield row


def events(spark: SparkSession, path: str, **options):
    """Stream of the log's events from the cursor that the query's checkpoint keeps."""
    spark.dataSource.register(EventLog)
    own = spark.readStream.format("event_log").option("path", path)
    for k, v in options.items():
        own = own.option(k, str(v))
    return own.load()
