"""What the training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set from ``spark.checkpoint.dir``; a temporary one only where everything runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of an Arrow batch, about; a longer row is a batch of its own. What a Python worker holds follows from it.
BATCH_BYTES = 2 << 20


def in_batches(df: DataFrame) -> DataFrame:
    """df, whose session sends Python batches of bounded bytes: a count of rows alone does not bound texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def width(spark: SparkSession) -> int:
    """Partitions that a shuffle makes here."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_of(batches, *names: str) -> Iterator[tuple[list, ...]]:
    """The named columns of each Arrow batch as lists."""
    for batch in batches:
        yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)


class Known(dict):
    """A memory of words that holds about ``room`` bytes; what comes later is not remembered."""

    def __init__(self, room: int):
        super().__init__()
        self.room = room

    def keep(self, key: str, value: bytes) -> None:
        self.room -= 160 + len(key) + len(value)
        if self.room > 0:
            self[key] = value


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each end of an edge can reach.

    edges has long columns u and v. Alternates large-star and small-star steps,
    each a grouped minimum and an equi-join on a node, until no edge changes:
    rounds grow with the logarithm of a component's size, links stay on the
    executors, and a node with very many links is an ordinary skewed join key.
    """
    e = cut(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark = None
    while True:
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(
            large.join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
