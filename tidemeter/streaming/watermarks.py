"""How far each session's transcript has been dealt with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import transcripts as tr
from ..sources import versions
from ..sources.shared import settled

MARKS = "file string, seen_ms long"


def marks(spark: SparkSession, root: str) -> DataFrame:
    """(file, seen_ms) of the sessions dealt with so far."""
    known = versions.read(spark, root, "marks")
    return spark.createDataFrame([], MARKS) if known is None else known


def advance(spark: SparkSession, root: str, records: DataFrame, store: Callable[[DataFrame], None], parts: int = versions.PARTS) -> None:
    """Hand what came after each session's mark to ``store``, as transcripts.delta_since() sums it up, and then move the marks there.

    Marks move once store has returned: a run that fails before that gives the same delta again. They only grow, so lines
    that come late, with times that a mark has passed, change nothing.
    """
    old = marks(spark, root)
    delta = settled(tr.delta_since(records, old))
    store(delta)
    new = delta.select("file", F.col("max_ms").alias("seen_ms")).unionByName(old.join(delta.select("file"), "file")).groupBy("file").agg(F.max("seen_ms").alias("seen_ms"))
    versions.replace(spark, root, {"marks": settled(new)}, new.select("file"), ["file"], parts)
