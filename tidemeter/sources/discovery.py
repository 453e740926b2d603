"""Transcript files as they lie in a folder, and which of them must be read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .transcripts import MIN_BYTES, UUID, owner_key, path_shape, read_lines

#: Outcomes of the gate: only the first is read.
READ, SMALL, UNCHANGED, UNLINKED = "read", "small", "unchanged", "unlinked"
LEDGER = "path string, mtime_s long"


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, shape, owner, bytes, mtime_s, uri) of the transcripts under ``root``, by the file system's own sizes and times; contents are not read.

    path is relative to root. Three layouts are transcripts: a session's file in its project, a subagent's one in
    the folder of the session that sent it, and a workflow's agents one folder deeper; whatever else lies there is left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    relative = F.substring_index(F.col("path"), base, -1)
    own = files.select(relative.alias("path"), F.col("length").alias("bytes"), F.unix_seconds("modificationTime").alias("mtime_s"), F.col("path").alias("uri"))
    shape = path_shape(F.col("path"))
    own = own.withColumns({"shape": shape, "owner": owner_key(F.col("path"))})
    return own.where("shape in ('top_level', 'subagent', 'workflow_agent')").select("path", "shape", "owner", "bytes", "mtime_s", "uri")


def gated(files: DataFrame, ledger: DataFrame, min_bytes: int = MIN_BYTES, force: bool = False) -> DataFrame:
    """files with ``outcome``: small ones at the top are left, then those whose time the ledger (path, mtime_s) holds, unless ``force``; a subagent's file under a folder that is no session's id is never read, as its turns would count for nobody.

    A ledger that names a path twice counts with its newest time.
    """
    known = ledger.groupBy("path").agg(F.max("mtime_s").alias("_seen"))
    top = F.col("shape") == "top_level"
    unchanged = F.lit(False) if force else F.coalesce(F.col("_seen") == F.col("mtime_s"), F.lit(False))
    outcome = F.when(top & (F.col("bytes") < min_bytes), SMALL).when(unchanged, UNCHANGED).when(~top & ~F.col("owner").rlike(UUID), UNLINKED).otherwise(READ)
    return files.join(known, "path", "left").withColumn("outcome", outcome).drop("_seen")


def noted(ledger: DataFrame, gate: DataFrame) -> DataFrame:
    """The ledger after what the gate let through was read: their times replace older ones."""
    new = gate.where(F.col("outcome") == READ).select("path", "mtime_s")
    return ledger.join(new, "path", "left_anti").unionByName(new)


def lines_of(spark: SparkSession, gate: DataFrame, batch: int = 10_000) -> DataFrame:
    """(file, line, value) of the files that the gate lets through, file being their path under the root.

    Only changed files are opened. Their names, a part of the listing that Spark keeps on the driver anyway, are handed over ``batch`` at a time.
    """
    own = gate.where(F.col("outcome") == READ).select("uri", "path")
    uris = [r.uri for r in own.select("uri").toLocalIterator()]
    if not uris:
        return spark.createDataFrame([], "file string, line long, value string")
    lines = None
    for k in range(0, len(uris), batch):
        some = read_lines(spark, uris[k : k + batch])
        lines = some if lines is None else lines.unionByName(some)
    names = own.select(F.regexp_replace("uri", "^[a-z]+:/*", "/").alias("_uri"), "path")
    plain = F.regexp_replace(F.url_decode(F.regexp_replace("file", r"\+", "%2B")), "^[a-z]+:/*", "/")
    return lines.withColumn("_uri", plain).join(names, "_uri").select(F.col("path").alias("file"), "line", "value")


def stream(spark: SparkSession, root: str, files_at_once: int = 1000) -> DataFrame:
    """Stream of (path, shape, owner, value): lines of transcripts as files appear under ``root``, each file once, also after a restart from the query's checkpoint.

    A file that is written again is not read again here: that is what the gate over listed() is for.
    """
    lines = spark.readStream.schema(T.StructType([T.StructField("value", T.StringType())])).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_at_once).format("text").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    own = lines.select(F.substring_index(F.col("_metadata.file_path"), base, -1).alias("path"), "value").where("trim(value) <> ''")
    own = own.withColumns({"shape": path_shape(F.col("path")), "owner": owner_key(F.col("path"))})
    return own.where("shape in ('top_level', 'subagent', 'workflow_agent')").select("path", "shape", "owner", "value")
