"""Things that may be done once: the first to claim one does it."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import SparkSession


def _folder(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark._jsc.hadoopConfiguration())


def claim(spark: SparkSession, root: str, key: str) -> bool:
    """Whether this caller is the first to claim ``key`` under ``root``: a file that the file system creates for one of all callers."""
    path, fs = _folder(spark, root)
    fs.mkdirs(path(root))
    return bool(fs.createNewFile(path(f"{root}/{quote(key, safe='')}")))


def claimed(spark: SparkSession, root: str) -> set[str]:
    """Keys claimed so far, as their files are called."""
    path, fs = _folder(spark, root)
    return {s.getPath().getName() for s in fs.listStatus(path(root))} if fs.exists(path(root)) else set()
