"""Tables that change together: data files first, then one manifest that names them.

A version is what its manifest says: for each table and part the folder that holds it. A
commit writes the parts that it changes to new folders and then the next manifest, a single file that appears as a whole; readers take the
newest one. A commit that dies before that leaves the old version in force and folders that
nothing names. Of two commits from one version the second fails, as its manifest's place is taken.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Parts that a table's keys are dealt to: a commit rewrites the parts of the keys that it touches.
PARTS = 64
MANIFEST = "version long, name string, part int, path string, schema string"


class Taken(Exception):
    """Another commit has made the next version first."""


def part_of(keys: list[str], parts: int = PARTS):
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def manifest(spark: SparkSession, root: str) -> list:
    """Rows of the newest manifest: at most a row a table and part. None before the first commit."""
    try:
        known = spark.read.schema(MANIFEST).option("recursiveFileLookup", True).parquet(f"{root}/manifest")
    except AnalysisException:
        return []
    last = known.agg(F.max("version")).first()[0]
    return known.where(F.col("version") == last).collect() if last is not None else []


def read(spark: SparkSession, root: str, name: str, of: list | None = None) -> DataFrame | None:
    """A table as its newest version has it, or as the manifest rows ``of`` say; None if it was never written."""
    own = [r for r in (manifest(spark, root) if of is None else of) if r.name == name]
    if not own:
        return None
    paths = sorted({r.path for r in own if r.path})
    return spark.read.schema(own[0].schema).parquet(*paths) if paths else spark.createDataFrame([], own[0].schema)


def replace(spark: SparkSession, root: str, tables: dict[str, DataFrame], touched: DataFrame, keys: list[str], parts: int = PARTS, over_dead: bool = False) -> int:
    """Make a version in which the rows of each table with a key of ``touched`` are those of ``tables`` and all others are as before; returns its number.

    tables: new rows by name, all with columns ``keys``. A touched key without new rows loses the ones it had. All
    tables change at once for every reader. What is rewritten is the parts that touched keys fall into. over_dead: take the place of a commit that died while its manifest was written.
    """
    old = manifest(spark, root)
    version = (old[0].version if old else 0) + 1
    touched = touched.select(*keys).distinct()
    hit = sorted(r.p for r in touched.select(part_of(keys, parts).alias("p")).distinct().collect())
    gone = touched.toDF(*[f"_{i}" for i in range(len(keys))])
    rows = []
    for name, new in tables.items():
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema.fields)
        own = [r for r in old if r.name == name]
        kept = [r for r in own if r.part not in hit]
        before = read(spark, root, name, [r for r in own if r.part in hit])
        some = new if before is None else before.join(gone, [before[k].eqNullSafe(gone[f"_{i}"]) for i, k in enumerate(keys)], "left_anti").unionByName(new)
        path = f"{root}/data/{name}-{version}-{uuid.uuid4().hex}"
        some.withColumn("_part", part_of(keys, parts)).where(F.col("_part").isin(*hit) if hit else F.lit(False)).repartition("_part").write.partitionBy("_part").parquet(path)
        rows += [(version, name, r.part, r.path, schema) for r in kept]
        filled = {r._part for r in spark.read.schema(f"{schema}, _part int").parquet(path).select("_part").distinct().collect()}
        rows += [(version, name, p, f"{path}/_part={p}" if p in filled else "", schema) for p in hit]
        if not kept and not hit:
            rows.append((version, name, -1, "", schema))
    rows += [(version, r.name, r.part, r.path, r.schema) for r in old if r.name not in tables]
    try:
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite" if over_dead else "errorifexists").parquet(f"{root}/manifest/version={version:012d}")
    except AnalysisException as taken:
        if "PATH_ALREADY_EXISTS" in str(taken):
            raise Taken(str(version)) from taken
        raise
    return version
