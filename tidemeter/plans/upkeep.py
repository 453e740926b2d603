"""Registered queries over tables that are kept up: files, versions, streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import rollups
from ..sources import discovery, fixtures, versions
from ..sources import transcripts as tr
from ..sources.shared import new_folder, settled
from ..streaming import announce, corrections, watermarks
from . import reports

Query = Callable[[SparkSession, str], DataFrame]
#: Sessions that are read again, and how many of their turns they have then.
AGAIN = {"s1": 20, "s4": 20, "s7": 20, "s17": 20, "s2": 0}


def _discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate says of files on disk: a third is in the ledger as it is, a third with an older time, the rest is new."""
    files = settled(discovery.listed(spark, fixtures.transcript_tree(spark, sf_dir)))
    n = F.coalesce(F.regexp_extract("path", r"s([0-9]+)\.jsonl$", 1).try_cast("int"), F.lit(2))
    ledger = files.where(n % 3 < 2).select("path", (F.col("mtime_s") - n % 3).alias("mtime_s"))
    gate = settled(discovery.gated(files, ledger))
    lines = discovery.lines_of(spark, gate).groupBy(F.col("file").alias("path")).agg(F.count("*").alias("lines"))
    return gate.join(lines, "path", "left").select("path", "shape", "owner", "outcome", F.coalesce("lines", F.lit(0).cast("bigint")).alias("lines"))


def session_tables(records: DataFrame) -> dict[str, DataFrame]:
    """The four tables that are read from transcripts, by session."""
    own = {"turns": tr.turns(records), "compactions": tr.compactions(records), "prompts": tr.human_prompts(records), "signals": tr.quota_signals(records)}
    return {k: v.withColumnRenamed("file", "session_uuid") for k, v in own.items()}


def _replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a session and table after some sessions were read again, as the manifest's newest version has them."""
    root, records = new_folder(spark, "versions"), settled(tr.parsed(fixtures.transcript(spark, sf_dir)))
    versions.replace(spark, root, session_tables(records), records.select(F.col("file").alias("session_uuid")), ["session_uuid"], parts=8)
    few = F.coalesce(*[F.when(F.col("file") == k, n) for k, n in AGAIN.items()])
    touched = spark.createDataFrame([(k,) for k in AGAIN], "session_uuid string")
    versions.replace(spark, root, session_tables(records.where(F.col("line") < few * 8)), touched, ["session_uuid"], parts=8)
    now = versions.manifest(spark, root)
    out = None
    for name in ("turns", "compactions", "prompts", "signals"):
        one = versions.read(spark, root, name, now).groupBy("session_uuid").agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.max("ts_unix_ms").alias("last_ms"))
        out = one if out is None else out.unionByName(one)
    return out.select("name", "session_uuid", "rows", "last_ms")


def _corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """usage_flags from readings that come in three batches, each with readings older than what was there."""
    root, readings = new_folder(spark, "flags"), settled(fixtures.meter(spark, sf_dir))
    late = F.when(F.col("id") % 80 == 8, 2).when(F.col("ts_unix_ms") > fixtures.MIDWAY_MS, 1).otherwise(0)
    for k in range(3):
        corrections.apply(spark, root, readings.where(late == k), parts=8)
    return corrections.flags(spark, root)


def _hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = reports.events(fixtures.turns(spark, sf_dir))
    return announce.hook_outcomes(HOOKS, events, reports.EPOCH_MS + 30 * reports.DAY_MS)


def _resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's delta when transcripts are read a second time: first all lines of an even account's sessions and half of the others', then all."""
    root, records = new_folder(spark, "marks"), settled(tr.parsed(fixtures.transcript(spark, sf_dir)))
    found: list[DataFrame] = []
    even = F.substring("file", 2, 9).cast("int") % 2 == 0
    for some in (records.where(even | (F.col("ts_unix_ms") <= fixtures.MIDWAY_MS)), records):
        watermarks.advance(spark, root, some, found.append, parts=8)
    return found[-1]


def _day_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rollups.model_days(fixtures.turns(spark, sf_dir))
    pairs = F.transform(F.map_entries("models"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 100).cast("bigint")))
    return d.select("day_ms", F.array_join(pairs, ",").alias("models"), "total_cw")


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price quotes from answers that are JSON, JSON among prose, a refusal, or broken."""
    k = F.col("k")
    quote = F.concat(F.lit('{"input": '), k / 4, F.lit(', "output": '), k * 5, F.lit("}"))
    answer = F.when(k % 4 == 0, quote).when(k % 4 == 1, F.concat(F.lit("Sure:\n"), quote, F.lit("\nbye"))).when(k % 4 == 2, ' {"error": "none"} ').otherwise("no {price")
    q = fixtures.with_k(fixtures.turns(spark, sf_dir)).select("event_id", text.salvaged(answer, "input double, output double, error string").alias("q"))
    return q.select("event_id", F.col("q").isNotNull().alias("found"), "q.input", "q.output", "q.error")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of accounts as logins tell them: what the newest turn of an account says."""
    k = F.col("k")
    t = fixtures.with_k(fixtures.turns(spark, sf_dir)).select("account_id", "event_id", F.when(k % 5 == 0, F.concat(F.lit("label "), k)).otherwise("").alias("label"), F.when(k % 3 > 0, F.concat(F.lit("u"), k, F.lit("@x.org"))).alias("email"), F.when(k % 2 == 0, "org").otherwise("").alias("org"))
    return t.select("event_id", text.display_name(F.col("account_id"), F.col("label"), F.col("email"), F.col("org")).alias("name"))


#: Hooks of all outcomes: fired late, fired, expired without a match, still waiting, settled before.
HOOKS = [
    *reports.HOOKS,
    {"hook_id": 5, "kind_glob": "c*", "after_event_id": 0, "expires_ms": reports.EPOCH_MS + 1, "status": "pending"},
    {"hook_id": 6, "kind_glob": "s?gn*", "after_event_id": 50, "expires_ms": reports.EPOCH_MS + 90 * reports.DAY_MS, "status": "pending", "session_uuid": "s3"},
    {"hook_id": 7, "kind_glob": "*", "after_event_id": 0, "expires_ms": reports.EPOCH_MS + 90 * reports.DAY_MS, "status": "pending", "cwd": "/w/none"},
]

QUERIES: dict[str, Query] = {
    "model_day_map": _day_map,
    "price_quotes": _quotes,
    "account_names": _names,
    "corrected_flags": _corrected,
    "hook_outcomes": _hooks,
    "delta_resumed": _resumed,
    "discovered_files": _discovered,
    "replaced_sessions": _replaced,
}
