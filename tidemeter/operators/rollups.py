"""Aggregates over turns: sessions, classes, models, days and top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import weights

CLASSES = ("idle_miss", "rotation", "restructure", "normal")
AVOIDABLE = ("idle_miss", "rotation", "restructure")


def _long(c) -> F.Column:
    return c.cast("bigint")


def by_class(turns: DataFrame) -> DataFrame:
    return turns.groupBy("classification").agg(_long(F.count("*")).alias("turns"), F.sum("raw_tokens").alias("raw_tokens"), (F.sum("cw100") / 100.0).alias("cw_tokens"))


def sessions(turns: DataFrame) -> DataFrame:
    """One row a session: span, counts, sums, class counts, models in order, newest account, first project."""
    at = F.struct("ts_unix_ms", "turn_idx")
    sums = [F.sum(c).alias(c) for c in (*weights.TYPE_WEIGHTS, "raw_tokens")]
    return turns.groupBy("session_uuid").agg(
        F.min("ts_unix_ms").alias("first_ms"), F.max("ts_unix_ms").alias("last_ms"), _long(F.count("*")).alias("turns"), *sums,
        (F.sum("cw100") / 100.0).alias("cw_tokens"), *[_long(F.count_if(F.col("classification") == c)).alias(f"{c}_count") for c in CLASSES],
        F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"), F.max_by("account_id", at).alias("account_id"), F.min_by("project", at).alias("project"),
        F.when((F.sum("cache_create_1h") > 0) & (F.sum("cache_create_5m") > 0), "mix").when(F.sum("cache_create_1h") > 0, "1h").when(F.sum("cache_create_5m") > 0, "5m").otherwise("none").alias("cache_ttl"),
    )


def cwd_mode(turns: DataFrame) -> DataFrame:
    """The directory most turns of a session have, the first seen of equals; empty ones do not count."""
    n = turns.where("cwd <> ''").groupBy("session_uuid", "cwd").agg(_long(F.count("*")).alias("n"), F.min("turn_idx").alias("first"))
    best = F.row_number().over(Window.partitionBy("session_uuid").orderBy(F.desc("n"), "first"))
    return n.withColumn("_r", best).where("_r = 1").select("session_uuid", "cwd", "n")


def peak_sum(turns: DataFrame, span_ms: int, slot_ms: int = 3_600_000) -> DataFrame:
    """The largest sum of raw tokens in any ``span_ms``, both ends included.

    Tokens enter a running sum at their time and leave it once the span is past, so a turn counts twice however
    many turns a span holds. The sum runs within slots of time, which spreads a session of any size; a row a slot carries it across them.
    Turns without a time are one span of their own, as in a frame by range.
    """
    key = ["session_uuid", "ts_unix_ms"]
    at = turns.groupBy(*key).agg(F.sum("raw_tokens").alias("_d"), _long(F.count("raw_tokens")).alias("_n")).withColumn("_in", F.lit(True))
    gone = at.where("ts_unix_ms is not null").select("session_uuid", (F.col("ts_unix_ms") + span_ms + 1).alias("ts_unix_ms"), (-F.col("_d")).alias("_d"), (-F.col("_n")).alias("_n"), F.lit(False).alias("_in"))
    both = at.unionByName(gone).withColumn("_slot", _long(F.floor(F.col("ts_unix_ms") / slot_ms)))
    slots = both.groupBy("session_uuid", "_slot").agg(F.sum("_d").alias("_d"), F.sum("_n").alias("_n"))
    before = Window.partitionBy("session_uuid").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    # what is without a time is first in order, and no part of what follows
    known = lambda c: F.coalesce(F.sum(F.when(F.col("_slot").isNotNull(), F.col(c))).over(before), F.lit(0).cast("bigint"))
    slots = slots.select(F.col("session_uuid").alias("_s"), F.col("_slot").alias("_k"), known("_d").alias("_bd"), known("_n").alias("_bn"))
    inside = Window.partitionBy("session_uuid", "_slot").orderBy("ts_unix_ms", "_in").rowsBetween(Window.unboundedPreceding, 0)
    ran = both.withColumns({c: F.coalesce(F.sum(c).over(inside), F.lit(0).cast("bigint")) for c in ("_d", "_n")}).where("_in")
    ran = ran.join(slots, F.col("session_uuid").eqNullSafe(F.col("_s")) & F.col("_slot").eqNullSafe(F.col("_k")))
    return ran.groupBy("session_uuid").agg(F.max(F.when(F.col("_n") + F.col("_bn") > 0, F.col("_d") + F.col("_bd"))).alias("peak_raw_tokens"))


def model_totals(turns: DataFrame) -> DataFrame:
    """Models with spend; the share is among priced models."""
    t = turns.groupBy("model").agg(_long(F.count("*")).alias("turns"), F.sum("raw_tokens").alias("raw_tokens"), F.sum("cw100").alias("c")).where("c > 0")
    t = t.withColumn("priced", F.col("model").isin(*weights.MULTIPLIERS))
    total = t.where("priced").agg(F.sum("c").alias("all"))
    share = F.when(F.col("priced"), F.round(F.col("c") / F.col("all"), 6)).otherwise(F.lit(None).cast("double"))
    # one row of totals beside a row a model
    return t.join(F.broadcast(total)).select("model", "turns", "raw_tokens", (F.col("c") / 100.0).alias("cw_tokens"), "priced", share.alias("share"))


def top_offenders(turns: DataFrame, compactions: DataFrame, k: int = 25) -> DataFrame:
    """The ``k`` sessions with most avoidable tokens, less those that have neither such tokens nor a confirmed cold compaction (transcripts.compactions)."""
    leak = F.sum(F.when(F.col("classification").isin(*AVOIDABLE), F.col("raw_tokens")).otherwise(0)).alias("leak_tokens")
    cold = compactions.where("confirmed and cache_state = 'cold'").groupBy(F.col("file").alias("session_uuid")).agg(_long(F.count("*")).alias("cold"))
    t = turns.groupBy("session_uuid").agg(leak, F.sum("raw_tokens").alias("raw_tokens"))
    top = t.orderBy(F.desc("leak_tokens"), "session_uuid").limit(k)
    return top.join(cold, "session_uuid", "left").withColumn("cold_compactions", F.coalesce("cold", F.lit(0).cast("bigint"))).drop("cold").where("leak_tokens > 0 or cold_compactions > 0")


def session_list(turns: DataFrame) -> DataFrame:
    """Sessions with the number and turns of their subagents."""
    s = turns.groupBy("session_uuid", "parent_session_uuid").agg(_long(F.count("*")).alias("turns"), F.sum("raw_tokens").alias("raw_tokens"))
    sub = s.where("parent_session_uuid <> ''").groupBy(F.col("parent_session_uuid").alias("session_uuid")).agg(_long(F.count("*")).alias("subagents"), F.sum("turns").alias("subagent_turns"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return s.join(sub, "session_uuid", "left").select("session_uuid", "turns", "raw_tokens", zero("subagents"), zero("subagent_turns"))


def heatmap(turns: DataFrame) -> DataFrame:
    at = F.timestamp_millis("ts_unix_ms")
    return turns.groupBy(_long(F.dayofweek(at) - 1).alias("weekday"), _long(F.hour(at)).alias("hour")).agg(F.sum("raw_tokens").alias("raw_tokens"))


def collapse_runs(turns: DataFrame, within_ms: int = 60_000) -> DataFrame:
    """Neighbouring turns of a session with equal model and tokens, each within ``within_ms`` of the one before, become one: the first's fields, the last's time, numbered anew."""
    same = ["model", *weights.TYPE_WEIGHTS]
    w = Window.partitionBy("session_uuid").orderBy("turn_idx")
    equal = F.abs(F.col("ts_unix_ms") - F.lag("ts_unix_ms").over(w)) <= within_ms
    for c in same:
        equal = equal & F.lag(c).over(w).eqNullSafe(F.col(c))
    t = turns.withColumn("_new", F.when(F.coalesce(equal, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("_new").over(w) - 1)
    t = t.groupBy("session_uuid", "run").agg(
        F.max_by("ts_unix_ms", "turn_idx").alias("ts_unix_ms"), *[F.min_by(c, "turn_idx").alias(c) for c in ("cwd", "project", "account_id", "parent_session_uuid", *same)], _long(F.count("*")).alias("merged")
    )
    return t.withColumnRenamed("run", "turn_idx")


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The row of each key that comes first in ``order``."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def tail_within(rows: DataFrame, keys: list[str], order: list, size: F.Column, limit: int) -> DataFrame:
    """Newest rows of each key whose sizes sum to at most ``limit``, the newest always."""
    w = Window.partitionBy(*keys).orderBy(*order)
    t = rows.withColumns({"_sum": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_r": F.row_number().over(w)})
    return t.where((F.col("_sum") <= limit) | (F.col("_r") == 1)).drop("_sum", "_r")


def model_days(turns: DataFrame) -> DataFrame:
    """(day_ms, models, total_cw): cost-weighted tokens of each day (UTC) by priced model, as a map, and their sum; unpriced models would make the parts miss the whole."""
    day = (F.floor(F.col("ts_unix_ms") / 86_400_000) * 86_400_000).cast("bigint").alias("day_ms")
    each = turns.where(F.col("model").isin(*weights.MULTIPLIERS)).groupBy(day, "model").agg(F.sum("cw100").alias("c"))
    models = F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", F.round(F.col("c") / 100.0, 2).alias("cw")))))
    return each.groupBy("day_ms").agg(models.alias("models"), F.round(F.sum("c") / 100.0, 2).alias("total_cw"))
