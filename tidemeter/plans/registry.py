"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import weights
from ..operators import attribution as att
from ..operators import identity, meter, policy, rollups
from ..sources import fixtures
from ..sources import transcripts as tr
from ..sources.shared import settled
from . import reports, reports_sql, sql, upkeep, upkeep_sql

DAY_MS = 86_400_000
SERIES = ("account_id", "bucket")


def _turns(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(fixtures.turns(spark, sf_dir))


def _flags(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(meter.usage_flags(fixtures.meter(spark, sf_dir)))


def _both(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(meter.usage_flags(fixtures.meter(spark, sf_dir)), fixtures.turns(spark, sf_dir))


def _count(name: str) -> F.Column:
    return F.count("*").cast("bigint").alias(name)


def _logins(t: DataFrame) -> DataFrame:
    return t.where("event_id % 40 < 4").select(F.concat(F.lit("/c/"), F.col("event_id") % 4).alias("config_dir"), "account_id", "ts_unix_ms", "event_id")


def _asof(t: DataFrame) -> DataFrame:
    asked = t.select("event_id", "ts_unix_ms", F.concat(F.lit("/c/"), F.col("event_id") % 5).alias("config_dir"))
    return identity.as_of(asked, identity.login_intervals(_logins(t))).select("event_id", "resolved")


def _recent(t: DataFrame) -> DataFrame:
    now = t.agg((F.max("ts_unix_ms") + 60_000 - DAY_MS).alias("since"))
    s = t.groupBy("session_uuid").agg(F.max("ts_unix_ms").alias("last_ms"))
    return s.join(F.broadcast(now), F.col("last_ms") >= F.col("since")).select("session_uuid", "last_ms").orderBy(F.desc("last_ms"), "session_uuid").limit(10)


def _trail_cost(t: DataFrame) -> DataFrame:
    # both cache writes count 1.5 here
    c = F.col("input_tokens") * 20 + F.col("output_tokens") * 100 + F.col("cache_read") * 2 + (F.col("cache_create_5m") + F.col("cache_create_1h")) * 30
    return t.agg((F.sum(c) / 20.0).alias("cw_tokens"), F.sum("raw_tokens").alias("raw_tokens"), _count("turns"))


def _heat_pct(f: DataFrame) -> DataFrame:
    good = f.where("pct is not null and valid and not saturated")
    before = F.lag("pct").over(Window.partitionBy(*SERIES).orderBy("ts_unix_ms", "id"))
    up = good.withColumn("p", before).where("not reset_detected and pct > p")
    at = F.timestamp_millis("ts_unix_ms")
    return up.groupBy("bucket", (F.dayofweek(at) - 1).cast("bigint").alias("weekday"), F.hour(at).cast("bigint").alias("hour")).agg(F.sum(F.col("pct") - F.col("p")).alias("pct"))


def _median(f: DataFrame) -> DataFrame:
    w = Window.partitionBy(*SERIES).orderBy("ts_unix_ms", "id").rowsBetween(-2, 2)
    near = F.array_sort(F.collect_list("pct").over(w))
    n = F.size("near")
    middle = (F.element_at("near", F.expr("(size(near) + 1) div 2").cast("int")) + F.element_at("near", F.expr("size(near) div 2 + 1").cast("int"))) / 2.0
    return f.withColumn("near", near).select("id", *SERIES, F.when(n >= 3, middle).alias("median_pct"))


def _breaks(f: DataFrame) -> DataFrame:
    before = F.lag("ts_unix_ms").over(Window.partitionBy(*SERIES).orderBy("ts_unix_ms", "id"))
    gaps = f.withColumn("b", before).where("reset_detected and b is not null").select(*SERIES, F.expr("(ts_unix_ms + b) div 2").alias("ts_unix_ms"), F.lit(None).cast("bigint").alias("pct"))
    return f.select(*SERIES, "ts_unix_ms", "pct").unionByName(gaps)


def _edges(t: DataFrame) -> DataFrame:
    r = t.select("session_uuid", "turn_idx", weights.cache_state().alias("state"))
    return identity.level_edges(r, ["session_uuid"], ["turn_idx"]).select("session_uuid", "turn_idx", "state", "previous")


def _events_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.table(spark, sf_dir, "events").where("event_id > 100")
    kinds = [F.col("event_type").rlike(policy.glob(g)) for g in ("c*", "*i?w")]
    return e.where(kinds[0] | kinds[1]).select("event_id", "event_type", "user_id").orderBy("event_id").limit(500)


def _budgets(t: DataFrame) -> DataFrame:
    b = t.sparkSession.createDataFrame([("/w/0/0", 1.0), ("/w/1/1", 6.0), ("/w/2/2", 20.0), ("/w/none", 5.0), ("/w/3/0", None)], "cwd string, allowance double")
    u = t.groupBy("cwd").agg(F.sum("cw100").alias("c"))
    total = t.agg(F.sum("cw100").alias("all"))
    used = b.join(u, "cwd", "left").join(F.broadcast(total)).withColumn("used", F.round(F.lit(100.0) * F.col("c") / F.col("all"), 4))
    return used.select("cwd", "used", "allowance", policy.pressure("allowance", "used").alias("pressure"))


def _attribution(flags: DataFrame, turns: DataFrame) -> DataFrame:
    flags, turns = settled(flags), settled(turns)
    return att.attribution(flags, turns, meter.calibration_median(meter.calibration_points(flags, turns)))


def _owners(turns: DataFrame) -> DataFrame:
    return turns.select("session_uuid", weights.owner().alias("owner")).distinct()


def _windows(flags: DataFrame, turns: DataFrame) -> DataFrame:
    now = turns.agg((F.max("ts_unix_ms") + 60_000).alias("n")).first().n
    return att.limit_windows(flags, now)


def _projection(flags: DataFrame) -> DataFrame:
    flags = flags.where(F.col("ts_unix_ms") <= fixtures.MIDWAY_MS)
    last = flags.where("reset_ms is not null").groupBy(*SERIES).agg(F.max_by("reset_ms", F.struct("ts_unix_ms", "id")).alias("reset_ms"))
    return meter.limit_projection(meter.burn_now(flags).join(last, [*SERIES], "left"))


def _attr(key: str) -> Callable[[SparkSession, str], DataFrame]:
    return _both(lambda f, t: att.group_totals(_attribution(f, t), key))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "leaks_by_class": _turns(rollups.by_class),
    "raw_tokens": _turns(lambda t: t.select("event_id", "raw_tokens")),
    "type_weighted": _turns(lambda t: t.select("event_id", (F.col("tw20") / 20.0).alias("tw_tokens"))),
    "cost_weighted": _turns(lambda t: t.select("event_id", (F.col("cw100") / 100.0).alias("cw_tokens"))),
    "cold_prefix": _turns(lambda t: t.select("event_id", (weights.cold_prefix100() / 100.0).alias("cold_cost"))),
    "classify_turns": _turns(lambda t: t.select("event_id", "classification")),
    "cache_state": _turns(lambda t: t.select("event_id", weights.cache_state().alias("cache_state"))),
    "effective_owner": _turns(lambda t: t.groupBy(weights.owner().alias("owner")).agg(_count("turns"), F.sum("raw_tokens").alias("raw_tokens"))),
    "turn_gaps": _turns(lambda t: t.select("event_id", "session_uuid", "turn_idx", "gap_s")),
    "price_table": _turns(lambda t: weights.model_prices(t.select("model").distinct(), weights.price_table(t.sparkSession))),
    "model_totals": _turns(rollups.model_totals),
    "model_days": _turns(lambda t: t.where(F.col("model").isin(*weights.MULTIPLIERS)).groupBy(F.to_date(F.timestamp_millis("ts_unix_ms")).alias("day"), "model").agg((F.sum("cw100") / 100.0).alias("cw_tokens"))),
    "models_with_spend": _turns(lambda t: t.groupBy("model").agg(F.max("ts_unix_ms").alias("last_ms"), F.sum("cw100").alias("c")).where("c > 0").drop("c")),
    "unpriced_models": _turns(lambda t: t.select("model").distinct().join(weights.price_table(t.sparkSession), "model", "left_anti")),
    "ingest_stats": _turns(lambda t: t.agg(_count("turns"), F.count_distinct("session_uuid").alias("sessions"), F.count_distinct("project").alias("projects"), F.min("ts_unix_ms").alias("first_ms"), F.max("ts_unix_ms").alias("last_ms"))),
    "heatmap_tokens": _turns(rollups.heatmap),
    "trail_cost": _turns(_trail_cost),
    "sessions": _turns(rollups.sessions),
    "session_cwd_mode": _turns(rollups.cwd_mode),
    "peak_5h": _turns(lambda t: rollups.peak_sum(t, fixtures.SESSION_MS)),
    "session_list": _turns(rollups.session_list),
    "leaks_top": lambda spark, sf_dir: rollups.top_offenders(fixtures.turns(spark, sf_dir), tr.compactions(tr.parsed(fixtures.transcript(spark, sf_dir)))),
    "recent_sessions": _turns(_recent),
    "last_turns": _turns(lambda t: t.withColumn("r", F.row_number().over(Window.partitionBy("session_uuid").orderBy(F.desc("turn_idx")))).where("r <= 3").select("session_uuid", "turn_idx", "raw_tokens")),
    "collapse_runs": _turns(rollups.collapse_runs),
    "collapse_stats": _turns(lambda t: rollups.collapse_runs(t).agg(F.sum("merged").alias("turns"), _count("kept"))),
    "upsert_latest": _turns(lambda t: rollups.latest(t, ["session_uuid", "cwd"], [F.desc("ts_unix_ms"), F.desc("event_id")]).select("session_uuid", "cwd", "event_id", "ts_unix_ms")),
    "dedupe_first_last": _turns(lambda t: t.groupBy("session_uuid", "model").agg(F.min_by("event_id", "turn_idx").alias("first_event"), F.max_by("event_id", "turn_idx").alias("last_event"))),
    "tail_budget": _turns(lambda t: rollups.tail_within(t, ["session_uuid"], [F.desc("turn_idx")], F.col("raw_tokens"), 24_000).select("session_uuid", "turn_idx", "raw_tokens")),
    "resolve_prefix": _turns(lambda t: t.where(F.col("session_uuid").startswith("s1")).agg(F.count_distinct("session_uuid").alias("matches"), F.bool_or(F.col("session_uuid") == "s1").alias("exact")).select(F.lit("s1").alias("prefix"), "matches", "exact")),
    "account_for": _turns(lambda t: t.where("cwd <> ''").groupBy("cwd").agg(F.max_by("account_id", F.struct("ts_unix_ms", "event_id")).alias("account_id"))),
    "login_intervals": _turns(lambda t: identity.login_intervals(_logins(t))),
    "asof_account": _turns(_asof),
    "usage_flags": _flags(lambda f: f),
    "window_reset_events": _flags(lambda f: f.where("reset_detected").select("account_id", "bucket", "ts_unix_ms", "pct")),
    "latest_usage": _flags(lambda f: rollups.latest(f.where("pct is not null"), [*SERIES], [F.desc("ts_unix_ms"), F.desc("id")]).select(*SERIES, "ts_unix_ms", "pct")),
    "heatmap_pct": _flags(_heat_pct),
    "burn_series": _flags(lambda f: meter.burn_series(f, 45 * 60_000)),
    "burn_now": _flags(meter.burn_now),
    "limit_projection": _flags(_projection),
    "rolling_median": _flags(_median),
    "series_breaks": _flags(_breaks),
    "calibration_points": _both(meter.calibration_points),
    "calibration_median": _both(lambda f, t: meter.calibration_median(meter.calibration_points(f, t))),
    "buckets_5h": _turns(lambda t: meter.fixed_buckets(t, fixtures.SESSION_MS)),
    "limit_windows": _both(_windows),
    "attribution": _both(_attribution),
    "session_pct_totals": _both(lambda f, t: att.pct_totals(_attribution(f, t), _owners(t))),
    "attr_groups_project": _attr("project"),
    "attr_groups_session": _attr("session_uuid"),
    "weekly_capacity": _flags(att.weekly_slices),
    "capacity_summary": _flags(lambda f: att.capacity_summary(att.weekly_slices(f), f)),
    "level_edges": _turns(_edges),
    "events_query": _events_query,
    "budget_pressure": _turns(_budgets),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["attribution"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | reports.QUERIES | upkeep.QUERIES


def oracle_sql() -> dict[str, str]:
    return sql.QUERIES | reports_sql.QUERIES | upkeep_sql.QUERIES
