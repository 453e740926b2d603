"""Registered queries over transcripts, quota signals, reports and policies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, weights
from ..operators import attribution as att
from ..operators import identity, meter, policy, quota, rollups, views
from ..sources import fixtures
from ..sources import transcripts as tr
from ..sources.shared import settled

DAY_MS, WEEK_MS = 86_400_000, 604_800_000
SERIES = ("account_id", "bucket")
Query = Callable[[SparkSession, str], DataFrame]
#: The fixtures' clock and small literal tables.
EPOCH_MS = fixtures.EPOCH_MS
HOOKS = [
    {"hook_id": 1, "kind_glob": "c*", "after_event_id": 10, "expires_ms": EPOCH_MS + DAY_MS, "status": "pending"},
    {"hook_id": 2, "kind_glob": "*i?w", "after_event_id": 300, "expires_ms": EPOCH_MS + 20 * DAY_MS, "status": "pending"},
    {"hook_id": 3, "kind_glob": "*", "after_event_id": 0, "expires_ms": EPOCH_MS + DAY_MS, "status": "fired"},
    {"hook_id": 4, "kind_glob": "none.*", "after_event_id": 0, "expires_ms": EPOCH_MS + 40 * DAY_MS, "status": "pending"},
]
BUDGETS = "(VALUES ('/w/0/0', 5), ('/w/1/1', 6), ('/w/none', 7), ('/w/3/0', 8)) AS b(cwd, allowance)"
OPEN_BUDGETS = "(VALUES ('/w/0/0', 'session', 5, 90), ('/w/1/1', 'week', 6, NULL), ('/w/2/1', 'week', 40, 30), ('/w/3/2', 'session', NULL, 50), ('/w/4/1', 'week', 2, 99), ('/w/none', 'week', 5, 50)) AS b(cwd, bucket, spend_pct, meter_pct)"
BASELINE = "m-base"
UNTIL = ["", "revoked", "reset", "5h", " Week ", "2h", "1h30m", "90m", "1.5h", "0s", "18:00", "7:05:30", "24:00", "2024-01-20", "2023-12-31", "2024-01-20T06:30", "2024-02-30", "soon"]


def _turns(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(fixtures.with_k(fixtures.turns(spark, sf_dir)))


def _flags(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(meter.usage_flags(fixtures.meter(spark, sf_dir)))


def _both(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(meter.usage_flags(fixtures.meter(spark, sf_dir)), fixtures.with_k(fixtures.turns(spark, sf_dir)))


def _records(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(tr.parsed(fixtures.transcript(spark, sf_dir)))


def _now(turns: DataFrame) -> int:
    return turns.agg(F.max("ts_unix_ms") + 60_000).first()[0] or 0


def _files(t: DataFrame) -> DataFrame:
    """Paths of transcripts: one a session, and some of other shapes."""
    own = F.when(F.col("parent_session_uuid") == "", F.concat_ws("/", "project", F.concat("session_uuid", F.lit(".jsonl")))).otherwise(F.concat_ws("/", "project", "parent_session_uuid", F.lit("subagents"), F.concat("session_uuid", F.lit(".jsonl"))))
    flow = F.concat(F.col("project"), F.lit("/"), F.col("session_uuid"), F.lit("/subagents/workflows/w/"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("agent-"), F.col("event_id"), F.lit(".jsonl"))).otherwise("journal.jsonl"))
    a = t.groupBy(own.alias("path")).agg(F.max("ts_unix_ms").alias("mtime_ms"), (F.count("*") * 100).alias("bytes"))
    b = t.where("k % 17 = 0").groupBy(flow.alias("path")).agg(F.max("ts_unix_ms").alias("mtime_ms"), (F.count("*") * 100).alias("bytes"))
    c = t.where("k = 5").select(F.concat(F.lit("odd/a/b/"), F.col("event_id")).alias("path"), F.col("ts_unix_ms").alias("mtime_ms"), F.lit(10).cast("bigint").alias("bytes"))
    return a.unionByName(b).unionByName(c)


def _ledger(files: DataFrame) -> DataFrame:
    return files.where("mtime_ms % 2 = 0").select("path", "mtime_ms")


def _excluded(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("s1",), ("s17",), ("s3",)], "session_uuid string")


#: Reset hints and zones of generated panels, the last of each unreadable.
HINTS = ["2am", "10:50am", "May1,1am", "Feb 29, 12pm", "15:04", "Jan5,23:59", "Mar31,2:30am", "12am", "Oct 27, 3:15am", "soon"]
ZONES = ["UTC", "Europe/Copenhagen", "America/Los_Angeles", "Asia/Kolkata", "Nowhere/Land"]


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fixtures.observations(spark, sf_dir)
    pick = lambda own, n: F.element_at(F.array(*[F.lit(x) for x in own]), (F.expr(n) % len(own) + 1).cast("int"))
    page = F.format_string("Settings Current session bar %d%% used Resets %s (%s) Current week (all models) %d%% used Resets %s (%s) Current week (small) 0%% used", "session_pct", pick(HINTS, "id div 8"), pick(ZONES, "id div 80"), "week_pct", pick(HINTS, "id div 16"), pick(ZONES, "id div 8"))
    o = o.select("id", "ts_unix_ms", F.when(F.col("session_pct").isNull(), "loading").otherwise(page).alias("text"))
    return tr.panel_readings(o).drop("text", "ts_unix_ms")


def _api(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fixtures.observations(spark, sf_dir)
    one = lambda p: F.struct((F.col(f"{p}_pct") + 0.5).alias("utilization"), F.date_format(F.timestamp_millis(F.col(f"{p}_reset_ms") + 31_000), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("resets_at"))
    body = F.to_json(F.struct(one("session").alias("five_hour"), one("week").alias("seven_day")))
    return tr.api_readings(o.select("id", body.alias("body"))).drop("body")


def _marks(t: DataFrame) -> DataFrame:
    return t.where("turn_idx = 0 and account_id < 3").select(F.col("session_uuid").alias("file"), (F.col("ts_unix_ms") + 5 * DAY_MS).alias("seen_ms"))


def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.delta_since(tr.parsed(fixtures.transcript(spark, sf_dir)), _marks(fixtures.turns(spark, sf_dir)))


def _signals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    t = fixtures.turns(spark, sf_dir)
    who = t.groupBy("session_uuid").agg(F.max("account_id").alias("account_id"))
    s = tr.quota_signals(tr.parsed(fixtures.transcript(spark, sf_dir))).withColumnRenamed("file", "session_uuid").join(who, "session_uuid")
    return s, fixtures.QUOTA_MS


def _quota(f: Callable[[DataFrame, int], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(*_signals(spark, sf_dir))


def _cap(v: DataFrame) -> DataFrame:
    v = v.select("*", F.explode(F.array(F.lit("session"), F.lit("week"))).alias("meter"))
    return v.select("account_id", F.col("meter"), quota.cap_state(F.col("bucket"), F.col("meter"), F.col("refused"), F.col("low_priority_sessions"), F.col("using_overage")).alias("state"))


def _owners(t: DataFrame) -> DataFrame:
    return t.select("session_uuid", weights.owner().alias("owner")).distinct()


def _attribution(f: DataFrame, t: DataFrame) -> DataFrame:
    f, t = settled(f), settled(t)
    return att.attribution(f, t, meter.calibration_median(meter.calibration_points(f, t)))


def _slices(f: DataFrame, t: DataFrame) -> DataFrame:
    return views.window_slices(_attribution(f, t), _owners(t))


def _session_windows(f: DataFrame, t: DataFrame) -> DataFrame:
    w = att.limit_windows(f, _now(t)).select(*SERIES, F.col("start_ms").alias("window_start_ms"), "end_ms", "peak_pct")
    return _attribution(f, t).where("session_uuid <> ''").join(w, [*SERIES, "window_start_ms"]).select(*SERIES, "window_start_ms", "end_ms", "session_uuid", "measured_pct", "estimated_pct", "peak_pct")


def _totals(f: DataFrame, t: DataFrame) -> DataFrame:
    pct = F.col("measured_pct") + F.col("estimated_pct")
    return _attribution(f, t).groupBy(*SERIES).agg(F.round(F.sum(pct), 4).alias("total_pct"), F.round(F.sum(F.when(F.col("session_uuid") == "", pct).otherwise(0.0)), 4).alias("unattributed_pct"))


def _cwds(f: DataFrame, t: DataFrame) -> DataFrame:
    return att.group_totals(views.by_cwd(_attribution(f, t), rollups.cwd_mode(t), _owners(t)), "cwd")


def _points(f: DataFrame, t: DataFrame) -> DataFrame:
    return meter.calibration_points(f, t).where("bucket = 'session'")


def _solo(t: DataFrame) -> DataFrame:
    """Turns of one model a work session, as weights are learned from rises that one model caused."""
    names = F.array(*[F.lit(m) for m in fixtures.MODELS.values()])
    return t.withColumn("model", F.element_at(names, (F.expr(f"ts_unix_ms div {fixtures.SESSION_MS}") % 5 + 1).cast("int")))


def _report(f: DataFrame, t: DataFrame) -> DataFrame:
    return views.weights_report(t.select("model").distinct(), views.learn_weights(_points(f, t), _solo(t), BASELINE), BASELINE)


def _homes(t: DataFrame) -> DataFrame:
    s = t.select("session_uuid", "parent_session_uuid").distinct()
    return s.join(rollups.cwd_mode(t).select("session_uuid", "cwd"), "session_uuid", "left")


def _open_budgets(f: DataFrame, t: DataFrame) -> DataFrame:
    b = t.sparkSession.sql(f"SELECT cwd, bucket, CAST(spend_pct AS DOUBLE) AS spend_pct, CAST(meter_pct AS DOUBLE) AS meter_pct FROM {OPEN_BUDGETS}")
    accounts = t.where("cwd <> ''").groupBy("cwd").agg(F.max_by("account_id", F.struct("ts_unix_ms", "event_id")).alias("account_id"))
    return policy.open_window_use(b, views.with_owners(_attribution(f, t), _homes(t)), att.limit_windows(f, _now(t)), accounts, _latest(f))


def _parents(t: DataFrame) -> DataFrame:
    """Subagents' files, half of them under a folder that is no session's id."""
    h = F.md5("parent_session_uuid")
    named = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    folder = F.when(F.col("k") % 2 == 0, named).otherwise(F.col("parent_session_uuid"))
    files = t.where("parent_session_uuid <> ''").select(F.concat_ws("/", "project", folder, F.lit("subagents"), F.concat("session_uuid", F.lit(".jsonl"))).alias("path")).distinct()
    return tr.parent_links(files)


def _merged(t: DataFrame) -> DataFrame:
    merges = t.sparkSession.createDataFrame([(3, 1)], "from_id long, to_id long")
    return identity.merged_accounts(t, merges).groupBy("account_id").agg(F.count("*").alias("turns"), F.sum("raw_tokens").alias("raw_tokens"))


def _session_compactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.turns(spark, sf_dir)
    c = tr.compactions(tr.parsed(fixtures.transcript(spark, sf_dir))).where("confirmed").groupBy(F.col("file").alias("session_uuid")).agg(F.count("*").alias("n"), F.count_if(F.col("cache_state") == "cold").alias("cold"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    s = rollups.sessions(t).join(c, "session_uuid", "left")
    return s.select("session_uuid", "turns", "raw_tokens", zero("n").alias("compaction_count"), zero("cold").alias("cold_compaction_count"))


def _from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tr.read_lines(spark, [fixtures.transcript_files(spark, sf_dir)], fixtures.session_of)
    return tr.turns(tr.parsed(lines)).drop("line")


def _maxed(f: DataFrame, t: DataFrame) -> DataFrame:
    m = meter.calibration_median(meter.calibration_points(f, t)).groupBy("account_id").agg(*[F.max(F.when(F.col("bucket") == b, F.col("median_cw_per_pct"))).alias(b) for b in ("week", "session")])
    return m.where("session > 0 and week > 0").select("account_id", F.round(F.col("week") / F.col("session"), 4).alias("sessions_per_week"))


def _logins(t: DataFrame) -> DataFrame:
    return t.where("event_id % 40 < 4").select(F.concat(F.lit("/c/"), F.col("event_id") % 4).alias("config_dir"), "account_id", "ts_unix_ms", "event_id")


def _accounts(f: DataFrame, t: DataFrame) -> DataFrame:
    a = t.groupBy("account_id").agg(F.count("*").alias("turns"))
    dirs = identity.login_intervals(_logins(t)).groupBy("account_id").agg(F.array_join(F.array_sort(F.collect_set("config_dir")), ",").alias("dirs"))
    metered = f.select("account_id", F.lit(True).alias("metered")).distinct()
    return a.join(metered, "account_id", "left").join(dirs, "account_id", "left").select("account_id", "turns", F.coalesce("metered", F.lit(False)).alias("metered"), F.coalesce("dirs", F.lit("")).alias("dirs"))


def _latest(f: DataFrame) -> DataFrame:
    return rollups.latest(f.where("pct is not null"), [*SERIES], [F.desc("ts_unix_ms"), F.desc("id")])


def _status(f: DataFrame) -> DataFrame:
    left = F.when(F.col("reset_ms") > F.col("ts_unix_ms"), text.compact_duration(F.col("reset_ms") - F.col("ts_unix_ms"))).otherwise("")
    return _latest(f).select(*SERIES, "pct", text.band(F.col("pct")).alias("band"), left.alias("resets_in"))


#: A poll older than this is stale.
STALE_MS = 2 * 3_600_000


def _midway(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(polls, flags, newest readings) as they were within a work session that runs out early."""
    f = settled(meter.usage_flags(fixtures.meter(spark, sf_dir)).where(F.col("ts_unix_ms") <= fixtures.MIDWAY_MS))
    return fixtures.observations(spark, sf_dir), f, _latest(f)


def _sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls, f, now = _midway(spark, sf_dir)
    resets = f.where("reset_ms is not null").groupBy(*SERIES).agg(F.max_by("reset_ms", F.struct("ts_unix_ms", "id")).alias("reset_ms"))
    projected = meter.limit_projection(meter.burn_now(f).join(resets, [*SERIES], "left"))
    return quota.meter_sensors(now, projected, quota.collection(polls, fixtures.MIDWAY_MS, STALE_MS))


def _status_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls, f, now = _midway(spark, sf_dir)
    return quota.status_lines(polls, now, meter.burn_now(f), fixtures.MIDWAY_MS, STALE_MS)


def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    health = quota.collection(fixtures.observations(spark, sf_dir).where("account_id = 1"), fixtures.QUOTA_MS, STALE_MS)
    own = policy.page(events(fixtures.turns(spark, sf_dir)), 100, 500)
    # one row each
    return own.join(health.select(F.col("age_s").alias("poll_age_s")), F.lit(True), "left").withColumn("stale", F.coalesce(F.col("poll_age_s") * 1000 > STALE_MS, F.lit(False)))


def _control(f: DataFrame, t: DataFrame) -> DataFrame:
    return views.control_pair(views.learn_weights(meter.calibration_points(f, t).where("bucket = 'session'"), _solo(t), BASELINE))


#: A user's own prices.
OWN_PRICES = [("m-mid", 3.0, 12.0, ""), ("m-unpriced", 2.0, 10.0, "unverified"), ("m-other", 1.0, 9.0, "")]


def _models(t: DataFrame) -> DataFrame:
    own = t.sparkSession.createDataFrame(OWN_PRICES, "model string, input_price double, output_price double, status string")
    return weights.model_prices(t.select("model").distinct(), weights.overridden(weights.price_table(t.sparkSession), own))


def _leases(t: DataFrame) -> DataFrame:
    """A lease of each kind and state of its window by turn, and whether it holds ten hours on."""
    k, ms, hour = F.col("k"), F.col("ts_unix_ms"), 3_600_000
    kind = F.element_at(F.array(F.lit("manual"), F.lit("deadline"), F.lit("window_reset"), F.lit("window_reset")), (F.col("event_id") % 4 + 1).cast("int"))
    own = t.select("event_id", "ts_unix_ms", kind.alias("kind"), F.when(k % 10 > 0, ms + (k - 40) * hour).alias("at_ms"), F.when(k % 2 == 0, ms + (k - 30) * hour).alias("window_end_ms"), F.when(k % 5 > 0, ms + (k - 60) * hour).alias("open_end_ms"), F.when(k % 7 > 0, ms - (k % 50) * hour).alias("bound_after_ms"))
    return own.select("event_id", "kind", policy.lease_live("kind", F.col("ts_unix_ms") + 10 * hour).alias("live"))


def _since_reset(f: DataFrame) -> DataFrame:
    last = F.max(F.when(F.col("reset_detected"), F.col("ts_unix_ms"))).over(Window.partitionBy(*SERIES))
    return f.withColumn("since", F.coalesce(last, F.lit(0).cast("bigint"))).where("valid and ts_unix_ms >= since").groupBy(*SERIES).agg(F.max("since").alias("since_ms"), F.max("pct").alias("max_pct"))


def _detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header of each session, its subagents, compactions and share of the meters' windows."""
    f, t = settled(meter.usage_flags(fixtures.meter(spark, sf_dir))), settled(fixtures.turns(spark, sf_dir))
    c = tr.compactions(tr.parsed(fixtures.transcript(spark, sf_dir))).groupBy(F.col("file").alias("session_uuid")).agg(
        F.count("*").alias("compactions"), F.count_if("confirmed").alias("confirmed"), F.count_if(F.col("confirmed") & (F.col("cache_state") == "cold")).alias("cold_compactions")
    )
    share = att.pct_totals(_attribution(f, t), _owners(t)).groupBy(F.col("owner").alias("session_uuid")).agg(
        *[F.max(F.when(F.col("bucket") == b, F.col(x))).alias(f"{b}_{x}") for b in ("session", "week") for x in ("total_pct", "peak_pct", "windows")]
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    head = rollups.sessions(t).select("session_uuid", "project", "first_ms", "last_ms", "output_tokens", "idle_miss_count", "rotation_count", "restructure_count", "cache_ttl", "models")
    all_ = rollups.session_list(t).join(head, "session_uuid").join(rollups.peak_sum(t, fixtures.SESSION_MS), "session_uuid").join(c, "session_uuid", "left").join(share, "session_uuid", "left")
    return all_.select(
        "session_uuid", "project", "first_ms", "last_ms", "turns", "raw_tokens", "output_tokens", F.col("peak_raw_tokens").alias("peak_5h_raw_tokens"), "idle_miss_count", "rotation_count", "restructure_count", "cache_ttl", "models",
        "subagents", "subagent_turns", zero("compactions"), zero("confirmed"), zero("cold_compactions"), *[f"{b}_{x}" for b in ("session", "week") for x in ("total_pct", "peak_pct", "windows")],
    )


def _since_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.turns(spark, sf_dir)
    # a summary's line is that of the turn it precedes
    marks = tr.compactions(tr.parsed(fixtures.transcript(spark, sf_dir))).select(F.col("file").alias("session_uuid"), F.expr("line div 8").alias("turn_idx"))
    return views.turns_since(t, marks)


def _announced(t: DataFrame) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("budget", "limit_projection", "saturation", "recommendation", "cache")])
    states = F.array(*[F.lit(x) for x in ("tight", "exceeded", "projected", "saturated", "compact", "expiring", "clear")])
    pick = lambda a, n: F.element_at(a, (n + 1).cast("int"))
    e = t.select("event_id", "ts_unix_ms", F.when(F.col("k") % 2 == 1, "").otherwise(F.col("session_uuid")).alias("session_uuid"), pick(kinds, F.col("k") % 5).alias("kind"), pick(states, F.col("event_id") % 7).alias("state"), F.when(F.col("k") % 3 > 0, F.col("ts_unix_ms") + F.col("k") * 600_000).alias("eta_ms"))
    return e.where(policy.worth_saying("kind", "state", "eta_ms", F.col("ts_unix_ms")))


def _gate(t: DataFrame) -> DataFrame:
    k = F.col("k")
    s = t.select("event_id", "ts_unix_ms", F.when(k % 11 == 0, "").otherwise("/sock").alias("socket"), (k % 7 > 0).alias("reachable"), F.when(k % 3 == 0, "idle").otherwise("busy").alias("status"), F.when(k % 13 > 0, F.col("ts_unix_ms") - k * 20_000).alias("status_ms"), (k % 4 == 0).alias("cold"))
    return s.select("event_id", policy.admission(F.col("ts_unix_ms")).alias("skip"))


def _loops(t: DataFrame) -> DataFrame:
    k = F.col("k")
    rows = t.where("cwd <> ''").select("session_uuid", text.loop_key(F.col("cwd")).alias("loop_key"), F.col("cwd").alias("text"), F.when(k % 9 == 0, "done").otherwise("open").alias("status"), F.when((k % 31 == 0) & (F.substring("session_uuid", 2, 9).cast("int") % 3 == 0), "dismissed").otherwise("").alias("user_status"), "ts_unix_ms", "event_id")
    return policy.loops(rows, _now(t), 7 * DAY_MS)


def _trail(t: DataFrame) -> DataFrame:
    n = _loops(t).groupBy("session_uuid").agg(F.count("*").alias("open_loops"), F.array_join(F.array_sort(F.collect_set("text")), ",").alias("texts"))
    s = t.groupBy("session_uuid").agg(F.max("ts_unix_ms").alias("last_ms"))
    return s.join(n, "session_uuid", "left").select("session_uuid", "last_ms", F.coalesce("open_loops", F.lit(0).cast("bigint")).alias("open_loops"), F.coalesce("texts", F.lit("")).alias("texts"))


def _log(t: DataFrame) -> DataFrame:
    actions = F.array(F.lit("set"), F.lit("revoke"), F.lit("settle"))
    return t.where("cwd <> ''").select("cwd", F.element_at(actions, (F.col("event_id") % 3 + 1).cast("int")).alias("action"), F.col("k").alias("allowance"), "ts_unix_ms", "event_id")


def _levels(t: DataFrame) -> DataFrame:
    return t.where("cwd <> ''").groupBy("cwd").agg(F.max_by("model", F.struct("ts_unix_ms", "event_id")).alias("state"))


def _budgets(t: DataFrame) -> DataFrame:
    return t.sparkSession.sql(f"SELECT cwd, CAST(allowance AS BIGINT) AS allowance FROM {BUDGETS}")


def _pressure(t: DataFrame) -> DataFrame:
    k = F.col("k")
    t = t.withColumns({"a": F.when(k % 5 > 0, 40.0), "u": F.when(k % 7 > 0, (k % 60) * 1.0), "b": F.when(k % 3 > 0, 90.0), "v": k * 1.0})
    state, rule = policy.combined(policy.pressure("a", "u"), policy.pressure("b", "v"))
    return t.select("event_id", state.alias("state"), rule.alias("rule"))


def _wakeups(f: DataFrame, t: DataFrame) -> DataFrame:
    week = F.col("k") % 2 == 0
    span = F.when(week, WEEK_MS).otherwise(fixtures.SESSION_MS).cast("bigint")
    p = t.withColumn("span", span).select(F.col("event_id").alias("promise_id"), "session_uuid", "account_id", F.when(week, "week").otherwise("session").alias("bucket"), F.col("ts_unix_ms").alias("created_ms"), F.expr("(ts_unix_ms div span + 1) * span").alias("due_ms"))
    return policy.wakeups(p, f.where("reset_detected"), _now(t))


def _text(t: DataFrame) -> DataFrame:
    ms = F.col("ts_unix_ms")
    return t.select("event_id", text.loop_key(F.col("cwd")).alias("loop_key"), text.base_name(F.col("cwd")).alias("base"), text.rfc3339(ms).alias("stamp"), text.compact_duration(F.col("k") * F.col("k") * F.col("event_id") * 37).alias("took"), text.short_number(F.col("raw_tokens")).alias("short"), text.band(F.col("k")).alias("band"))


def _deadlines(t: DataFrame) -> DataFrame:
    return t.select("event_id", text.deadline_phrase(F.col("ts_unix_ms") + F.col("k") * 7_000_000, F.col("ts_unix_ms")).alias("phrase"))


def _until(t: DataFrame) -> DataFrame:
    k, now = F.col("k"), F.col("ts_unix_ms")
    spec = F.element_at(F.array(*[F.lit(x) for x in UNTIL]), (F.col("event_id") % len(UNTIL) + 1).cast("int"))
    bucket = F.when(k % 7 == 0, "other").when(k % 2 == 0, "week").otherwise("session")
    lease = policy.until(spec, bucket, now, {"session": F.when(k % 3 > 0, now + (k - 20) * 60_000), "week": now + k * 3_600_000})
    return t.select("event_id", lease.alias("lease")).select("event_id", "lease.*")


def events(t: DataFrame) -> DataFrame:
    kinds = {v: k for k, v in fixtures.MODELS.items()}
    named = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return t.select("event_id", "ts_unix_ms", named[F.col("model")].alias("kind"), "session_uuid", "cwd", "account_id")


def _nearest(t: DataFrame) -> DataFrame:
    prices = t.where("k % 17 = 0").groupBy("account_id", "ts_unix_ms").agg(F.min("k").alias("price"))
    return views.nearest_price(t.select("event_id", "account_id", "ts_unix_ms"), prices, ["account_id"]).select("event_id", "price")


QUERIES: dict[str, Query] = {
    "path_shapes": _turns(lambda t: _files(t).groupBy(tr.path_shape(F.col("path")).alias("shape")).agg(F.count("*").alias("files"))),
    "mtime_gate": _turns(lambda t: tr.changed(_files(t), _ledger(_files(t))).select("path", "mtime_ms")),
    "excluded_sessions": _turns(lambda t: _owners(t).join(_excluded(t.sparkSession), "session_uuid", "left_anti").join(_excluded(t.sparkSession).withColumnRenamed("session_uuid", "owner"), "owner", "left_anti").select("session_uuid", "owner")),
    "coverage": _turns(lambda t: tr.coverage(_files(t), _ledger(_files(t)), _excluded(t.sparkSession))),
    "panel_extract": _panel,
    "api_reading": _api,
    "transcript_turns": _records(lambda r: tr.turns(r).drop("line")),
    "transcript_files": _from_files,
    "parent_links": _turns(_parents),
    "account_merge": _turns(_merged),
    "session_compactions": _session_compactions,
    "attr_rows": _both(lambda f, t: views.with_owners(_attribution(f, t), _homes(t)).select(*SERIES, "window_start_ms", "session_uuid", "effective_uuid", "cwd", "measured_pct", "estimated_pct")),
    "budget_open_window": _both(_open_budgets),
    "dedupe_responses": _records(lambda r: tr.responses(r).select("file", F.col("message.id").alias("message_id"), F.col("message.usage.output_tokens").alias("output_tokens"))),
    "human_prompts": _records(tr.human_prompts),
    "compaction_confirm": _records(tr.compactions),
    "compactions_summary": _records(lambda r: tr.compactions(r).where("confirmed").groupBy("cache_state").agg(F.count("*").alias("n"), F.sum("prefix_tokens").alias("prefix_tokens"), F.sum("summary_tokens").alias("summary_tokens"))),
    "cold_waste": _records(lambda r: tr.compactions(r).where("confirmed and cache_state = 'cold'").agg(F.count("*").alias("n"), F.coalesce(F.sum("prefix_tokens"), F.lit(0).cast("bigint")).alias("tokens"))),
    "quota_signals": _records(tr.quota_signals),
    "delta_since": _delta,
    "quota_low_priority": _quota(quota.low_priority),
    "quota_verdict": _quota(quota.verdict),
    "cap_state": _quota(lambda s, n: _cap(quota.verdict(s, n))),
    "now_state": lambda spark, sf_dir: quota.now_state(fixtures.observations(spark, sf_dir)),
    "now_history": _flags(lambda f: f.withColumn("_m", F.max("ts_unix_ms").over(Window.partitionBy("account_id"))).where(F.col("ts_unix_ms").between(F.col("_m") - DAY_MS, F.col("_m"))).select("id", *SERIES, "ts_unix_ms", "pct")),
    "pct_since_reset": _flags(_since_reset),
    "sensor_readings": _sensors,
    "status_text": _status_text,
    "weights_control": _both(_control),
    "model_status": _turns(_models),
    "status_line": _flags(_status),
    "session_insight": _turns(lambda t: views.session_insight(t, _now(t))),
    "sensor_session": _turns(lambda t: views.session_sensors(views.session_insight(t, _now(t)))),
    "session_detail": _detail,
    "turns_since_compact": _since_compact,
    "learn_weights": _both(lambda f, t: views.learn_weights(_points(f, t), _solo(t), BASELINE)),
    "weights_report": _both(_report),
    "maxed_per_week": _both(_maxed),
    "nearest_price": _turns(_nearest),
    "accounts_view": _both(_accounts),
    "current_logins": _turns(lambda t: _logins(t).groupBy("config_dir").agg(F.max_by("account_id", F.struct("ts_unix_ms", "event_id")).alias("account_id"))),
    "session_windows": _both(_session_windows),
    "window_slices": _both(_slices),
    "attr_window_slices": _both(lambda f, t: views.fold_tail(_slices(f, t), [*SERIES, "window_start_ms"], "owner", "pct", 8)),
    "attr_group_windows": _both(lambda f, t: _attribution(f, t).groupBy(*SERIES, "project", "window_start_ms").agg(F.round(F.sum(F.col("measured_pct") + F.col("estimated_pct")), 4).alias("pct"))),
    "attr_current_window": _both(lambda f, t: views.current_window(_slices(f, t))),
    "attr_totals": _both(_totals),
    "attr_groups_cwd": _both(_cwds),
    "budget_rules": _turns(_pressure),
    "budget_lifecycle": _turns(lambda t: policy.lifecycle(_log(t))),
    "budgets_with_level": _turns(lambda t: _budgets(t).join(_levels(t), "cwd", "left")),
    "orphan_levels": _turns(lambda t: _levels(t).join(_budgets(t), "cwd", "left_anti")),
    "prune_by_cwd": _turns(lambda t: t.join(_budgets(t), "cwd", "left_semi").select("event_id", "cwd")),
    "lease_status": _turns(_leases),
    "events_page": _page,
    "hook_matches": _turns(lambda t: policy.hook_matches(HOOKS, events(t))),
    "event_retention": _turns(lambda t: policy.retained(events(t), HOOKS[1:2], EPOCH_MS + 14 * DAY_MS).select("event_id")),
    "announce_filter": _turns(lambda t: _announced(t).select("event_id", "kind", "state")),
    "announce_cap": _turns(lambda t: policy.capped(_announced(t)).select("event_id", "session_uuid")),
    "wakeup_outcomes": _both(_wakeups),
    "trail_open_loops": _turns(_loops),
    "trail_view": _turns(_trail),
    "admission_gate": _turns(_gate),
    "text_functions": _turns(_text),
    "deadline_phrases": _turns(_deadlines),
    "until_leases": _turns(_until),
}
