"""Budgets: how close a directory is to what it may use."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .asof import around


def pressure(allowance: str, used: str) -> F.Column:
    """clear, tight from 75 %, exceeded from 100 %; unknown where either is missing."""
    a, u = F.col(allowance), F.col(used)
    return F.when(a.isNull() | u.isNull(), "unknown").when(u >= a, "exceeded").when(u >= 0.75 * a, "tight").otherwise("clear")


def glob(pattern: str) -> str:
    """A regular expression for a glob of *, ? and character sets."""
    import re

    out = "".join({"*": ".*", "?": "."}.get(p, p if p[0] == "[" else re.escape(p)) for p in re.findall(r"\[[^\]]+\]|.", pattern))
    return f"^{out}$"


def severity(state) -> F.Column:
    return F.when(state == "exceeded", 3).when(state == "tight", 2).when(state == "clear", 1).otherwise(0)


def combined(spend: F.Column, meter: F.Column) -> tuple[F.Column, F.Column]:
    """(state, rule) of the worse of two pressures, the spend rule at a tie; clear names no rule."""
    first = (severity(spend) >= severity(meter)) & (spend != "unknown")
    state = F.when(first, spend).otherwise(meter)
    return state, F.when(state.isin("clear", "unknown"), "").when(first, "spend").otherwise("meter")


def open_window_use(budgets: DataFrame, owned: DataFrame, windows: DataFrame, accounts: DataFrame, latest: DataFrame) -> DataFrame:
    """budgets (cwd, bucket, spend_pct, meter_pct) with what their directory caused in the open window of its account's meter, and the pressure.

    owned: with_owners() rows; windows: limit_windows(); accounts: cwd, account_id of
    the directory's newest turn; latest: newest readings. A directory
    without movement in a measured window has used 0; without an open window nothing is known.
    """
    open_ = windows.where("in_progress").select("account_id", "bucket", F.col("start_ms").alias("window_start_ms"))
    used = owned.groupBy("account_id", "bucket", "window_start_ms", "cwd").agg(F.sum(F.col("measured_pct") + F.col("estimated_pct")).alias("used"))
    b = budgets.join(accounts, "cwd", "left").join(open_, ["account_id", "bucket"], "left").join(used, ["account_id", "bucket", "window_start_ms", "cwd"], "left")
    b = b.join(latest.select("account_id", "bucket", "pct"), ["account_id", "bucket"], "left")
    b = b.withColumn("spent_pct", F.when(F.col("window_start_ms").isNotNull(), F.round(F.coalesce("used", F.lit(0.0)), 2)))
    state, rule = combined(pressure("spend_pct", "spent_pct"), pressure("meter_pct", "pct"))
    rest = F.col("spend_pct") - F.col("spent_pct")
    left = F.when(rest.isNotNull(), F.round(F.greatest(F.lit(0.0), rest), 2))
    return b.select("cwd", "bucket", "account_id", "spent_pct", left.alias("remaining_pct"), state.alias("state"), rule.alias("rule"))


def lease_live(kind: str, now_ms: F.Column) -> F.Column:
    """Whether a lease holds: until revoked, to its time, or to the end of the window it is bound to, or of the next one that opens."""
    k, opened = F.col(kind), F.coalesce("open_end_ms", F.lit(0).cast("bigint"))
    waits = (opened == 0) | F.coalesce(opened <= F.col("bound_after_ms"), F.lit(False)) | (opened > now_ms)
    return (
        F.when(k == "deadline", F.coalesce(F.col("at_ms") > now_ms, F.lit(True)))
        .when((k == "window_reset") & F.col("window_end_ms").isNotNull(), F.col("window_end_ms") > now_ms).when(k == "window_reset", waits).otherwise(True)
    )


#: The words that bind a lease to a window.
RESETS = {"session": ("session", "5h", "session-reset", "5h-reset"), "week": ("week", "week-reset")}


def until(spec: F.Column, bucket: F.Column, now_ms: F.Column, ends: dict[str, F.Column]) -> F.Column:
    """(kind, bucket, at_ms, window_end_ms, bound_after_ms, problem): the lease that an ``until`` text asks for.

    Nothing, null or ``revoked`` holds until revoked; ``reset`` ends with the
    window of the row's own bucket, other words with the one they name; all else is an instant of text.instant.
    ends has the end of each bucket's open window; without a later one the
    lease binds to the next window. kind is null where problem says why: bucket, unreadable or passed.
    """
    s = F.lower(F.trim(F.coalesce(spec, F.lit(""))))
    target, end = F.when(s == "reset", F.coalesce(bucket, F.lit(""))), F.lit(None).cast("bigint")
    for name, words in RESETS.items():
        target = target.when(s.isin(*words), name)
    for name, at in ends.items():
        end = F.when(target == name, at).otherwise(end)
    at = text.instant(s, now_ms)
    manual, bound, later = s.isin("", "revoked"), target.isin(*RESETS), at > now_ms
    kind = F.when(manual, "manual").when(target.isNotNull(), F.when(bound, "window_reset")).when(later, "deadline")
    problem = F.when(kind.isNotNull(), "").when(target.isNotNull(), "bucket").when(at.isNull(), "unreadable").otherwise("passed")
    return F.struct(
        kind.alias("kind"), F.when(bound, target).otherwise("").alias("bucket"), F.when(kind == "deadline", at).alias("at_ms"),
        F.when(bound & (end > now_ms), end).alias("window_end_ms"), F.when(bound, now_ms).alias("bound_after_ms"), problem.alias("problem"),
    )


#: What a hook may be limited to besides the kind of event.
ABOUT = ("bucket", "session_uuid", "cwd", "account_id")


def hook_matches(hooks: list[dict], events):
    """The first event of each pending hook (configuration: hook_id, kind_glob, after_event_id, expires_ms, and perhaps one of ABOUT) after its cursor and before it expires. One pass over the events, no join."""
    about = lambda h: [F.col(c) == h[c] for c in ABOUT if h.get(c)]
    hits = [
        F.when(reduce(and_, about(h), F.col("kind").rlike(glob(h["kind_glob"])) & (F.col("event_id") > h["after_event_id"]) & (F.col("ts_unix_ms") <= h["expires_ms"])), F.lit(h["hook_id"]).cast("bigint"))
        for h in hooks if h["status"] == "pending"
    ]
    return events.select("event_id", F.explode(F.array_compact(F.array(*hits))).alias("hook_id")).groupBy("hook_id").agg(F.min("event_id").alias("event_id"))


def retained(events, hooks: list[dict], cutoff_ms: int):
    """Events that pruning leaves: the newer ones, and all from the oldest pending hook's cursor on."""
    floor = min((h["after_event_id"] for h in hooks if h["status"] == "pending"), default=None)
    old = F.col("ts_unix_ms") < cutoff_ms
    return events.where(~old if floor is None else ~old | (F.col("event_id") >= floor))


def page(events, since_id: int, limit: int = 500):
    """(from, to, n, more) of the page of events after a cursor."""
    p = events.where(F.col("event_id") > since_id).orderBy("event_id").limit(limit)
    return p.agg(F.lit(since_id).cast("bigint").alias("from_id"), F.coalesce(F.max("event_id"), F.lit(since_id).cast("bigint")).alias("to_id"), F.count("*").alias("n"), (F.count("*") >= limit).alias("more"))


#: The states of each kind that are worth a line in a conversation.
SAID = {"budget": ("tight", "exceeded"), "limit_projection": ("projected",), "saturation": ("saturated",), "recommendation": ("compact",), "cache": ("expiring",)}
HORIZON_MS, BROAD = 21_600_000, 3


def worth_saying(kind: str, state: str, eta_ms: str, now_ms: F.Column) -> F.Column:
    """Whether an event is announced; a projection only within HORIZON_MS, or if its time is unknown."""
    out = F.lit(False)
    for k, states in SAID.items():
        out = F.when(F.col(kind) == k, F.col(state).isin(*states)).otherwise(out)
    return out & ((F.col(kind) != "limit_projection") | F.coalesce(F.col(eta_ms) - now_ms <= HORIZON_MS, F.lit(True)))


def capped(events, top: int = BROAD):
    """The ``top`` newest events that concern no one session, and all that do."""
    newest = events.where("session_uuid = ''").orderBy(F.desc("event_id")).limit(top)
    return newest.unionByName(events.where("session_uuid <> ''"))


def admission(now_ms: F.Column, max_age_ms: int = 900_000) -> F.Column:
    """'' where a session may be spoken to, else why not: the first of inbox, reach, busy, age of its status, cold cache."""
    age = F.greatest(F.lit(0), now_ms - F.col("status_ms"))
    return (
        F.when(F.coalesce("socket", F.lit("")) == "", "no inbox").when(~F.col("reachable"), "unreachable").when(F.col("status") != "busy", "at rest")
        .when(F.col("status_ms").isNull() | (age > max_age_ms), "stale status").when(F.coalesce("cold", F.lit(False)), "cache cold").otherwise("")
    )


def loops(rows, now_ms: int, stale_ms: int):
    """Open loops by (session_uuid, loop_key): the newest text, the first and last sight, and the status in force: the user's own, else stale after ``stale_ms``, else the newest. Settled ones are left out."""
    at = F.struct("ts_unix_ms", "event_id")
    s = rows.groupBy("session_uuid", "loop_key").agg(F.max_by("text", at).alias("text"), F.max_by("status", at).alias("status"), F.max_by("user_status", F.when(F.col("user_status") != "", at)).alias("u"), F.min("ts_unix_ms").alias("first_ms"), F.max("ts_unix_ms").alias("last_ms"))
    state = F.coalesce("u", F.when((F.col("status") == "open") & (F.col("last_ms") < now_ms - stale_ms), "stale").otherwise(F.col("status")))
    return s.withColumn("status", state).where("status not in ('done', 'dismissed', 'stale')").drop("u")


def lifecycle(log):
    """State of each budget by an event log of set, revoke and settle: the newest set, whether it is live, and the number of changes."""
    at = F.struct("ts_unix_ms", "event_id")
    return log.groupBy("cwd").agg(F.max_by("action", at).alias("last_action"), F.max_by("allowance", F.when(F.col("action") == "set", at)).alias("allowance"), F.count("*").alias("changes")).withColumn("live", F.col("last_action") == "set")


def wakeups(promises, ends, now_ms: int):
    """Outcome of each promise to wake a session at its meter's reset: only the newest of a session and meter counts ('superseded'), then early, due, expired (a day late) or pending. ends: bucket, account_id, reset_ms detected after the promise."""
    from pyspark.sql import Window

    newer = F.lead("promise_id").over(Window.partitionBy("session_uuid", "bucket").orderBy("created_ms", "promise_id"))
    p = promises.withColumn("_n", newer)
    marks = ends.select("account_id", "bucket", "ts_unix_ms", F.col("ts_unix_ms").alias("mark"))
    p = around(p.withColumn("ts_unix_ms", F.col("created_ms")), marks, ["account_id", "bucket"]).withColumn("reset_seen_ms", F.col("_ahead.mark"))
    outcome = (
        F.when(F.col("_n").isNotNull(), "superseded").when(F.col("reset_seen_ms") < F.col("due_ms"), "early").when(F.col("due_ms") < now_ms - 86_400_000, "expired")
        .when(F.col("due_ms") <= now_ms, "due").otherwise("pending")
    )
    return p.select("promise_id", "session_uuid", "bucket", outcome.alias("outcome"))
