"""What is known about a limit right now: refusals, low priority, readings and their age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact_duration

FIVE_HOURS = 18_000_000


def low_priority(signals: DataFrame, now_ms: int) -> DataFrame:
    """Sessions whose newest switch is on, until the reset of the newest refusal of their account in the five hours before, or five hours."""
    at = F.struct("ts_unix_ms", F.col("kind").alias("k"))
    switch = signals.where(f"kind <> 'rate_limited' and ts_unix_ms <= {now_ms}").groupBy("account_id", "session_uuid").agg(F.max_by("kind", at).alias("kind"), F.max("ts_unix_ms").alias("since_ms")).where("kind = 'low_priority_on'")
    refused = signals.where("kind = 'rate_limited' and reset_ms > 0").select("account_id", "ts_unix_ms", F.struct("ts_unix_ms", "reset_ms").alias("r"), F.lit(0).alias("o"))
    both = refused.unionByName(switch.select("account_id", F.col("since_ms").alias("ts_unix_ms"), "session_uuid", F.lit(1).alias("o")), allowMissingColumns=True)
    last = F.last("r", ignorenulls=True).over(Window.partitionBy("account_id").orderBy("ts_unix_ms", "o", "r.reset_ms").rowsBetween(Window.unboundedPreceding, 0))
    fresh = both.withColumn("l", last).where("o = 1").withColumn("until_ms", F.when(F.col("l.ts_unix_ms") > F.col("ts_unix_ms") - FIVE_HOURS, F.col("l.reset_ms")).otherwise(F.col("ts_unix_ms") + FIVE_HOURS))
    return fresh.where(F.col("until_ms") > now_ms).select("account_id", "session_uuid", F.col("ts_unix_ms").alias("since_ms"), "until_ms")


def verdict(signals: DataFrame, now_ms: int) -> DataFrame:
    """Per account: the newest refusal that still holds, and its live low-priority sessions."""
    live = F.when(F.col("reset_ms") > 0, F.col("reset_ms") > now_ms).otherwise(F.col("ts_unix_ms") > now_ms - FIVE_HOURS)
    r = signals.where("kind = 'rate_limited'").where(F.col("ts_unix_ms") <= now_ms).where(live)
    r = r.groupBy("account_id").agg(F.max(F.struct("ts_unix_ms", "reset_ms", "bucket", "using_overage", "offer")).alias("r"))
    low = low_priority(signals, now_ms).groupBy("account_id").agg(F.count("*").alias("low"), F.max("until_ms").alias("low_until_ms"))
    out = r.join(low, "account_id", "full")
    return out.select("account_id", F.col("r").isNotNull().alias("refused"), F.col("r.ts_unix_ms").alias("refused_ms"), F.col("r.bucket").alias("bucket"), F.col("r.reset_ms").alias("reset_ms"), F.coalesce("r.using_overage", F.lit(False)).alias("using_overage"), F.coalesce("low", F.lit(0).cast("bigint")).alias("low_priority_sessions"), "low_until_ms")


def cap_state(about: Column, bucket: Column, refused: Column, low: Column, overage: Column) -> Column:
    """low_priority, extra_usage or refused for the meter that the refusal was about (a nameless one: session), else ''."""
    named = F.coalesce(F.nullif(about, F.lit("")), F.lit("session"))
    return F.when(~(refused | (low > 0)) | (named != bucket), "").when(low > 0, "low_priority").when(overage, "extra_usage").otherwise("refused")


def now_state(polls: DataFrame) -> DataFrame:
    """Per account the newest poll, or, where that has no reading, the newest whole one, marked stale."""
    at = F.struct("ts_unix_ms", "id")
    ok = F.col("session_pct").isNotNull() & F.col("week_pct").isNotNull()
    got = polls.groupBy("account_id").agg(F.max_by(ok, at).alias("ok"), F.max("ts_unix_ms").alias("polled_ms"), F.max_by(F.struct("ts_unix_ms", "session_pct", "week_pct"), F.when(ok, at)).alias("r"))
    return got.select("account_id", "ok", "polled_ms", F.col("r.ts_unix_ms").alias("read_ms"), F.col("r.session_pct").alias("session_pct"), F.col("r.week_pct").alias("week_pct"), (~F.col("ok") & F.col("r").isNotNull()).alias("stale"))


def collection(polls: DataFrame, now_ms: int, stale_after_ms: int) -> DataFrame:
    """(account_id, state, age_s) of each account's newest poll: extraction_failed if it has no whole reading, stale if it is too old, else ok. Accounts without polls say nothing."""
    at = F.struct("ts_unix_ms", "id")
    ok = F.col("session_pct").isNotNull() & F.col("week_pct").isNotNull()
    last = polls.where(F.col("ts_unix_ms") <= now_ms).groupBy("account_id").agg(F.max_by(ok, at).alias("ok"), F.max("ts_unix_ms").alias("ms"))
    age = F.lit(now_ms) - F.col("ms")
    return last.select("account_id", F.when(~F.col("ok"), "extraction_failed").when(age > stale_after_ms, "stale").otherwise("ok").alias("state"), F.floor(age / 1000).cast("bigint").alias("age_s"))


def meter_sensors(latest: DataFrame, projected: DataFrame, health: DataFrame) -> DataFrame:
    """Readings (account_id, bucket, kind, state) of the sensors of meters and of their collection. latest: newest readings; projected: meter.limit_projection(); health: collection()."""
    key = ["account_id", "bucket"]
    now = latest.join(projected.select(*key, F.lit(True).alias("_p")), key, "left")
    kinds = {
        "threshold": F.expr("cast(pct div 10 * 10 as string)"), "saturation": F.when(F.col("saturated"), "saturated").otherwise("clear"),
        "limit_projection": F.when(F.col("_p"), "projected").otherwise("clear"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("state")) for k, v in kinds.items()]))
    meters = now.select(*key, each.alias("_s")).select(*key, "_s.kind", "_s.state")
    return meters.unionByName(health.select("account_id", F.lit("").alias("bucket"), F.lit("collection").alias("kind"), "state"))


#: Percentages from which a gauge warns and is in danger, time to the limit that is in danger, share of a window that resuming cold costs.
WARN, DANGER, VERY_NEAR_MS, RESUME_WARN, RESUME_DANGER = 70, 90, 1_800_000, 3.0, 10.0


def gauge_class(pct: Column) -> Column:
    return F.when(pct >= DANGER, "danger").when(pct >= WARN, "warn").otherwise("ok")


def burn_class(eta_ms: Column) -> Column:
    """Of a meter that will reach its limit, by how soon; null eta: neutral."""
    return F.when(eta_ms.isNull(), "neutral").when(eta_ms <= VERY_NEAR_MS, "danger").otherwise("warn")


def resume_class(pct: Column) -> Column:
    """Of the share of a window that a cold cache will cost; info where it is small or unknown."""
    return F.when(pct >= RESUME_DANGER, "danger").when(pct >= RESUME_WARN, "warn").otherwise("info")


def status_lines(polls: DataFrame, latest: DataFrame, slopes: DataFrame, now_ms: int, stale_after_ms: int) -> DataFrame:
    """(account_id, line, session_class, week_class, session_burn, week_burn) for each account with polls.

    A poll that is too old says STALE and its age. One without a whole reading falls back to the newest whole one,
    whose age stands before it, or says that extraction failed. A meter shows its percentage, the time to its limit where that comes before the reset,
    and the time to the reset. slopes: meter.burn_now(); latest: newest readings by account and bucket.
    """
    state = now_state(polls.where(F.col("ts_unix_ms") <= now_ms))
    m = latest.join(slopes.select("account_id", "bucket", "pct_per_hour"), ["account_id", "bucket"], "left")
    ttr = F.when(F.col("reset_ms") > now_ms, F.col("reset_ms") - now_ms)
    eta = F.when((F.col("pct_per_hour") > 0) & (F.col("pct") < 100), F.floor((100 - F.col("pct")) / F.col("pct_per_hour") * 3_600_000).cast("bigint"))
    m = m.withColumns({"ttr": ttr, "eta": F.when(ttr.isNull() | (eta < ttr), eta)})
    part = F.struct("ttr", "eta")
    m = m.groupBy("account_id").agg(*[F.max(F.when(F.col("bucket") == b, part)).alias(b) for b in ("session", "week")])
    one = lambda b, label: F.concat(
        F.col(f"{b}_pct"), F.lit(f"%/{label}"), F.when(F.col(f"{b}.eta").isNotNull(), F.concat(F.lit(" ⚠100% in "), compact_duration(F.col(f"{b}.eta")))).otherwise(""),
        F.when(F.col(f"{b}.ttr").isNotNull(), F.concat(F.lit(" ("), compact_duration(F.col(f"{b}.ttr")), F.lit(")"))).otherwise(""),
    )
    s = state.join(m, "account_id", "left")
    age, old = F.lit(now_ms) - F.col("polled_ms"), F.lit(now_ms) - F.col("read_ms")
    shown = F.concat(F.when(F.col("ok"), "").otherwise(F.concat(F.lit("◷"), compact_duration(old), F.lit(" "))), one("session", "5h"), F.lit(" · "), one("week", "wk"))
    line = F.when(age >= stale_after_ms, F.concat(F.lit("STALE "), compact_duration(age))).when(F.col("read_ms").isNull(), "extraction failed").otherwise(shown)
    fresh = (age < stale_after_ms) & F.col("read_ms").isNotNull()
    return s.select("account_id", line.alias("line"), *[F.when(fresh, gauge_class(F.col(f"{b}_pct"))).alias(f"{b}_class") for b in ("session", "week")], *[F.when(fresh, burn_class(F.col(f"{b}.eta"))).alias(f"{b}_burn") for b in ("session", "week")])
