"""Limit windows, and the meter movement that each session caused in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled

HOUR_MS = 3_600_000
#: Period, least step of a new reset, furthest credible reset, per meter.
PERIOD = {"session": 5 * HOUR_MS, "week": 168 * HOUR_MS}
MIN_GAP = {"session": 4 * HOUR_MS, "week": 48 * HOUR_MS}
AHEAD = {"session": 6 * HOUR_MS, "week": 192 * HOUR_MS}
MIN_DELTA, MAX_RATIO = 3, 2.0
#: Slots of time in which turns meet what happened to a meter.
SLOT = {"session": HOUR_MS, "week": 24 * HOUR_MS}
SERIES = ("account_id", "bucket")


def half_up(x: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def of_bucket(values: dict[str, int]) -> Column:
    return F.when(F.col("bucket") == "week", F.lit(values["week"])).otherwise(F.lit(values["session"])).cast("bigint")


def slot_of(ms: Column) -> Column:
    return F.floor(ms / of_bucket(SLOT)).cast("bigint")


def _series() -> Window:
    return Window.partitionBy(*SERIES).orderBy("ts_unix_ms", "id")


def window_starts(flags: DataFrame) -> DataFrame:
    """(account_id, bucket, window, start_ms, seen_ms, id): the advertised start of each window and the reading that began it.

    A credible reset further than the least step beyond the one in force begins a
    window; smaller moves are jitter and change nothing. Only a reset beyond all
    before it can do so, which leaves about a row a window to be walked through.
    """
    credible = F.when(F.col("reset_ms").between(F.col("ts_unix_ms"), F.col("ts_unix_ms") + of_bucket(AHEAD)), F.col("reset_ms"))
    f = flags.select(*SERIES, "ts_unix_ms", "id", credible.alias("r"))
    f = f.withColumns({"n": F.row_number().over(_series()), "high": F.max("r").over(_series().rowsBetween(Window.unboundedPreceding, -1))})
    few = f.where("n = 1 or r > coalesce(high, r - 1)")
    walked = few.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("ts_unix_ms", "id", "r"))).alias("x"), F.first(of_bucket(MIN_GAP)).alias("gap"))
    one = "named_struct('start_ms', {}, 'seen_ms', {}, 'id', {})".format
    starts = F.expr(f"""aggregate(x, named_struct('due', cast(null as bigint), 's', array({one("x[0].ts_unix_ms", "x[0].ts_unix_ms", "x[0].id")})), (a, y) -> CASE
        WHEN y.r IS NULL THEN a
        WHEN a.due IS NULL THEN named_struct('due', y.r, 's', a.s)
        WHEN y.r > a.due + gap THEN named_struct('due', y.r, 's', concat(a.s, array({one("least(greatest(a.due, element_at(a.s, -1).start_ms + 1), y.ts_unix_ms)", "y.ts_unix_ms", "y.id")})))
        ELSE a END, a -> a.s)""")
    each = walked.select(*SERIES, F.posexplode(starts).alias("window", "w"))
    return each.select(*SERIES, F.col("window").cast("bigint").alias("window"), "w.start_ms", "w.seen_ms", "w.id")


def segments(flags: DataFrame) -> DataFrame:
    """usage_flags() rows with their window's number, its advertised start and the reading that began it."""
    begun = window_starts(flags).select(*SERIES, "id", F.struct("window", "start_ms", "seen_ms").alias("_w"))
    placed = F.last("_w", ignorenulls=True).over(_series().rowsBetween(Window.unboundedPreceding, 0))
    return flags.join(begun, [*SERIES, "id"], "left").withColumn("_w", placed).select(*flags.columns, "_w.window", "_w.start_ms", "_w.seen_ms")


def limit_windows(flags: DataFrame, now_ms: int) -> DataFrame:
    """The windows of each account and meter, end to end: the last one runs to ``now_ms``."""
    w = segments(flags).groupBy("account_id", "bucket", "window").agg(
        F.min("start_ms").alias("start_ms"), F.count("*").alias("readings"), F.max(F.when(F.col("valid") & ~F.col("saturated"), F.col("pct"))).alias("peak_pct"), F.max("saturated").alias("hit_cap")
    )
    nxt = F.lead("start_ms").over(Window.partitionBy("account_id", "bucket").orderBy("window"))
    return w.select("account_id", "bucket", "window", "start_ms", F.coalesce(nxt, F.greatest(F.lit(now_ms), F.col("start_ms") + 1)).alias("end_ms"), "readings", "peak_pct", "hit_cap", (F.col("window") == 0).alias("partial"), nxt.isNull().alias("in_progress"))


def spans(seg: DataFrame) -> DataFrame:
    """(account_id, bucket, window, start_ms, run, after_ms, until_ms, rise): turns in (after, until] paid for a run's rise.

    Runs end at saturated readings. A run counts from the peak before it; the
    first of a whole window counts from zero at the window's start.
    """
    number = F.sum(F.col("saturated").cast("int")).over(Window.partitionBy(*SERIES, "window").orderBy("ts_unix_ms", "id").rowsBetween(Window.unboundedPreceding, 0))
    good = seg.withColumn("run", number).where("pct is not null and valid and not saturated")
    runs = good.groupBy(*SERIES, "window", "start_ms", "run").agg(
        F.min("ts_unix_ms").alias("a"), F.max("ts_unix_ms").alias("until_ms"), F.min_by("pct", F.struct("ts_unix_ms", "id")).alias("low"), F.max("pct").alias("top")
    )
    peak = F.max("top").over(Window.partitionBy(*SERIES, "window").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("peak", peak)
    whole = F.col("peak").isNull() & (F.col("window") > 0)
    low = F.when(whole, 0).otherwise(F.greatest("low", "peak"))
    return runs.select(*SERIES, "window", "start_ms", "run", F.when(whole, F.col("start_ms") - 1).otherwise(F.col("a")).alias("after_ms"), "until_ms", F.greatest(F.col("top") - low, F.lit(0).cast("bigint")).alias("rise"))


def with_rates(own: DataFrame, paid: DataFrame) -> DataFrame:
    """spans() with what was spent in each, its window's cost-weighted tokens a point (0: unknown), and how much of the rise its turns explain."""
    key = [*SERIES, "window", "run"]
    own = own.join(paid.groupBy(*key).agg(F.sum("c").alias("total")), key, "left").fillna(0, ["total"])
    w = Window.partitionBy(*SERIES, "window")
    own = own.withColumns({"spent": F.sum("total").over(w) / 100.0, "rose": F.sum("rise").over(w)})
    own = own.withColumn("rate", F.when((F.col("rose") >= MIN_DELTA) & (F.col("spent") > 0), half_up(F.col("spent") / F.col("rose"), 2)).otherwise(0.0))
    rise = F.col("rise").cast("double")
    local = F.when(F.col("total") <= 0, 0.0).when(F.col("rate") > 0, F.least(rise, F.lit(MAX_RATIO) * (F.col("total") / 100.0) / F.col("rate"))).otherwise(rise)
    return own.withColumn("local", local)


def around(slots: DataFrame, windows: DataFrame) -> DataFrame:
    """For each slot (account_id, bucket, slot): the start in force as it begins, windows that start within it, the last price before and the first behind it.

    windows has start_ms and rate (0: none). What is ordered is a row a slot and window, never a turn.
    """
    price = F.when(F.col("rate") > 0, F.struct("start_ms", "rate"))
    begun = windows.select(*SERIES, F.col("start_ms").alias("at"), F.lit(1).alias("o"), "start_ms", price.alias("price"))
    edge = lambda k, name: slots.select(*SERIES, ((F.col("slot") + k) * of_bucket(SLOT)).alias("at"), F.lit(0).alias("o"), F.col("slot").alias(name))
    both = begun.unionByName(edge(0, "opens"), allowMissingColumns=True).unionByName(edge(1, "closes"), allowMissingColumns=True)
    by, before = Window.partitionBy(*SERIES), (Window.unboundedPreceding, -1)
    back, ahead = by.orderBy("at", "o").rowsBetween(*before), by.orderBy(F.desc("at"), F.desc("o")).rowsBetween(*before)
    both = both.withColumns({"carry": F.last("start_ms", ignorenulls=True).over(back), "before": F.last("price", ignorenulls=True).over(back), "behind": F.last("price", ignorenulls=True).over(ahead)})
    opens = both.where("opens is not null").select(*SERIES, F.col("opens").alias("slot"), "carry", "before")
    closes = both.where("closes is not null").select(*SERIES, F.col("closes").alias("slot"), "behind")
    inside = windows.groupBy(*SERIES, slot_of(F.col("start_ms")).alias("slot")).agg(F.collect_list(F.struct("start_ms", "rate")).alias("inside"))
    return opens.join(closes, [*SERIES, "slot"]).join(inside, [*SERIES, "slot"], "left")


def estimated(free: DataFrame, windows: DataFrame, first_turns: DataFrame, medians: DataFrame) -> DataFrame:
    """Turns outside all spans, with the window they fall in and the nearest window's price, or the median where there is none."""
    near = around(free.select(*SERIES, "slot").distinct(), windows)
    anchor = windows.groupBy(*SERIES).agg(F.min("start_ms").alias("first_start"))
    t = free.join(near, [*SERIES, "slot"]).join(anchor, [*SERIES], "left").join(first_turns, "account_id").join(medians.select(*SERIES, "median_cw_per_pct"), [*SERIES], "left")
    within = F.expr("array_max(transform(filter(inside, x -> x.start_ms <= ts_unix_ms), x -> x.start_ms))")
    base, period = F.coalesce("first_start", "first_ms"), of_bucket(PERIOD)
    inferred = base + F.floor((F.col("ts_unix_ms") - base) / period).cast("bigint") * period
    price = F.expr("array_min(transform(filter(concat(array(before, behind), coalesce(inside, array())), x -> x is not null and x.rate > 0), x -> struct(abs(x.start_ms - ts_unix_ms) as d, x.start_ms as s, x.rate as rate))).rate")
    return t.withColumns({"window_start_ms": F.coalesce(within, "carry", inferred), "rate": F.coalesce(price, "median_cw_per_pct", F.lit(0.0))})


def attribution(flags: DataFrame, turns: DataFrame, medians: DataFrame) -> DataFrame:
    """(account_id, bucket, window_start_ms, session_uuid, project, measured_pct, estimated_pct, cw_tokens, raw_tokens, turns), one row a window and session.

    First pass: the rise of each run is shared among the turns in its span by what they cost, up to twice what
    they are worth at the window's price; the rest is session '', which no turn explains. Second pass: turns outside
    all spans count by the nearest window's price. Turns meet spans and windows in slots of time,
    so an account of any size is spread over as many tasks as it has slots.
    """
    each = turns.select("account_id", F.explode(F.array(F.lit("session"), F.lit("week"))).alias("bucket"), "ts_unix_ms", "event_id", "session_uuid", "project", "cw100", "raw_tokens")
    each = each.withColumn("slot", slot_of(F.col("ts_unix_ms")))
    seg = segments(flags)
    own = spans(seg)
    touched = own.select(*SERIES, "window", "run", "start_ms", "after_ms", "until_ms", F.explode(F.sequence(slot_of(F.col("after_ms")), slot_of(F.col("until_ms")))).alias("slot"))
    met = each.alias("t").join(touched.alias("s"), [F.col(f"t.{c}") == F.col(f"s.{c}") for c in (*SERIES, "slot")] + [F.col("t.ts_unix_ms") > F.col("s.after_ms"), F.col("t.ts_unix_ms") <= F.col("s.until_ms")], "left")
    met = settled(met.select("t.*", "s.window", "s.run", "s.start_ms"))
    first = F.min(F.struct("ts_unix_ms", "event_id", "project")).alias("first")
    sums = F.sum("cw100").alias("c"), F.sum("raw_tokens").alias("raw"), F.count("*").alias("n"), first
    paid = met.where("window is not null").groupBy(*SERIES, "window", "run", "session_uuid").agg(*sums)
    rated = settled(with_rates(own, paid))
    windows = seg.groupBy(*SERIES, "window").agg(F.min("start_ms").alias("start_ms")).join(rated.groupBy(*SERIES, "window").agg(F.max("rate").alias("rate")), [*SERIES, "window"], "left").fillna(0.0, ["rate"])
    zero = F.lit(0.0)
    measured = paid.join(rated.where("total > 0").select(*SERIES, "window", "run", "start_ms", "local", "total"), [*SERIES, "window", "run"])
    measured = measured.select(*SERIES, F.col("start_ms").alias("window_start_ms"), "session_uuid", (F.col("local") * F.col("c") / F.col("total")).alias("m"), zero.alias("e"), "c", "raw", "n", "first")
    nobody = rated.where("rise > local").select(*SERIES, F.col("start_ms").alias("window_start_ms"), F.lit("").alias("session_uuid"), (F.col("rise") - F.col("local")).alias("m"), zero.alias("e"), *[F.lit(0).cast("bigint").alias(x) for x in ("c", "raw", "n")])
    free = estimated(met.where("window is null").drop("window", "run", "start_ms"), windows, turns.groupBy("account_id").agg(F.min("ts_unix_ms").alias("first_ms")), medians)
    free = free.groupBy(*SERIES, "window_start_ms", "session_uuid", "rate").agg(*sums)
    free = free.select(*SERIES, "window_start_ms", "session_uuid", zero.alias("m"), F.when(F.col("rate") > 0, F.col("c") / 100.0 / F.col("rate")).otherwise(0.0).alias("e"), "c", "raw", "n", "first")
    rows = measured.unionByName(nobody, allowMissingColumns=True).unionByName(free)
    total = rows.groupBy(*SERIES, "window_start_ms", "session_uuid").agg(F.min("first").alias("first"), *[F.sum(x).alias(x) for x in ("m", "e", "c", "raw", "n")])
    return total.select(
        *SERIES, "window_start_ms", "session_uuid", F.coalesce("first.project", F.lit("")).alias("project"), half_up(F.col("m"), 4).alias("measured_pct"),
        half_up(F.col("e"), 4).alias("estimated_pct"), (F.col("c") / 100.0).alias("cw_tokens"), F.col("raw").alias("raw_tokens"), F.col("n").alias("turns"),
    )


def pct_totals(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Per owner, account and meter: the sum, the largest window and the number of windows; subagents count with their owner within a window."""
    own = rows.where("session_uuid <> ''").join(owners, "session_uuid", "left").withColumn("owner", F.coalesce("owner", "session_uuid"))
    window = own.groupBy("owner", "account_id", "bucket", "window_start_ms").agg(F.sum(F.col("measured_pct") + F.col("estimated_pct")).alias("pct"))
    return window.groupBy("owner", "account_id", "bucket").agg(F.round(F.sum("pct"), 4).alias("total_pct"), F.round(F.max("pct"), 4).alias("peak_pct"), F.count("*").alias("windows"))


def group_totals(rows: DataFrame, key: str) -> DataFrame:
    """Per value of ``key``: movement, tokens, sessions and windows; the blank key has no sessions."""
    pct = F.col("measured_pct") + F.col("estimated_pct")
    window = rows.groupBy("account_id", "bucket", key, "window_start_ms").agg(F.sum(pct).alias("p"), F.sum("cw_tokens").alias("cw"), F.collect_set("session_uuid").alias("who"))
    sessions = F.count_distinct("session_uuid").alias("s")
    count = rows.groupBy("account_id", "bucket", key).agg(sessions)
    total = window.groupBy("account_id", "bucket", key).agg(F.round(F.sum("p"), 4).alias("total_pct"), F.round(F.max("p"), 4).alias("peak_pct"), F.round(F.sum("cw"), 2).alias("cw_tokens"), F.count("*").alias("windows"))
    return total.join(count, ["account_id", "bucket", key]).select("account_id", "bucket", key, "total_pct", "peak_pct", "cw_tokens", "windows", F.when(F.col(key) == "", 0).otherwise(F.col("s")).cast("bigint").alias("sessions"))


def weekly_slices(flags: DataFrame) -> DataFrame:
    """What each work session lifted the week's peak by, a row for each session and week it ran in."""
    keys = ["account_id", "id"]
    seg = segments(flags)
    week = seg.where("bucket = 'week'").select(*keys, "ts_unix_ms", "pct", "valid", "saturated", F.col("window").alias("week"))
    both = week.join(seg.where("bucket = 'session'").select(*keys, F.col("window").alias("session")), keys)
    good = F.col("pct").isNotNull() & F.col("valid") & ~F.col("saturated")
    both = both.withColumn("v", F.when(good, F.least(F.col("pct"), F.lit(100).cast("bigint"))))
    slices = both.groupBy("account_id", "week", "session").agg(F.min("ts_unix_ms").alias("start_ms"), F.max("ts_unix_ms").alias("end_ms"), F.max("v").alias("top"), F.min_by("v", F.when(F.col("v").isNotNull(), F.col("ts_unix_ms"))).alias("first"))
    before = Window.partitionBy("account_id", "week").orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
    entry = F.coalesce(F.max("top").over(before), F.when(F.col("week") == 0, F.col("first")).otherwise(F.lit(0).cast("bigint")))
    return slices.withColumn("cost", F.greatest(F.lit(0).cast("bigint"), F.col("top") - entry)).where("cost > 0").select("account_id", "week", "session", "start_ms", "end_ms", F.col("cost").cast("double").alias("week_pct"))


def capacity_summary(slices: DataFrame, flags: DataFrame, least: float = 3.0, few: int = 3) -> DataFrame:
    """Typical cost of a whole work session: the first and the open one do not count, nor small ones."""
    last = segments(flags.where("bucket = 'session'")).groupBy("account_id").agg(F.max("window").alias("last"))
    each = slices.groupBy("account_id", "session").agg(F.sum("week_pct").alias("total")).join(last, "account_id").where((F.col("session") > 0) & (F.col("session") < F.col("last")) & (F.col("total") >= least))
    s = each.groupBy("account_id").agg(F.count("*").alias("sessions"), *[F.percentile("total", p).alias(n) for n, p in (("m", 0.5), ("a", 0.25), ("b", 0.75))])
    enough = lambda c: F.when(F.col("sessions") >= few, F.round(c, 2))
    m = F.col("m")
    return s.select("account_id", "sessions", enough(m).alias("typical_week_pct"), enough(F.col("a")).alias("p25"), enough(F.col("b")).alias("p75"), enough(100 / m).alias("sessions_per_week"), enough(7 * m / 100).alias("days_per_session"))
