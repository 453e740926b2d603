"""Reports over sessions, windows and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import weights
from .asof import around

HOUR_MS = 3_600_000
OTHER, NO_CWD = "__other__", "__unknown_cwd__"
#: Fixed values of weight learning: least rise and purity of a window, least samples, tolerance.
MIN_DELTA, PURITY, MIN_SAMPLES, TOLERANCE = 5, 0.9, 8, 0.25


def session_insight(turns: DataFrame, now_ms: int) -> DataFrame:
    """Per session: totals and averages, the last three turns, the cache's age, and whether to compact."""
    r = F.row_number().over(Window.partitionBy("session_uuid").orderBy(F.desc("turn_idx")))
    t = turns.withColumns({"r": r, "cold5": weights.cold_prefix100(False), "cold1": weights.cold_prefix100(True)})
    last = lambda c: F.max(F.when(F.col("r") == 1, F.col(c)))
    s = t.groupBy("session_uuid").agg(
        F.count("*").alias("turns"), F.max("ts_unix_ms").alias("last_ms"), F.sum("raw_tokens").alias("raw_tokens"), F.sum("cw100").alias("c"),
        F.sum(F.when(F.col("r") <= 3, F.col("cw100"))).alias("c3"), last("cw100").alias("c1"), last("cache_create_1h").alias("h"), last("cache_create_5m").alias("m"),
        F.sum("cache_create_1h").alias("hs"), F.sum("cache_create_5m").alias("ms"), last("cold5").alias("cold5"), last("cold1").alias("cold1"),
    )
    hour = (F.col("h") > 0) | ((F.col("m") <= 0) & (F.col("hs") > 0) & (F.col("ms") <= 0))
    five = (F.col("m") > 0) | ((F.col("ms") > 0) & (F.col("hs") <= 0))
    s = s.withColumns({"ttl_s": F.when(hour, 3600).when(five, 300).otherwise(0).cast("bigint"), "age_s": F.floor((now_ms - F.col("last_ms")) / 1000).cast("bigint")})
    cold = (F.col("ttl_s") > 0) & (F.col("age_s") >= F.col("ttl_s"))
    left = F.col("ttl_s") - F.col("age_s")
    each, three = F.round(F.col("c") / 100.0 / F.col("turns"), 2), F.round(F.col("c3") / 100.0 / F.least(F.col("turns"), F.lit(3)), 2)
    ratio = three / each
    return s.select(
        "session_uuid", "turns", "raw_tokens", "age_s", "ttl_s", (F.col("c") / 100.0).alias("cw_tokens"), each.alias("avg_cw"), three.alias("recent_cw"), (F.col("c1") / 100.0).alias("last_cw"),
        F.when(cold, F.when(F.col("ttl_s") == 3600, F.col("cold1")).otherwise(F.col("cold5")) / 100.0).alias("cold_resume_cw"), F.when(~cold & (F.col("ttl_s") > 0) & (left * 5 <= F.col("ttl_s")), left).alias("expires_in_s"),
        F.when((F.col("turns") >= 5) & (each > 0) & (three > 0), F.when(ratio >= 2, "compact").when(ratio >= 1.5, "watch").otherwise("ok")).otherwise("").alias("recommendation"),
    )


def session_sensors(insight: DataFrame) -> DataFrame:
    """Readings (kind, session_uuid, state) of caches and recommendations."""
    cache = F.when(F.col("cold_resume_cw") > 0, "expired").when(F.col("expires_in_s") > 0, "expiring").otherwise("warm")
    a = insight.where("ttl_s > 0").select(F.lit("cache").alias("kind"), "session_uuid", cache.alias("state"))
    return a.unionByName(insight.where("recommendation <> ''").select(F.lit("recommendation").alias("kind"), "session_uuid", F.col("recommendation").alias("state")))


def turns_since(turns: DataFrame, marks: DataFrame) -> DataFrame:
    """Turns of each session after its last marked one (marks: session_uuid, turn_idx)."""
    m = marks.groupBy("session_uuid").agg(F.max("turn_idx").alias("_m"))
    return turns.join(m, "session_uuid", "left").groupBy("session_uuid").agg(F.count_if(F.col("turn_idx") > F.coalesce("_m", F.lit(-1))).alias("turns_since"))


def learn_weights(points: DataFrame, turns: DataFrame, baseline: str, purity: float = PURITY, least: int = MIN_SAMPLES) -> DataFrame:
    """Weight of each model, from meter rises during which it spent ``purity`` of the type-weighted tokens.

    Turns of all accounts count towards every account's rises. Points cover the
    hours they touch, so a turn meets only points of its hour.
    """
    p = points.where(F.col("delta") >= MIN_DELTA).select(F.monotonically_increasing_id().alias("p"), "delta", "a_ms", "b_ms")
    p = p.withColumn("slot", F.explode(F.sequence(F.floor(F.col("a_ms") / HOUR_MS), F.floor(F.col("b_ms") / HOUR_MS))))
    t = turns.select("ts_unix_ms", "model", "tw20", F.floor(F.col("ts_unix_ms") / HOUR_MS).alias("slot"))
    each = p.join(t, "slot").where("ts_unix_ms > a_ms and ts_unix_ms <= b_ms").groupBy("p", "delta", "model").agg(F.sum("tw20").alias("c"))
    total = F.sum("c").over(Window.partitionBy("p"))
    pure = each.withColumn("all", total).where((F.col("all") > 0) & (F.col("c") >= purity * F.col("all")))
    s = pure.groupBy("model").agg(F.count("*").alias("samples"), F.percentile(F.col("all") / 20.0 / F.col("delta"), 0.5).alias("per_pct"))
    base = s.where((F.col("model") == baseline) & (F.col("samples") >= least)).select(F.col("per_pct").alias("base"))
    # one row at most beside a row a model
    s = s.join(F.broadcast(base), F.lit(True), "left")
    weight = F.when((F.col("samples") >= least) & (F.col("per_pct") > 0), F.round(F.col("base") / F.col("per_pct"), 2))
    return s.select("model", "samples", F.round("per_pct", 2).alias("tokens_per_pct"), weight.alias("weight"))


def weights_report(present: DataFrame, learned: DataFrame, baseline: str) -> DataFrame:
    """Learned beside listed weights for every model present; diverging where they differ by over a quarter."""
    listed = weights.multiplier5() / 5.0
    r = present.join(learned, "model", "left").withColumn("list_weight", listed)
    off = F.coalesce(F.abs(F.col("weight") - F.col("list_weight")) / F.col("list_weight") > TOLERANCE, F.lit(False))
    return r.select("model", F.coalesce("samples", F.lit(0).cast("bigint")).alias("samples"), "tokens_per_pct", "weight", "list_weight", (F.col("model") == baseline).alias("is_baseline"), off.alias("diverges"))


def control_pair(learned: DataFrame) -> DataFrame:
    """(model_a, model_b, ratio): the first two models, by name, that list at one price and have learned weights; these should be equal, so their ratio is the estimator's error. No row where there is no such pair.

    A row a model is compared here, by list price.
    """
    own = learned.where("weight is not null and weight <> 0").select("model", "weight", multiplier_of("model").alias("p"))
    near = Window.partitionBy("p").orderBy("model")
    pairs = own.withColumns({"model_b": F.lead("model").over(near), "w": F.lead("weight").over(near)}).where("model_b is not null")
    return pairs.select(F.col("model").alias("model_a"), "model_b", F.round(F.col("weight") / F.col("w"), 2).alias("ratio")).orderBy("model_a").limit(1)


def multiplier_of(model: str) -> F.Column:
    out = F.lit(weights.DEFAULT)
    for m, v in weights.MULTIPLIERS.items():
        out = F.when(F.col(model) == m, v).otherwise(out)
    return out


def nearest_price(asked: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """asked with the price nearest in time, the earlier of equally near ones, by slots of time (asof.around)."""
    both = around(asked, prices.select(*keys, "ts_unix_ms", F.col("price").alias("mark")), keys)
    at = F.col("ts_unix_ms")
    first = F.col("_ahead").isNull() | (at - F.col("_back.ts_unix_ms") <= F.col("_ahead.ts_unix_ms") - at)
    return both.withColumn("price", F.when(first, F.col("_back.mark")).otherwise(F.col("_ahead.mark"))).drop("_back", "_ahead")


def with_owners(attribution: DataFrame, sessions: DataFrame) -> DataFrame:
    """attribution with the effective session and its directory; sessions: session_uuid, parent_session_uuid, cwd. A subagent has its parent's directory, never its own."""
    own = sessions.select("session_uuid", F.nullif("parent_session_uuid", F.lit("")).alias("_p"), F.col("cwd").alias("_c"))
    parent = sessions.select(F.col("session_uuid").alias("_p"), F.col("cwd").alias("_pc"))
    rows = attribution.join(own, "session_uuid", "left").join(parent, "_p", "left")
    cwd = F.when(F.col("_p").isNotNull(), F.col("_pc")).otherwise(F.col("_c"))
    return rows.select(*attribution.columns, F.coalesce("_p", "session_uuid").alias("effective_uuid"), F.coalesce(cwd, F.lit("")).alias("cwd"))


def fold_tail(rows: DataFrame, keys: list[str], group: str, value: str, top: int) -> DataFrame:
    """Per keys the ``top`` groups by value; the others are one group OTHER, blank ones stay."""
    r = F.row_number().over(Window.partitionBy(*keys, F.col(group) == "").orderBy(F.desc(value), group))
    name = F.when((F.col(group) == "") | (F.col("_r") <= top), F.col(group)).otherwise(OTHER)
    return rows.withColumn("_r", r).withColumn(group, name).groupBy(*keys, group).agg(F.round(F.sum(value), 4).alias(value))


def window_slices(attribution: DataFrame, owners: DataFrame) -> DataFrame:
    """Per window the owners' movement and its share of the window."""
    own = attribution.join(owners, "session_uuid", "left").withColumn("owner", F.coalesce("owner", "session_uuid"))
    s = own.groupBy("account_id", "bucket", "window_start_ms", "owner").agg(F.round(F.sum(F.col("measured_pct") + F.col("estimated_pct")), 4).alias("pct"))
    total = F.sum("pct").over(Window.partitionBy("account_id", "bucket", "window_start_ms"))
    return s.withColumn("share", F.when(total > 0, F.round(F.col("pct") / total, 6)))


def current_window(slices: DataFrame) -> DataFrame:
    """The slices of each account and meter's last window."""
    last = F.max("window_start_ms").over(Window.partitionBy("account_id", "bucket"))
    return slices.withColumn("_l", last).where("window_start_ms = _l").drop("_l")


def by_cwd(attribution: DataFrame, cwds: DataFrame, owners: DataFrame) -> DataFrame:
    """attribution with a column cwd: the owner's directory; '' stays the movement of nobody, NO_CWD a session without one."""
    own = attribution.join(owners, "session_uuid", "left").withColumn("owner", F.coalesce("owner", "session_uuid"))
    own = own.join(cwds.select(F.col("session_uuid").alias("owner"), "cwd"), "owner", "left")
    return own.withColumn("cwd", F.when(F.col("session_uuid") == "", "").otherwise(F.coalesce(F.nullif("cwd", F.lit("")), F.lit(NO_CWD))))
