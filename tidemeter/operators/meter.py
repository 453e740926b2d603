"""The quota meter: resets and misreadings, calibration runs, burn, buckets, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled
from .asof import around

HOUR_MS = 3_600_000
FLAGS = "id long, account_id long, bucket string, ts_unix_ms long, pct long, reset_ms long, saturated boolean, reset_detected boolean, valid boolean"


def flags_of(ts: list, pct: list, reset: list, resumed: bool = False) -> list[tuple[bool, bool, int | None]]:
    """(reset_detected, valid, decided_ms) of an account's readings of one meter, in order.

    A reading far below the peak is a misreading if a later one comes back to the
    peak, and a reset otherwise. Whether it comes back is decided by the first later reading
    that differs from it by more than one point: decided_ms is that reading's time, null while there is none, and the reading's own
    time where nothing later matters. resumed: the first reading is a reset that is decided, at which an earlier run left off.
    """
    return _walk(ts, pct, reset, (None, None), True, resumed)[0]


def _walk(ts: list, pct: list, reset: list, state: tuple, last: bool, resumed: bool = False) -> tuple[list[tuple[bool, bool, int | None]], tuple]:
    """flags_of() from a state (peak, due) on, and the state behind it; unless these are the ``last`` readings, up to the first that later ones decide."""
    # for each reading the next one that differs by more than one, found from the end
    out, (peak, due) = [], state
    n = len(ts)
    values = [(i, p) for i, p in enumerate(pct) if p is not None]
    place = {i: k for k, (i, _) in enumerate(values)}
    jump: list[int] = [len(values)] * len(values)
    for k in range(len(values) - 2, -1, -1):
        j = k + 1
        while j < len(values) and abs(values[j][1] - values[k][1]) <= 1:
            # a stretch of one value leads on at once
            j = jump[j] if values[j][1] == values[k][1] else j + 1
        jump[k] = j
    for i in range(n):
        p, boundary, here, decided = pct[i], due is not None and ts[i] is not None and ts[i] >= due, resumed and i == 0, ts[i]
        valid = True
        if p is None:
            pass
        elif p > 100:
            valid = False
        elif peak is None or boundary:
            here, peak = here or boundary, p
        elif peak - p <= 1:
            peak = max(peak, p)
        else:
            j = jump[place[i]]
            if j == len(values) and not last:
                break
            decided = ts[values[j][0]] if j < len(values) else None
            if j < len(values) and values[j][1] >= peak - 1:
                valid = False
            else:
                here, peak = True, p
        out.append((here, valid, decided))
        if reset[i] is not None:
            due = reset[i]
        elif here:
            due = None
    return out, (peak, due)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Flags of readings that come by series, time and id. Only a stretch that later readings decide is held, and tried anew once it has doubled."""
    names = ["account_id", "bucket"]
    held: pa.Table | None = None
    key, state, tried = None, (None, None), 0

    def emit(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, state, tried
        got, state = _walk(*[held[c].to_pylist() for c in ("ts_unix_ms", "pct", "reset_ms")], state, last)
        done = held.slice(0, len(got)).append_column("reset_detected", pa.array([a for a, *_ in got], pa.bool_())).append_column("valid", pa.array([b for _, b, _ in got], pa.bool_()))
        held = held.slice(len(got)).combine_chunks()
        tried = len(held)
        yield from done.to_batches()

    for batch in batches:
        own = [*zip(*[batch[c].to_pylist() for c in names], strict=True)]
        begin = [i for i in range(len(own)) if i == 0 or own[i] != own[i - 1]]
        for a, b in zip(begin, [*begin[1:], len(own)], strict=True):
            if held is None or own[a] != key:
                if held is not None:
                    yield from emit(True)
                held, key, state, tried = None, own[a], (None, None), 0
            some = pa.Table.from_batches([batch.slice(a, b - a)])
            held = some if held is None else pa.concat_tables([held, some])
            if len(held) >= 2 * tried:
                yield from emit(False)
    if held is not None:
        yield from emit(True)


def _flagged(pdf: pd.DataFrame, resumed: bool = False) -> pd.DataFrame:
    pdf = pdf.sort_values(["ts_unix_ms", "id"])
    lists = [[None if pd.isna(x) else int(x) for x in pdf[c]] for c in ("ts_unix_ms", "pct", "reset_ms")]
    got = flags_of(*lists, resumed)
    return pdf.assign(pct=pd.array(lists[1], "Int64"), reset_ms=pd.array(lists[2], "Int64"), reset_detected=[a for a, *_ in got], valid=[b for _, b, _ in got], decided_ms=pd.array([c for *_, c in got], "Int64"))


def usage_flags(meter: DataFrame) -> DataFrame:
    """meter() rows with reset_detected and valid. One account's readings of one meter stream through one task in order, which Spark sorts; Python holds a batch, and what later readings decide."""
    own = meter.select("id", "account_id", "bucket", "ts_unix_ms", "pct", "reset_ms", "saturated")
    sorted_ = own.repartition("account_id", "bucket").sortWithinPartitions("account_id", "bucket", F.asc_nulls_last("ts_unix_ms"), F.asc_nulls_last("id"))
    return sorted_.mapInArrow(_in_order, FLAGS)


def resumed_flags(readings: DataFrame) -> DataFrame:
    """Flags with decided_ms of readings with a column ``resumed``: true in a series whose first row is a decided reset that an earlier run left off at."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _flagged(pdf.drop(columns="resumed"), bool(pdf["resumed"].iloc[0]))

    return readings.groupBy("account_id", "bucket").applyInPandas(run, f"{FLAGS}, decided_ms long")


def _series() -> Window:
    return Window.partitionBy("account_id", "bucket").orderBy("ts_unix_ms", "id")


def calibration_points(flags: DataFrame, turns: DataFrame) -> DataFrame:
    """Runs between resets and saturated readings in which the meter rose, with the tokens spent meanwhile.

    Runs and peaks are running counts and maxima. Turns meet runs in slots of
    time (an hour for the work-session meter, a day for the week's), so no account's turns are ordered or held together.
    """
    w = _series()
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    broken = F.col("reset_detected")
    cut = ~broken & F.col("saturated")
    f = flags.withColumns({"window": F.sum(broken.cast("int")).over(before), "run": F.sum((broken | cut).cast("int")).over(before), "n": F.count("*").over(Window.partitionBy("account_id", "bucket"))})
    anchor = F.when(F.col("pct").isNotNull() & F.col("valid"), F.least(F.col("pct"), F.lit(100).cast("bigint")))
    rows = f.where(~cut & (F.col("n") > 1)).withColumn("anchor", anchor)
    at = F.struct("ts_unix_ms", "id")
    runs = rows.groupBy("account_id", "bucket", "window", "run").agg(
        F.min("ts_unix_ms").alias("a_ms"), F.max("ts_unix_ms").alias("b_ms"), F.min(F.when(F.col("anchor").isNotNull(), F.struct(at.alias("at"), "anchor"))).getField("anchor").alias("entry"), F.max("anchor").alias("high")
    )
    earlier = Window.partitionBy("account_id", "bucket", "window").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("from_pct", F.greatest("entry", F.max("high").over(earlier))).withColumn("to_pct", F.greatest("high", "from_pct"))
    span = F.when(F.col("bucket") == "week", 24 * HOUR_MS).otherwise(HOUR_MS)
    slot = lambda ms: F.floor(F.col(ms) / span).cast("bigint")
    spent_at = turns.groupBy("account_id", "ts_unix_ms").agg(F.sum("raw_tokens").alias("raw_tokens"), F.sum("cw100").alias("cw100"))
    spent_at = spent_at.withColumn("bucket", F.explode(F.array(F.lit("session"), F.lit("week")))).withColumn("slot", slot("ts_unix_ms"))
    touched = runs.where("to_pct > from_pct").select("account_id", "bucket", "run", "a_ms", "b_ms", F.explode(F.sequence(slot("a_ms"), slot("b_ms"))).alias("slot"))
    met = spent_at.join(touched, ["account_id", "bucket", "slot"]).where("ts_unix_ms > a_ms and ts_unix_ms <= b_ms")
    spent = met.groupBy("account_id", "bucket", "run").agg(F.sum("raw_tokens").alias("raw_tokens"), F.sum("cw100").alias("c"))
    out = runs.where("to_pct > from_pct").join(spent, ["account_id", "bucket", "run"]).where("raw_tokens > 0")
    delta = F.col("to_pct") - F.col("from_pct")
    return out.select("account_id", "bucket", "a_ms", "b_ms", "from_pct", "to_pct", delta.alias("delta"), "raw_tokens", (F.col("c") / 100.0).alias("cw_tokens"), F.round(F.col("c") / 100.0 / delta, 6).alias("cw_per_pct"))


def calibration_median(points: DataFrame, last: int = 50) -> DataFrame:
    w = Window.partitionBy("account_id", "bucket").orderBy(F.desc("b_ms"), F.desc("a_ms"))
    own = points.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    return own.groupBy("account_id", "bucket").agg(F.count("*").alias("points"), F.round(F.percentile("cw_per_pct", 0.5), 6).alias("median_cw_per_pct"))


def burn_series(flags: DataFrame, lookback_ms: int) -> DataFrame:
    """Points an hour over the trailing lookback within a segment; null where the span is under 10 minutes or over 4 hours."""
    look = max(lookback_ms, 600_000)
    w = _series()
    good = F.col("pct").isNotNull() & F.col("valid") & ~F.col("saturated")
    f = flags.withColumns({"segment": F.sum(F.col("reset_detected").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "p": F.when(good, F.struct("ts_unix_ms", "pct"))})
    seg = Window.partitionBy("account_id", "bucket", "segment").orderBy("ts_unix_ms")
    first = F.min("p").over(seg.rangeBetween(-look, -1))
    rest = F.last("p", ignorenulls=True).over(seg.rangeBetween(Window.unboundedPreceding, -1))
    f = f.withColumn("base", F.coalesce(first, rest))
    span = F.col("ts_unix_ms") - F.col("base.ts_unix_ms")
    rate = F.round(F.greatest(F.lit(0.0), (F.col("pct") - F.col("base.pct")).cast("double") / (span / HOUR_MS)), 6)
    return f.select("id", "account_id", "bucket", "ts_unix_ms", F.when(good & span.between(600_000, 4 * HOUR_MS), rate).alias("pct_per_hour"))


def burn_now(flags: DataFrame) -> DataFrame:
    """Slope an hour over the last hour since the last reset, or over the last two points if that has fewer."""
    last_reset = F.max(F.when(F.col("reset_detected"), F.col("ts_unix_ms"))).over(Window.partitionBy("account_id", "bucket"))
    p = flags.withColumn("since", F.coalesce(last_reset, F.lit(0))).where("pct is not null and valid and not saturated and ts_unix_ms >= since")
    key = Window.partitionBy("account_id", "bucket")
    p = p.withColumns({"end": F.max("ts_unix_ms").over(key), "r": F.row_number().over(key.orderBy(F.desc("ts_unix_ms"), F.desc("id")))})
    p = p.withColumn("n", F.count_if(F.col("ts_unix_ms") >= F.col("end") - HOUR_MS).over(key))
    use = F.when(F.col("n") >= 2, F.col("ts_unix_ms") >= F.col("end") - HOUR_MS).otherwise(F.col("r") <= 2)
    at = F.struct("ts_unix_ms", "id")
    e = p.where(use).groupBy("account_id", "bucket").agg(F.min_by("ts_unix_ms", at).alias("a"), F.max_by("ts_unix_ms", at).alias("b"), F.min_by("pct", at).alias("x"), F.max_by("pct", at).alias("y"))
    return e.where("b > a").select("account_id", "bucket", F.col("b").alias("ts_unix_ms"), F.col("y").alias("pct"), F.round((F.col("y") - F.col("x")).cast("double") / ((F.col("b") - F.col("a")) / HOUR_MS), 6).alias("pct_per_hour"))


def limit_projection(now: DataFrame) -> DataFrame:
    """Hours to the limit at the present slope, where it matters: before the reset, ahead of pace, and not far beyond what has passed. now: burn_now() with reset_ms."""
    span = F.when(F.col("bucket") == "week", 168.0).otherwise(5.0)
    left, slope = 100 - F.col("pct"), F.col("pct_per_hour")
    ttr = F.greatest(F.lit(0.0), (F.col("reset_ms") - F.col("ts_unix_ms")) / HOUR_MS)
    passed = span - ttr
    eta = left / slope
    off_pace = (passed <= 0) | (F.col("pct") * span / passed >= 110)
    fine = F.col("reset_ms").isNull() | ((eta < ttr) & off_pace & (eta <= 3 * F.greatest(passed, F.lit(1.0))))
    return now.where((slope > 0.05) & (left > 0) & fine).select("account_id", "bucket", "pct", "pct_per_hour", F.round(eta, 6).alias("eta_hours"))


def fixed_buckets(turns: DataFrame, span_ms: int) -> DataFrame:
    """Greedy buckets of ``span_ms`` from each account's first turn: the next begins at the first turn that the last does not hold.

    Each distinct time points to the first one at least a span later. From an account's first time the chain of pointers is marked
    by doubling: pointers of twice the length reach twice as many starts in each round, so rounds grow with the logarithm of the
    chain, and all joins are by time, which spreads an account of any size over all tasks.
    """
    key = ["account_id", "ts_unix_ms"]
    each = settled(turns.groupBy(*key).agg(F.sum("raw_tokens").alias("raw_tokens"), F.sum("cw100").alias("c")))
    marks = each.select(*key, F.col("ts_unix_ms").alias("mark"))
    asked = each.select("account_id", "ts_unix_ms", F.col("ts_unix_ms").alias("_from")).withColumn("ts_unix_ms", F.col("ts_unix_ms") + span_ms)
    jump = settled(around(asked, marks, ["account_id"]).select("account_id", F.col("_from").alias("ts_unix_ms"), F.col("_ahead.mark").alias("next")).where("next is not null"))
    starts = each.groupBy("account_id").agg(F.min("ts_unix_ms").alias("ts_unix_ms"))
    while True:
        reached = settled(starts.join(jump, key).select("account_id", F.col("next").alias("ts_unix_ms")))
        if reached.isEmpty():
            break
        # what is reached in a round lies behind all starts before it
        starts = settled(starts.unionByName(reached))
        onward = jump.select("account_id", F.col("ts_unix_ms").alias("next"), F.col("next").alias("_then"))
        jump = settled(jump.join(onward, ["account_id", "next"]).select("account_id", "ts_unix_ms", F.col("_then").alias("next")))
    held = around(each, starts.withColumn("mark", F.col("ts_unix_ms")), ["account_id"])
    got = held.groupBy("account_id", F.col("_back.mark").alias("start_ms")).agg(F.sum("raw_tokens").alias("raw_tokens"), F.sum("c").alias("c"))
    return got.select("account_id", "start_ms", (F.col("start_ms") + span_ms).alias("end_ms"), "raw_tokens", (F.col("c") / 100.0).alias("cw_tokens"))
