"""Hand-checked cases of report forms."""

from pyspark.sql import functions as F

from tidemeter.functions import text, weights
from tidemeter.operators import asof, meter, quota, rollups, views

HOUR = 3_600_000


def test_offenders_keep_cold_compactions(spark):
    turns = spark.createDataFrame([("a", "idle_miss", 5), ("b", "normal", 9), ("c", "normal", 9)], "session_uuid string, classification string, raw_tokens long")
    marks = spark.createDataFrame([("b", True, "cold"), ("c", False, "cold"), ("c", True, "warm_5m")], "file string, confirmed boolean, cache_state string")
    got = {r.session_uuid: (r.leak_tokens, r.cold_compactions) for r in rollups.top_offenders(turns, marks).collect()}
    assert got == {"a": (5, 0), "b": (0, 1)}


def test_prices_that_a_user_sets(spark):
    own = spark.createDataFrame([("m-mid", 3.0, 12.0, None), ("new", 1.0, 5.0, "unverified")], "model string, input_price double, output_price double, status string")
    models = spark.createDataFrame([("m-mid",), ("new",), ("m-base",), ("none",)], "model string")
    got = {r.model: (r.multiplier, r.priced, r.breaks_ratio, r.unverified) for r in weights.model_prices(models, weights.overridden(weights.price_table(spark), own)).collect()}
    assert got == {"m-mid": (0.6, True, True, False), "new": (0.2, True, False, True), "m-base": (1.0, True, False, False), "none": (1.0, False, False, False)}


def test_control_pair(spark):
    learned = spark.createDataFrame([("m-base", 1.0), ("m-odd", 0.8), ("m-zzz", None), ("m-mid", 0.5)], "model string, weight double")
    assert [tuple(r) for r in views.control_pair(learned).collect()] == [("m-base", "m-odd", 1.25)]
    assert views.control_pair(learned.where("model <> 'm-odd'")).collect() == []


POLL = "id long, account_id long, ts_unix_ms long, session_pct long, week_pct long"


def test_collection_and_sensors(spark):
    polls = spark.createDataFrame([(1, 1, 100, 5, 5), (2, 2, 0, 5, 5), (3, 3, 100, 5, 5), (4, 3, 150, None, 5), (5, 4, 900, 1, 1)], POLL)
    health = quota.collection(polls, 200, 100)
    assert {(r.account_id, r.state) for r in health.collect()} == {(1, "ok"), (2, "stale"), (3, "extraction_failed")}
    latest = spark.createDataFrame([(1, "session", 89, False), (1, "week", 100, True)], "account_id long, bucket string, pct long, saturated boolean")
    projected = spark.createDataFrame([(1, "session")], "account_id long, bucket string")
    got = {(r.bucket, r.kind): r.state for r in quota.meter_sensors(latest, projected, health.where("account_id = 1")).collect()}
    assert got == {
        ("session", "threshold"): "80", ("week", "threshold"): "100", ("session", "saturation"): "clear", ("week", "saturation"): "saturated",
        ("session", "limit_projection"): "projected", ("week", "limit_projection"): "clear", ("", "collection"): "ok",
    }


def test_status_lines(spark):
    now = 100 * HOUR
    polls = spark.createDataFrame([(1, 1, now - 60_000, 72, 91), (2, 2, now - 3 * HOUR, 5, 5), (3, 3, now - 5 * 60_000, 10, 20), (4, 3, now - 1000, None, None), (5, 4, now - 1000, None, 1)], POLL)
    latest = spark.createDataFrame([(1, "session", 72, now + HOUR), (1, "week", 91, now - 1), (3, "session", 10, now + 2 * HOUR)], "account_id long, bucket string, pct long, reset_ms long")
    slopes = spark.createDataFrame([(1, "session", 56.0), (1, "week", 1.0), (3, "session", 10.0)], "account_id long, bucket string, pct_per_hour double")
    got = {r.account_id: tuple(r)[1:] for r in quota.status_lines(polls, latest, slopes, now, 2 * HOUR).collect()}
    assert got == {
        1: ("72%/5h ⚠100% in 30m (1h) · 91%/wk ⚠100% in 9h", "warn", "danger", "danger", "warn"), 2: ("STALE 3h", None, None, None, None),
        # nine hours to the limit are more than the two to the reset
        3: ("◷5m 10%/5h (2h) · 20%/wk", "ok", "ok", "neutral", "neutral"), 4: ("extraction failed", None, None, None, None),
    }
    classes = spark.createDataFrame([(2.9,), (3.0,), (10.0,), (None,)], "p double").select(quota.resume_class(F.col("p")).alias("c")).collect()
    assert [r.c for r in classes] == ["info", "warn", "danger", "info"]


def test_marks_around_by_slots_equal_plain_search(spark):
    import random

    rng = random.Random(6)
    marks = [(rng.choice("ab"), rng.randrange(-50, 400), k) for k in range(30)]
    rows = [(k, rng.choice("abc"), rng.randrange(-100, 500)) for k in range(120)] + [(500 + k, m[0], m[1]) for k, m in enumerate(marks[:5])]
    m, r = spark.createDataFrame(marks, "key string, ts_unix_ms long, mark long"), spark.createDataFrame(rows, "id long, key string, ts_unix_ms long")
    got = {x.id: (x._back and tuple(x._back), x._ahead and tuple(x._ahead)) for x in asof.around(r, m, ["key"], slot_ms=40).collect()}
    for i, key, t in rows:
        own = [(ts, n) for k, ts, n in marks if k == key]
        assert got[i] == (max((x for x in own if x[0] <= t), default=None), min((x for x in own if x[0] >= t), default=None))


def test_decisions_of_flags():
    # a drop is decided by the first reading that differs; the last one is still open
    assert meter.flags_of([0, 1, 2, 3], [50, 5, 5, 50], [None] * 4) == [(False, True, 0), (False, False, 3), (False, False, 3), (False, True, 3)]
    assert meter.flags_of([0, 1], [50, 5], [None] * 2)[1] == (True, True, None)
    assert meter.flags_of([7, 8], [5, 6], [None, None], resumed=True) == [(True, True, 7), (False, True, 8)]


def test_buckets_by_doubling_equal_a_plain_walk(spark):
    import random

    rng = random.Random(1)
    rows = [(a, rng.randrange(400 * HOUR) if a < 3 else 0, 3, 100) for a in (1, 2, 2, 3) for _ in range(500)] + [(4, k * HOUR, 1, 100) for k in range(40)]
    want = []
    for a in (1, 2, 3, 4):
        start = None
        for t, raw, c in sorted((t, raw, c) for x, t, raw, c in rows if x == a):
            if start is None or t >= start + 5 * HOUR:
                start = t
                want.append([a, start, start + 5 * HOUR, 0, 0.0])
            want[-1][3] += raw
            want[-1][4] += c / 100
    got = meter.fixed_buckets(spark.createDataFrame(rows, "account_id long, ts_unix_ms long, raw_tokens long, cw100 long"), 5 * HOUR)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    assert meter.fixed_buckets(spark.createDataFrame([], "account_id long, ts_unix_ms long, raw_tokens long, cw100 long"), HOUR).collect() == []


def test_json_in_prose(spark):
    texts = ['{"a": 1}', 'so {"a": 2}\nbye', "none", "{broken", "x {broken} y", None, "", "[1]", '{"b": 3}']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, t string")
    got = {r.id: r.q and r.q.a for r in df.select("id", text.salvaged(F.col("t"), "a int").alias("q")).collect()}
    assert got == {0: 1, 1: 2, 2: None, 3: None, 4: None, 5: None, 6: None, 7: None, 8: None}


def test_names_of_accounts(spark):
    rows = [(1, "me", "a@b", "o"), (2, "", "a@b", "o"), (3, None, "a@b", ""), (4, "", "", "o"), (5, None, None, None)]
    df = spark.createDataFrame(rows, "id long, label string, email string, org string")
    assert [r.n for r in df.orderBy("id").select(text.display_name(F.col("id"), F.col("label"), F.col("email"), F.col("org")).alias("n")).collect()] == ["me", "a@b (o)", "a@b", "o", "account 5"]


def test_days_by_model_as_a_map(spark):
    day = 86_400_000
    turns = spark.createDataFrame([("m-mid", 5, 150), ("m-base", 6, 250), ("m-mid", 7, 50), ("m-unpriced", 8, 9999), ("m-base", day, 1)], "model string, ts_unix_ms long, cw100 long")
    assert {r.day_ms: (r.models, r.total_cw) for r in rollups.model_days(turns).collect()} == {0: ({"m-base": 2.5, "m-mid": 2.0}, 4.5), day: ({"m-base": 0.01}, 0.01)}
