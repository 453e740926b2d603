"""Transcripts, quota, reports and policies on small hand-checked cases."""

import json

from pyspark.sql import functions as F

from tidemeter.functions import text
from tidemeter.operators import policy, quota, views
from tidemeter.sources import transcripts as tr

MIN, HOUR = 60_000, 3_600_000


def stamp(minute):
    return f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00.000Z"


def answer(minute, mid, prefix, out=5):
    return {"type": "assistant", "timestamp": stamp(minute), "requestId": "r", "message": {"id": mid, "model": "m", "content": [{"type": "text", "text": "hi"}], "usage": {"input_tokens": prefix, "output_tokens": out}}}


def boundary(minute):
    return {"type": "system", "subtype": "compact_boundary", "timestamp": stamp(minute)}


def summary(minute, words=40):
    return {"type": "user", "isCompactSummary": True, "timestamp": stamp(minute), "message": {"content": "x" * words}}


def written(tmp_path, **files):
    for name, records in files.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n\n")
    return [str(tmp_path)]


def records(spark, tmp_path, *rows):
    return tr.parsed(tr.read_lines(spark, written(tmp_path, a=rows)))


def test_turns_keep_the_last_of_equal_ids(spark, tmp_path):
    r = records(spark, tmp_path, answer(0, "A", 1, 5), answer(1, "B", 1, 5), answer(2, "B", 1, 15), "{broken", answer(3, "B", 1, 25), answer(4, "", 1), answer(4, "", 1), answer(2, "C", 1))
    got = [(t.message_id, t.output_tokens, t.turn_idx, t.gap_s) for t in tr.turns(r).orderBy("turn_idx").collect()]
    assert got == [("A", 5, 0, 0.0), ("B", 25, 1, 180.0), ("", 5, 2, 60.0), ("", 5, 3, 0.0), ("C", 5, 4, 0.0)]


def compact(spark, tmp_path, *rows):
    return [(c.prefix_tokens, c.summary_tokens, c.cache_state, c.confirmed, c.reason) for c in tr.compactions(records(spark, tmp_path, *rows)).orderBy("line").collect()]


def test_compaction_with_a_repeated_answer_is_judged_by_the_last(spark, tmp_path):
    assert compact(spark, tmp_path, answer(0, "A", 1000), boundary(1), summary(1), answer(2, "B", 100), answer(3, "B", 950)) == [(1000, 10, "warm_5m", False, "weak_shrink")]


def test_compaction_confirmed_without_boundary_and_at_the_end(spark, tmp_path):
    rows = summary(0), answer(1, "A", 1000), summary(90), answer(91, "B", 500), boundary(92), summary(92), summary(93, 80)
    assert compact(spark, tmp_path, *rows) == [(0, 10, "unknown", False, "no_baseline_prefix"), (1000, 10, "cold", True, ""), (500, 20, "warm_5m", False, "no_following_turn")]


def test_signals(spark, tmp_path):
    refusal = {"type": "assistant", "timestamp": stamp(10), "error": "rate_limit", "quotaLimits": {"resetsAt": 1_704_067_200 + 3600, "rateLimitType": "seven_day"}}
    resumed = lambda m: {"type": "user", "timestamp": stamp(m), "queuePriority": "later", "origin": {"kind": "auto-continuation"}}
    command = lambda m, s: {"type": "system", "subtype": "local_command", "timestamp": stamp(m), "content": s}
    ask = lambda m: {"type": "user", "timestamp": stamp(m), "message": {"content": "<command-name>/low-priority</command-name>"}}
    rows = resumed(1), command(2, "x"), refusal, resumed(20), resumed(70), ask(71), command(72, "Continuing now at lower priority"), command(73, "x"), ask(74), command(75, "x"), command(76, "x")
    got = [((s.ts_unix_ms // MIN) % 1440, s.kind, s.bucket) for s in tr.quota_signals(records(spark, tmp_path, *rows)).orderBy("ts_unix_ms").collect()]
    assert got == [(10, "rate_limited", "week"), (20, "low_priority_on", ""), (72, "low_priority_on", ""), (75, "low_priority_off", "")]


def test_prompts(spark, tmp_path):
    user = lambda m, c, **f: {"type": "user", "userType": "external", "timestamp": stamp(m), "message": {"content": c}} | f
    rows = user(0, "a  b<system-reminder>x</system-reminder>\nc"), user(1, [{"type": "text", "text": "block"}]), user(2, "meta", isMeta=True), user(3, "y" * 300), user(4, "<command-name>open"), user(5, "tool", toolUseResult={"a": 1})
    got = [p.preview for p in tr.human_prompts(records(spark, tmp_path, *rows)).orderBy("ts_unix_ms").collect()]
    assert got == ["a b c", "block", "y" * 240 + "…"]


def test_delta(spark, tmp_path):
    r = records(spark, tmp_path, answer(0, "A", 1), answer(5, "B", 1) | {"cwd": "/w"}, answer(9, "C", 1) | {"cwd": ""})
    file = r.first().file
    marks = spark.createDataFrame([(file, 1_704_067_200_000)], "file string, seen_ms long")
    assert [(d.records, d.cwd) for d in tr.delta_since(r, marks).collect()] == [(2, "/w")]


def test_paths_and_coverage(spark):
    paths = [("p/u.jsonl", 9000), ("p/small.jsonl", 10), ("p/u/subagents/x.jsonl", 10), ("p/s1/subagents/workflows/w/agent-1.jsonl", 10), ("p/u/subagents/workflows/w/journal.jsonl", 10), ("p/u/subagents/workflows/w/other", 10), ("q", 10)]
    files = spark.createDataFrame([(p, 1, b) for p, b in paths], "path string, mtime_ms long, bytes long")
    excluded = spark.createDataFrame([("s1",)], "session_uuid string")
    got = {r.shape: (r.on_disk, r.ingested, r.skipped, r.missing) for r in tr.coverage(files, files.where("path = 'p/u.jsonl'"), excluded).collect()}
    assert got == {"top_level": (2, 1, 1, 0), "subagent": (1, 0, 0, 1), "workflow_agent": (1, 0, 1, 0), "unrecognized": (2, 0, 0, 2)}
    assert {r.path for r in tr.changed(files, files.where("bytes = 9000").select("path", "mtime_ms")).collect()} == {p for p, _ in paths[2:]} - {"p/u/subagents/workflows/w/journal.jsonl"}


def test_panel(spark):
    page = "Current session bar 16% used Resets 2am (UTC) Current week (all models) 61% used Resets May1,1am (UTC) Current week (small) 0% used"
    a, b = tr.extract(spark.createDataFrame([(1, page), (2, "loading")], "id int, text string"), tr.PANEL).orderBy("id").collect()
    assert (a.session_pct, a.week_pct, a.session_reset, a.week_reset, a.missing) == (16, 61, "2am", "May1,1am", "") and b.missing == "session_pct,week_pct"


SIGNAL = "account_id long, session_uuid string, ts_unix_ms long, kind string, bucket string, reset_ms long, using_overage boolean, offer string"


def test_low_priority_and_verdict(spark):
    rows = [
        (1, "a", 10 * HOUR, "rate_limited", "", 14 * HOUR, False, "x"), (1, "a", 11 * HOUR, "low_priority_on", "", 0, False, ""), (1, "b", 1 * HOUR, "low_priority_on", "", 0, False, ""),
        (1, "c", 11 * HOUR, "low_priority_on", "", 0, False, ""), (1, "c", 12 * HOUR, "low_priority_off", "", 0, False, ""), (2, "d", 9 * HOUR, "low_priority_on", "", 0, False, ""), (3, "e", 2 * HOUR, "rate_limited", "week", 0, True, ""),
    ]
    s = spark.createDataFrame(rows, SIGNAL)
    assert sorted(map(tuple, quota.low_priority(s, 13 * HOUR).collect())) == [(1, "a", 11 * HOUR, 14 * HOUR), (2, "d", 9 * HOUR, 14 * HOUR)]
    assert {r.account_id: (r.refused, r.low_priority_sessions) for r in quota.verdict(s, 13 * HOUR).collect()} == {1: (True, 1), 2: (False, 1)}
    cap = spark.createDataFrame([("", True, 0, False), ("week", True, 0, True), ("", True, 1, True), (None, False, 0, False)], "b string, r boolean, l long, o boolean")
    state = lambda m: [x.s for x in cap.select(quota.cap_state(F.col("b"), F.lit(m), F.col("r"), F.col("l"), F.col("o")).alias("s")).collect()]
    assert state("session") == ["refused", "", "low_priority", ""] and state("week") == ["", "extra_usage", "", ""]


def test_learned_weights(spark):
    points = spark.createDataFrame([(5, i * HOUR, i * HOUR + 30 * MIN) for i in range(16)] + [(4, 90 * HOUR, 91 * HOUR)], "delta long, a_ms long, b_ms long")
    turns = [(i * HOUR + 10 * MIN, "base" if i < 8 else "big", 20 * (100 if i < 8 else 50)) for i in range(16)] + [(0, "big", 10**9), (90 * HOUR + 1, "big", 10**9), (MIN, "big", 20)]
    t = spark.createDataFrame(turns, "ts_unix_ms long, model string, tw20 long")
    got = {r.model: (r.samples, r.tokens_per_pct, r.weight) for r in views.learn_weights(points, t, "base").collect()}
    assert got == {"base": (8, 20.0, 1.0), "big": (8, 10.0, 2.0)}


def test_nearest_price_takes_the_earlier_of_equals(spark):
    p = spark.createDataFrame([(1, 10, 1.0), (1, 20, 2.0)], "a long, ts_unix_ms long, price double")
    q = spark.createDataFrame([(1, t) for t in (0, 15, 16, 99)] + [(2, 5)], "a long, ts_unix_ms long")
    assert [r.price for r in views.nearest_price(q, p, ["a"]).orderBy("a", "ts_unix_ms").collect()] == [1.0, 1.0, 2.0, 2.0, None]


def test_tail_folds_and_blank_stays(spark):
    rows = spark.createDataFrame([(1, "", 9.0), (1, "a", 3.0), (1, "b", 2.0), (1, "c", 1.0)], "w long, g string, v double")
    assert {r.g: r.v for r in views.fold_tail(rows, ["w"], "g", "v", 1).collect()} == {"": 9.0, "a": 3.0, "__other__": 3.0}


def test_hooks_take_the_first_event_once(spark):
    e = spark.createDataFrame([(i, i * 10, k) for i, k in enumerate(("cache.a", "budget.x", "cache.b", "cache.c"))], "event_id long, ts_unix_ms long, kind string")
    hook = lambda n, glob, after, until, status="pending": {"hook_id": n, "kind_glob": glob, "after_event_id": after, "expires_ms": until, "status": status}
    hooks = [hook(1, "cache.*", 0, 100), hook(2, "cache.?", 2, 20), hook(3, "*", 0, 100, "fired")]
    assert [tuple(r) for r in policy.hook_matches(hooks, e).collect()] == [(1, 2)]
    assert sorted(r.event_id for r in policy.retained(e, hooks[1:2], 15).collect()) == [2, 3] and sorted(r.event_id for r in policy.retained(e, [], 15).collect()) == [2, 3]


def test_text(spark):
    row = spark.range(1).select(*[text.compact_duration(F.lit(s * 1000)).alias(f"d{i}") for i, s in enumerate((5, 720, 12_000, 187_200, 86_400))], *[text.short_number(F.lit(n)).alias(f"n{i}") for i, n in enumerate((999, 1500, 2_000_000))], text.base_name(F.lit("/a/b/")).alias("b")).first()
    assert tuple(row) == ("5s", "12m", "3h20m", "2d4h", "1d", "999", "1.5k", "2.0M", "b")


def test_deadline_phrases(spark):
    # Wednesday 2024-01-03 10:00
    now = 1_704_276_000_000
    cases = {19 * HOUR: "in 19h", 24 * HOUR: "on thu 10:00", 35 * HOUR: "on fri", 40 * HOUR: "on fri", 42 * HOUR: "on fri 04:00", 53 * HOUR + 30 * MIN: "on fri 15:30", 158 * HOUR: "in 6d14h", 168 * HOUR: "in 7d", -5: "in 0s", None: None}
    got = spark.createDataFrame([(now, None if d is None else now + d) for d in cases], "n long, a long").select(text.deadline_phrase(F.col("a"), F.col("n"))).collect()
    assert [r[0] for r in got] == [*cases.values()]


def test_until_leases(spark):
    now = 1_704_276_000_000
    cases = {
        None: ("manual", "", None, None, None, ""), "Revoked ": ("manual", "", None, None, None, ""), "reset": ("window_reset", "week", None, None, now, ""),
        "5h": ("window_reset", "session", None, now + HOUR, now, ""), "6h": ("deadline", "", now + 6 * HOUR, None, None, ""), "1h30m": ("deadline", "", now + 90 * MIN, None, None, ""),
        ".5h": ("deadline", "", now + 30 * MIN, None, None, ""), "-2h": (None, "", None, None, None, "unreadable"), "0s": (None, "", None, None, None, "passed"), "10:00": ("deadline", "", now + 24 * HOUR, None, None, ""),
        "10:00:01": ("deadline", "", now + 1000, None, None, ""), "2024-01-04": ("deadline", "", now + 14 * HOUR, None, None, ""), "2024-01-03": (None, "", None, None, None, "passed"), "2024-02-30": (None, "", None, None, None, "unreadable"),
    }
    asked = spark.createDataFrame([(c,) for c in cases], "c string")
    lease = policy.until(F.col("c"), F.lit("week"), F.lit(now), {"session": F.lit(now + HOUR), "week": F.lit(now - 1)})
    assert [tuple(r[0]) for r in asked.select(lease).collect()] == [*cases.values()]
