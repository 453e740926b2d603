"""Files, versions and streams that are kept up: gates, crashes, restarts and retries."""

import os
import random
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tidemeter.functions import text
from tidemeter.operators import meter
from tidemeter.sources import discovery, eventlog, fixtures, versions
from tidemeter.streaming import announce, buckets, corrections, levels, watermarks

FOLDER = "01234567-89ab-cdef-0123-456789abcdef"


def put(root, path, lines, at=1_700_000_000):
    os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
    with open(f"{root}/{path}", "w") as f:
        f.write("".join(f"{x}\n" for x in lines))
    os.utime(f"{root}/{path}", (at, at))


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "projects")
    big = ["x" * 100] * 60
    put(root, "p/a.jsonl", big)
    put(root, "p/small.jsonl", ["x"])
    put(root, f"p/{FOLDER}/subagents/agent-1.jsonl", ["small but paid", " ", "two"])
    put(root, "p/garbled/subagents/agent-2.jsonl", big)
    put(root, f"p/{FOLDER}/subagents/workflows/w/agent-3.jsonl", big)
    put(root, f"p/{FOLDER}/subagents/workflows/w/journal.jsonl", big)
    put(root, "p/deep/er/b.jsonl", big)
    put(root, "p/name with + and %41.jsonl", big)
    return root


def outcomes(gate):
    return {r.path: r.outcome for r in gate.collect()}


def test_gate_over_real_files(spark, tree):
    empty = spark.createDataFrame([], discovery.LEDGER)
    gate = discovery.gated(discovery.listed(spark, tree), empty)
    agent, flow, odd = f"p/{FOLDER}/subagents/agent-1.jsonl", f"p/{FOLDER}/subagents/workflows/w/agent-3.jsonl", "p/name with + and %41.jsonl"
    assert outcomes(gate) == {"p/a.jsonl": "read", "p/small.jsonl": "small", agent: "read", "p/garbled/subagents/agent-2.jsonl": "unlinked", flow: "read", odd: "read"}
    lines = discovery.lines_of(spark, gate)
    assert {(r.file, r.n) for r in lines.groupBy("file").agg(F.count("*").alias("n")).collect()} == {("p/a.jsonl", 60), (agent, 2), (flow, 60), (odd, 60)}
    assert sorted(r.line for r in lines.where(F.col("file") == agent).collect()) == [0, 2]
    ledger = spark.createDataFrame(discovery.noted(empty, gate).collect(), discovery.LEDGER)
    assert {r.outcome for r in discovery.gated(discovery.listed(spark, tree), ledger).where("outcome <> 'small' and outcome <> 'unlinked'").collect()} == {"unchanged"}
    # a touched file alone is read again, and the ledger then holds its new time
    put(tree, "p/a.jsonl", ["y" * 100] * 70, at=1_700_000_500)
    again = discovery.gated(discovery.listed(spark, tree), ledger)
    assert [p for p, o in outcomes(again).items() if o == "read"] == ["p/a.jsonl"]
    assert {r.value for r in discovery.lines_of(spark, again).collect()} == {"y" * 100}
    assert {(r.path, r.mtime_s) for r in discovery.noted(ledger, again).collect()} >= {("p/a.jsonl", 1_700_000_500)}
    assert set(outcomes(discovery.gated(discovery.listed(spark, tree), ledger, force=True)).values()) == {"read", "small", "unlinked"}
    assert discovery.lines_of(spark, gate.where("outcome = 'none'")).collect() == []


def test_file_stream_reads_each_file_once(spark, tree, tmp_path):
    def run():
        q = discovery.stream(spark, tree).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return {(r.path, r.n) for r in spark.read.parquet(str(tmp_path / "out")).groupBy("path").agg(F.count("*").alias("n")).collect()}

    first = run()
    assert ("p/small.jsonl", 1) in first and len(first) == 6
    put(tree, "p/new.jsonl", ["x"] * 3)
    assert run() == first | {("p/new.jsonl", 3)}


DAY = 86_400_000


@pytest.mark.parametrize(
    ("hint", "zone", "now", "want"),
    [
        ("1am", "America/Los_Angeles", "2024-01-10 12:00", "2024-01-11 09:00"), ("10:50am", "Europe/Copenhagen", "2024-01-10 09:50", "2024-01-10 09:50"),
        ("10:50am", "Europe/Copenhagen", "2024-01-10 09:51", "2024-01-11 09:50"), ("May1,1am", "Europe/Copenhagen", "2024-01-01 00:00", "2024-04-30 23:00"),
        ("May 1, 12am", "Europe/Copenhagen", "2024-05-01 00:00", "2025-04-30 22:00"), ("15:04", "", "2024-01-01 16:00", "2024-01-02 15:04"), ("Dec 31, 23:59", "Asia/Kolkata", "2024-12-31 18:30", "2025-12-31 18:29"),
        ("Feb 29, 12pm", "UTC", "2024-03-01 00:00", "2025-03-01 12:00"), ("feb 29,  12:30PM", "UTC", "2024-01-01 00:00", None), ("Feb 30, 1am", "UTC", "2024-01-01 00:00", None), ("1am", "Nowhere/Land", "2024-01-01 00:00", "2024-01-01 01:00"),
        ("25:00", "UTC", "2024-01-01 00:00", None), ("13pm", "UTC", "2024-01-01 00:00", None), ("", "UTC", "2024-01-01 00:00", None), (None, None, "2024-01-01 00:00", None), ("12pm", "UTC", "2024-01-01 13:00", "2024-01-02 12:00"),
    ],
)
def test_reset_hints(spark, hint, zone, now, want):
    one = spark.createDataFrame([(hint, zone, now)], "h string, z string, n string").withColumn("n", F.unix_millis(F.to_timestamp("n")))
    got = one.select(text.reset_ms(F.col("h"), F.col("z"), F.col("n")).alias("r")).select(F.date_format(F.timestamp_millis("r"), "yyyy-MM-dd HH:mm").alias("t")).first().t
    assert got == want


def rows_of(spark, root, name):
    return sorted((tuple(r) for r in versions.read(spark, root, name).collect()), key=str)


def test_replace_is_seen_as_a_whole(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    a = spark.createDataFrame([("s1", 1), ("s1", 2), ("s2", 3), (None, 4)], "session string, n int")
    b = spark.createDataFrame([("s1", "x"), ("s3", "y")], "session string, t string")
    assert versions.read(spark, root, "a") is None
    every = a.select("session").unionByName(b.select("session"))
    assert versions.replace(spark, root, {"a": a, "b": b}, every, ["session"], parts=4) == 1
    before = rows_of(spark, root, "a"), rows_of(spark, root, "b")
    new = {"a": spark.createDataFrame([("s1", 9)], "session string, n int"), "b": b.limit(0)}
    only = spark.createDataFrame([("s1",)], "session string")
    # a job that dies once data is written, before the manifest, changes nothing
    boom = monkeypatch.context()
    with boom as m:
        m.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            versions.replace(spark, root, new, only, ["session"], parts=4)
    assert (rows_of(spark, root, "a"), rows_of(spark, root, "b")) == before
    held = versions.manifest(spark, root)
    assert versions.replace(spark, root, new, only, ["session"], parts=4) == 2
    assert rows_of(spark, root, "b") == [("s3", "y")]
    assert sorted(map(str, rows_of(spark, root, "a"))) == sorted(map(str, [("s1", 9), ("s2", 3), (None, 4)]))
    # who read the manifest before goes on reading that version
    assert sorted(r.n for r in versions.read(spark, root, "a", held).collect()) == [1, 2, 3, 4]
    # of two commits from one version the second fails
    monkeypatch.setattr(versions, "manifest", lambda *_: held)
    with pytest.raises(versions.Taken):
        versions.replace(spark, root, new, only, ["session"], parts=4)


def test_replace_of_all_rows_and_of_none(spark, tmp_path):
    root = str(tmp_path)
    a = spark.createDataFrame([("s1", 1)], "session string, n int")
    versions.replace(spark, root, {"a": a}, a, ["session"], parts=2)
    versions.replace(spark, root, {"a": a.limit(0)}, a, ["session"], parts=2)
    assert rows_of(spark, root, "a") == []
    versions.replace(spark, root, {"a": a}, a.limit(0), ["session"], parts=2)
    assert rows_of(spark, root, "a") == []


READING = "id long, account_id long, bucket string, ts_unix_ms long, pct long, reset_ms long, saturated boolean"


def test_corrections_equal_a_full_rebuild_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    for case in range(2):
        rows, pct = [], 0
        for i in range(240):
            pct = rng.choice([pct, pct + 1, pct + 2, pct + 2, pct + 9, pct // 3 if rng.random() < 0.3 else pct])
            rows.append((i, 1, "session", 3_600_000 * i, None if rng.random() < 0.05 else min(pct, 107), 3_600_000 * (i + rng.randint(1, 30)) if rng.random() < 0.1 else None, False))
        order = rows[:]
        if case:
            rng.shuffle(order)
        root, counts = str(tmp_path / str(case)), []
        write = corrections.writer(root, counts, parts=4)
        cuts = [0, 80, 160, 200, 239, 240]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            write(spark.createDataFrame(order[a:b], READING), k)
        want = {tuple(r) for r in meter.usage_flags(spark.createDataFrame(rows, READING)).collect()}
        assert {tuple(r) for r in corrections.flags(spark, root).collect()} == want
        # a batch that is tried again changes nothing
        write(spark.createDataFrame(order[200:239], READING), 3)
        assert {tuple(r) for r in corrections.flags(spark, root).collect()} == want
        if not case:
            # in order, only what follows the last decided reset is computed again
            assert counts[0] == 80 and counts[4] < 60
    # a reading that is replaced, late
    fixed = [(*rows[10][:4], 55, None, False)]
    write(spark.createDataFrame(fixed, READING), 9)
    rows[10] = fixed[0]
    assert {tuple(r) for r in corrections.flags(spark, root).collect()} == {tuple(r) for r in meter.usage_flags(spark.createDataFrame(rows, READING)).collect()}


def run_stream(df, folder, **how):
    out = df.writeStream.option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True)
    q = (out.foreachBatch(how["each"]) if "each" in how else out.format("parquet").option("path", f"{folder}/out")).start()
    assert q.awaitTermination(180)


def test_event_log_resumes_behind_its_cursor(spark, tmp_path):
    log = str(tmp_path / "log")

    def put(ids):
        spark.createDataFrame([(i, i * 10, "budget" if i % 3 else "cache.warm", f"s{i % 2}", "/w", i % 4) for i in ids], eventlog.SCHEMA).coalesce(1).write.mode("append").parquet(log)

    def run():
        run_stream(eventlog.events(spark, log, since=5, page=7, kinds="b*,none", session_uuid="s1"), str(tmp_path))
        return sorted(r.event_id for r in spark.read.schema(eventlog.SCHEMA).parquet(str(tmp_path / "out")).collect())

    want = lambda n: [i for i in range(6, n) if i % 3 and i % 2]
    put(range(1, 40))
    assert run() == want(40)
    assert run() == want(40)
    put(range(40, 75))
    assert run() == want(75)


def test_a_batch_tried_three_times_announces_once(spark, tmp_path):
    said = []
    batch = spark.createDataFrame([(k, "", "budget", "tight", None) for k in range(5)] + [(9, "s1", "cache", "expiring", None), (10, "s1", "cache", "warm", None)], "event_id long, session_uuid string, kind string, state string, eta_ms long")
    write = announce.once(str(tmp_path / "claims"), lambda df: said.append(sorted(r.event_id for r in df.collect())), now_ms=0)
    for number in (0, 0, 0, 1):
        write(batch, number)
    assert said == [[2, 3, 4, 9]] * 2
    # a run that dies while it speaks loses the batch rather than say it again
    def dies(df):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        announce.once(str(tmp_path / "claims"), dies, now_ms=0)(batch, 2)
    write(batch, 2)
    assert len(said) == 2


def test_hooks_fire_once_and_late(spark, tmp_path):
    events = spark.createDataFrame([(1, 100, "cache.warm", "s1"), (2, 200, "budget", "s1"), (3, 300, "budget", "s2")], "event_id long, ts_unix_ms long, kind string, session_uuid string")
    hook = lambda k, kind, after, expires, status="pending", **more: {"hook_id": k, "kind_glob": kind, "after_event_id": after, "expires_ms": expires, "status": status} | more
    hooks = [hook(1, "budget", 0, 250), hook(2, "bud?et", 2, 250), hook(3, "b*", 0, 999, session_uuid="s2"), hook(4, "none", 0, 2000), hook(5, "*", 0, 999, "fired")]
    got = announce.hook_outcomes(hooks, events, now_ms=1000)
    # the first is owed its event though its time has passed meanwhile
    assert {r.hook_id: (r.status, r.event_id) for r in got.collect()} == {1: ("fired", 2), 2: ("expired", None), 3: ("fired", 3), 4: ("pending", None), 5: ("fired", None)}
    ran = []
    root = str(tmp_path / "hooks")
    assert sorted(announce.fire(spark, root, got, lambda h, e: ran.append((h, e)))) == [1, 3]
    assert announce.fire(spark, root, got, lambda h, e: ran.append((h, e))) == []
    assert sorted(ran) == [(1, 2), (3, 3)]


def test_marks_move_once_the_delta_is_stored(spark, tmp_path):
    root, seen = str(tmp_path), []
    records = lambda *rows: spark.createDataFrame([(f, k, t, c) for k, (f, t, c) in enumerate(rows)], "file string, line long, ts_unix_ms long, cwd string")
    first = records(("a", 10, "/x"), ("a", 20, ""), ("b", 5, None))

    def fails(df):
        seen.append({(r.file, r.records) for r in df.collect()})
        raise RuntimeError

    with pytest.raises(RuntimeError):
        watermarks.advance(spark, root, first, fails)
    keep = lambda df: seen.append({(r.file, r.records) for r in df.collect()})
    watermarks.advance(spark, root, first, keep)
    assert seen == [{("a", 2), ("b", 1)}] * 2
    # late lines are not in the delta and move nothing back
    watermarks.advance(spark, root, records(("a", 15, "/late"), ("b", 6, "/y")), keep)
    assert seen[-1] == {("b", 1)}
    assert {tuple(r) for r in watermarks.marks(spark, root).collect()} == {("a", 20), ("b", 6)}


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, old)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_stream_buckets_equal_the_batch(rocks, tmp_path):
    spark, rng, hour = rocks, random.Random(8), 3_600_000
    rows = [(a, 1_700_000_000_000 + rng.randrange(60 * hour), 10 + i, 100 * i) for a in (1, 2) for i in range(60)]
    schema, source = "account_id long, ts_unix_ms long, raw_tokens long, cw100 long", str(tmp_path / "in")
    rows.sort(key=lambda r: r[1] + rng.randrange(hour // 2))
    stream = lambda: buckets.fixed_buckets(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), 5 * hour)
    for k in range(0, 120, 40):
        spark.createDataFrame(rows[k : k + 40], schema).coalesce(1).write.mode("append").parquet(source)
        # a new query each time: it goes on from its checkpoint
        run_stream(stream(), str(tmp_path))
    # a row long after all others closes what is open; one far too late is dropped
    for t in (1_700_000_000_000 + 900 * hour, 1_700_000_000_000 - 50 * hour, 1_700_000_000_000 + 901 * hour):
        spark.createDataFrame([(a, t, 1, 1) for a in (1, 2)], schema).coalesce(1).write.mode("append").parquet(source)
        run_stream(stream(), str(tmp_path))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("account_id", "start_ms", "end_ms", "raw_tokens", "cw_tokens").collect()}
    assert got == {tuple(r) for r in meter.fixed_buckets(spark.createDataFrame(rows, schema), 5 * hour).collect()}


def test_a_silent_key_is_forgotten(rocks, tmp_path):
    spark, source = rocks, str(tmp_path / "in")
    # time passes for this query, which would have batches without data for ever
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    schema = "key string, n long, state string"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        run_stream(levels.level_edges_for(spark.readStream.schema(schema).parquet(source), "key", "n", timedelta(seconds=12)), str(tmp_path))
        return {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("key", "n", "state", "previous").collect()}

    first = run([("a", 1, "warm"), ("a", 2, "cold"), ("b", 1, "warm")])
    assert first == {("a", 1, "warm", "unknown"), ("a", 2, "cold", "warm"), ("b", 1, "warm", "unknown")}
    time.sleep(13)
    assert run([("a", 3, "cold"), ("a", 4, "warm")]) - first == {("a", 3, "cold", "unknown"), ("a", 4, "warm", "cold")}
