"""Files, parts, merges and owners against hand-checked cases."""

from pyspark.sql import functions as F

from tidemeter.operators import identity, meter, policy, views
from tidemeter.sources import transcripts as tr
from tidemeter.streaming import sinks


def test_lines_keep_their_numbers_over_splits(spark, tmp_path):
    rows = [f"{i} " + "x" * (i % 50) if i % 7 else "" for i in range(3000)]
    (tmp_path / "a.jsonl").write_text("\n".join(rows))
    (tmp_path / "b.jsonl").write_text("one\n\nthree\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = {(r.file.rsplit("/", 1)[1], r.line): r.value for r in tr.read_lines(spark, [str(tmp_path)]).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {("a.jsonl", i): t for i, t in enumerate(rows) if t} | {("b.jsonl", 0): "one", ("b.jsonl", 2): "three"}


def test_replaced_parts(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_parts(spark.createDataFrame([(1, "week", 5), (1, "week", 6), (2, "week", 7)], "account_id long, bucket string, v int"), path, ["account_id", "bucket"])
    sinks.replace_parts(spark.createDataFrame([(1, "week", 9)], "account_id long, bucket string, v int"), path, ["account_id", "bucket"])
    assert sorted((r.account_id, r.v) for r in spark.read.parquet(path).collect()) == [(1, 9), (2, 7)]


def test_parents_and_merges(spark):
    good = "0a1B2c3d-0000-1111-2222-0123456789ab"
    files = spark.createDataFrame([(f"p/{x}/subagents/a.jsonl",) for x in (good, good[:-1], "s1")] + [(f"p/{good}.jsonl",)], "path string")
    assert {(r.parent, r.valid) for r in tr.parent_links(files).collect()} == {(good, True), (good[:-1], False), ("s1", False)}
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "account_id long, v string")
    merges = spark.createDataFrame([(3, 1)], "from_id long, to_id long")
    assert sorted(map(tuple, identity.merged_accounts(rows, merges).collect())) == [(1, "a"), (1, "c"), (2, "b")]


def test_a_subagent_has_its_parent_s_directory(spark):
    rows = spark.createDataFrame([("a", 1.0), ("x", 2.0), ("", 3.0), ("gone", 4.0)], "session_uuid string, measured_pct double")
    sessions = spark.createDataFrame([("a", "", "/w"), ("x", "a", "/other")], "session_uuid string, parent_session_uuid string, cwd string")
    assert {(r.session_uuid, r.effective_uuid, r.cwd) for r in views.with_owners(rows, sessions).collect()} == {("a", "a", "/w"), ("x", "a", "/w"), ("", "", ""), ("gone", "gone", "")}


def test_budgets_in_the_open_window(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    budgets = df([("/a", "week", 10.0, 90.0), ("/b", "week", 4.0, None), ("/c", "week", 5.0, 50.0), ("/d", "week", 5.0, None)], "cwd string, bucket string, spend_pct double, meter_pct double")
    owned = df([(1, "week", 100, "/a", 7.0, 0.6), (1, "week", 50, "/a", 50.0, 0.0), (1, "week", 100, "/b", 1.0, 3.5)], "account_id long, bucket string, window_start_ms long, cwd string, measured_pct double, estimated_pct double")
    windows = df([(1, "week", 50, False), (1, "week", 100, True)], "account_id long, bucket string, start_ms long, in_progress boolean")
    accounts, latest = df([("/a", 1), ("/b", 1), ("/c", 1), ("/d", 2)], "cwd string, account_id long"), df([(1, "week", 60)], "account_id long, bucket string, pct long")
    got = {r.cwd: (r.spent_pct, r.remaining_pct, r.state, r.rule) for r in policy.open_window_use(budgets, owned, windows, accounts, latest).collect()}
    assert got == {"/a": (7.6, 2.4, "tight", "spend"), "/b": (4.5, 0.0, "exceeded", "spend"), "/c": (0.0, 5.0, "exceeded", "meter"), "/d": (None, None, "unknown", "")}


def test_greedy_buckets(spark):
    t = spark.createDataFrame([(1, x, 1, 100) for x in (0, 3, 9, 10, 10, 25, 34)] + [(2, 7, 5, 200)], "account_id long, ts_unix_ms long, raw_tokens long, cw100 long")
    got = sorted(map(tuple, meter.fixed_buckets(t, 10).select("account_id", "start_ms", "end_ms", F.col("raw_tokens")).collect()))
    assert got == [(1, 0, 10, 3), (1, 10, 20, 2), (1, 25, 35, 2), (2, 7, 17, 5)]
