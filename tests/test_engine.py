"""The engine against hand-checked cases, its SQL, and its invariants."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemeter.operators import attribution as att
from tidemeter.operators import meter, policy, rollups
from tidemeter.plans import registry
from tidemeter.sources import fixtures
from tidemeter.streaming import levels

MIN, HOUR, DAY = 60_000, 3_600_000, 86_400_000


@pytest.mark.parametrize(
    "series, resets, invalid",
    [
        ([15, 17, 18, 0, 0, 1, 2], [3], []),
        ([18, 17, 17, 18, 25], [], []),
        ([34, 34, 34, 16, 34, 34], [], [3]),
        ([40, 40, 12, 40, 41], [], [2]),
        ([40, 40, 12, 13, 15], [2], []),
        ([88, 95, 97, 2, 6, 9], [3], []),
        ([10, 12, None, 14, 16], [], []),
        ([92, 95, 109, 100, 100], [], [2]),
        ([30, 28, 28, 28, 30, 30], [], [1, 2, 3]),
        ([88, 95, 97, 0, 0, 1, 2], [3], []),
        ([50], [], []),
    ],
)
def test_flags(series, resets, invalid):
    got = meter.flags_of([i * 5 * MIN for i in range(len(series))], series, [None] * len(series))
    assert [i for i, g in enumerate(got) if g[0]] == resets and [i for i, g in enumerate(got) if not g[1]] == invalid


def test_flags_at_an_advertised_reset():
    got = meter.flags_of([0, 60 * MIN, 90 * MIN], [40, 44, 46], [30 * MIN, None, None])
    assert [g[0] for g in got] == [False, True, False]


def windows(spark, bucket, cases):
    """Movement by window and session of each case: obs (ms, pct, reset after ms, flag '' / 'inv' / 'sat'), turns (session, cost, ms), median price. Cases are accounts."""
    o = [(i, n, bucket, t, p, t + r if r is not None else None, f == "sat", f != "inv") for n, (obs, *_) in enumerate(cases) for i, (t, p, r, f) in enumerate(obs)]
    t = [(i, n, ms, s, "p", c, c * 100) for n, (_, turns, *_) in enumerate(cases) for i, (s, c, ms) in enumerate(turns)]
    flags = spark.createDataFrame(o, "id long, account_id long, bucket string, ts_unix_ms long, pct long, reset_ms long, saturated boolean, valid boolean")
    turns = spark.createDataFrame(t, "event_id long, account_id long, ts_unix_ms long, session_uuid string, project string, raw_tokens long, cw100 long")
    medians = spark.createDataFrame([(n, bucket, float(c[2])) for n, c in enumerate(cases)], "account_id long, bucket string, median_cw_per_pct double")
    out = [{} for _ in cases]
    for r in att.attribution(flags, turns, medians).where(F.col("bucket") == bucket).collect():
        out[r.account_id][r.window_start_ms, r.session_uuid] = r.measured_pct, r.estimated_pct
    return out


def by_session(rows):
    out = {}
    for (_, s), (m, e) in rows.items():
        a, b = out.get(s, (0, 0))
        out[s] = round(a + m, 4), round(b + e, 4)
    return out


W = 7 * DAY


ATTRIBUTED = [
    ([(0, 10, W, ""), (HOUR, 20, W, "")], [("a", 300, 10 * MIN), ("b", 100, 20 * MIN)], 0, {"a": (7.5, 0), "b": (2.5, 0)}),
    ([(0, 50, HOUR, ""), (2 * HOUR, 3, W, ""), (3 * HOUR, 12, W, "")], [("c", 500, 65 * MIN)], 0, {"c": (12, 0)}),
    ([(0, 10, W, ""), (HOUR, 18, W, "")], [], 0, {"": (8, 0)}),
    ([(0, 10, W, ""), (HOUR, 12, W, "")], [("a", 400, 30 * MIN), ("b", 1000, 2 * HOUR)], 500, {"a": (2, 0), "b": (0, 2)}),
    ([(0, 90, W, ""), (HOUR, 99, W, "sat"), (2 * HOUR, 99, W, "sat")], [("a", 100, 30 * MIN), ("b", 1000, 90 * MIN)], 500, {"a": (0, 0.2), "b": (0, 2)}),
    ([(0, 10, W, ""), (HOUR, 4, W, "inv"), (2 * HOUR, 30, W, "")], [("a", 100, 90 * MIN)], 0, {"a": (20, 0)}),
    ([], [("a", 500, 0), ("b", 1500, 8 * DAY)], 500, {"a": (0, 1), "b": (0, 3)}),
    ([(0, 10, W, ""), (2 * HOUR, 30, W, "")], [("a", 20000, HOUR), ("b", 5000, 3 * HOUR)], 250, {"a": (20, 0), "b": (0, 5)}),
    ([(0, 10, W, ""), (HOUR, 18, W, ""), (90 * MIN, 99, W, "sat"), (2 * HOUR, 18, W, ""), (3 * HOUR, 22, W, "")], [("a", 8000, 30 * MIN), ("b", 4000, 150 * MIN)], 0, {"a": (8, 0), "b": (4, 0)}),
    ([(0, 10, W, ""), (HOUR, 11, W, "")], [("a", 1, 30 * MIN)], 0, {"a": (1, 0)}),
    ([(0, 10, W, ""), (HOUR, 12, W, "")], [("old", 1000, -3 * DAY)], 500, {"": (2, 0), "old": (0, 2)}),
    ([(HOUR, 5, HOUR // 2, ""), (2 * HOUR, 7, None, ""), (3 * HOUR, 9, W, ""), (4 * HOUR, 12, W, "")], [("a", 100, 110 * MIN), ("b", 300, 200 * MIN)], 0, {"a": (6.9, 0), "b": (7.1, 0)}),
]


def test_attribution(spark):
    got = windows(spark, "week", ATTRIBUTED)
    for rows, (*_, expected) in zip(got[:-1], ATTRIBUTED[:-1], strict=True):
        assert by_session(rows) == expected
    # the last one's second window begins at its advertised start, before the first one's last reading: a turn counts in both
    assert set(got[-1]) == {(HOUR, "a"), (HOUR + HOUR // 2, "a"), (HOUR + HOUR // 2, "b")}


def test_attribution_in_two_windows_of_a_session(spark):
    (got,) = windows(spark, "session", [([(0, 60, 30 * MIN, ""), (HOUR, 8, 5 * HOUR, ""), (2 * HOUR, 25, 4 * HOUR, "")], [("a", 100, 90 * MIN)], 0)])
    assert by_session(got) == {"a": (25, 0)}


def test_attribution_shares_and_caps(spark):
    rises = [(i * HOUR, p, W, "") for i, p in enumerate((5, 11, 26, 31))]
    capped = [(0, 10, W, ""), (HOUR, 18, W, ""), (90 * MIN, 99, W, "sat"), (2 * HOUR, 18, W, ""), (3 * HOUR, 20, W, "")]
    a, b = windows(spark, "week", [(rises, [("a", 137, 10 * MIN), ("b", 921, 70 * MIN), ("a", 44, 80 * MIN), ("c", 611, 160 * MIN)], 0), (capped, [("a", 8000, 30 * MIN), ("b", 20, 150 * MIN)], 0)])
    assert abs(sum(m for m, _ in a.values()) - 26) < 0.01
    few = by_session(b)
    assert abs(few["b"][0] - 40 / 802) < 1e-4 and few["a"][0] == 8 and abs(sum(m for m, _ in b.values()) - 10) < 0.01


def flags(spark, rows):
    schema = "id long, account_id long, bucket string, ts_unix_ms long, pct long, reset_ms long, saturated boolean, reset_detected boolean, valid boolean"
    return spark.createDataFrame([(i, 1, "session", t, p, None, s, r, v) for i, (t, p, s, r, v) in enumerate(rows)], schema)


def test_calibration(spark):
    t = lambda rows: spark.createDataFrame([(1, ms, c, c * 100) for c, ms in rows], "account_id long, ts_unix_ms long, raw_tokens long, cw100 long")
    ok = lambda ms, p: (ms, p, False, False, True)
    run = lambda obs, turns: [(r.from_pct, r.to_pct, r.cw_tokens) for r in meter.calibration_points(flags(spark, obs), t(turns)).where("bucket = 'session'").orderBy("a_ms").collect()]
    assert run([ok(0, 10), ok(5 * MIN, 10), ok(10 * MIN, 11)], [(100, MIN), (100, 6 * MIN)]) == [(10, 11, 200.0)]
    assert run([ok(0, 28), ok(HOUR, 30), ok(2 * HOUR, 28), ok(3 * HOUR, 30)], [(500, 30 * MIN), (500, 90 * MIN), (500, 150 * MIN)]) == [(28, 30, 1500.0)]
    assert run([ok(0, 10), (HOUR, 3, False, False, False), ok(2 * HOUR, 25)], [(300, 90 * MIN)]) == [(10, 25, 300.0)]
    assert run([ok(0, 90), (HOUR, 2, False, True, True), ok(2 * HOUR, 20)], [(400, 90 * MIN)]) == [(2, 20, 400.0)]
    assert run([ok(0, 10), ok(30 * MIN, 90), (HOUR, 99, True, False, True), ok(2 * HOUR, 85), ok(3 * HOUR, 95)], [(50, 15 * MIN), (1000, 90 * MIN), (300, 150 * MIN)]) == [(10, 90, 50.0), (90, 95, 300.0)]


def test_burn(spark):
    ok = lambda ms, p: (ms, p, False, False, True)
    rate = lambda obs, look=45 * MIN: [r.pct_per_hour for r in meter.burn_series(flags(spark, obs), look).orderBy("id").collect()]
    assert rate([ok(15 * i * MIN, 2 * i) for i in range(6)]) == [None] + [8.0] * 5
    assert rate([ok(0, 80), ok(15 * MIN, 90), ok(30 * MIN, 95), (45 * MIN, 1, False, True, True), ok(60 * MIN, 3)])[3:] == [None, 8.0]
    assert rate([ok(0, 1), ok(6 * HOUR, 9)]) == [None, None]
    now = lambda obs: [r.pct_per_hour for r in meter.burn_now(flags(spark, obs)).collect()]
    assert now([ok(0, 2), ok(30 * MIN, 10)]) == [16.0]
    assert now([ok(0, 0), ok(60 * MIN, 40), ok(90 * MIN, 46)]) == [12.0]
    assert now([ok(0, 0), ok(2 * HOUR, 10)]) == [5.0]


def test_projection(spark):
    rows = [("week", 2, 2.0, 167), ("week", 60, 3.0, 120), ("session", 60, 20.0, 3)]
    df = spark.createDataFrame([(i, b, 0, p, s, h * HOUR) for i, (b, p, s, h) in enumerate(rows)], "account_id long, bucket string, ts_unix_ms long, pct long, pct_per_hour double, reset_ms long")
    assert {r.account_id: round(r.eta_hours, 4) for r in meter.limit_projection(df).collect()} == {1: 13.3333, 2: 2.0}


def test_owner_totals_fold_before_the_peak(spark):
    rows = spark.createDataFrame([(1, "session", w, s, p, 0.0) for w, s, p in [(1, "a", 5.0), (1, "x", 20.0), (1, "y", 15.0), (2, "a", 8.0)]], "account_id long, bucket string, window_start_ms long, session_uuid string, measured_pct double, estimated_pct double")
    owners = spark.createDataFrame([("a", "a"), ("x", "a"), ("y", "a")], "session_uuid string, owner string")
    r = att.pct_totals(rows, owners).first()
    assert (r.total_pct, r.peak_pct, r.windows) == (48.0, 40.0, 2)


def test_pressure(spark):
    df = spark.createDataFrame([(20.0, u) for u in (5.0, 14.9, 15.0, 19.9, 20.0, 31.0, None)], "a double, u double")
    assert [r.p for r in df.select(policy.pressure("a", "u").alias("p")).collect()] == ["clear", "clear", "tight", "tight", "exceeded", "exceeded", "unknown"]


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", [*registry.queries()])
def test_query_matches_its_sql(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    tidy = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    got = tidy([tuple(r[c] for c in names) for r in df.collect()])
    if name in registry.oracle_sql():
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        rel = con.sql(registry.oracle_sql()[name])
        assert sorted(rel.columns) == names
        assert got == tidy(rel.select(", ".join(f'"{n}"' for n in names)).fetchall())


def test_streams_equal_batch(spark, sf_dir, tmp_path):
    t = registry.fixtures.turns(spark, sf_dir).select("session_uuid", "turn_idx", "event_id", registry.weights.cache_state().alias("state"))
    t.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    q = levels.level_edges(stream, "session_uuid", "turn_idx").writeStream.format("memory").queryName("edges").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    rows = lambda df: sorted(map(tuple, df.select("session_uuid", "turn_idx", "state", "previous").collect()))
    assert rows(spark.table("edges")) == rows(registry.queries()["level_edges"](spark, sf_dir))
    out = str(tmp_path / "out")
    q = stream.writeStream.foreachBatch(levels.upsert_latest(out, ["session_uuid"], ["turn_idx"])).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    want = {r.session_uuid: r.turn_idx for r in t.groupBy("session_uuid").agg(F.max("turn_idx").alias("turn_idx")).collect()}
    assert {r.session_uuid: r.turn_idx for r in spark.read.parquet(f"{out}/batch=0").collect()} == want


def test_tail_keeps_the_newest(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 50), ("b", 1, 3), ("b", 2, 4)], "k string, i long, n long")
    got = rollups.tail_within(df, ["k"], [F.desc("i")], F.col("n"), 7).collect()
    assert sorted((r.k, r.i) for r in got) == [("a", 2), ("b", 1), ("b", 2)]


def test_meter_has_two_rows_a_poll(spark, sf_dir):
    assert fixtures.meter(spark, sf_dir).count() == 2 * fixtures.observations(spark, sf_dir).count()


def test_peak_sum_without_a_frame_by_range(spark):
    """As by summing every span by hand, times and tokens that are null included; no frame looks at a span's rows again for each turn."""
    rows = [("a", t * 7 % 400, t % 5) for t in range(120)] + [("b", None, 3), ("b", None, 4), ("b", 5, None), ("c", 9, None), (None, 1, 2), ("d", 10, 1), ("d", 30, 2), ("d", 31, 4), ("e", -15, 6), ("e", 4, 1)]
    df = spark.createDataFrame(rows, "session_uuid string, ts_unix_ms long, raw_tokens long")
    want = {}
    for s, t, _ in rows:
        near = [x for u, v, x in rows if u == s and x is not None and (v is None if t is None else v is not None and t - 20 <= v <= t)]
        want[s] = max([want.get(s), sum(near) if near else None], key=lambda x: -1 if x is None else x)
    for slot in (16, 3_600_000):
        got = rollups.peak_sum(df, 20, slot)
        assert {r.session_uuid: r.peak_raw_tokens for r in got.collect()} == want
    assert "RangeFrame" not in got._jdf.queryExecution().executedPlan().toString()


def test_flags_stream_as_of_all_readings_at_once(spark):
    """Batches of any size give the flags of the whole series, and what is held is the stretch that later readings decide, not the series."""
    import random

    import pyarrow as pa

    rng, rows = random.Random(3), []
    for account in (1, None, 2):
        p = 0
        for i in range(700):
            p = 0 if p > 103 else p + rng.choice((0, 0, 0, 1, 2))
            rows.append((len(rows), account, "week", i * 10 if i < 690 else None, rng.choice((p, p, p, p // 2, None)), i * 10 + 500 if i % 90 == 0 else None, False))
    rows += [(len(rows) + i, 3, "week", i, 50 if i < 5 else 10, None, False) for i in range(3000)]
    names = ["id", "account_id", "bucket", "ts_unix_ms", "pct", "reset_ms", "saturated"]
    table = pa.table({n: [r[k] for r in rows] for k, n in enumerate(names)})
    want = {}
    for account in (1, None, 2, 3):
        own = [r for r in rows if r[1] == account]
        want |= {r[0]: f[:2] for r, f in zip(own, meter.flags_of(*[[r[k] for r in own] for k in (3, 4, 5)]), strict=True)}
    for size in (1, 7, 64, 10_000):
        out = pa.Table.from_batches(meter._in_order(iter(table.to_batches(max_chunksize=size)))).to_pylist()
        assert [r["id"] for r in out] == [r[0] for r in rows]
        assert {r["id"]: (r["reset_detected"], r["valid"]) for r in out} == want
    read = []
    stream = meter._in_order(read.append(k) or b for k, b in enumerate(table.to_batches(max_chunksize=7)))
    next(stream)
    assert len(read) <= 3, "rows leave before the series has been read"
    df = spark.createDataFrame(rows, meter.FLAGS.split(", reset_detected")[0])
    assert {r.id: (r.reset_detected, r.valid) for r in meter.usage_flags(df).collect()} == want
    assert "FlatMapGroups" not in meter.usage_flags(df)._jdf.queryExecution().executedPlan().toString()


def test_transcripts_in_parts_are_read_as_one(spark, sf_dir, tmp_path, monkeypatch):
    """A session in several parts gives the turns of one file; no sort or window holds a file's lines."""
    from tidemeter.plans import reports
    from tidemeter.sources import transcripts as tr

    want = sorted(reports.QUERIES["transcript_files"](spark, sf_dir).toPandas().fillna(-1).values.tolist(), key=str)
    monkeypatch.setattr(fixtures, "PART_LINES", 64)
    folder = fixtures.transcript_files(spark, sf_dir)
    lines = tr.read_lines(spark, [folder], fixtures.session_of)
    assert "SortMergeJoin" not in lines._jdf.queryExecution().executedPlan().toString()
    got = sorted(tr.turns(tr.parsed(lines)).drop("line").toPandas().fillna(-1).values.tolist(), key=str)
    assert got == want
    told = [r.value for r in fixtures.transcript(spark, sf_dir).where("file = 's3'").orderBy("line").collect()]
    parts = spark.read.text(folder).where(F.col("_metadata.file_path").contains("/file=s3/")).select("_metadata.file_path").distinct().count()
    own = lines.where("file = 's3'").orderBy("line").collect()
    assert parts > 1 and [r.line for r in own] == [*range(len(told))] and [r.value for r in own] == told
    # splits of one file, blank lines counted but left out
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" if i % 5 else "\n" for i in range(2000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        read = tr.read_lines(spark, [str(tmp_path / "a.txt")])
        assert sorted((r.line, r.value) for r in read.collect()) == [(i, f"line {i}") for i in range(2000) if i % 5]
        # numbers come from the splits: lines themselves are never dealt by file
        assert read._jdf.queryExecution().executedPlan().toString().count("value#") and "row_number" not in read._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
