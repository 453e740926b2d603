"""Turns and meter readings derived from the event stream by integer formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import weights
from .shared import new_folder

HOUR_MS = 3_600_000
SESSION_MS, WEEK_MS = 5 * HOUR_MS, 168 * HOUR_MS
EPOCH_MS = 1_704_067_200_000
#: Clocks: in a work session that runs out early, and on a day with sessions of low priority.
MIDWAY_MS, QUOTA_MS = EPOCH_MS + 384_120_000, EPOCH_MS + 264 * HOUR_MS
MODELS = {"click": "m-large", "view": "m-base", "purchase": "m-mid", "signup": "m-small", "error": "m-unpriced"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "event_id", "event_type",
        F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("ms"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        (F.col("user_id") % 20).alias("s"),
    )
    return e.withColumn("o", F.when(F.col("s") >= 16, F.col("s") - 16).otherwise(F.col("s")))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a turn, with its index, gap, class and weights."""
    k, s, o = F.col("k"), F.col("s"), F.col("o")
    model = F.lit(None).cast("string")
    for kind, name in MODELS.items():
        model = F.when(F.col("event_type") == kind, name).otherwise(model)
    t = _events(spark, sf_dir).select(
        "event_id", F.col("ms").alias("ts_unix_ms"), F.concat(F.lit("s"), s).alias("session_uuid"),
        F.when(s >= 16, F.concat(F.lit("s"), s - 16)).otherwise("").alias("parent_session_uuid"),
        F.concat(F.lit("p"), o % 5).alias("project"), (o % 3 + 1).alias("account_id"),
        F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("/w/"), s % 7, F.lit("/"), k % 3)).alias("cwd"),
        model.alias("model"), (k * 10 + 1).alias("input_tokens"), (k * 37 % 500).alias("output_tokens"),
        F.when(k % 4 == 0, 0).otherwise(k * 400).alias("cache_read"),
        F.when(k % 3 == 0, k * 150).otherwise(0).alias("cache_create_5m"),
        F.when(k % 5 == 0, k * 200).otherwise(0).alias("cache_create_1h"),
    )
    w = Window.partitionBy("session_uuid").orderBy("ts_unix_ms", "event_id")
    gap = F.greatest(F.lit(0).cast("bigint"), F.col("ts_unix_ms") - F.lag("ts_unix_ms").over(w))
    t = t.withColumns({"turn_idx": (F.row_number().over(w) - 1).cast("bigint"), "gap_s": F.coalesce(gap, F.lit(0)).cast("double") / 1000.0})
    return weights.weighted(weights.classified(t))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a poll: both meters' percentages and advertised resets, null where a poll has none."""
    ms, k = F.col("ms"), F.col("k")
    e = _events(spark, sf_dir).where(F.col("event_id") % 8 == 0)
    fill = lambda span, low, step, n: F.expr(f"least(100, (ms % {span}) * ({low} + {step} * ((ms div {span}) % {n})) div {span})")
    e = e.withColumns({"sb": fill(SESSION_MS, 60, 14, 6), "wb": fill(WEEK_MS, 50, 15, 5)})
    session = F.when(k == 99, None).when(k == 7, 107).when(k == 13, F.expr("sb div 3")).otherwise(F.col("sb"))
    week = F.when(k == 99, None).when(k == 17, F.expr("wb div 2")).otherwise(F.col("wb"))
    reset = lambda span: F.when(k % 25 == 0, None).otherwise(F.expr(f"(ms div {span} + 1) * {span}"))
    return e.select(
        F.col("event_id").alias("id"), (F.col("o") % 3 + 1).alias("account_id"), ms.alias("ts_unix_ms"),
        session.cast("bigint").alias("session_pct"), week.cast("bigint").alias("week_pct"),
        reset(SESSION_MS).cast("bigint").alias("session_reset_ms"), reset(WEEK_MS).cast("bigint").alias("week_reset_ms"),
    )


def meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form of observations(): one row a poll and bucket ('session', 'week')."""
    o = observations(spark, sf_dir)
    one = lambda name: o.select(
        "id", "account_id", F.lit(name).alias("bucket"), "ts_unix_ms", F.col(f"{name}_pct").alias("pct"), F.col(f"{name}_reset_ms").alias("reset_ms"),
        F.coalesce(F.col(f"{name}_pct") >= 99, F.lit(False)).alias("saturated"),
    )
    return one("session").unionByName(one("week"))


def with_k(turns_: DataFrame) -> DataFrame:
    """turns() with the events' k, from which the further tables are derived."""
    return turns_.withColumn("k", F.expr("(input_tokens - 1) div 10"))


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line, value): a session's turns as JSON records, among prompts, compactions, refusals, partial repeats and broken lines."""
    k, model = F.col("k"), F.col("model")
    t = with_k(turns(spark, sf_dir)).withColumn("stamp", F.date_format(F.timestamp_millis("ts_unix_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    word = lambda **f: [F.lit(v).alias(n) if not isinstance(v, F.Column) else v.alias(n) for n, v in f.items()]
    record = lambda **f: F.to_json(F.struct(F.col("stamp").alias("timestamp"), *word(**f)))
    said = lambda text: F.struct(text.alias("content"))
    usage = lambda out: F.struct(
        "input_tokens", out.alias("output_tokens"), F.col("cache_read").alias("cache_read_input_tokens"),
        F.struct(F.col("cache_create_5m").alias("ephemeral_5m_input_tokens"), F.col("cache_create_1h").alias("ephemeral_1h_input_tokens")).alias("cache_creation"),
    )
    answer = lambda out: record(type="assistant", requestId=F.concat(F.lit("r"), "event_id"), cwd=F.col("cwd"), message=F.struct(F.concat(F.lit("m"), "event_id").alias("id"), "model", usage(out).alias("usage")))
    limits = F.struct(
        F.when(k % 5 == 0, 0).otherwise(F.expr("ts_unix_ms div 1000") + 86_400).alias("resetsAt"), F.element_at(F.array(F.lit("five_hour"), F.lit("seven_day"), F.lit("")), (k % 3 + 1).cast("int")).alias("rateLimitType"),
        (k % 4 == 0).alias("isUsingOverage"), F.when(k % 2 == 0, "treatment").otherwise("").alias("lowPriorityOffer"),
    )
    signal = (
        F.when(k >= 99, None).when(k >= 90, record(type="assistant", error="rate_limit", quotaLimits=limits)).when(k == 89, record(type="user", queuePriority="later", origin=F.struct(F.lit("auto-continuation").alias("kind"))))
        .when(k == 88, record(type="user", message=said(F.lit("<command-name>/low-priority</command-name>")))).when(k == 87, record(type="system", subtype="local_command", content="Continuing now at lower priority until 5pm"))
        .when(k == 86, record(type="system", subtype="local_command", content="done"))
    )
    ask = F.concat(F.lit("ask "), k, F.when(k % 2 == 0, " <system-reminder>never shown</system-reminder>  twice").otherwise(""))
    slots = [
        F.when((model == "m-mid") & (k % 4 == 1), record(type="system", subtype="compact_boundary")),
        F.when((model == "m-mid") & (k % 8 == 1), record(type="user", isCompactSummary=True, message=said(F.repeat(F.lit("word"), k.cast("int"))))),
        F.when(model == "m-small", record(type="user", userType="external", message=said(ask))),
        F.when(model == "m-unpriced", signal),
        F.when(k % 3 == 0, answer(F.lit(1).cast("bigint"))),
        answer(F.col("output_tokens")),
        F.when(k % 50 == 0, "{broken"),
    ]
    return t.select(F.col("session_uuid").alias("file"), "turn_idx", F.posexplode(F.array(*slots)).alias("slot", "value")).where("value is not null").select("file", (F.col("turn_idx") * 8 + F.col("slot")).alias("line"), "value")


#: Lines of a part of a transcript: what a task sorts at once.
PART_LINES = 1 << 19


def transcript_files(spark: SparkSession, sf_dir: str) -> str:
    """A new folder of transcript() as JSON line files, one a session, or several parts in order of their paths where it has many lines."""
    path = new_folder(spark, "transcripts")
    lines = transcript(spark, sf_dir).withColumn("part", F.format_string("%012d", F.expr(f"line div {PART_LINES}")))
    lines = lines.repartition("file", "part").sortWithinPartitions("file", "part", "line")
    lines.select("file", "part", "value").write.partitionBy("file", "part").text(path)
    return path


def session_of(path: Column) -> Column:
    """The session that a path below transcript_files() is part of."""
    return F.regexp_extract(path, "/file=([^/]+)/", 1)


def session_paths(turns_: DataFrame) -> DataFrame:
    """(file, path) of each session's transcript in the layouts: at the top of its project, as a subagent's under its parent's id (one under a garbled id), or as a workflow's agent."""
    h = F.md5("parent_session_uuid")
    parent = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    n = F.substring("session_uuid", 2, 9).cast("int")
    name = F.concat(F.lit("agent-"), F.col("session_uuid"), F.lit(".jsonl"))
    path = (
        F.when(F.col("parent_session_uuid") == "", F.concat("project", F.lit("/"), "session_uuid", F.lit(".jsonl")))
        .when(n % 4 == 3, F.concat("project", F.lit("/"), parent, F.lit("/subagents/workflows/w1/"), name))
        .when(n % 4 == 2, F.concat("project", F.lit("/"), "parent_session_uuid", F.lit("/subagents/"), name)).otherwise(F.concat("project", F.lit("/"), parent, F.lit("/subagents/"), name))
    )
    return turns_.select("session_uuid", "parent_session_uuid", "project").distinct().select(F.col("session_uuid").alias("file"), path.alias("path"))


def transcript_tree(spark: SparkSession, sf_dir: str) -> str:
    """A new folder with transcript() as files of the layouts, a session that ended at once (``p0/tiny.jsonl``), a workflow's journal and a file that is no transcript."""
    root, raw = new_folder(spark, "tree"), new_folder(spark, "raw")
    lines = transcript(spark, sf_dir).repartition("file").sortWithinPartitions("file", "line")
    lines.select("file", "value").write.partitionBy("file").text(raw)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def put(source: str, target: str) -> None:
        parts = [s.getPath() for s in fs.listStatus(path(source)) if s.getPath().getName().startswith("part-")]
        to = path(f"{root}/{target}")
        fs.mkdirs(to.getParent())
        assert len(parts) == 1 and fs.rename(parts[0], to)

    for r in session_paths(turns(spark, sf_dir)).collect():
        put(f"{raw}/file={r.file}", r.path)
    for k, name in enumerate(("p0/tiny.jsonl", "p1/0/subagents/workflows/w1/journal.jsonl", "p1/notes.txt")):
        spark.createDataFrame([('{"type":"user"}',)], "value string").coalesce(1).write.text(f"{raw}-{k}")
        put(f"{raw}-{k}", name)
    return root
