"""Assistant transcripts, one JSON record a line: files, records, and the tables they hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import reset_ms

#: Fields of a record that the tables need; content stays text, since it is a string or an array.
RECORD = """type string, subtype string, timestamp string, requestId string, cwd string, userType string, error string, queuePriority string, content string,
isMeta boolean, isCompactSummary boolean, isSidechain boolean, toolUseResult string, sourceToolAssistantUUID string, origin struct<kind: string>,
quotaLimits struct<resetsAt: bigint, rateLimitType: string, isUsingOverage: boolean, lowPriorityOffer: string>,
message struct<id: string, model: string, content: string, usage: struct<input_tokens: bigint, output_tokens: bigint, cache_read_input_tokens: bigint,
cache_creation: struct<ephemeral_5m_input_tokens: bigint, ephemeral_1h_input_tokens: bigint>>>"""
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
#: The meter that a limit's name stands for.
LIMITS = {"five_hour": "session", "seven_day": "week"}
MIN_BYTES, SHRINK, PREVIEW = 5000, 0.5, 240
TAGS = ("system-reminder", "local-command-stdout", "local-command-stderr", "command-name", "command-message", "command-args")


def read_lines(spark: SparkSession, paths: list[str], whole: Callable[[Column], Column] | None = None) -> DataFrame:
    """(file, line, value) of text files, blank lines left out. ``whole`` names the file that a path is a part of, in order of paths; else each path is a file.

    Large files are read in splits; a line's number is its own in the split and the lines of the splits before. Only a row a split is ordered, so no file is sorted or held.
    """
    path = F.col("_metadata.file_path")
    lines = spark.read.text(paths).select((whole(path) if whole else path).alias("file"), path.alias("_path"), "value", F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_n"))
    before = Window.partitionBy("file").orderBy("_path", "_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "_path", "_at").agg(F.min("_n").alias("_first"), F.count("*").alias("_lines"))
    splits = splits.select("_path", "_at", "_first", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before"))
    # a row a split
    placed = lines.join(F.broadcast(splits), ["_path", "_at"])
    return placed.where("trim(value) <> ''").select("file", (F.col("_n") - F.col("_first") + F.col("_before")).cast("bigint").alias("line"), "value")


def path_shape(path: Column) -> Column:
    """top_level, subagent, workflow_agent or unrecognized by a path's depth; null for journals, which do not count."""
    p = F.split(path, "/")
    n, at = F.size(p), lambda i: F.get(p, F.lit(i))
    flow = (n == 6) & (at(2) == "subagents") & (at(3) == "workflows")
    return (
        F.when((n == 2) & at(1).endswith(".jsonl"), "top_level").when((n == 4) & (at(2) == "subagents") & at(3).endswith(".jsonl"), "subagent")
        .when(flow & (at(5) == "journal.jsonl"), None).when(flow & at(5).startswith("agent-") & at(5).endswith(".jsonl"), "workflow_agent").otherwise("unrecognized")
    )


def owner_key(path: Column) -> Column:
    """The session that a path belongs to: its own name at the top, else its parent folder's."""
    p = F.split(path, "/")
    return F.when(F.size(p) == 2, F.regexp_replace(F.get(p, F.lit(1)), r"\.jsonl$", "")).when(F.size(p) > 2, F.get(p, F.lit(1)))


def parent_links(files: DataFrame) -> DataFrame:
    """Subagents' files with the session that their folder names, and whether that is a session's id: rows of a garbled folder must not be read, as their turns would count for nobody."""
    parent = owner_key(F.col("path"))
    return files.where(path_shape(F.col("path")).isin("subagent", "workflow_agent")).select("path", parent.alias("parent"), parent.rlike(UUID).alias("valid"))


def changed(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose (path, mtime_ms) the ledger does not hold, and which are large enough or not at the top."""
    big = (F.col("bytes") >= MIN_BYTES) | (path_shape(F.col("path")) != "top_level")
    return files.where(big).join(ledger, ["path", "mtime_ms"], "left_anti")


def coverage(files: DataFrame, ingested: DataFrame, excluded: DataFrame) -> DataFrame:
    """Files by shape: on disk, ingested, skipped (excluded sessions, small ones) and missing. All four shapes are always there."""
    spark = files.sparkSession
    f = files.withColumns({"shape": path_shape(F.col("path")), "key": owner_key(F.col("path"))}).where("shape is not null")
    f = f.join(ingested.select("path", F.lit(True).alias("_in")), "path", "left").join(excluded.select(F.col("session_uuid").alias("key"), F.lit(True).alias("_ex")), "key", "left")
    state = F.when(F.col("_in"), "ingested").when(F.col("_ex") | ((F.col("shape") == "top_level") & (F.col("bytes") < MIN_BYTES)), "skipped").otherwise("missing")
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    n = f.withColumn("state", state).groupBy("shape").agg(F.count("*").alias("on_disk"), count("ingested"), count("skipped"), count("missing"))
    shapes = spark.createDataFrame([(s,) for s in ("top_level", "subagent", "workflow_agent", "unrecognized")], "shape string")
    return shapes.join(n, "shape", "left").na.fill(0)


def parsed(lines: DataFrame) -> DataFrame:
    """Records with ts_unix_ms (0 where unreadable); lines that are no JSON objects with a type are dropped."""
    r = lines.withColumn("r", F.from_json("value", RECORD)).where("r.type is not null").select("file", "line", "r.*")
    return r.withColumn("ts_unix_ms", F.coalesce(F.unix_millis(F.try_to_timestamp("timestamp")), F.lit(0).cast("bigint")))


def _file(*order: str) -> Window:
    return Window.partitionBy("file").orderBy(*(order or ("line",)))


def responses(records: DataFrame) -> DataFrame:
    """Assistant records with usage; of those that share message and request ids in a file the last. Records without an id all stay."""
    own = records.where("type = 'assistant' and message.usage is not null")
    key = F.when(F.col("message.id") != "", F.concat_ws("\0", "message.id", F.coalesce("requestId", F.lit("")))).otherwise(F.concat(F.lit("line "), F.col("line")))
    later = F.row_number().over(Window.partitionBy("file", "_key").orderBy(F.desc("line")))
    return own.withColumn("_key", key).withColumn("_r", later).where("_r = 1").drop("_key", "_r")


def turns(records: DataFrame) -> DataFrame:
    """One row a response, with its index and gap, in order of lines."""
    zero = lambda c: F.coalesce(F.col(f"message.usage.{c}"), F.lit(0).cast("bigint"))
    t = responses(records).select(
        "file", "line", "ts_unix_ms", F.col("message.id").alias("message_id"), F.col("message.model").alias("model"), "cwd",
        zero("input_tokens").alias("input_tokens"), zero("output_tokens").alias("output_tokens"), zero("cache_read_input_tokens").alias("cache_read"),
        zero("cache_creation.ephemeral_5m_input_tokens").alias("cache_create_5m"), zero("cache_creation.ephemeral_1h_input_tokens").alias("cache_create_1h"),
    )
    gap = F.greatest(F.lit(0).cast("bigint"), F.col("ts_unix_ms") - F.lag("ts_unix_ms").over(_file()))
    return t.withColumns({"turn_idx": (F.row_number().over(_file()) - 1).cast("bigint"), "gap_s": F.coalesce(gap, F.lit(0)).cast("double") / 1000.0})


def compactions(records: DataFrame) -> DataFrame:
    """Summaries of a compacted context, confirmed where the next turn's prefix is at most half of the one before.

    A boundary record fixes what was before; a summary without one stands for
    itself, and a summary that another follows before any turn does not count.
    """
    prefix = F.col("input_tokens") + F.col("cache_read") + F.col("cache_create_5m") + F.col("cache_create_1h")
    t = turns(records).select("file", "line", "ts_unix_ms", F.lit("turn").alias("kind"), prefix.alias("prefix"), F.lit(0).cast("bigint").alias("tokens"))
    kind = F.when((F.col("type") == "system") & (F.col("subtype") == "compact_boundary"), "boundary").when((F.col("type") == "user") & F.col("isCompactSummary"), "summary")
    m = records.select("file", "line", "ts_unix_ms", kind.alias("kind"), F.lit(None).cast("bigint").alias("prefix"), F.floor(F.octet_length(F.coalesce("message.content", F.lit(""))) / 4).cast("bigint").alias("tokens")).where("kind is not null")
    before = _file().rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c, w=before: F.last(c, ignorenulls=True).over(w)
    of = lambda k, c: F.when(F.col("kind") == k, F.col(c))
    s = t.unionByName(m).withColumns({"old": F.coalesce(last("prefix"), F.lit(0).cast("bigint")), "was": last(of("turn", "ts_unix_ms")), "b": last(of("boundary", "line")), "s": last(of("summary", "line"))})
    s = s.withColumn("bare", (F.col("kind") == "summary") & ~F.coalesce(F.col("b") > F.coalesce("s", F.lit(-1)), F.lit(False)))
    gap = F.when((F.col("ts_unix_ms") > 0) & F.col("was").isNotNull(), F.greatest(F.lit(0).cast("bigint"), F.col("ts_unix_ms") - F.col("was")))
    s = s.withColumn("mark", F.when((F.col("kind") == "boundary") | F.col("bare"), F.struct("ts_unix_ms", F.col("old").alias("prefix"), gap.alias("gap_ms"))))
    s = s.withColumn("mark", F.last("mark", ignorenulls=True).over(_file().rowsBetween(Window.unboundedPreceding, 0))).where("kind <> 'boundary'")
    nxt = lambda c: F.lead(c).over(_file())
    s = s.withColumns({"next": nxt("kind"), "now": nxt("prefix"), "base": nxt(F.col("mark.prefix"))}).where("kind = 'summary' and coalesce(next, '') <> 'summary'")
    reason = F.when(F.col("next").isNull(), "no_following_turn").when(F.col("base") <= 0, "no_baseline_prefix").when(1 - F.col("now") / F.col("base") >= SHRINK, "").otherwise("weak_shrink")
    state = F.when(F.col("mark.gap_ms").isNull(), "unknown").when(F.col("mark.gap_ms") > 3_600_000, "cold").when(F.col("mark.gap_ms") > 300_000, "warm_1h").otherwise("warm_5m")
    return s.select("file", "line", F.when(F.col("mark.ts_unix_ms") > 0, F.col("mark.ts_unix_ms")).otherwise(F.col("ts_unix_ms")).alias("ts_unix_ms"), F.col("mark.prefix").alias("prefix_tokens"), F.col("tokens").alias("summary_tokens"), state.alias("cache_state"), (reason == "").alias("confirmed"), reason.alias("reason"))


def quota_signals(records: DataFrame) -> DataFrame:
    """Refusals and switches of low priority, the last of equal (file, time, kind)."""
    before = _file().rowsBetween(Window.unboundedPreceding, -1)
    r = records.where("ts_unix_ms > 0")
    refused = F.col("quotaLimits").isNotNull() & (F.col("error") == "rate_limit")
    command = (F.col("type") == "system") & (F.col("subtype") == "local_command")
    asked = (F.col("type") == "user") & (F.regexp_extract(F.coalesce("message.content", F.lit("")), "<command-name>([^<]*)</command-name>", 1) == "/low-priority")
    reset = F.when(refused, F.coalesce(F.col("quotaLimits.resetsAt"), F.lit(0).cast("bigint")) * 1000).otherwise(F.lit(0).cast("bigint"))
    mark = lambda c, v: F.last(F.when(c, v), ignorenulls=True).over(before)
    r = r.withColumns({"_refused": F.coalesce(refused, F.lit(False)), "_command": F.coalesce(command, F.lit(False)), "_asked": F.coalesce(asked, F.lit(False)), "reset_ms": F.coalesce(reset, F.lit(0).cast("bigint"))})
    r = r.withColumns({"_due": mark(F.col("reset_ms") > 0, F.col("reset_ms")), "_toggle": F.coalesce(mark(F.col("_asked"), F.col("line")) > F.coalesce(mark(F.col("_command"), F.col("line")), F.lit(-1)), F.lit(False))})
    on = F.col("content").contains("at lower priority") & F.col("content").contains("Continuing")
    resumed = (F.col("queuePriority") == "later") & (F.col("origin.kind") == "auto-continuation")
    kind = (
        F.when(F.col("_refused"), "rate_limited").when(resumed, F.when(F.col("ts_unix_ms") < F.col("_due"), "low_priority_on"))
        .when(F.col("_command"), F.when(on, "low_priority_on").when(F.col("_toggle"), "low_priority_off"))
    )
    named = F.col("quotaLimits.rateLimitType")
    bucket = F.when(F.col("_refused"), F.coalesce(*[F.when(named == k, v) for k, v in LIMITS.items()], F.lit(""))).otherwise("")
    out = r.withColumn("kind", kind).where("kind is not null").withColumn("_r", F.row_number().over(Window.partitionBy("file", "ts_unix_ms", "kind").orderBy(F.desc("line")))).where("_r = 1")
    return out.select("file", "ts_unix_ms", "kind", bucket.alias("bucket"), "reset_ms", F.coalesce("quotaLimits.isUsingOverage", F.lit(False)).alias("using_overage"), F.coalesce("quotaLimits.lowPriorityOffer", F.lit("")).alias("offer"))


def plain(text: Column) -> Column:
    """Text without the blocks of TAGS (one that never closes runs to the end), white space as one space, at most PREVIEW characters."""
    for tag in TAGS:
        text = F.regexp_replace(F.regexp_replace(text, f"(?s)<{tag}[^>]*>.*?</{tag}>", ""), f"(?s)<{tag}[^>]*>.*", "")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(text) > PREVIEW, F.concat(F.rtrim(F.substring(text, 1, PREVIEW)), F.lit("…"))).otherwise(text)


def flat(content: Column) -> Column:
    """A message's content as text: the string itself, or its text blocks."""
    blocks = F.from_json(content, "array<struct<type: string, text: string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["text"].isNotNull()), lambda b: b["text"]), "\n")
    return F.when(content.startswith("["), F.coalesce(joined, content)).otherwise(content)


def human_prompts(records: DataFrame) -> DataFrame:
    """What a person typed: no meta, summary, sidechain or tool records; the first of equal (file, time)."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    own = records.where((F.col("type") == "user") & (F.col("userType") == "external") & no("isMeta") & no("isCompactSummary") & no("isSidechain") & F.col("toolUseResult").isNull() & (F.coalesce("sourceToolAssistantUUID", F.lit("")) == ""))
    own = own.withColumn("preview", plain(flat(F.col("message.content")))).where("preview <> '' and ts_unix_ms > 0")
    return own.withColumn("_r", F.row_number().over(Window.partitionBy("file", "ts_unix_ms").orderBy("line"))).where("_r = 1").select("file", "ts_unix_ms", "preview")


def delta_since(records: DataFrame, marks: DataFrame) -> DataFrame:
    """Per file what came after its watermark (marks: file, seen_ms; 0 where it has none): records, newest time, latest directory."""
    new = records.join(marks, "file", "left").where("ts_unix_ms > coalesce(seen_ms, 0)")
    at = F.struct("ts_unix_ms", "line")
    return new.groupBy("file").agg(F.count("*").alias("records"), F.max("ts_unix_ms").alias("max_ms"), F.max_by("cwd", F.when(F.coalesce("cwd", F.lit("")) != "", at)).alias("cwd"))


def extract(texts: DataFrame, rules: list[tuple[str, str, str, int, bool]], text: str = "text") -> DataFrame:
    """Columns by rules (name, 'int' or 'string', pattern, group, required) from a text column, and ``missing``: required names that found nothing."""
    got = {}
    for name, kind, pattern, group, _ in rules:
        found = F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
        got[name] = F.expr(f"try_cast(`_{name}` as bigint)") if kind == "int" else F.col(f"_{name}")
        texts = texts.withColumn(f"_{name}", found)
    missing = F.array_join(F.array_compact(F.array(*[F.when(got[n].isNull(), n) for n, *_, required in rules if required])), ",")
    return texts.withColumns({**got, "missing": missing}).drop(*[f"_{n}" for n in got])


#: Readings of a usage panel whose lines are joined by spaces.
PANEL = [
    ("session_pct", "int", r"Current session\s.*?(\d+)% used", 1, True),
    ("session_reset", "string", r"Current session\s.*?Resets ([^()%]+?) ?(?:\(|Current|$)", 1, False),
    ("session_zone", "string", r"Current session\s.*?Resets [^()%]*?\(([^()]+)\)", 1, False),
    ("week_pct", "int", r"Current week \(all models\)\s.*?(\d+)% used", 1, True),
    ("week_reset", "string", r"Current week \(all models\)\s.*?Resets ([^()%]+?) ?(?:\(|Current|$)", 1, False),
    ("week_zone", "string", r"Current week \(all models\)\s.*?Resets [^()%]*?\(([^()]+)\)", 1, False),
]


def panel_readings(panels: DataFrame, text: str = "text", now_ms: str = "ts_unix_ms") -> DataFrame:
    """panels with PANEL's fields, and the instants that the reset hints mean at ``now_ms``."""
    got = extract(panels, PANEL, text)
    return got.withColumns({f"{b}_reset_ms": reset_ms(F.col(f"{b}_reset"), F.col(f"{b}_zone"), F.col(now_ms)) for b in ("session", "week")})


def api_readings(answers: DataFrame, body: str = "body") -> DataFrame:
    """Percentages, halves rounded up, and resets at whole minutes, from a usage endpoint's JSON."""
    a = answers.withColumn("_a", F.from_json(body, "five_hour struct<utilization: double, resets_at: string>, seven_day struct<utilization: double, resets_at: string>"))
    pct = lambda c: F.round(f"_a.{c}.utilization").cast("bigint")
    at = lambda c: (F.round(F.unix_millis(F.try_to_timestamp(f"_a.{c}.resets_at")) / 60_000) * 60_000).cast("bigint")
    return a.withColumns({"session_pct": pct("five_hour"), "week_pct": pct("seven_day"), "session_reset_ms": at("five_hour"), "week_reset_ms": at("seven_day")}).drop("_a")
