"""SQL for DuckDB that gives the rows of the report queries, written from the rules."""

from . import sql

K = "tk AS (SELECT *, (input_tokens - 1) // 10 AS k FROM turns)"
NOW = "(SELECT max(ts_unix_ms) + 60000 FROM turns)"


def turns(body: str, more: str = "") -> str:
    return sql.turns(body, K + (", " + more if more else ""))


def flags(body: str, more: str = "", own_turns: bool = False) -> str:
    return sql.meter(body, ", ".join(x for x in (K if own_turns else "", more) if x), own_turns=own_turns)


FILES = """
p AS (
  SELECT CASE WHEN parent_session_uuid = '' THEN concat(project, '/', session_uuid, '.jsonl') ELSE concat(project, '/', parent_session_uuid, '/subagents/', session_uuid, '.jsonl') END AS path, ts_unix_ms, 100 AS b FROM tk
  UNION ALL SELECT concat(project, '/', session_uuid, '/subagents/workflows/w/', CASE WHEN k % 2 = 0 THEN concat('agent-', event_id, '.jsonl') ELSE 'journal.jsonl' END), ts_unix_ms, 100 FROM tk WHERE k % 17 = 0
  UNION ALL SELECT concat('odd/a/b/', event_id), ts_unix_ms, 10 FROM tk WHERE k = 5),
files AS (
  SELECT path, max(ts_unix_ms) AS mtime_ms, CAST(sum(b) AS BIGINT) AS bytes, CASE WHEN regexp_full_match(path, '[^/]+/[^/]+[.]jsonl') THEN 'top_level' WHEN path LIKE '%/journal.jsonl' THEN NULL
    WHEN path LIKE '%/workflows/%' THEN 'workflow_agent' WHEN path LIKE '%/subagents/%' THEN 'subagent' ELSE 'unrecognized' END AS shape,
    regexp_replace(split_part(path, '/', 2), '[.]jsonl$', '') AS key
  FROM p GROUP BY path)"""

COMPACT = """
cw AS (SELECT *, raw_tokens - output_tokens AS prefix, lag(raw_tokens - output_tokens) OVER w AS old, lag(ts_unix_ms) OVER w AS was FROM tk WINDOW w AS (PARTITION BY session_uuid ORDER BY turn_idx)),
comp AS (
  SELECT session_uuid AS file, turn_idx * 8 + 1 AS line, ts_unix_ms, coalesce(old, 0) AS prefix_tokens, k AS summary_tokens, turn_idx,
    CASE WHEN was IS NULL THEN 'unknown' WHEN ts_unix_ms - was > 3600000 THEN 'cold' WHEN ts_unix_ms - was > 300000 THEN 'warm_1h' ELSE 'warm_5m' END AS cache_state,
    coalesce(old, 0) > 0 AND prefix * 2 <= old AS confirmed,
    CASE WHEN coalesce(old, 0) = 0 THEN 'no_baseline_prefix' WHEN prefix * 2 <= old THEN '' ELSE 'weak_shrink' END AS reason
  FROM cw WHERE model = 'm-mid' AND k % 8 = 1)"""

SIGNALS = """
q0 AS (
  SELECT *, last_value(CASE WHEN k BETWEEN 90 AND 98 AND k % 5 > 0 THEN (ts_unix_ms // 1000 + 86400) * 1000 END IGNORE NULLS) OVER w AS due,
    max(CASE WHEN k = 88 THEN turn_idx END) OVER w AS asked, max(CASE WHEN k IN (86, 87) THEN turn_idx END) OVER w AS told
  FROM tk WHERE model = 'm-unpriced' WINDOW w AS (PARTITION BY session_uuid ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q1 AS (
  SELECT *, CASE WHEN k BETWEEN 90 AND 98 THEN 'rate_limited' WHEN k = 89 AND ts_unix_ms < due THEN 'low_priority_on' WHEN k = 87 THEN 'low_priority_on' WHEN k = 86 AND asked > coalesce(told, -1) THEN 'low_priority_off' END AS kind,
    k BETWEEN 90 AND 98 AS r FROM q0),
sig AS (
  SELECT session_uuid AS file, account_id, ts_unix_ms, kind, CASE WHEN r AND k % 3 = 0 THEN 'session' WHEN r AND k % 3 = 1 THEN 'week' ELSE '' END AS bucket,
    CASE WHEN r AND k % 5 > 0 THEN (ts_unix_ms // 1000 + 86400) * 1000 ELSE 0 END AS reset_ms, r AND k % 4 = 0 AS using_overage, CASE WHEN r AND k % 2 = 0 THEN 'treatment' ELSE '' END AS offer
  FROM q1 WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_uuid, ts_unix_ms, kind ORDER BY turn_idx DESC) = 1),
sw AS (SELECT account_id, file AS session_uuid, arg_max(kind, struct_pack(a := ts_unix_ms, b := kind)) AS kind, max(ts_unix_ms) AS since_ms FROM sig WHERE kind <> 'rate_limited' AND ts_unix_ms <= NOW GROUP BY 1, 2),
low AS (
  SELECT * FROM (
    SELECT account_id, session_uuid, since_ms, coalesce((SELECT arg_max(s.reset_ms, struct_pack(a := s.ts_unix_ms, b := s.reset_ms)) FROM sig s WHERE s.kind = 'rate_limited' AND s.account_id = sw.account_id AND s.reset_ms > 0 AND s.ts_unix_ms <= since_ms AND s.ts_unix_ms > since_ms - 18000000), since_ms + 18000000) AS until_ms
    FROM sw WHERE kind = 'low_priority_on') WHERE until_ms > NOW),
ver AS (
  SELECT coalesce(a.account_id, b.account_id) AS account_id, a.account_id IS NOT NULL AS refused, a.ts_unix_ms AS refused_ms, a.bucket, a.reset_ms, coalesce(a.using_overage, false) AS using_overage, coalesce(b.n, 0) AS low_priority_sessions, b.u AS low_until_ms
  FROM (SELECT * FROM sig WHERE kind = 'rate_limited' AND ts_unix_ms <= NOW AND CASE WHEN reset_ms > 0 THEN reset_ms > NOW ELSE ts_unix_ms > NOW - 18000000 END
        QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY ts_unix_ms DESC, reset_ms DESC, bucket DESC, using_overage DESC, offer DESC) = 1) a
  FULL JOIN (SELECT account_id, count(*) AS n, max(until_ms) AS u FROM low GROUP BY 1) b ON a.account_id = b.account_id)""".replace("NOW", "1705017600000")

INSIGHT = f"""
i0 AS (SELECT *, row_number() OVER (PARTITION BY session_uuid ORDER BY turn_idx DESC) AS r, CASE model WHEN 'm-large' THEN 10 WHEN 'm-mid' THEN 3 WHEN 'm-small' THEN 1 ELSE 5 END AS mult FROM turns),
i1 AS (
  SELECT session_uuid, count(*) AS turns, CAST(sum(raw_tokens) AS BIGINT) AS raw_tokens, ({NOW} - max(ts_unix_ms)) // 1000 AS age_s, CAST(sum(cw100) AS BIGINT) / 100.0::DOUBLE AS cw,
    CAST(sum(cw100) FILTER (WHERE r <= 3) AS BIGINT) / 100.0::DOUBLE AS cw3, max(cw100) FILTER (WHERE r = 1) / 100.0::DOUBLE AS last_cw,
    CASE WHEN max(cache_create_1h) FILTER (WHERE r = 1) > 0 THEN 3600 WHEN max(cache_create_5m) FILTER (WHERE r = 1) > 0 THEN 300 WHEN sum(cache_create_1h) > 0 AND sum(cache_create_5m) > 0 THEN 0 WHEN sum(cache_create_1h) > 0 THEN 3600 WHEN sum(cache_create_5m) > 0 THEN 300 ELSE 0 END AS ttl_s,
    max(raw_tokens * mult) FILTER (WHERE r = 1) AS cold
  FROM i0 GROUP BY 1),
i2 AS (SELECT *, round(cw / turns, 2) AS avg_cw, round(cw3 / least(turns, 3), 2) AS recent_cw, ttl_s > 0 AND age_s >= ttl_s AS expired FROM i1),
insight AS (
  SELECT session_uuid, turns, raw_tokens, age_s, CAST(ttl_s AS BIGINT) AS ttl_s, cw AS cw_tokens, avg_cw, recent_cw, last_cw, CASE WHEN expired THEN cold * CASE WHEN ttl_s = 3600 THEN 40 ELSE 25 END / 100.0::DOUBLE END AS cold_resume_cw,
    CASE WHEN NOT expired AND ttl_s > 0 AND ttl_s - age_s <= ttl_s // 5 THEN ttl_s - age_s END AS expires_in_s,
    CASE WHEN turns < 5 OR avg_cw = 0 OR recent_cw = 0 THEN '' WHEN recent_cw / avg_cw >= 2 THEN 'compact' WHEN recent_cw / avg_cw >= 1.5 THEN 'watch' ELSE 'ok' END AS recommendation
  FROM i2)"""

LEARN = f"""
cp AS (SELECT row_number() OVER () AS p, * FROM ({sql.QUERIES["calibration_points"]}) WHERE bucket = 'session' AND delta >= 5),
solo AS (SELECT ts_unix_ms, tw20, ['m-large', 'm-base', 'm-mid', 'm-small', 'm-unpriced'][CAST(ts_unix_ms // 18000000 % 5 + 1 AS INT)] AS model FROM turns),
each AS (SELECT p, delta, model, sum(tw20) AS c FROM cp JOIN solo t ON t.ts_unix_ms > a_ms AND t.ts_unix_ms <= b_ms GROUP BY 1, 2, 3),
pure AS (SELECT * FROM (SELECT *, sum(c) OVER (PARTITION BY p) AS a FROM each) WHERE a > 0 AND c >= 0.9 * a),
s AS (SELECT model, count(*) AS samples, quantile_cont(CAST(a AS BIGINT) / 20.0::DOUBLE / delta, 0.5) AS x FROM pure GROUP BY 1),
learned AS (SELECT model, samples, round(x, 2) AS tokens_per_pct, CASE WHEN samples >= 8 AND x > 0 THEN round((SELECT x FROM s WHERE model = 'm-base' AND samples >= 8) / x, 2) END AS weight FROM s)"""

LOGINS = "l AS (SELECT concat('/c/', event_id % 4) AS config_dir, account_id, ts_unix_ms, event_id FROM turns WHERE event_id % 40 < 4)"
LATEST = "lat AS (SELECT * FROM flags WHERE pct IS NOT NULL QUALIFY row_number() OVER (PARTITION BY account_id, bucket ORDER BY ts_unix_ms DESC, id DESC) = 1)"
BUDGETS = "b(cwd, allowance) AS (VALUES ('/w/0/0', 5::BIGINT), ('/w/1/1', 6), ('/w/none', 7), ('/w/3/0', 8))"
LEVELS = "lv AS (SELECT cwd, arg_max(model, struct_pack(a := ts_unix_ms, b := event_id)) AS state FROM turns WHERE cwd <> '' GROUP BY 1)"
KIND = "CASE model WHEN 'm-large' THEN 'click' WHEN 'm-base' THEN 'view' WHEN 'm-mid' THEN 'purchase' WHEN 'm-small' THEN 'signup' ELSE 'error' END"
SAID = """
an AS (SELECT event_id, ts_unix_ms, CASE WHEN k % 2 = 1 THEN '' ELSE session_uuid END AS session_uuid, ['budget', 'limit_projection', 'saturation', 'recommendation', 'cache'][CAST(k % 5 + 1 AS INT)] AS kind,
  ['tight', 'exceeded', 'projected', 'saturated', 'compact', 'expiring', 'clear'][CAST(event_id % 7 + 1 AS INT)] AS state, CASE WHEN k % 3 > 0 THEN k * 600000 END AS ahead FROM tk),
said AS (SELECT * FROM an WHERE (kind, state) IN (('budget', 'tight'), ('budget', 'exceeded'), ('saturation', 'saturated'), ('recommendation', 'compact'), ('cache', 'expiring')) OR (kind = 'limit_projection' AND state = 'projected' AND coalesce(ahead <= 21600000, true)))"""
LOOPS = f"""
lr AS (SELECT session_uuid, concat('auto-', substring(sha256(cwd), 1, 8)) AS loop_key, cwd AS text, CASE WHEN k % 9 = 0 THEN 'done' ELSE 'open' END AS status, CASE WHEN k % 31 = 0 AND CAST(substr(session_uuid, 2) AS INTEGER) % 3 = 0 THEN 'dismissed' END AS us, ts_unix_ms AS t, event_id AS e FROM tk WHERE cwd <> ''),
lo AS (
  SELECT session_uuid, loop_key, text, status, first_ms, last_ms FROM (
    SELECT session_uuid, loop_key, text, first_ms, last_ms, CASE WHEN u IS NOT NULL THEN u WHEN s = 'open' AND last_ms < {NOW} - 604800000 THEN 'stale' ELSE s END AS status
    FROM (SELECT session_uuid, loop_key, arg_max(text, struct_pack(a := t, b := e)) AS text, arg_max(status, struct_pack(a := t, b := e)) AS s, arg_max(us, struct_pack(a := t, b := e)) FILTER (WHERE us IS NOT NULL) AS u, min(t) AS first_ms, max(t) AS last_ms FROM lr GROUP BY 1, 2))
  WHERE status NOT IN ('done', 'dismissed', 'stale'))"""

_ZONED = "timezone(CASE WHEN {0}_zone = 'Nowhere/Land' THEN 'UTC' ELSE {0}_zone END, {1})"
_LOCAL = "timezone(CASE WHEN {0}_zone = 'Nowhere/Land' THEN 'UTC' ELSE {0}_zone END, make_timestamp(ts * 1000) AT TIME ZONE 'UTC')"


def _reset(b: str) -> str:
    """Milliseconds of a generated hint: its month, day, hour and minute stand in the list hints."""
    day = f"CASE WHEN {b}_mon IS NULL THEN CAST({_LOCAL.format(b)} AS DATE) ELSE make_date(CAST(year({_LOCAL.format(b)}) AS BIGINT), {b}_mon, 1) + CAST({b}_day - 1 AS INTEGER) END"
    clock = f"to_minutes({b}_min)"
    later = f"CASE WHEN {b}_mon IS NULL THEN ({day}) + 1 ELSE make_date(year({day}) + 1, month({day}), 1) + CAST(day({day}) - 1 AS INTEGER) END"
    ms = lambda d: f"epoch_ms({_ZONED.format(b, f'CAST({d} AS TIMESTAMP) + {clock}')})"
    return f"CASE WHEN {b}_min IS NOT NULL THEN CASE WHEN {ms(day)} < ts THEN {ms(later)} ELSE {ms(day)} END END"


PANELS = """
hints AS (SELECT * FROM (VALUES (0, '2am', NULL, NULL, 120), (1, '10:50am', NULL, NULL, 650), (2, 'May1,1am', 5, 1, 60), (3, 'Feb 29, 12pm', 2, 29, 720), (4, '15:04', NULL, NULL, 904), (5, 'Jan5,23:59', 1, 5, 1439),
  (6, 'Mar31,2:30am', 3, 31, 150), (7, '12am', NULL, NULL, 0), (8, 'Oct 27, 3:15am', 10, 27, 195), (9, 'soon', NULL, NULL, NULL)) h(n, hint, mon, dy, mins)),
zones AS (SELECT * FROM (VALUES (0, 'UTC'), (1, 'Europe/Copenhagen'), (2, 'America/Los_Angeles'), (3, 'Asia/Kolkata'), (4, 'Nowhere/Land')) z(n, zone)),
seen AS (SELECT id, max(ts) AS ts, max(pct) FILTER (WHERE bucket = 'session') AS session_pct, max(pct) FILTER (WHERE bucket = 'week') AS week_pct FROM meter GROUP BY 1),
panels AS (
  SELECT seen.*, a.hint AS session_reset, a.mon AS session_mon, a.dy AS session_day, a.mins AS session_min, b.zone AS session_zone, c.hint AS week_reset, c.mon AS week_mon, c.dy AS week_day, c.mins AS week_min, d.zone AS week_zone
  FROM seen LEFT JOIN hints a ON session_pct IS NOT NULL AND a.n = id // 8 % 10 LEFT JOIN zones b ON session_pct IS NOT NULL AND b.n = id // 80 % 5
    LEFT JOIN hints c ON session_pct IS NOT NULL AND c.n = id // 16 % 10 LEFT JOIN zones d ON session_pct IS NOT NULL AND d.n = id // 8 % 5)"""
PANEL_BODY = f"""SELECT id, session_pct, session_reset, session_zone, {_reset('session')} AS session_reset_ms, week_pct, week_reset, week_zone, {_reset('week')} AS week_reset_ms,
  CASE WHEN session_pct IS NULL THEN 'session_pct,week_pct' ELSE '' END AS missing FROM panels"""

QUERIES = {
    "path_shapes": turns("SELECT shape, count(*) AS files FROM files GROUP BY 1", FILES),
    "mtime_gate": turns("SELECT path, mtime_ms FROM files WHERE (bytes >= 5000 OR shape <> 'top_level') AND mtime_ms % 2 = 1", FILES),
    "excluded_sessions": turns("SELECT DISTINCT session_uuid, coalesce(nullif(parent_session_uuid, ''), session_uuid) AS owner FROM turns WHERE session_uuid NOT IN ('s1', 's17', 's3') AND parent_session_uuid NOT IN ('s1', 's17', 's3')"),
    "coverage": turns(
        "SELECT s.shape, count(path) AS on_disk, count(*) FILTER (WHERE st = 'i') AS ingested, count(*) FILTER (WHERE st = 's') AS skipped, count(*) FILTER (WHERE st = 'm') AS missing FROM (VALUES ('top_level'), ('subagent'), ('workflow_agent'), ('unrecognized')) s(shape) "
        "LEFT JOIN (SELECT *, CASE WHEN mtime_ms % 2 = 0 THEN 'i' WHEN key IN ('s1', 's17', 's3') OR (shape = 'top_level' AND bytes < 5000) THEN 's' ELSE 'm' END AS st FROM files) f ON f.shape = s.shape GROUP BY 1",
        FILES,
    ),
    "panel_extract": sql.meter(PANEL_BODY, PANELS),
    "api_reading": sql.meter("SELECT id, s + 1 AS session_pct, w + 1 AS week_pct, (a + 60000) // 60000 * 60000 AS session_reset_ms, (b + 60000) // 60000 * 60000 AS week_reset_ms FROM (SELECT id, max(pct) FILTER (WHERE bucket = 'session') AS s, max(pct) FILTER (WHERE bucket = 'week') AS w, max(rst) FILTER (WHERE bucket = 'session') AS a, max(rst) FILTER (WHERE bucket = 'week') AS b FROM meter GROUP BY 1)"),
    "transcript_turns": turns("SELECT session_uuid AS file, ts_unix_ms, concat('m', event_id) AS message_id, model, cwd, input_tokens, output_tokens, cache_read, cache_create_5m, cache_create_1h, turn_idx, gap_s FROM turns"),
    "dedupe_responses": turns("SELECT session_uuid AS file, concat('m', event_id) AS message_id, output_tokens FROM turns"),
    "human_prompts": turns("SELECT session_uuid AS file, ts_unix_ms, concat('ask ', k, CASE WHEN k % 2 = 0 THEN ' twice' ELSE '' END) AS preview FROM tk WHERE model = 'm-small' QUALIFY row_number() OVER (PARTITION BY session_uuid, ts_unix_ms ORDER BY turn_idx) = 1"),
    "compaction_confirm": turns("SELECT * EXCLUDE (turn_idx) FROM comp", COMPACT),
    "compactions_summary": turns("SELECT cache_state, count(*) AS n, CAST(sum(prefix_tokens) AS BIGINT) AS prefix_tokens, CAST(sum(summary_tokens) AS BIGINT) AS summary_tokens FROM comp WHERE confirmed GROUP BY 1", COMPACT),
    "cold_waste": turns("SELECT count(*) AS n, CAST(coalesce(sum(prefix_tokens), 0) AS BIGINT) AS tokens FROM comp WHERE confirmed AND cache_state = 'cold'", COMPACT),
    "quota_signals": turns("SELECT file, ts_unix_ms, kind, bucket, reset_ms, using_overage, offer FROM sig", SIGNALS),
    "quota_low_priority": turns("SELECT * FROM low", SIGNALS),
    "quota_verdict": turns("SELECT * FROM ver", SIGNALS),
    "cap_state": turns("SELECT account_id, meter, CASE WHEN coalesce(nullif(bucket, ''), 'session') <> meter THEN '' WHEN low_priority_sessions > 0 THEN 'low_priority' WHEN using_overage THEN 'extra_usage' ELSE 'refused' END AS state FROM ver, (VALUES ('session'), ('week')) m(meter)", SIGNALS),
    "delta_since": turns(
        "SELECT session_uuid AS file, CAST(sum(n) AS BIGINT) AS records, max(ts_unix_ms) AS max_ms, arg_max(cwd, turn_idx) FILTER (WHERE cwd <> '') AS cwd FROM d WHERE ts_unix_ms > s GROUP BY 1",
        "d AS (SELECT *, 1 + (k % 3 = 0)::INT + (model = 'm-mid' AND k % 4 = 1)::INT + (model = 'm-mid' AND k % 8 = 1)::INT + (model = 'm-small')::INT + (model = 'm-unpriced' AND k BETWEEN 86 AND 98)::INT AS n, CASE WHEN account_id < 3 THEN first_value(ts_unix_ms) OVER (PARTITION BY session_uuid ORDER BY turn_idx) + 432000000 ELSE 0 END AS s FROM tk)",
    ),
    "now_state": sql.meter(
        "SELECT account_id, arg_max(ok, n) AS ok, max(ts) AS polled_ms, max(ts) FILTER (WHERE ok) AS read_ms, arg_max(s, n) FILTER (WHERE ok) AS session_pct, arg_max(w, n) FILTER (WHERE ok) AS week_pct, NOT arg_max(ok, n) AND bool_or(ok) AS stale FROM o GROUP BY 1",
        "o AS (SELECT a.account_id, a.ts, a.n, a.pct AS s, b.pct AS w, a.pct IS NOT NULL AND b.pct IS NOT NULL AS ok FROM mn a JOIN mn b ON a.id = b.id AND a.bucket = 'session' AND b.bucket = 'week')",
    ),
    "now_history": flags("SELECT id, account_id, bucket, ts_unix_ms, pct FROM (SELECT *, max(ts_unix_ms) OVER (PARTITION BY account_id) AS m FROM flags) WHERE ts_unix_ms BETWEEN m - 86400000 AND m"),
    "pct_since_reset": flags("SELECT account_id, bucket, s AS since_ms, max(pct) AS max_pct FROM (SELECT *, coalesce(max(ts_unix_ms) FILTER (WHERE reset_detected) OVER (PARTITION BY account_id, bucket), 0) AS s FROM flags) WHERE valid AND ts_unix_ms >= s GROUP BY 1, 2, 3"),
    "status_line": flags(
        "SELECT account_id, bucket, pct, CASE WHEN pct >= 90 THEN 'critical' WHEN pct >= 70 THEN 'high' WHEN pct >= 40 THEN 'medium' ELSE 'low' END AS band, CASE WHEN d IS NULL OR d <= 0 THEN '' WHEN d < 60000 THEN concat(d // 1000, 's') WHEN d < 3600000 THEN concat(d // 60000, 'm') "
        "WHEN d < 86400000 THEN concat(d // 3600000, 'h', CASE WHEN d // 60000 % 60 > 0 THEN concat(d // 60000 % 60, 'm') ELSE '' END) ELSE concat(d // 86400000, 'd', CASE WHEN d // 3600000 % 24 > 0 THEN concat(d // 3600000 % 24, 'h') ELSE '' END) END AS resets_in FROM (SELECT *, reset_ms - ts_unix_ms AS d FROM lat)",
        LATEST,
    ),
    "session_insight": turns("SELECT * FROM insight", INSIGHT),
    "sensor_session": turns("SELECT 'cache' AS kind, session_uuid, CASE WHEN cold_resume_cw > 0 THEN 'expired' WHEN expires_in_s > 0 THEN 'expiring' ELSE 'warm' END AS state FROM insight WHERE ttl_s > 0 UNION ALL SELECT 'recommendation', session_uuid, recommendation FROM insight WHERE recommendation <> ''", INSIGHT),
    "turns_since_compact": turns("SELECT session_uuid, count(*) FILTER (WHERE turn_idx > coalesce(m, -1)) AS turns_since FROM turns LEFT JOIN (SELECT file, max(turn_idx) AS m FROM comp GROUP BY 1) ON file = session_uuid GROUP BY 1", COMPACT),
    "learn_weights": turns("SELECT * FROM learned", LEARN),
    "weights_report": turns("SELECT model, coalesce(samples, 0) AS samples, tokens_per_pct, weight, w AS list_weight, model = 'm-base' AS is_baseline, coalesce(abs(weight - w) / w > 0.25, false) AS diverges FROM (SELECT DISTINCT model, m5 / 5.0::DOUBLE AS w FROM turns) LEFT JOIN learned USING (model)", LEARN),
    "maxed_per_week": f"WITH cp AS ({sql.QUERIES['calibration_points']}), m AS (SELECT account_id, bucket, round(quantile_cont(cw_per_pct, 0.5), 6) AS x FROM (SELECT *, row_number() OVER (PARTITION BY account_id, bucket ORDER BY b_ms DESC, a_ms DESC) AS r FROM cp) WHERE r <= 50 GROUP BY 1, 2) SELECT a.account_id, round(a.x / b.x, 4) AS sessions_per_week FROM m a JOIN m b ON a.account_id = b.account_id AND a.bucket = 'week' AND b.bucket = 'session'",
    "nearest_price": turns(
        "SELECT event_id, CASE WHEN a.ts_unix_ms IS NOT NULL AND (b.ts_unix_ms IS NULL OR t.ts_unix_ms - a.ts_unix_ms <= b.ts_unix_ms - t.ts_unix_ms) THEN a.price ELSE b.price END AS price FROM tk t ASOF LEFT JOIN p a ON a.account_id = t.account_id AND t.ts_unix_ms >= a.ts_unix_ms ASOF LEFT JOIN p b ON b.account_id = t.account_id AND t.ts_unix_ms <= b.ts_unix_ms",
        "p AS (SELECT account_id, ts_unix_ms, min(k) AS price FROM tk WHERE k % 17 = 0 GROUP BY 1, 2)",
    ),
    "accounts_view": turns(
        "SELECT account_id, count(*) AS turns, coalesce(bool_or(event_id % 8 = 0), false) AS metered, coalesce((SELECT string_agg(DISTINCT config_dir, ',' ORDER BY config_dir) FROM (SELECT *, lag(account_id) OVER (PARTITION BY config_dir ORDER BY ts_unix_ms, event_id) AS b FROM l) x WHERE x.account_id = t.account_id AND (b IS NULL OR b <> x.account_id)), '') AS dirs FROM turns t GROUP BY 1",
        LOGINS,
    ),
    "current_logins": turns("SELECT config_dir, arg_max(account_id, struct_pack(a := ts_unix_ms, b := event_id)) AS account_id FROM l GROUP BY 1", LOGINS),
    "budget_rules": turns(
        "SELECT event_id, CASE WHEN f THEN s ELSE m END AS state, CASE WHEN (CASE WHEN f THEN s ELSE m END) IN ('clear', 'unknown') THEN '' WHEN f THEN 'spend' ELSE 'meter' END AS rule FROM r1",
        "r0 AS (SELECT event_id, CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN 'unknown' WHEN k % 60 >= 40 THEN 'exceeded' WHEN k % 60 >= 30 THEN 'tight' ELSE 'clear' END AS s, CASE WHEN k % 3 = 0 THEN 'unknown' WHEN k >= 90 THEN 'exceeded' WHEN k >= 67.5 THEN 'tight' ELSE 'clear' END AS m FROM tk), r1 AS (SELECT *, list_position(['unknown', 'clear', 'tight', 'exceeded'], s) >= list_position(['unknown', 'clear', 'tight', 'exceeded'], m) AND s <> 'unknown' AS f FROM r0)",
    ),
    "budget_lifecycle": turns(
        "SELECT cwd, arg_max(action, struct_pack(a := ts_unix_ms, b := event_id)) AS last_action, arg_max(k, struct_pack(a := ts_unix_ms, b := event_id)) FILTER (WHERE action = 'set') AS allowance, count(*) AS changes, arg_max(action, struct_pack(a := ts_unix_ms, b := event_id)) = 'set' AS live FROM g GROUP BY 1",
        "g AS (SELECT *, ['set', 'revoke', 'settle'][CAST(event_id % 3 + 1 AS INT)] AS action FROM tk WHERE cwd <> '')",
    ),
    "budgets_with_level": turns("SELECT b.cwd, allowance, state FROM b LEFT JOIN lv ON b.cwd = lv.cwd", f"{BUDGETS}, {LEVELS}"),
    "orphan_levels": turns("SELECT cwd, state FROM lv WHERE cwd NOT IN (SELECT cwd FROM b)", f"{BUDGETS}, {LEVELS}"),
    "prune_by_cwd": turns("SELECT event_id, cwd FROM turns WHERE cwd IN (SELECT cwd FROM b)", BUDGETS),
    "hook_matches": turns(f"SELECT 1::BIGINT AS hook_id, min(event_id) AS event_id FROM turns WHERE {KIND} LIKE 'c%' AND event_id > 10 AND ts_unix_ms <= 1704067200000 + 86400000 HAVING count(*) > 0 UNION ALL SELECT 2, min(event_id) FROM turns WHERE {KIND} LIKE '%i_w' AND event_id > 300 AND ts_unix_ms <= 1704067200000 + 20 * 86400000 HAVING count(*) > 0"),
    "event_retention": turns("SELECT event_id FROM turns WHERE ts_unix_ms >= 1704067200000 + 14 * 86400000 OR event_id >= 300"),
    "announce_filter": turns("SELECT event_id, kind, state FROM said", SAID),
    "announce_cap": turns("SELECT event_id, session_uuid FROM said WHERE session_uuid <> '' UNION ALL (SELECT event_id, session_uuid FROM said WHERE session_uuid = '' ORDER BY event_id DESC LIMIT 3)", SAID),
    "wakeup_outcomes": flags(
        f"SELECT promise_id, session_uuid, bucket, CASE WHEN nx IS NOT NULL THEN 'superseded' WHEN e < due THEN 'early' WHEN due < {NOW} - 86400000 THEN 'expired' WHEN due <= {NOW} THEN 'due' ELSE 'pending' END AS outcome FROM (SELECT *, (SELECT min(f.ts_unix_ms) FROM flags f WHERE f.reset_detected AND f.account_id = pr.account_id AND f.bucket = pr.bucket AND f.ts_unix_ms >= pr.created) AS e, lead(promise_id) OVER (PARTITION BY session_uuid, bucket ORDER BY created, promise_id) AS nx FROM pr)",
        "pr AS (SELECT event_id AS promise_id, session_uuid, account_id, CASE WHEN k % 2 = 0 THEN 'week' ELSE 'session' END AS bucket, ts_unix_ms AS created, CASE WHEN k % 2 = 0 THEN (ts_unix_ms // 604800000 + 1) * 604800000 ELSE (ts_unix_ms // 18000000 + 1) * 18000000 END AS due FROM tk)",
        own_turns=True,
    ),
    "trail_open_loops": turns("SELECT * FROM lo", LOOPS),
    "trail_view": turns("SELECT t.session_uuid, last_ms, coalesce(n, 0) AS open_loops, coalesce(x, '') AS texts FROM (SELECT session_uuid, max(ts_unix_ms) AS last_ms FROM turns GROUP BY 1) t LEFT JOIN (SELECT session_uuid, count(*) AS n, string_agg(DISTINCT text, ',' ORDER BY text) AS x FROM lo GROUP BY 1) l ON l.session_uuid = t.session_uuid", LOOPS),
    "admission_gate": turns("SELECT event_id, CASE WHEN k % 11 = 0 THEN 'no inbox' WHEN k % 7 = 0 THEN 'unreachable' WHEN k % 3 = 0 THEN 'at rest' WHEN k % 13 = 0 OR k * 20000 > 900000 THEN 'stale status' WHEN k % 4 = 0 THEN 'cache cold' ELSE '' END AS skip FROM tk"),
    "deadline_phrases": turns(
        "SELECT event_id, CASE WHEN d >= 86400000 AND date_diff('day', epoch_ms(ts_unix_ms), named) BETWEEN 1 AND 6 THEN 'on ' || lower(strftime(named, '%a')) || CASE WHEN bare THEN '' ELSE strftime(epoch_ms(a), ' %H:%M') END "
        "WHEN d < 60000 THEN concat('in ', d // 1000, 's') WHEN d < 3600000 THEN concat('in ', d // 60000, 'm') WHEN d < 86400000 THEN concat('in ', d // 3600000, 'h', CASE WHEN d % 3600000 >= 60000 THEN concat(d % 3600000 // 60000, 'm') ELSE '' END) "
        "ELSE concat('in ', d // 86400000, 'd', CASE WHEN d % 86400000 >= 3600000 THEN concat(d % 86400000 // 3600000, 'h') ELSE '' END) END AS phrase "
        "FROM (SELECT *, hour(epoch_ms(a)) < 3 OR a % 86400000 IN (10800000) OR hour(epoch_ms(a)) >= 21 AS bare, CASE WHEN hour(epoch_ms(a)) >= 21 THEN epoch_ms(a + 10800000) ELSE epoch_ms(a) END AS named FROM (SELECT *, k * 7000000 AS d, ts_unix_ms + k * 7000000 AS a FROM tk))"
    ),
    "until_leases": turns(
        "SELECT event_id, CASE WHEN i < 2 THEN 'manual' WHEN w IN ('session', 'week') THEN 'window_reset' WHEN due > now THEN 'deadline' END AS kind, CASE WHEN w IN ('session', 'week') THEN w ELSE '' END AS bucket, CASE WHEN due > now THEN due END AS at_ms, "
        "CASE WHEN w = 'session' AND k % 3 > 0 AND k > 20 THEN now + (k - 20) * 60000 WHEN w = 'week' AND k > 0 THEN now + k * 3600000 END AS window_end_ms, CASE WHEN w IN ('session', 'week') THEN now END AS bound_after_ms, "
        "CASE WHEN w = 'other' THEN 'bucket' WHEN i IN (12, 16, 17) THEN 'unreadable' WHEN due <= now THEN 'passed' ELSE '' END AS problem FROM u",
        "u AS (SELECT *, CASE i WHEN 2 THEN CASE WHEN k % 7 = 0 THEN 'other' WHEN k % 2 = 0 THEN 'week' ELSE 'session' END WHEN 3 THEN 'session' WHEN 4 THEN 'week' END AS w, "
        "CASE WHEN i = 5 THEN now + 7200000 WHEN i IN (6, 7, 8) THEN now + 5400000 WHEN i = 9 THEN now WHEN i = 10 THEN day + 64800000 + CASE WHEN now - day >= 64800000 THEN 86400000 ELSE 0 END WHEN i = 11 THEN day + 25530000 + CASE WHEN now - day >= 25530000 THEN 86400000 ELSE 0 END "
        "WHEN i = 13 THEN epoch_ms(TIMESTAMP '2024-01-20 00:00:00') WHEN i = 14 THEN epoch_ms(TIMESTAMP '2023-12-31 00:00:00') WHEN i = 15 THEN epoch_ms(TIMESTAMP '2024-01-20 06:30:00') END AS due "
        "FROM (SELECT event_id, k, event_id % 18 AS i, ts_unix_ms AS now, ts_unix_ms - ts_unix_ms % 86400000 AS day FROM tk))",
    ),
    "text_functions": turns(
        "SELECT event_id, concat('auto-', substring(sha256(cwd), 1, 8)) AS loop_key, split_part(cwd, '/', 4) AS base, strftime(make_timestamp(ts_unix_ms * 1000), '%Y-%m-%dT%H:%M:%SZ') AS stamp, "
        "CASE WHEN s < 60 THEN concat(s, 's') WHEN s < 3600 THEN concat(s // 60, 'm') WHEN s < 86400 THEN concat(s // 3600, 'h', CASE WHEN s // 60 % 60 > 0 THEN concat(s // 60 % 60, 'm') ELSE '' END) ELSE concat(s // 86400, 'd', CASE WHEN s // 3600 % 24 > 0 THEN concat(s // 3600 % 24, 'h') ELSE '' END) END AS took, "
        "CASE WHEN raw_tokens < 1000 THEN CAST(raw_tokens AS VARCHAR) WHEN raw_tokens < 1000000 THEN concat((raw_tokens + 50) // 1000, '.', (raw_tokens + 50) % 1000 // 100, 'k') ELSE 'M' END AS short, CASE WHEN k >= 90 THEN 'critical' WHEN k >= 70 THEN 'high' WHEN k >= 40 THEN 'medium' ELSE 'low' END AS band FROM (SELECT *, k * k * event_id * 37 // 1000 AS s FROM tk)"
    ),
}

POINTS = """
pt AS (SELECT *, row_number() OVER (PARTITION BY account_id, bucket ORDER BY ts_unix_ms DESC, id DESC) AS r, max(ts_unix_ms) OVER (PARTITION BY account_id, bucket) AS e
  FROM (SELECT *, coalesce(max(ts_unix_ms) FILTER (WHERE reset_detected) OVER (PARTITION BY account_id, bucket), 0) AS s FROM flags) WHERE pct IS NOT NULL AND valid AND NOT saturated AND ts_unix_ms >= s),
pu AS (SELECT * FROM (SELECT *, count(*) FILTER (WHERE ts_unix_ms >= e - 3600000) OVER (PARTITION BY account_id, bucket) AS c FROM pt) WHERE CASE WHEN c >= 2 THEN ts_unix_ms >= e - 3600000 ELSE r <= 2 END),
bn AS (SELECT account_id, bucket, max(ts_unix_ms) AS ts_unix_ms, arg_min(pct, r) AS pct, round((arg_min(pct, r) - arg_max(pct, r))::DOUBLE / ((max(ts_unix_ms) - min(ts_unix_ms)) / 3600000.0::DOUBLE), 6) AS pct_per_hour FROM pu GROUP BY 1, 2 HAVING max(ts_unix_ms) > min(ts_unix_ms))"""

#: The walk of the limit windows: the reset in force, the window's number and its start.
WALK = """
u AS (SELECT *, CASE WHEN reset_ms BETWEEN ts_unix_ms AND ts_unix_ms + CASE bucket WHEN 'week' THEN 691200000 ELSE 21600000 END THEN reset_ms END AS ok, CASE bucket WHEN 'week' THEN 172800000 ELSE 14400000 END AS gap FROM flags),
walk AS (
  SELECT account_id, bucket, n, ok AS due, 0::BIGINT AS win, ts_unix_ms AS start FROM u WHERE n = 1
  UNION ALL
  SELECT u.account_id, u.bucket, u.n, CASE WHEN due IS NULL OR ok > due + gap THEN coalesce(ok, due) ELSE due END, win + coalesce(ok > due + gap, false)::BIGINT, CASE WHEN ok > due + gap THEN least(greatest(due, start + 1), ts_unix_ms) ELSE start END
  FROM walk w JOIN u ON u.account_id = w.account_id AND u.bucket = w.bucket AND u.n = w.n + 1),
placed AS (SELECT u.*, win, start FROM u JOIN walk USING (account_id, bucket, n))"""

SLICES = """
pair AS (SELECT a.account_id, a.win AS week, b.win AS session, a.ts_unix_ms AS t, CASE WHEN a.pct IS NOT NULL AND a.valid AND NOT a.saturated THEN least(a.pct, 100) END AS v FROM placed a JOIN placed b ON a.id = b.id AND a.bucket = 'week' AND b.bucket = 'session'),
sl AS (SELECT account_id, week, session, min(t) AS start_ms, max(t) AS end_ms, max(v) AS top, arg_min(v, t) FILTER (WHERE v IS NOT NULL) AS opens FROM pair GROUP BY 1, 2, 3),
sc AS (SELECT *, greatest(0, top - coalesce(max(top) OVER (PARTITION BY account_id, week ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CASE WHEN week = 0 THEN opens ELSE 0 END)) AS cost FROM sl),
slices AS (SELECT account_id, week, session, start_ms, end_ms, cost::DOUBLE AS week_pct FROM sc WHERE cost > 0)"""

QUERIES |= {
    "calibration_median": f"SELECT account_id, bucket, count(*) AS points, round(quantile_cont(cw_per_pct, 0.5), 6) AS median_cw_per_pct FROM (SELECT *, row_number() OVER (PARTITION BY account_id, bucket ORDER BY b_ms DESC, a_ms DESC) AS r FROM ({sql.QUERIES['calibration_points']})) WHERE r <= 50 GROUP BY 1, 2",
    "burn_now": flags("SELECT * FROM bn", POINTS),
    "limit_projection": flags(
        "SELECT account_id, bucket, pct, pct_per_hour, round(eta, 6) AS eta_hours FROM (SELECT *, span - ttr AS passed FROM lp) WHERE pct_per_hour > 0.05 AND pct < 100 AND (reset_ms IS NULL OR (eta < ttr AND (span <= ttr OR pct * span / (span - ttr) >= 110) AND eta <= 3 * greatest(passed, 1)))",
        POINTS.replace("FROM flags)", "FROM flags WHERE ts_unix_ms <= 1704451320000)")
        + ", lr AS (SELECT account_id, bucket, arg_max(reset_ms, n) AS reset_ms FROM flags WHERE ts_unix_ms <= 1704451320000 AND reset_ms IS NOT NULL GROUP BY 1, 2), lp AS (SELECT *, CASE bucket WHEN 'week' THEN 168.0::DOUBLE ELSE 5.0 END AS span, greatest(0, (reset_ms - ts_unix_ms) / 3600000.0::DOUBLE) AS ttr, (100 - pct) / nullif(pct_per_hour, 0) AS eta FROM bn LEFT JOIN lr USING (account_id, bucket))",
    ),
    "limit_windows": flags(
        f"SELECT account_id, bucket, win AS \"window\", s AS start_ms, coalesce(lead(s) OVER (PARTITION BY account_id, bucket ORDER BY win), greatest({NOW}, s + 1)) AS end_ms, readings, peak_pct, hit_cap, win = 0 AS partial, lead(s) OVER (PARTITION BY account_id, bucket ORDER BY win) IS NULL AS in_progress FROM g",
        WALK + ", g AS (SELECT account_id, bucket, win, min(start) AS s, count(*) AS readings, max(pct) FILTER (WHERE valid AND NOT saturated) AS peak_pct, bool_or(saturated) AS hit_cap FROM placed GROUP BY 1, 2, 3)",
        own_turns=True,
    ),
    "weekly_capacity": flags("SELECT * FROM slices", WALK + "," + SLICES),
    "capacity_summary": flags(
        "SELECT account_id, n AS sessions, CASE WHEN n >= 3 THEN round(m, 2) END AS typical_week_pct, CASE WHEN n >= 3 THEN round(a, 2) END AS p25, CASE WHEN n >= 3 THEN round(b, 2) END AS p75, CASE WHEN n >= 3 THEN round(100 / m, 2) END AS sessions_per_week, CASE WHEN n >= 3 THEN round(7 * m / 100, 2) END AS days_per_session "
        "FROM (SELECT account_id, count(*) AS n, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM (SELECT account_id, session, sum(week_pct) AS x FROM slices GROUP BY 1, 2) s JOIN (SELECT account_id, max(win) AS z FROM placed WHERE bucket = 'session' GROUP BY 1) USING (account_id) WHERE session > 0 AND session < z AND x >= 3 GROUP BY 1)",
        WALK + "," + SLICES,
    ),
}

# attribution: every turn against every span of its account, straight from the rule
_F = "floor(abs({0}) * {1} + 0.5) / {1}.0::DOUBLE"
ATTRIBUTION = WALK + f""",
a_run AS (SELECT *, sum(saturated::INT) OVER (PARTITION BY account_id, bucket, win ORDER BY n) AS run FROM placed),
a_low AS (SELECT account_id, bucket, win, run, min(start) AS start, min(ts_unix_ms) AS a, max(ts_unix_ms) AS u, arg_min(pct, n) AS low, max(pct) AS top FROM a_run WHERE pct IS NOT NULL AND valid AND NOT saturated GROUP BY 1, 2, 3, 4),
a_peak AS (SELECT *, max(top) OVER (PARTITION BY account_id, bucket, win ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak FROM a_low),
a_span AS (SELECT account_id, bucket, win, run, start, CASE WHEN peak IS NULL AND win > 0 THEN start - 1 ELSE a END AS a, u, greatest(top - CASE WHEN peak IS NOT NULL THEN greatest(low, peak) WHEN win > 0 THEN 0 ELSE low END, 0) AS rise FROM a_peak),
a_turn AS (SELECT t.*, bucket FROM turns t, (VALUES ('session'), ('week')) v(bucket)),
a_met AS (SELECT t.*, s.win, s.run, s.start FROM a_turn t JOIN a_span s ON s.account_id = t.account_id AND s.bucket = t.bucket AND t.ts_unix_ms > s.a AND t.ts_unix_ms <= s.u),
a_paid AS (SELECT account_id, bucket, win, run, start, session_uuid, CAST(sum(cw100) AS BIGINT) AS c, CAST(sum(raw_tokens) AS BIGINT) AS raw, count(*) AS n FROM a_met GROUP BY 1, 2, 3, 4, 5, 6),
a_sum AS (SELECT s.*, CAST(coalesce((SELECT sum(c) FROM a_paid p WHERE p.account_id = s.account_id AND p.bucket = s.bucket AND p.win = s.win AND p.run = s.run), 0) AS BIGINT) AS total FROM a_span s),
a_win AS (SELECT account_id, bucket, win, CAST(sum(total) AS BIGINT) / 100.0::DOUBLE AS spent, CAST(sum(rise) AS BIGINT) AS rose FROM a_sum GROUP BY 1, 2, 3),
a_rate AS (SELECT *, CASE WHEN rose >= 3 AND spent > 0 THEN {_F.format("(spent / rose)", 100)} ELSE 0.0::DOUBLE END AS rate FROM a_win),
a_loc AS (SELECT *, CASE WHEN total <= 0 THEN 0.0::DOUBLE WHEN rate > 0 THEN least(rise::DOUBLE, 2.0::DOUBLE * (total / 100.0::DOUBLE) / rate) ELSE rise::DOUBLE END AS local FROM a_sum JOIN a_rate USING (account_id, bucket, win)),
a_begin AS (SELECT account_id, bucket, win, min(start) AS start FROM placed GROUP BY 1, 2, 3),
a_price AS (SELECT account_id, bucket, start, rate FROM a_begin JOIN a_rate USING (account_id, bucket, win) WHERE rate > 0),
a_free AS (SELECT t.*, CASE bucket WHEN 'week' THEN 604800000 ELSE 18000000 END AS period, coalesce((SELECT min(start) FROM a_begin b WHERE b.account_id = t.account_id AND b.bucket = t.bucket), (SELECT min(ts_unix_ms) FROM turns x WHERE x.account_id = t.account_id)) AS anchor FROM a_turn t ANTI JOIN a_met m ON m.event_id = t.event_id AND m.bucket = t.bucket),
a_near AS (
  SELECT *, coalesce((SELECT max(start) FROM a_begin b WHERE b.account_id = f.account_id AND b.bucket = f.bucket AND b.start <= f.ts_unix_ms), anchor + CAST(floor((ts_unix_ms - anchor) / period::DOUBLE) AS BIGINT) * period) AS start,
    coalesce((SELECT arg_min(p.rate, struct_pack(d := abs(p.start - f.ts_unix_ms), s := p.start)) FROM a_price p WHERE p.account_id = f.account_id AND p.bucket = f.bucket), (SELECT max(median_cw_per_pct) FROM a_median d WHERE d.account_id = f.account_id AND d.bucket = f.bucket), 0.0::DOUBLE) AS rate
  FROM a_free f),
a_est AS (SELECT account_id, bucket, start, session_uuid, rate, CAST(sum(cw100) AS BIGINT) AS c, CAST(sum(raw_tokens) AS BIGINT) AS raw, count(*) AS n FROM a_near GROUP BY 1, 2, 3, 4, 5),
a_rows AS (
  SELECT account_id, bucket, start, session_uuid, l.local * p.c / l.total AS m, 0.0::DOUBLE AS e, p.c, p.raw, p.n FROM a_paid p JOIN (SELECT account_id, bucket, win, run, local, total FROM a_loc WHERE total > 0) l USING (account_id, bucket, win, run)
  UNION ALL SELECT account_id, bucket, start, '', rise - local, 0, 0, 0, 0 FROM a_loc WHERE rise > local
  UNION ALL SELECT account_id, bucket, start, session_uuid, 0, CASE WHEN rate > 0 THEN c / 100.0::DOUBLE / rate ELSE 0 END, c, raw, n FROM a_est),
a_home AS (SELECT session_uuid, arg_min(project, struct_pack(a := ts_unix_ms, b := event_id)) AS project, any_value(coalesce(nullif(parent_session_uuid, ''), session_uuid)) AS owner FROM turns GROUP BY 1),
att AS (
  SELECT account_id, bucket, start AS window_start_ms, session_uuid, coalesce(any_value(project), '') AS project, {_F.format("sum(m)", 10000)} AS measured_pct, {_F.format("sum(e)", 10000)} AS estimated_pct,
    CAST(sum(c) AS BIGINT) / 100.0::DOUBLE AS cw_tokens, CAST(sum(raw) AS BIGINT) AS raw_tokens, CAST(sum(n) AS BIGINT) AS turns, coalesce(any_value(owner), session_uuid) AS owner
  FROM a_rows LEFT JOIN a_home USING (session_uuid) GROUP BY 1, 2, 3, 4),
a_slice AS (SELECT *, CASE WHEN t > 0 THEN round(pct / t, 6) END AS share FROM (SELECT *, sum(pct) OVER (PARTITION BY account_id, bucket, window_start_ms) AS t FROM (SELECT account_id, bucket, window_start_ms, owner, round(sum(measured_pct + estimated_pct), 4) AS pct FROM att GROUP BY 1, 2, 3, 4)))"""


#: Attribution with the directory of each row's owner.
HOMES = "ho_n AS (SELECT session_uuid, cwd, count(*) AS n, min(turn_idx) AS f FROM turns WHERE cwd <> '' GROUP BY 1, 2), ho_m AS (SELECT session_uuid AS owner, cwd FROM ho_n QUALIFY row_number() OVER (PARTITION BY session_uuid ORDER BY n DESC, f) = 1), ho AS (SELECT att.*, coalesce(ho_m.cwd, '') AS cwd FROM att LEFT JOIN ho_m USING (owner))"


def attributed(body: str, more: str = "") -> str:
    median = f"a_median AS ({QUERIES['calibration_median']}),"
    return flags(body, median + ATTRIBUTION.lstrip() + ("," + more if more else ""), own_turns=True)


def _groups(key: str, rows: str = "att") -> str:
    return f"""SELECT account_id, bucket, {key}, round(sum(p), 4) AS total_pct, round(max(p), 4) AS peak_pct, round(sum(cw), 2) AS cw_tokens, count(*) AS windows, CASE WHEN {key} = '' THEN 0 ELSE any_value(s) END AS sessions
FROM (SELECT account_id, bucket, {key}, window_start_ms, sum(measured_pct + estimated_pct) AS p, sum(cw_tokens) AS cw FROM {rows} GROUP BY 1, 2, 3, 4)
JOIN (SELECT account_id, bucket, {key}, count(DISTINCT session_uuid) AS s FROM {rows} GROUP BY 1, 2, 3) USING (account_id, bucket, {key}) GROUP BY 1, 2, 3"""


QUERIES |= {
    "attribution": attributed("SELECT * EXCLUDE (owner) FROM att"),
    "session_pct_totals": attributed("SELECT owner, account_id, bucket, round(sum(p), 4) AS total_pct, round(max(p), 4) AS peak_pct, count(*) AS windows FROM (SELECT owner, account_id, bucket, window_start_ms, sum(measured_pct + estimated_pct) AS p FROM att WHERE session_uuid <> '' GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"),
    "attr_groups_project": attributed(_groups("project")),
    "attr_groups_session": attributed(_groups("session_uuid")),
    "attr_groups_cwd": attributed(
        _groups("cwd", "wd"),
        "wd_n AS (SELECT session_uuid, cwd, count(*) AS n, min(turn_idx) AS f FROM turns WHERE cwd <> '' GROUP BY 1, 2), wd_m AS (SELECT session_uuid AS owner, cwd FROM wd_n QUALIFY row_number() OVER (PARTITION BY session_uuid ORDER BY n DESC, f) = 1), wd AS (SELECT att.*, CASE WHEN session_uuid = '' THEN '' ELSE coalesce(nullif(wd_m.cwd, ''), '__unknown_cwd__') END AS cwd FROM att LEFT JOIN wd_m USING (owner))",
    ),
    "attr_totals": attributed("SELECT account_id, bucket, round(sum(measured_pct + estimated_pct), 4) AS total_pct, round(coalesce(sum(measured_pct + estimated_pct) FILTER (WHERE session_uuid = ''), 0), 4) AS unattributed_pct FROM att GROUP BY 1, 2"),
    "window_slices": attributed("SELECT account_id, bucket, window_start_ms, owner, pct, share FROM a_slice"),
    "attr_current_window": attributed("SELECT account_id, bucket, window_start_ms, owner, pct, share FROM a_slice QUALIFY window_start_ms = max(window_start_ms) OVER (PARTITION BY account_id, bucket)"),
    "attr_window_slices": attributed(
        "SELECT account_id, bucket, window_start_ms, CASE WHEN owner = '' OR r <= 8 THEN owner ELSE '__other__' END AS owner, round(sum(pct), 4) AS pct FROM (SELECT *, row_number() OVER (PARTITION BY account_id, bucket, window_start_ms, owner = '' ORDER BY pct DESC, owner) AS r FROM a_slice) GROUP BY 1, 2, 3, 4"
    ),
    "attr_group_windows": attributed("SELECT account_id, bucket, project, window_start_ms, round(sum(measured_pct + estimated_pct), 4) AS pct FROM att GROUP BY 1, 2, 3, 4"),
    "session_windows": attributed(
        "SELECT account_id, bucket, window_start_ms, end_ms, session_uuid, measured_pct, estimated_pct, peak_pct FROM att JOIN lw USING (account_id, bucket, window_start_ms) WHERE session_uuid <> ''",
        f"lw AS (SELECT account_id, bucket, s AS window_start_ms, peak_pct, coalesce(lead(s) OVER (PARTITION BY account_id, bucket ORDER BY win), greatest({NOW}, s + 1)) AS end_ms FROM (SELECT account_id, bucket, win, min(start) AS s, max(pct) FILTER (WHERE valid AND NOT saturated) AS peak_pct FROM placed GROUP BY 1, 2, 3))",
    ),
}

QUERIES |= {
    "transcript_files": QUERIES["transcript_turns"],
    "parent_links": turns(
        "SELECT DISTINCT concat(project, '/', parent, '/subagents/', session_uuid, '.jsonl') AS path, parent, valid FROM f",
        "f AS (SELECT project, session_uuid, k % 2 = 0 AS valid, CASE WHEN k % 2 = 0 THEN concat(h[1:8], '-', h[9:12], '-', h[13:16], '-', h[17:20], '-', h[21:32]) ELSE parent_session_uuid END AS parent FROM (SELECT *, md5(parent_session_uuid) AS h FROM tk WHERE parent_session_uuid <> ''))",
    ),
    "account_merge": turns("SELECT CASE account_id WHEN 3 THEN 1 ELSE account_id END AS account_id, count(*) AS turns, CAST(sum(raw_tokens) AS BIGINT) AS raw_tokens FROM turns GROUP BY 1"),
    "session_compactions": turns(
        "SELECT session_uuid, count(*) AS turns, CAST(sum(raw_tokens) AS BIGINT) AS raw_tokens, (SELECT count(*) FROM comp WHERE file = session_uuid AND confirmed) AS compaction_count, (SELECT count(*) FROM comp WHERE file = session_uuid AND confirmed AND cache_state = 'cold') AS cold_compaction_count FROM turns GROUP BY 1",
        COMPACT,
    ),
    "attr_rows": attributed("SELECT account_id, bucket, window_start_ms, session_uuid, owner AS effective_uuid, cwd, measured_pct, estimated_pct FROM ho", HOMES),
    "budget_open_window": attributed(
        """SELECT cwd, bucket, account_id, spent_pct, CASE WHEN spend_pct - spent_pct IS NOT NULL THEN round(greatest(0.0::DOUBLE, spend_pct - spent_pct), 2) END AS remaining_pct, CASE WHEN s >= m AND s > 0 THEN ['clear', 'tight', 'exceeded'][s] WHEN m > 0 THEN ['clear', 'tight', 'exceeded'][m] ELSE 'unknown' END AS state, CASE WHEN greatest(s, m) <= 1 THEN '' WHEN s >= m THEN 'spend' ELSE 'meter' END AS rule
        FROM (SELECT *, CASE WHEN spent_pct IS NULL OR spend_pct IS NULL THEN 0 WHEN spent_pct >= spend_pct THEN 3 WHEN spent_pct >= 0.75 * spend_pct THEN 2 ELSE 1 END AS s, CASE WHEN pct IS NULL OR meter_pct IS NULL THEN 0 WHEN pct >= meter_pct THEN 3 WHEN pct >= 0.75 * meter_pct THEN 2 ELSE 1 END AS m FROM (
          SELECT b.*, a.account_id, lat.pct, CASE WHEN o.start IS NOT NULL THEN round(coalesce((SELECT sum(measured_pct + estimated_pct) FROM ho WHERE ho.account_id = a.account_id AND ho.bucket = b.bucket AND ho.cwd = b.cwd AND ho.window_start_ms = o.start), 0), 2) END AS spent_pct
          FROM (VALUES ('/w/0/0', 'session', 5::DOUBLE, 90::DOUBLE), ('/w/1/1', 'week', 6, NULL), ('/w/2/1', 'week', 40, 30), ('/w/3/2', 'session', NULL, 50), ('/w/4/1', 'week', 2, 99), ('/w/none', 'week', 5, 50)) b(cwd, bucket, spend_pct, meter_pct)
          LEFT JOIN (SELECT cwd, arg_max(account_id, struct_pack(a := ts_unix_ms, b := event_id)) AS account_id FROM turns GROUP BY 1) a ON a.cwd = b.cwd
          LEFT JOIN (SELECT account_id, bucket, max(start) AS start FROM placed GROUP BY 1, 2) o ON o.account_id = a.account_id AND o.bucket = b.bucket
          LEFT JOIN lat ON lat.account_id = a.account_id AND lat.bucket = b.bucket))""",
        HOMES + ", " + LATEST,
    ),
}

_MID = "1704451320000"
_MIDWAY = LATEST.replace("WHERE pct IS NOT NULL", f"WHERE ts_unix_ms <= {_MID} AND pct IS NOT NULL")
#: Each account's polls, whole or not, and the newest of each.
POLLS = "po AS (SELECT a.account_id, a.ts, a.n, a.pct AS s, b.pct AS w, a.pct IS NOT NULL AND b.pct IS NOT NULL AS ok FROM mn a JOIN mn b ON a.id = b.id AND a.bucket = 'session' AND b.bucket = 'week')"
_HEALTH = "SELECT account_id, CASE WHEN NOT arg_max(ok, n) THEN 'extraction_failed' WHEN {0} - max(ts) > 7200000 THEN 'stale' ELSE 'ok' END AS state, ({0} - max(ts)) // 1000 AS age_s FROM po WHERE ts <= {0} GROUP BY 1"


def _dur(ms: str) -> str:
    s = f"(greatest({ms}, 0) // 1000)"
    return f"""CASE WHEN {s} < 60 THEN concat({s}, 's') WHEN {s} < 3600 THEN concat({s} // 60, 'm') WHEN {s} < 86400 THEN concat({s} // 3600, 'h', CASE WHEN {s} // 60 % 60 > 0 THEN concat({s} // 60 % 60, 'm') ELSE '' END)
      ELSE concat({s} // 86400, 'd', CASE WHEN {s} // 3600 % 24 > 0 THEN concat({s} // 3600 % 24, 'h') ELSE '' END) END"""


def _gauge(b: str, label: str) -> str:
    return f"concat({b}_pct, '%/{label}', CASE WHEN {b}_eta IS NOT NULL THEN concat(' ⚠100% in ', {_dur(f'{b}_eta')}) ELSE '' END, CASE WHEN {b}_ttr IS NOT NULL THEN concat(' (', {_dur(f'{b}_ttr')}, ')') ELSE '' END)"


_fresh = f"{_MID} - polled_ms < 7200000 AND read_ms IS NOT NULL"
_class = "CASE WHEN {1} THEN CASE WHEN {0}_pct >= 90 THEN 'danger' WHEN {0}_pct >= 70 THEN 'warn' ELSE 'ok' END END AS {0}_class, CASE WHEN {1} THEN CASE WHEN {0}_eta IS NULL THEN 'neutral' WHEN {0}_eta <= 1800000 THEN 'danger' ELSE 'warn' END END AS {0}_burn"
_each = ", ".join(f"max({x}) FILTER (WHERE bucket = '{b}') AS {b}_{x}" for b in ("session", "week") for x in ("ttr", "eta"))
_share = ", ".join(f"max({x}) FILTER (WHERE bucket = '{b}') AS {b}_{x}" for b in ("session", "week") for x in ("total_pct", "peak_pct", "windows"))
_shares = ", ".join(f"{b}_{x}" for b in ("session", "week") for x in ("total_pct", "peak_pct", "windows"))
QUERIES |= {
    "leaks_top": turns(
        "SELECT session_uuid, leak_tokens, raw_tokens, coalesce(cold, 0) AS cold_compactions FROM (SELECT session_uuid, CAST(coalesce(sum(raw_tokens) FILTER (WHERE classification <> 'normal'), 0) AS BIGINT) AS leak_tokens, CAST(sum(raw_tokens) AS BIGINT) AS raw_tokens FROM turns GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25) LEFT JOIN (SELECT file AS session_uuid, count(*) AS cold FROM comp WHERE confirmed AND cache_state = 'cold' GROUP BY 1) USING (session_uuid) WHERE leak_tokens > 0 OR cold > 0",
        COMPACT,
    ),
    "sensor_readings": flags(
        f"""SELECT account_id, bucket, 'threshold' AS kind, CAST(pct // 10 * 10 AS VARCHAR) AS state FROM lat UNION ALL SELECT account_id, bucket, 'saturation', CASE WHEN saturated THEN 'saturated' ELSE 'clear' END FROM lat
        UNION ALL SELECT l.account_id, l.bucket, 'limit_projection', CASE WHEN p.account_id IS NULL THEN 'clear' ELSE 'projected' END FROM lat l LEFT JOIN ({QUERIES['limit_projection']}) p ON p.account_id = l.account_id AND p.bucket = l.bucket
        UNION ALL SELECT account_id, '', 'collection', state FROM ({_HEALTH.format(_MID)})""",
        _MIDWAY + ", " + POLLS,
    ),
    "status_text": flags(
        f"""SELECT account_id, CASE WHEN {_MID} - polled_ms >= 7200000 THEN concat('STALE ', {_dur(f'{_MID} - polled_ms')}) WHEN read_ms IS NULL THEN 'extraction failed'
          ELSE concat(CASE WHEN ok THEN '' ELSE concat('◷', {_dur(f'{_MID} - read_ms')}, ' ') END, {_gauge('session', '5h')}, ' · ', {_gauge('week', 'wk')}) END AS line, {_class.format('session', _fresh)}, {_class.format('week', _fresh)}
        FROM st LEFT JOIN g USING (account_id)""",
        POINTS.replace("FROM flags)", f"FROM flags WHERE ts_unix_ms <= {_MID})").strip() + ", " + _MIDWAY + ", " + POLLS + f""",
        st AS (SELECT account_id, arg_max(ok, n) AS ok, max(ts) AS polled_ms, max(ts) FILTER (WHERE ok) AS read_ms, arg_max(s, n) FILTER (WHERE ok) AS session_pct, arg_max(w, n) FILTER (WHERE ok) AS week_pct FROM po WHERE ts <= {_MID} GROUP BY 1),
        g0 AS (SELECT l.account_id, l.bucket, CASE WHEN reset_ms > {_MID} THEN reset_ms - {_MID} END AS ttr, CASE WHEN pct_per_hour > 0 AND l.pct < 100 THEN CAST(floor((100 - l.pct) / pct_per_hour * 3600000) AS BIGINT) END AS e FROM lat l LEFT JOIN bn b ON b.account_id = l.account_id AND b.bucket = l.bucket),
        g1 AS (SELECT *, CASE WHEN ttr IS NULL OR e < ttr THEN e END AS eta FROM g0), g AS (SELECT account_id, {_each} FROM g1 GROUP BY 1)""",
    ),
    "weights_control": turns("SELECT model AS model_a, b AS model_b, round(weight / w2, 2) AS ratio FROM (SELECT l.model, weight, lead(l.model) OVER v AS b, lead(weight) OVER v AS w2 FROM learned l JOIN (SELECT DISTINCT model, m5 FROM turns) p ON p.model = l.model WHERE weight <> 0 WINDOW v AS (PARTITION BY m5 ORDER BY l.model)) WHERE b IS NOT NULL ORDER BY 1 LIMIT 1", LEARN),
    "model_status": turns(
        "SELECT model, coalesce(m, 1.0) AS multiplier, i AS input_price, o AS output_price, i IS NOT NULL AS priced, coalesce(abs(o / i - 5) > 0.01, false) AS breaks_ratio, coalesce(u, false) AS unverified FROM (SELECT DISTINCT model FROM turns) LEFT JOIN (VALUES ('m-large', 2.0::DOUBLE, 10.0::DOUBLE, 50.0::DOUBLE, false), ('m-base', 1.0, 5.0, 25.0, false), ('m-small', 0.2, 1.0, 5.0, false), ('m-mid', 0.6, 3.0, 12.0, false), ('m-unpriced', 0.4, 2.0, 10.0, true)) p(model, m, i, o, u) USING (model)"
    ),
    "events_page": sql.meter(
        f"SELECT from_id, to_id, n, more, age_s AS poll_age_s, coalesce(age_s * 1000 > 7200000, false) AS stale FROM (SELECT 100::BIGINT AS from_id, max(event_id) AS to_id, count(*) AS n, count(*) >= 500 AS more FROM (SELECT event_id FROM turns WHERE event_id > 100 ORDER BY event_id LIMIT 500)) LEFT JOIN ({_HEALTH.format('1705017600000')}) h ON h.account_id = 1",
        POLLS, own_turns=True,
    ),
    "lease_status": turns(
        "SELECT event_id, kind, CASE kind WHEN 'manual' THEN true WHEN 'deadline' THEN coalesce(at_ms > now, true) ELSE CASE WHEN we IS NOT NULL THEN we > now WHEN oe IS NULL OR oe = 0 THEN true WHEN ba IS NOT NULL AND oe <= ba THEN true ELSE oe > now END END AS live FROM le",
        "le AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'deadline' ELSE 'window_reset' END AS kind, ts_unix_ms + 36000000 AS now, CASE WHEN k % 10 > 0 THEN ts_unix_ms + (k - 40) * 3600000 END AS at_ms, CASE WHEN k % 2 = 0 THEN ts_unix_ms + (k - 30) * 3600000 END AS we, CASE WHEN k % 5 > 0 THEN ts_unix_ms + (k - 60) * 3600000 END AS oe, CASE WHEN k % 7 > 0 THEN ts_unix_ms - (k % 50) * 3600000 END AS ba FROM tk)",
    ),
    "session_detail": f"""SELECT session_uuid, project, first_ms, last_ms, s.turns, s.raw_tokens, output_tokens, peak_raw_tokens AS peak_5h_raw_tokens, idle_miss_count, rotation_count, restructure_count, cache_ttl, models, subagents, subagent_turns,
      coalesce(compactions, 0) AS compactions, coalesce(confirmed, 0) AS confirmed, coalesce(cold_compactions, 0) AS cold_compactions, {_shares}
      FROM ({sql.QUERIES['sessions']}) s JOIN ({sql.QUERIES['session_list']}) l USING (session_uuid) JOIN ({sql.QUERIES['peak_5h']}) p USING (session_uuid)
      LEFT JOIN ({turns("SELECT file AS session_uuid, count(*) AS compactions, count(*) FILTER (WHERE confirmed) AS confirmed, count(*) FILTER (WHERE confirmed AND cache_state = 'cold') AS cold_compactions FROM comp GROUP BY 1", COMPACT)}) c USING (session_uuid)
      LEFT JOIN (SELECT owner AS session_uuid, {_share} FROM ({QUERIES['session_pct_totals']}) GROUP BY 1) a USING (session_uuid)""",
}
