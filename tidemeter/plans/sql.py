"""SQL for DuckDB that gives the registered queries' rows from the same tables, written from the rules."""

TURNS = """
ev AS (SELECT event_id, event_type, epoch_us(ts) // 1000 AS ms, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id % 20 AS s FROM events),
eo AS (SELECT *, CASE WHEN s >= 16 THEN s - 16 ELSE s END AS o FROM ev),
t0 AS (
  SELECT event_id, ms AS ts_unix_ms, concat('s', s) AS session_uuid, CASE WHEN s >= 16 THEN concat('s', s - 16) ELSE '' END AS parent_session_uuid,
    concat('p', o % 5) AS project, 1 + o % 3 AS account_id, CASE WHEN k % 10 = 0 THEN '' ELSE concat('/w/', s % 7, '/', k % 3) END AS cwd,
    CASE event_type WHEN 'click' THEN 'm-large' WHEN 'view' THEN 'm-base' WHEN 'purchase' THEN 'm-mid' WHEN 'signup' THEN 'm-small' WHEN 'error' THEN 'm-unpriced' END AS model,
    CASE event_type WHEN 'click' THEN 10 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 1 ELSE 5 END AS m5,
    k * 10 + 1 AS input_tokens, (k * 37) % 500 AS output_tokens, CASE WHEN k % 4 = 0 THEN 0 ELSE k * 400 END AS cache_read,
    CASE WHEN k % 3 = 0 THEN k * 150 ELSE 0 END AS cache_create_5m, CASE WHEN k % 5 = 0 THEN k * 200 ELSE 0 END AS cache_create_1h
  FROM eo),
t1 AS (
  SELECT *, row_number() OVER w - 1 AS turn_idx, coalesce(greatest(0, ts_unix_ms - lag(ts_unix_ms) OVER w), 0) / 1000.0::DOUBLE AS gap_s,
    input_tokens + output_tokens + cache_read + cache_create_5m + cache_create_1h AS raw_tokens,
    20 * input_tokens + 100 * output_tokens + 2 * cache_read + 25 * cache_create_5m + 40 * cache_create_1h AS tw20
  FROM t0 WINDOW w AS (PARTITION BY session_uuid ORDER BY ts_unix_ms, event_id)),
turns AS (
  SELECT *, tw20 * m5 AS cw100,
    CASE WHEN cache_create_5m + cache_create_1h + cache_read < 1000 THEN 'normal'
      WHEN gap_s > 300 AND cache_create_5m + cache_create_1h > 3000 THEN 'idle_miss'
      WHEN cache_create_5m + cache_create_1h > 10000 AND cache_read < 1000 THEN 'rotation'
      WHEN cache_create_5m + cache_create_1h > 10000 AND (cache_create_5m + cache_create_1h) * 5 > cache_create_5m + cache_create_1h + cache_read THEN 'restructure'
      ELSE 'normal' END AS classification
  FROM t1)"""

METER = """
pv AS (SELECT *, 1 + o % 3 AS account_id,
    least(100, (ms % 18000000) * (60 + 14 * ((ms // 18000000) % 6)) // 18000000) AS sb,
    least(100, (ms % 604800000) * (50 + 15 * ((ms // 604800000) % 5)) // 604800000) AS wb FROM eo WHERE event_id % 8 = 0),
meter AS (
  SELECT event_id AS id, account_id, 'session' AS bucket, ms AS ts, CASE WHEN k = 99 THEN NULL WHEN k = 7 THEN 107 WHEN k = 13 THEN sb // 3 ELSE sb END AS pct,
    CASE WHEN k % 25 = 0 THEN NULL ELSE (ms // 18000000 + 1) * 18000000 END AS rst FROM pv
  UNION ALL
  SELECT event_id, account_id, 'week', ms, CASE WHEN k = 99 THEN NULL WHEN k = 17 THEN wb // 2 ELSE wb END,
    CASE WHEN k % 25 = 0 THEN NULL ELSE (ms // 604800000 + 1) * 604800000 END FROM pv),
mn AS (SELECT *, coalesce(pct >= 99, false) AS saturated, row_number() OVER (PARTITION BY account_id, bucket ORDER BY ts, id) AS n FROM meter),
ml AS (SELECT a.*, (SELECT arg_min(b.pct, b.n) FROM mn b WHERE b.account_id = a.account_id AND b.bucket = a.bucket AND b.n > a.n AND b.pct IS NOT NULL AND abs(b.pct - a.pct) > 1) AS later FROM mn a),
fold AS (
  SELECT account_id, bucket, n, false AS reset_detected, coalesce(pct <= 100, true) AS valid, CASE WHEN pct <= 100 THEN pct END AS peak, rst AS due FROM ml WHERE n = 1
  UNION ALL
  SELECT account_id, bucket, n, reset_detected, valid, peak, CASE WHEN rst IS NOT NULL THEN rst WHEN reset_detected THEN NULL ELSE due END
  FROM (
    SELECT *, CASE WHEN kind IN ('first', 'edge') THEN kind = 'edge' OR edge ELSE kind = 'drop' END AS reset_detected, kind NOT IN ('over', 'misread') AS valid,
      CASE kind WHEN 'none' THEN old WHEN 'over' THEN old WHEN 'misread' THEN old WHEN 'near' THEN greatest(old, pct) ELSE pct END AS peak
    FROM (
      SELECT *, CASE WHEN pct IS NULL THEN 'none' WHEN pct > 100 THEN 'over' WHEN old IS NULL THEN 'first' WHEN edge THEN 'edge' WHEN old - pct <= 1 THEN 'near' WHEN coalesce(later >= old - 1, false) THEN 'misread' ELSE 'drop' END AS kind
      FROM (SELECT ml.*, f.peak AS old, f.due, coalesce(ml.ts >= f.due, false) AS edge FROM fold f JOIN ml ON ml.account_id = f.account_id AND ml.bucket = f.bucket AND ml.n = f.n + 1))))
,
flags AS (SELECT ml.id, ml.account_id, ml.bucket, ml.ts AS ts_unix_ms, ml.pct, ml.rst AS reset_ms, ml.saturated, fold.reset_detected, fold.valid, ml.n FROM ml JOIN fold USING (account_id, bucket, n))"""


def turns(body: str, more: str = "") -> str:
    return f"WITH {TURNS}{', ' + more if more else ''} {body}"


def meter(body: str, more: str = "", own_turns: bool = False) -> str:
    head = TURNS if own_turns else ",".join(TURNS.split("),\nt0 AS")[:1]) + ")"
    return f"WITH RECURSIVE {head},{METER}{', ' + more if more else ''} {body}"


_S = "input_tokens, output_tokens, cache_read, cache_create_5m, cache_create_1h"
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in (*_S.split(", "), "raw_tokens"))
_SAME = " AND ".join(f"lag({c}) OVER w = {c}" for c in ("model", *_S.split(", ")))

QUERIES = {
    "leaks_by_class": turns("SELECT classification, count(*) AS turns, CAST(sum(raw_tokens) AS BIGINT) AS raw_tokens, CAST(sum(cw100) AS BIGINT) / 100.0::DOUBLE AS cw_tokens FROM turns GROUP BY 1"),
    "raw_tokens": turns("SELECT event_id, raw_tokens FROM turns"),
    "type_weighted": turns("SELECT event_id, tw20 / 20.0::DOUBLE AS tw_tokens FROM turns"),
    "cost_weighted": turns("SELECT event_id, cw100 / 100.0::DOUBLE AS cw_tokens FROM turns"),
    "cold_prefix": turns("SELECT event_id, raw_tokens * 40 * m5 / 100.0::DOUBLE AS cold_cost FROM turns"),
    "classify_turns": turns("SELECT event_id, classification FROM turns"),
    "cache_state": turns("SELECT event_id, CASE WHEN gap_s > 3600 THEN 'cold' WHEN gap_s > 300 THEN 'warm_1h' ELSE 'warm_5m' END AS cache_state FROM turns"),
    "effective_owner": turns("SELECT coalesce(nullif(parent_session_uuid, ''), session_uuid) AS owner, count(*) AS turns, CAST(sum(raw_tokens) AS BIGINT) AS raw_tokens FROM turns GROUP BY 1"),
    "turn_gaps": turns("SELECT event_id, session_uuid, turn_idx, gap_s FROM turns"),
    "price_table": turns("SELECT model, m5 / 5.0::DOUBLE AS multiplier, CASE WHEN model <> 'm-unpriced' THEN m5 * 1.0::DOUBLE END AS input_price, CASE WHEN model <> 'm-unpriced' THEN m5 * 5.0::DOUBLE END AS output_price, model <> 'm-unpriced' AS priced, false AS breaks_ratio, false AS unverified FROM (SELECT DISTINCT model, m5 FROM turns)"),
    "model_totals": turns(
        "SELECT model, turns, raw_tokens, c / 100.0::DOUBLE AS cw_tokens, model <> 'm-unpriced' AS priced, CASE WHEN model <> 'm-unpriced' THEN round(c / (sum(c) FILTER (WHERE model <> 'm-unpriced') OVER ())::DOUBLE, 6) END AS share FROM m WHERE c > 0",
        "m AS (SELECT model, count(*) AS turns, CAST(sum(raw_tokens) AS BIGINT) AS raw_tokens, CAST(sum(cw100) AS BIGINT) AS c FROM turns GROUP BY 1)",
    ),
    "model_days": turns("SELECT CAST(make_timestamp(ts_unix_ms * 1000) AS DATE) AS day, model, CAST(sum(cw100) AS BIGINT) / 100.0::DOUBLE AS cw_tokens FROM turns WHERE model <> 'm-unpriced' GROUP BY 1, 2"),
    "models_with_spend": turns("SELECT model, max(ts_unix_ms) AS last_ms FROM turns GROUP BY 1 HAVING sum(cw100) > 0"),
    "unpriced_models": turns("SELECT DISTINCT model FROM turns WHERE model NOT IN ('m-large', 'm-base', 'm-mid', 'm-small')"),
    "ingest_stats": turns("SELECT count(*) AS turns, count(DISTINCT session_uuid) AS sessions, count(DISTINCT project) AS projects, min(ts_unix_ms) AS first_ms, max(ts_unix_ms) AS last_ms FROM turns"),
    "heatmap_tokens": turns("SELECT CAST(dayofweek(make_timestamp(ts_unix_ms * 1000)) AS BIGINT) AS weekday, CAST(hour(make_timestamp(ts_unix_ms * 1000)) AS BIGINT) AS hour, CAST(sum(raw_tokens) AS BIGINT) AS raw_tokens FROM turns GROUP BY 1, 2"),
    "trail_cost": turns("SELECT CAST(sum(20 * input_tokens + 100 * output_tokens + 2 * cache_read + 30 * (cache_create_5m + cache_create_1h)) AS BIGINT) / 20.0::DOUBLE AS cw_tokens, CAST(sum(raw_tokens) AS BIGINT) AS raw_tokens, count(*) AS turns FROM turns"),
    "sessions": turns(
        f"SELECT session_uuid, min(ts_unix_ms) AS first_ms, max(ts_unix_ms) AS last_ms, count(*) AS turns, {_SUMS}, CAST(sum(cw100) AS BIGINT) / 100.0::DOUBLE AS cw_tokens, "
        + ", ".join(f"count(*) FILTER (WHERE classification = '{c}') AS {c}_count" for c in ("idle_miss", "rotation", "restructure", "normal"))
        + ", string_agg(DISTINCT model, ',' ORDER BY model) AS models, arg_max(account_id, turn_idx) AS account_id, arg_min(project, turn_idx) AS project, CASE WHEN sum(cache_create_1h) > 0 AND sum(cache_create_5m) > 0 THEN 'mix' WHEN sum(cache_create_1h) > 0 THEN '1h' WHEN sum(cache_create_5m) > 0 THEN '5m' ELSE 'none' END AS cache_ttl FROM turns GROUP BY 1"
    ),
    "session_cwd_mode": turns("SELECT session_uuid, cwd, n FROM (SELECT *, row_number() OVER (PARTITION BY session_uuid ORDER BY n DESC, f) AS r FROM (SELECT session_uuid, cwd, count(*) AS n, min(turn_idx) AS f FROM turns WHERE cwd <> '' GROUP BY 1, 2)) WHERE r = 1"),
    "peak_5h": turns("SELECT session_uuid, CAST(max(x) AS BIGINT) AS peak_raw_tokens FROM (SELECT session_uuid, sum(raw_tokens) OVER (PARTITION BY session_uuid ORDER BY ts_unix_ms RANGE BETWEEN 18000000 PRECEDING AND CURRENT ROW) AS x FROM turns) GROUP BY 1"),
    "session_list": turns(
        "SELECT a.session_uuid, a.turns, a.raw_tokens, CAST(count(b.session_uuid) AS BIGINT) AS subagents, CAST(coalesce(sum(b.turns), 0) AS BIGINT) AS subagent_turns FROM s a LEFT JOIN s b ON b.parent_session_uuid = a.session_uuid GROUP BY ALL",
        "s AS (SELECT session_uuid, parent_session_uuid, count(*) AS turns, CAST(sum(raw_tokens) AS BIGINT) AS raw_tokens FROM turns GROUP BY 1, 2)",
    ),
    "recent_sessions": turns("SELECT session_uuid, max(ts_unix_ms) AS last_ms FROM turns GROUP BY 1 HAVING max(ts_unix_ms) >= (SELECT max(ts_unix_ms) + 60000 - 86400000 FROM turns) ORDER BY 2 DESC, 1 LIMIT 10"),
    "last_turns": turns("SELECT session_uuid, turn_idx, raw_tokens FROM turns QUALIFY row_number() OVER (PARTITION BY session_uuid ORDER BY turn_idx DESC) <= 3"),
    "collapse_runs": turns(
        f"SELECT session_uuid, CAST(run AS BIGINT) AS turn_idx, max(ts_unix_ms) AS ts_unix_ms, arg_min(cwd, i) AS cwd, arg_min(project, i) AS project, arg_min(account_id, i) AS account_id, arg_min(parent_session_uuid, i) AS parent_session_uuid, arg_min(model, i) AS model, {', '.join(f'arg_min({c}, i) AS {c}' for c in _S.split(', '))}, count(*) AS merged FROM b GROUP BY session_uuid, run",
        f"a AS (SELECT *, turn_idx AS i, CASE WHEN ts_unix_ms - lag(ts_unix_ms) OVER w <= 60000 AND {_SAME} THEN 0 ELSE 1 END AS fresh FROM turns WINDOW w AS (PARTITION BY session_uuid ORDER BY turn_idx)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY session_uuid ORDER BY i) - 1 AS run FROM a)",
    ),
    "collapse_stats": turns(
        "SELECT count(*) AS turns, CAST(sum(fresh) AS BIGINT) AS kept FROM a",
        f"a AS (SELECT CASE WHEN ts_unix_ms - lag(ts_unix_ms) OVER w <= 60000 AND {_SAME} THEN 0 ELSE 1 END AS fresh FROM turns WINDOW w AS (PARTITION BY session_uuid ORDER BY turn_idx))",
    ),
    "upsert_latest": turns("SELECT session_uuid, cwd, event_id, ts_unix_ms FROM turns QUALIFY row_number() OVER (PARTITION BY session_uuid, cwd ORDER BY ts_unix_ms DESC, event_id DESC) = 1"),
    "dedupe_first_last": turns("SELECT session_uuid, model, min_by(event_id, turn_idx) AS first_event, max_by(event_id, turn_idx) AS last_event FROM turns GROUP BY 1, 2"),
    "tail_budget": turns("SELECT session_uuid, turn_idx, raw_tokens FROM (SELECT *, sum(raw_tokens) OVER w AS x, row_number() OVER w AS r FROM turns WINDOW w AS (PARTITION BY session_uuid ORDER BY turn_idx DESC)) WHERE x <= 24000 OR r = 1"),
    "resolve_prefix": turns("SELECT 's1' AS prefix, count(DISTINCT session_uuid) AS matches, bool_or(session_uuid = 's1') AS exact FROM turns WHERE starts_with(session_uuid, 's1')"),
    "account_for": turns("SELECT cwd, arg_max(account_id, struct_pack(a := ts_unix_ms, b := event_id)) AS account_id FROM turns WHERE cwd <> '' GROUP BY 1"),
    "login_intervals": turns(
        "SELECT config_dir, account_id, CASE WHEN n = 1 THEN 0 ELSE ts_unix_ms END AS from_ms FROM l WHERE n = 1 OR account_id <> b",
        "l AS (SELECT concat('/c/', event_id % 4) AS config_dir, account_id, ts_unix_ms, row_number() OVER w AS n, lag(account_id) OVER w AS b FROM turns WHERE event_id % 40 < 4 WINDOW w AS (PARTITION BY event_id % 4 ORDER BY ts_unix_ms, event_id))",
    ),
    "asof_account": turns(
        "SELECT event_id, coalesce(i.account_id, f.first_id, 1) AS resolved FROM (SELECT event_id, ts_unix_ms, concat('/c/', event_id % 5) AS config_dir FROM turns) t ASOF LEFT JOIN i ON i.config_dir = t.config_dir AND t.ts_unix_ms >= i.from_ms LEFT JOIN (SELECT config_dir, arg_min(account_id, from_ms) AS first_id FROM i GROUP BY 1) f ON f.config_dir = t.config_dir",
        "l AS (SELECT concat('/c/', event_id % 4) AS config_dir, account_id, ts_unix_ms, row_number() OVER w AS n, lag(account_id) OVER w AS b FROM turns WHERE event_id % 40 < 4 WINDOW w AS (PARTITION BY event_id % 4 ORDER BY ts_unix_ms, event_id)), i AS (SELECT config_dir, account_id, CASE WHEN n = 1 THEN 0 ELSE ts_unix_ms END AS from_ms FROM l WHERE n = 1 OR account_id <> b)",
    ),
    "usage_flags": meter("SELECT id, account_id, bucket, ts_unix_ms, pct, reset_ms, saturated, reset_detected, valid FROM flags"),
    "window_reset_events": meter("SELECT account_id, bucket, ts_unix_ms, pct FROM flags WHERE reset_detected"),
    "latest_usage": meter("SELECT account_id, bucket, ts_unix_ms, pct FROM flags WHERE pct IS NOT NULL QUALIFY row_number() OVER (PARTITION BY account_id, bucket ORDER BY ts_unix_ms DESC, id DESC) = 1"),
    "heatmap_pct": meter(
        "SELECT bucket, CAST(dayofweek(make_timestamp(ts_unix_ms * 1000)) AS BIGINT) AS weekday, CAST(hour(make_timestamp(ts_unix_ms * 1000)) AS BIGINT) AS hour, CAST(sum(pct - p) AS BIGINT) AS pct FROM (SELECT *, lag(pct) OVER (PARTITION BY account_id, bucket ORDER BY ts_unix_ms, id) AS p FROM flags WHERE pct IS NOT NULL AND valid AND NOT saturated) WHERE NOT reset_detected AND pct > p GROUP BY 1, 2, 3"
    ),
    "burn_series": meter(
        "SELECT id, account_id, bucket, ts_unix_ms, CASE WHEN ok AND ts_unix_ms - b.t BETWEEN 600000 AND 14400000 THEN round(greatest(0, (pct - b.p)::DOUBLE / ((ts_unix_ms - b.t) / 3600000.0::DOUBLE)), 6) END AS pct_per_hour FROM h",
        "g AS (SELECT *, pct IS NOT NULL AND valid AND NOT saturated AS ok, sum(reset_detected::INT) OVER (PARTITION BY account_id, bucket ORDER BY n) AS seg FROM flags), h AS (SELECT g.*, coalesce((SELECT arg_min(struct_pack(t := x.ts_unix_ms, p := x.pct), struct_pack(t := x.ts_unix_ms, p := x.pct)) FROM g x WHERE x.ok AND x.account_id = g.account_id AND x.bucket = g.bucket AND x.seg = g.seg AND x.ts_unix_ms BETWEEN g.ts_unix_ms - 2700000 AND g.ts_unix_ms - 1), (SELECT arg_max(struct_pack(t := x.ts_unix_ms, p := x.pct), x.n) FROM g x WHERE x.ok AND x.account_id = g.account_id AND x.bucket = g.bucket AND x.seg = g.seg AND x.ts_unix_ms < g.ts_unix_ms)) AS b FROM g)",
    ),
    "rolling_median": meter(
        "SELECT id, account_id, bucket, CASE WHEN count(pct) OVER w >= 3 THEN CAST(quantile_cont(pct, 0.5) OVER w AS DOUBLE) END AS median_pct FROM flags WINDOW w AS (PARTITION BY account_id, bucket ORDER BY ts_unix_ms, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
    ),
    "series_breaks": meter(
        "SELECT account_id, bucket, ts_unix_ms, pct FROM flags UNION ALL SELECT account_id, bucket, (ts_unix_ms + b) // 2, NULL FROM (SELECT *, lag(ts_unix_ms) OVER (PARTITION BY account_id, bucket ORDER BY n) AS b FROM flags) WHERE reset_detected AND b IS NOT NULL"
    ),
    "calibration_points": meter(
        "SELECT account_id, bucket, a_ms, b_ms, entry AS from_pct, top AS to_pct, top - entry AS delta, raw AS raw_tokens, c / 100.0::DOUBLE AS cw_tokens, round(c / 100.0::DOUBLE / (top - entry), 6) AS cw_per_pct FROM z WHERE top > entry AND raw > 0",
        "r0 AS (SELECT *, sum(reset_detected::INT) OVER w AS win, sum((reset_detected OR saturated)::INT) OVER w AS run, reset_detected OR NOT saturated AS inside, CASE WHEN valid AND pct IS NOT NULL THEN least(pct, 100) END AS anchor FROM flags WINDOW w AS (PARTITION BY account_id, bucket ORDER BY n)), r1 AS (SELECT account_id, bucket, win, run, min(ts_unix_ms) AS a_ms, max(ts_unix_ms) AS b_ms, arg_min(anchor, n) FILTER (WHERE anchor IS NOT NULL) AS first, max(anchor) AS high FROM r0 WHERE inside GROUP BY ALL), r2 AS (SELECT *, greatest(first, max(high) OVER (PARTITION BY account_id, bucket, win ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS entry FROM r1), z AS (SELECT r2.*, greatest(high, entry) AS top, (SELECT CAST(sum(raw_tokens) AS BIGINT) FROM turns t WHERE t.account_id = r2.account_id AND t.ts_unix_ms > a_ms AND t.ts_unix_ms <= b_ms) AS raw, (SELECT CAST(sum(cw100) AS BIGINT) FROM turns t WHERE t.account_id = r2.account_id AND t.ts_unix_ms > a_ms AND t.ts_unix_ms <= b_ms) AS c FROM r2)",
        own_turns=True,
    ),
    "buckets_5h": f"WITH RECURSIVE {TURNS}, b AS (SELECT account_id, min(ts_unix_ms) AS s FROM turns GROUP BY 1 UNION ALL SELECT account_id, (SELECT min(ts_unix_ms) FROM turns t WHERE t.account_id = b.account_id AND t.ts_unix_ms >= b.s + 18000000) FROM b WHERE s IS NOT NULL) SELECT b.account_id, b.s AS start_ms, b.s + 18000000 AS end_ms, CAST(sum(raw_tokens) AS BIGINT) AS raw_tokens, CAST(sum(cw100) AS BIGINT) / 100.0::DOUBLE AS cw_tokens FROM b JOIN turns t ON t.account_id = b.account_id AND t.ts_unix_ms >= b.s AND t.ts_unix_ms < b.s + 18000000 GROUP BY 1, 2",
    "level_edges": turns(
        "SELECT session_uuid, turn_idx, state, coalesce(b, 'unknown') AS previous FROM (SELECT *, lag(state) OVER (PARTITION BY session_uuid ORDER BY turn_idx) AS b FROM r) WHERE state <> coalesce(b, 'unknown')",
        "r AS (SELECT session_uuid, turn_idx, CASE WHEN gap_s > 3600 THEN 'cold' WHEN gap_s > 300 THEN 'warm_1h' ELSE 'warm_5m' END AS state FROM turns)",
    ),
    "events_query": turns("SELECT event_id, event_type, user_id FROM events WHERE event_id > 100 AND (event_type LIKE 'c%' OR event_type LIKE '%i_w') ORDER BY event_id LIMIT 500"),
    "budget_pressure": turns(
        "SELECT cwd, used, allowance, CASE WHEN allowance IS NULL OR used IS NULL THEN 'unknown' WHEN used >= allowance THEN 'exceeded' WHEN used >= 0.75 * allowance THEN 'tight' ELSE 'clear' END AS pressure FROM (SELECT b.cwd, b.allowance, round(100.0::DOUBLE * u.c / (SELECT CAST(sum(cw100) AS BIGINT) FROM turns), 4) AS used FROM (VALUES ('/w/0/0', 1.0::DOUBLE), ('/w/1/1', 6.0), ('/w/2/2', 20.0), ('/w/none', 5.0), ('/w/3/0', NULL)) b(cwd, allowance) LEFT JOIN (SELECT cwd, CAST(sum(cw100) AS BIGINT) AS c FROM turns GROUP BY 1) u USING (cwd))"
    ),
}
