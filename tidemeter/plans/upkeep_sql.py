"""SQL for DuckDB that gives the rows of the queries over kept tables."""

from . import reports_sql, sql
from .reports_sql import turns

TREE = """
w AS (SELECT DISTINCT session_uuid, parent_session_uuid AS parent, project, CAST(substr(session_uuid, 2) AS INTEGER) AS n FROM turns),
w1 AS (SELECT *, regexp_replace(md5(parent), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5') AS folder FROM w),
tree AS (
  SELECT session_uuid, n, CASE WHEN parent = '' THEN 'top_level' WHEN n % 4 = 3 THEN 'workflow_agent' ELSE 'subagent' END AS shape,
    CASE WHEN parent = '' THEN session_uuid WHEN n % 4 = 2 THEN parent ELSE folder END AS owner,
    CASE WHEN parent = '' THEN concat(project, '/', session_uuid, '.jsonl') WHEN n % 4 = 3 THEN concat(project, '/', folder, '/subagents/workflows/w1/agent-', session_uuid, '.jsonl')
      WHEN n % 4 = 2 THEN concat(project, '/', parent, '/subagents/agent-', session_uuid, '.jsonl') ELSE concat(project, '/', folder, '/subagents/agent-', session_uuid, '.jsonl') END AS path
  FROM w1),
many AS (
  SELECT session_uuid, CAST(sum(1 + (model = 'm-mid' AND k % 4 = 1)::INT + (model = 'm-mid' AND k % 8 = 1)::INT + (model = 'm-small')::INT + (model = 'm-unpriced' AND k BETWEEN 86 AND 98)::INT + (k % 3 = 0)::INT + (k % 50 = 0)::INT) AS BIGINT) AS lines
  FROM tk GROUP BY 1)"""

_few = "CASE session_uuid WHEN 's1' THEN 20 WHEN 's4' THEN 20 WHEN 's7' THEN 20 WHEN 's17' THEN 20 WHEN 's2' THEN 0 ELSE 100000000 END"

_E, _D = "1704067200000", "86400000::BIGINT"


def _hook(k: int, kind: str, after: int, expires: str, status: str = "pending", about: str = "true") -> str:
    first = f"(SELECT min(event_id) FROM turns WHERE {reports_sql.KIND} LIKE '{kind}' AND event_id > {after} AND ts_unix_ms <= {expires} AND {about})"
    return f"SELECT {k}::BIGINT AS hook_id, '{status}' AS status, {expires} AS expires_ms, CASE WHEN '{status}' = 'pending' THEN {first} END AS event_id"


HOOKS = "ho AS (" + " UNION ALL ".join((
    _hook(1, "c%", 10, f"{_E} + {_D}"), _hook(2, "%i_w", 300, f"{_E} + 20 * {_D}"), _hook(3, "%", 0, f"{_E} + {_D}", "fired"), _hook(4, "none.%", 0, f"{_E} + 40 * {_D}"),
    _hook(5, "c%", 0, f"{_E} + 1"), _hook(6, "s_gn%", 50, f"{_E} + 90 * {_D}", about="session_uuid = 's3'"), _hook(7, "%", 0, f"{_E} + 90 * {_D}", about="cwd = '/w/none'"),
)) + ")"

#: The newest directory among a session's answers in the delta; only answers have one.
DELTA = f"""
x AS (SELECT session_uuid AS file, ts_unix_ms, cwd, turn_idx, CAST(substr(session_uuid, 2) AS INTEGER) % 2 = 1 AND ts_unix_ms > 1704451320000 AS new,
    1 + (model = 'm-mid' AND k % 4 = 1)::INT + (model = 'm-mid' AND k % 8 = 1)::INT + (model = 'm-small')::INT + (model = 'm-unpriced' AND k BETWEEN 86 AND 98)::INT + (k % 3 = 0)::INT AS lines FROM tk)"""

QUERIES = {
    "model_day_map": turns("SELECT day_ms, string_agg(concat(model, '=', c), ',' ORDER BY model) AS models, round(CAST(sum(c) AS BIGINT) / 100.0::DOUBLE, 2) AS total_cw FROM (SELECT ts_unix_ms // 86400000 * 86400000 AS day_ms, model, CAST(sum(cw100) AS BIGINT) AS c FROM turns WHERE model <> 'm-unpriced' GROUP BY 1, 2) GROUP BY 1"),
    "price_quotes": turns("SELECT event_id, k % 4 < 3 AS found, CASE WHEN k % 4 < 2 THEN k / 4.0::DOUBLE END AS input, CASE WHEN k % 4 < 2 THEN k * 5.0::DOUBLE END AS output, CASE WHEN k % 4 = 2 THEN 'none' END AS error FROM tk"),
    "account_names": turns("SELECT event_id, CASE WHEN k % 5 = 0 THEN concat('label ', k) WHEN k % 3 > 0 AND k % 2 = 0 THEN concat('u', k, '@x.org (org)') WHEN k % 3 > 0 THEN concat('u', k, '@x.org') WHEN k % 2 = 0 THEN 'org' ELSE concat('account ', account_id) END AS name FROM tk"),
    "corrected_flags": sql.meter("SELECT id, account_id, bucket, ts_unix_ms, pct, reset_ms, saturated, reset_detected, valid FROM flags"),
    "hook_outcomes": turns(f"SELECT hook_id, CASE WHEN status <> 'pending' THEN status WHEN event_id IS NOT NULL THEN 'fired' WHEN expires_ms <= {_E} + 30 * {_D} THEN 'expired' ELSE 'pending' END AS status, event_id FROM ho", HOOKS),
    "delta_resumed": turns("SELECT file, CAST(sum(lines) AS BIGINT) AS records, max(ts_unix_ms) AS max_ms, arg_max(cwd, struct_pack(a := ts_unix_ms, b := turn_idx)) FILTER (WHERE cwd <> '') AS cwd FROM x WHERE new GROUP BY 1", DELTA),
    "discovered_files": turns(
        "SELECT path, shape, owner, outcome, CASE WHEN outcome = 'read' THEN lines ELSE 0 END AS lines FROM (SELECT *, CASE WHEN n % 3 = 0 THEN 'unchanged' WHEN shape <> 'top_level' AND n % 4 = 2 THEN 'unlinked' ELSE 'read' END AS outcome FROM tree) JOIN many USING (session_uuid) UNION ALL SELECT 'p0/tiny.jsonl', 'top_level', 'tiny', 'small', 0",
        TREE,
    ),
    "replaced_sessions": turns(
        f"""SELECT name, session_uuid, count(*) AS rows, max(ts_unix_ms) AS last_ms FROM (
        SELECT 'turns' AS name, session_uuid, ts_unix_ms FROM turns WHERE turn_idx < {_few}
        UNION ALL SELECT 'compactions', file, ts_unix_ms FROM (SELECT *, file AS session_uuid FROM comp) WHERE line < 8 * {_few}
        UNION ALL SELECT 'prompts', session_uuid, ts_unix_ms FROM (SELECT session_uuid, ts_unix_ms, turn_idx FROM tk WHERE model = 'm-small' QUALIFY row_number() OVER (PARTITION BY session_uuid, ts_unix_ms ORDER BY turn_idx) = 1) WHERE turn_idx < {_few}
        UNION ALL SELECT 'signals', session_uuid, ts_unix_ms FROM (SELECT *, file AS session_uuid FROM sig) s WHERE ts_unix_ms <= coalesce((SELECT max(t.ts_unix_ms) FROM turns t WHERE t.session_uuid = s.session_uuid AND t.turn_idx < {_few.replace('session_uuid', 't.session_uuid')}), -1)
        ) GROUP BY 1, 2""",
        reports_sql.COMPACT + ", " + reports_sql.SIGNALS,
    ),
}
