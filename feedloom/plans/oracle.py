"""DuckDB oracle SQL, one string per named query.

Each string is a CTE prefix of fixture views (FIXTURES.md section B, written
independently of the PySpark code) followed by the query. Column names equal
those of the Spark result.
"""

from __future__ import annotations

FX = {
    "fx_invocations": """
SELECT event_id + 1 AS id,
  concat('skill-', lpad(CAST(5 + user_id % 23 AS STRING), 2, '0')) AS skill_name,
  concat('/repo/', event_type) AS working_directory,
  split(CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE 'typescript,fastify' END, ',') AS tech_stack,
  ts AS started_at,
  CASE event_type WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'failed' ELSE 'unknown' END AS status
FROM events WHERE event_type <> 'error'""",
    "fx_corrections": """
SELECT row_number() OVER (ORDER BY event_id) AS id,
  concat('skill-', lpad(CAST(user_id % 20 AS STRING), 2, '0')) AS skill_name,
  '/repo/project' AS working_directory,
  split(CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE 'typescript,fastify' END, ',') AS tech_stack,
  props AS ai_output,
  concat('fix, "', CAST(event_id AS STRING), '"') AS user_correction_input,
  CAST(event_id * 37 % 101 AS DOUBLE) / 100 AS classification_confidence,
  event_id * 37 % 101 BETWEEN 60 AND 79 AS needs_batch_review,
  ts AS created_at
FROM events WHERE event_type = 'error'""",
    "fx_turn_pairs": """
SELECT conv_id, turn, prev_text AS ai_output, text AS user_input
FROM (SELECT conv_id, turn, role, text,
        lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role,
        lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_text
      FROM conversations) t
WHERE role = 'user' AND prev_role = 'assistant'""",
    "fx_upgrade_posts": """
SELECT o_orderkey AS arrival,
  concat('https://example.com/mr/', CAST(o_orderkey % 97 AS STRING)) AS mr_url,
  concat('[skills-feedback][', CASE WHEN o_orderkey % 4 = 0 THEN 'major' ELSE 'minor' END,
         '][feedback:', CAST(1 + o_orderkey * 7 % 150 AS STRING), '-',
         CAST(1 + o_orderkey * 7 % 150 + o_orderkey % 40 AS STRING), '] skill updates') AS title,
  concat('hash', CAST(o_orderkey AS STRING)) AS head_commit_hash,
  CASE WHEN o_orderkey % 4 = 0 THEN 'major' ELSE 'minor' END AS iteration_type,
  1 + o_orderkey * 7 % 150 AS feedback_id_start,
  1 + o_orderkey * 7 % 150 + o_orderkey % 40 AS feedback_id_end,
  CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'P' THEN 'closed' ELSE 'open' END AS status,
  o_orderdate AS opened_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '1' DAY END AS merged_at
FROM orders""",
    "fx_scopes": """
SELECT concat('scope-', CAST(n_nationkey AS STRING)) AS feedback_scope,
  concat('http://feedback', CAST(n_nationkey AS STRING), '.dev.lan:4321') AS feedback_server_url,
  split(concat('skill-', lpad(CAST(n_nationkey % 20 AS STRING), 2, '0'), ',skill-',
               lpad(CAST(20 + n_nationkey % 8 AS STRING), 2, '0')), ',') AS reportable_skills
FROM nation""",
    "fx_last_seen": """
SELECT concat('scope-', CAST(n_nationkey AS STRING)) AS scope,
  CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE concat('hash', CAST(n_nationkey AS STRING)) END AS head_commit_hash
FROM nation""",
    "fx_raw_posts": """
SELECT event_id AS arrival,
  concat('{"skill_name":',
    CASE WHEN event_id % 17 = 0 THEN '""' WHEN event_id % 19 = 0 THEN '"feedback-rules-zeta"'
         WHEN event_id % 23 = 0 THEN '123' ELSE concat('"skill-', CAST(user_id % 20 AS STRING), '"') END,
    ',"working_directory":"/repo/project","tech_stack":',
    CASE WHEN event_id % 11 = 0 THEN '"typescript"' WHEN event_id % 7 = 0 THEN '[]' ELSE '["typescript","fastify"]' END,
    ',"ai_output":"wrong","user_correction_input":"no","classification_confidence":',
    CASE WHEN event_id % 13 = 0 THEN '1.5' WHEN event_id % 29 = 0 THEN '"0.9"'
         ELSE concat('0.', lpad(CAST(event_id * 37 % 100 AS STRING), 2, '0')) END,
    ',"needs_batch_review":false,"extra":1,"created_at":"2024-01-',
    lpad(CAST(1 + event_id % 28 AS STRING), 2, '0'), 'T',
    lpad(CAST(event_id % 24 AS STRING), 2, '0'), ':00:00',
    CASE WHEN event_id % 31 = 0 THEN '+08:00' ELSE '.000Z' END, '"}') AS payload, user_id
FROM events""",
}


def with_fx(names: list[str], body: str) -> str:
    """``WITH <fixtures>`` then ``body``; a body starting with ``,`` adds more CTEs."""
    ctes = ",\n".join(f"{n} AS ({FX[n]}\n)" for n in names)
    return f"WITH {ctes}\n{body.strip()}" if names else body.strip()


SQL: dict[str, str] = {}


def register(name: str, fx: list[str], body: str) -> None:
    SQL[name] = with_fx(fx, body)


register("skill_stats", ["fx_invocations", "fx_corrections"], """
, skills AS (SELECT skill_name FROM fx_invocations UNION SELECT skill_name FROM fx_corrections),
inv AS (SELECT skill_name, count(*) AS n FROM fx_invocations GROUP BY skill_name),
cor AS (SELECT skill_name, count(*) AS n FROM fx_corrections GROUP BY skill_name)
SELECT s.skill_name,
  CAST(coalesce(inv.n, 0) AS BIGINT) AS invocation_count,
  CAST(coalesce(cor.n, 0) AS BIGINT) AS correction_count,
  CASE WHEN coalesce(inv.n, 0) = 0 THEN 0.0 ELSE CAST(coalesce(cor.n, 0) AS DOUBLE) / inv.n END AS correction_rate
FROM skills s LEFT JOIN inv ON inv.skill_name = s.skill_name LEFT JOIN cor ON cor.skill_name = s.skill_name
ORDER BY correction_count DESC, invocation_count DESC, s.skill_name
""")


# ---------------------------------------------------------------------------
from .params import (ASSIGN_HWM, INTERVAL_DAYS, MAJOR_EVERY, PURGED_AT, RECENT_N,  # noqa: E402
                     TEXT_SIGNALS)

_PURGED = f"TIMESTAMP '{PURGED_AT.isoformat(sep=' ')}'"


def _cell(x: str) -> str:
    return (f"coalesce(CASE WHEN regexp_matches({x}, '[,\"\\n\\r]') "
            f"THEN concat('\"', replace({x}, '\"', '\"\"'), '\"') ELSE {x} END, '')")


_MRS = """
, _last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mr_url ORDER BY arrival DESC) AS rn,
                                 min(arrival) OVER (PARTITION BY mr_url) AS first_arrival
                          FROM fx_upgrade_posts) WHERE rn = 1),
fx_mrs AS (SELECT row_number() OVER (ORDER BY first_arrival, mr_url) AS id, mr_url, title, head_commit_hash,
             iteration_type, feedback_id_start, feedback_id_end, status, opened_at, merged_at,
             CAST(NULL AS TIMESTAMP) AS purged_at FROM _last)
"""

_STATS = """
, _skills AS (SELECT skill_name FROM fx_invocations UNION SELECT skill_name FROM fx_corrections),
_inv AS (SELECT skill_name, count(*) AS n FROM fx_invocations GROUP BY skill_name),
_cor AS (SELECT skill_name, count(*) AS n FROM fx_corrections GROUP BY skill_name),
_st AS (SELECT s.skill_name, CAST(coalesce(_inv.n, 0) AS BIGINT) AS invocation_count,
          CAST(coalesce(_cor.n, 0) AS BIGINT) AS correction_count
        FROM _skills s LEFT JOIN _inv ON _inv.skill_name = s.skill_name LEFT JOIN _cor ON _cor.skill_name = s.skill_name)
"""

SQL["skill_stats_join_form"] = SQL["skill_stats"]

register("totals", ["fx_invocations", "fx_corrections"], """
SELECT (SELECT count(*) FROM fx_invocations) AS invocation_count,
       (SELECT count(*) FROM fx_corrections) AS correction_count""")

register("invocations_by_skill", ["fx_invocations"],
         "SELECT skill_name, count(*) AS invocation_count FROM fx_invocations GROUP BY skill_name")
register("corrections_by_skill", ["fx_corrections"],
         "SELECT skill_name, count(*) AS correction_count FROM fx_corrections GROUP BY skill_name")
register("skill_universe", ["fx_invocations", "fx_corrections"],
         "SELECT skill_name FROM fx_invocations UNION SELECT skill_name FROM fx_corrections")

register("failure_rate", ["fx_invocations"], """
SELECT skill_name, count(*) AS invocation_count, count(*) FILTER (WHERE status = 'failed') AS failed_count,
  CAST(count(*) FILTER (WHERE status = 'failed') AS DOUBLE) / count(*) AS failure_rate
FROM fx_invocations GROUP BY skill_name""")

register("rate_label", ["fx_invocations", "fx_corrections"], _STATS + """
SELECT skill_name, invocation_count, correction_count,
  CASE WHEN invocation_count = 0 THEN '0.0%'
       ELSE concat(CAST(n // 10 AS VARCHAR), '.', CAST(n % 10 AS VARCHAR), '%') END AS rate_label
FROM (SELECT *, CAST(floor(x) AS HUGEINT) * 10 + (t // 4611686018427387904)
             + CASE WHEN 2 * (t % 4611686018427387904) >= 4611686018427387904 THEN 1 ELSE 0 END AS n
      FROM (SELECT *, 10 * CAST((x - floor(x)) * 4611686018427387904.0 AS HUGEINT) AS t
            FROM (SELECT *, coalesce(CAST(correction_count AS DOUBLE) / nullif(CAST(invocation_count AS DOUBLE), 0), 0) * CAST(100 AS DOUBLE) AS x
                  FROM _st)))""")

register("recent_corrections", ["fx_corrections"], f"""
SELECT id, skill_name, created_at FROM fx_corrections ORDER BY created_at DESC, id DESC LIMIT {RECENT_N}""")

register("corrections_in_range", ["fx_corrections"], """
SELECT id, skill_name, created_at FROM fx_corrections
WHERE created_at >= TIMESTAMP '2024-01-05 00:00:00' AND created_at < TIMESTAMP '2024-01-13 00:00:00'""")

register("corrections_in_instant_range", ["fx_corrections"], """
SELECT id, skill_name, created_at FROM fx_corrections
WHERE created_at >= TIMESTAMP '2024-01-03 06:00:00' AND created_at <= TIMESTAMP '2024-01-09 18:30:00.5'""")

_CONF_TEXT = ("CASE WHEN classification_confidence = floor(classification_confidence) "
              "THEN CAST(CAST(classification_confidence AS BIGINT) AS VARCHAR) "
              "ELSE CAST(classification_confidence AS VARCHAR) END")
_ISO = ("CASE WHEN epoch_us(created_at) % 1000 = 0 THEN strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' "
        "ELSE strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' END")

register("export_csv_lines", ["fx_corrections"], f"""
SELECT id, concat_ws(',', CAST(id AS VARCHAR), {_cell('skill_name')}, {_cell('working_directory')},
  {_cell("array_to_string(tech_stack, ';')")}, {_cell('ai_output')}, {_cell('user_correction_input')},
  {_cell(_CONF_TEXT)}, CASE WHEN needs_batch_review THEN 'true' ELSE 'false' END, {_cell(_ISO)}) AS line
FROM fx_corrections
WHERE created_at >= TIMESTAMP '2024-01-01 00:00:00' AND created_at < TIMESTAMP '2024-01-31 00:00:00'""")

register("csv_cells_documents", [], f"SELECT doc_id, {_cell('text')} AS cell FROM documents")

register("html_escape_pages", [], """
SELECT page_id, replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
  '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""")

_VALID_WHERE = ("arrival % 17 <> 0 AND arrival % 19 <> 0 AND arrival % 23 <> 0 AND arrival % 11 <> 0 "
                "AND arrival % 13 <> 0 AND arrival % 29 <> 0 AND arrival % 31 <> 0")

register("validate_posts", ["fx_raw_posts"], f"""
SELECT arrival, concat('skill-', CAST(user_id % 20 AS STRING)) AS skill_name, '/repo/project' AS working_directory,
  CASE WHEN arrival % 7 = 0 THEN '[]' ELSE '["typescript","fastify"]' END AS tech_stack_json,
  'wrong' AS ai_output, 'no' AS user_correction_input,
  CAST(concat('0.', lpad(CAST(arrival * 37 % 100 AS STRING), 2, '0')) AS DOUBLE) AS classification_confidence,
  false AS needs_batch_review,
  CAST(concat('2024-01-', lpad(CAST(1 + arrival % 28 AS STRING), 2, '0'), ' ',
              lpad(CAST(arrival % 24 AS STRING), 2, '0'), ':00:00') AS TIMESTAMP) AS created_at
FROM fx_raw_posts WHERE {_VALID_WHERE}""")

register("rejected_posts", ["fx_raw_posts"], """
, e AS (SELECT arrival, concat_ws(',',
    CASE WHEN arrival % 17 = 0 THEN 'skill_name:empty' WHEN arrival % 19 = 0 THEN NULL
         WHEN arrival % 23 = 0 THEN 'skill_name:type' END,
    CASE WHEN arrival % 11 = 0 THEN 'tech_stack:type' END,
    CASE WHEN arrival % 13 = 0 THEN 'classification_confidence:range'
         WHEN arrival % 29 = 0 THEN 'classification_confidence:type' END,
    CASE WHEN arrival % 31 = 0 THEN 'created_at:format' END) AS schema_errors
  FROM fx_raw_posts)
SELECT arrival, CASE WHEN schema_errors <> '' THEN schema_errors ELSE 'skill_name:reserved' END AS error_fields
FROM e WHERE schema_errors <> '' OR (arrival % 17 <> 0 AND arrival % 19 = 0)""")

register("assigned_ids", ["fx_raw_posts"], f"""
SELECT arrival, {ASSIGN_HWM} + row_number() OVER (ORDER BY arrival) AS id FROM fx_raw_posts WHERE {_VALID_WHERE}""")

_TITLE_RE = r"^\[skills-feedback\]\[(minor|major)\]\[feedback:([0-9]+)-([0-9]+)\]\s+.+$"
register("title_check", ["fx_upgrade_posts"], f"""
, p AS (SELECT arrival, iteration_type, feedback_id_start, feedback_id_end,
          regexp_matches(title, '{_TITLE_RE}') AS m,
          regexp_extract(title, '{_TITLE_RE}', 1) AS t,
          TRY_CAST(regexp_extract(title, '{_TITLE_RE}', 2) AS BIGINT) AS s,
          TRY_CAST(regexp_extract(title, '{_TITLE_RE}', 3) AS BIGINT) AS e
        FROM fx_upgrade_posts),
q AS (SELECT *, CASE WHEN NOT m OR s IS NULL OR e IS NULL THEN 'invalid_title' WHEN s > e THEN 'range_order' END AS perr
      FROM p)
SELECT arrival, CASE WHEN perr IS NULL THEN t END AS parsed_type, CASE WHEN perr IS NULL THEN s END AS parsed_start,
  CASE WHEN perr IS NULL THEN e END AS parsed_end,
  CASE WHEN perr IS NOT NULL THEN perr
       WHEN t <> iteration_type OR s <> feedback_id_start OR e <> feedback_id_end THEN 'title_payload_mismatch'
  END AS title_error
FROM q""")

register("mr_upsert", ["fx_upgrade_posts"], _MRS + "SELECT * FROM fx_mrs")

_UPD = """
, _upd AS (SELECT o_orderkey AS arrival, o_orderkey + 1 AS id, 'merged' AS status,
                  o_orderdate + INTERVAL '3' DAY AS merged_at FROM orders WHERE o_orderstatus = 'O'),
_lastu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY arrival DESC) AS rn FROM _upd)
           WHERE rn = 1)
"""
register("mr_status_update", ["fx_upgrade_posts"], _MRS + _UPD + """
SELECT m.id, coalesce(u.status, m.status) AS status,
  CASE WHEN u.id IS NOT NULL THEN u.merged_at ELSE m.merged_at END AS merged_at
FROM fx_mrs m LEFT JOIN _lastu u ON u.id = m.id""")

register("mr_status_errors", ["fx_upgrade_posts"], _MRS + _UPD + """
SELECT arrival, id, 'not_found' AS error FROM _upd WHERE id NOT IN (SELECT id FROM fx_mrs)""")

register("latest_mr", ["fx_upgrade_posts"], _MRS + "SELECT * FROM fx_mrs ORDER BY opened_at DESC, id DESC LIMIT 1")

register("covered_counts", ["fx_upgrade_posts", "fx_corrections"], _MRS + """
SELECT m.id, CAST(count(c.id) AS BIGINT) AS covered_count
FROM fx_mrs m LEFT JOIN fx_corrections c ON c.id BETWEEN m.feedback_id_start AND m.feedback_id_end
GROUP BY m.id""")

register("purge_eligibility", ["fx_upgrade_posts"], _MRS + """
SELECT id,
  (iteration_type = 'major' AND status = 'merged' AND merged_at IS NOT NULL AND purged_at IS NULL) AS eligible,
  CASE WHEN iteration_type <> 'major' THEN 'not_major' WHEN status <> 'merged' THEN 'not_merged'
       WHEN merged_at IS NULL THEN 'missing_merged_at' WHEN purged_at IS NOT NULL THEN 'already_purged' END
    AS refusal_reason,
  CASE WHEN purged_at IS NOT NULL THEN 'already_purged' WHEN status = 'closed' THEN 'closed'
       WHEN status <> 'merged' THEN 'not_merged' WHEN merged_at IS NULL THEN 'missing_merged_at'
       WHEN iteration_type <> 'major' THEN 'not_major' ELSE 'eligible' END AS display_reason,
  CASE WHEN status = 'merged' THEN 'Merged' WHEN status = 'closed' THEN 'Closed' ELSE 'Open' END AS status_label,
  (mr_url LIKE 'http://%' OR mr_url LIKE 'https://%') AS safe_link
FROM fx_mrs""")

_PURGE = _MRS + """
, _elig AS (SELECT * FROM fx_mrs WHERE iteration_type = 'major' AND status = 'merged' AND merged_at IS NOT NULL
                                   AND purged_at IS NULL),
_own AS (SELECT c.id AS cid, min(e.id) AS owner FROM fx_corrections c
         JOIN _elig e ON c.id BETWEEN e.feedback_id_start AND e.feedback_id_end GROUP BY c.id)
"""
register("purge_survivors", ["fx_upgrade_posts", "fx_corrections"], _PURGE + """
SELECT id, skill_name FROM fx_corrections WHERE id NOT IN (SELECT cid FROM _own)""")
register("purge_audit", ["fx_upgrade_posts", "fx_corrections"], _PURGE + f"""
SELECT row_number() OVER (ORDER BY e.id) AS id, e.id AS merge_request_id, e.feedback_id_start, e.feedback_id_end,
  CAST(coalesce(o.n, 0) AS BIGINT) AS deleted_count, {_PURGED} AS purged_at
FROM _elig e LEFT JOIN (SELECT owner, count(*) AS n FROM _own GROUP BY owner) o ON o.owner = e.id""")
register("purge_marked", ["fx_upgrade_posts", "fx_corrections"], _PURGE + f"""
SELECT id, CASE WHEN id IN (SELECT id FROM _elig) THEN {_PURGED} ELSE purged_at END AS purged_at FROM fx_mrs""")

register("integrity_violations", ["fx_upgrade_posts", "fx_corrections"], _PURGE + """
, _audit AS (SELECT row_number() OVER (ORDER BY id) AS id, id AS merge_request_id FROM _elig)
SELECT 'merge_request_posts' AS table_name, min(arrival) AS id, 'unique_mr_url' AS "check"
FROM fx_upgrade_posts GROUP BY mr_url HAVING count(*) > 1
UNION ALL SELECT 'merge_request_posts', arrival, 'range_order' FROM fx_upgrade_posts
  WHERE NOT (feedback_id_start <= feedback_id_end)
UNION ALL SELECT 'merge_request_posts', arrival, 'status' FROM fx_upgrade_posts
  WHERE status NOT IN ('open', 'merged', 'closed')
UNION ALL SELECT 'corrections', id, 'confidence_range' FROM fx_corrections
  WHERE NOT (classification_confidence BETWEEN 0 AND 1)
UNION ALL SELECT 'purge_audit', id, 'orphan_merge_request' FROM _audit
  WHERE merge_request_id NOT IN (SELECT id FROM fx_mrs)""")

register("turn_pairs", ["fx_turn_pairs"], "SELECT * FROM fx_turn_pairs")

register("confidence_tiers", ["fx_corrections"], """
SELECT id,
  CASE WHEN NOT (classification_confidence BETWEEN 0 AND 1) THEN 'invalid'
       WHEN classification_confidence >= 0.8 THEN 'report' WHEN classification_confidence >= 0.6 THEN 'review'
       ELSE 'drop' END AS tier,
  (classification_confidence >= 0.6 AND classification_confidence < 0.8) AS review_flag,
  needs_batch_review = (classification_confidence >= 0.6 AND classification_confidence < 0.8) AS flag_consistent
FROM fx_corrections""")


def _signal_sql() -> str:
    arms = []
    for name, phrases in TEXT_SIGNALS.items():
        cond = " OR ".join(f"instr(user_input, '{p}') > 0" for p in phrases)
        arms.append(f"CASE WHEN {cond} THEN '{name}' END")
    count = " + ".join(f"(CASE WHEN {a} IS NOT NULL THEN 1 ELSE 0 END)" for a in arms)
    return (f"SELECT conv_id, turn, concat_ws(',', {', '.join(arms)}) AS signals, "
            f"CAST({count} AS BIGINT) AS signal_count FROM fx_turn_pairs")


register("correction_signals", ["fx_turn_pairs"], _signal_sql())

register("tech_stack_default", ["fx_invocations"], """
SELECT id, CAST(to_json(CASE WHEN tech_stack IS NULL OR len(tech_stack) = 0 THEN ['unknown'] ELSE tech_stack END)
  AS VARCHAR) AS tech_stack_json FROM fx_invocations""")

_SS = """
, _ss AS (SELECT DISTINCT feedback_scope, unnest(reportable_skills) AS skill_name FROM fx_scopes)
"""
register("scope_conflicts", ["fx_scopes"], _SS + """
SELECT skill_name, count(DISTINCT feedback_scope) AS scope_count, min(feedback_scope) AS first_scope,
  max(feedback_scope) AS last_scope FROM _ss GROUP BY skill_name HAVING count(DISTINCT feedback_scope) > 1""")
register("scope_routing", ["fx_scopes", "fx_corrections"], _SS + """
, _owners AS (SELECT skill_name, min(feedback_scope) AS feedback_scope FROM _ss GROUP BY skill_name
              HAVING count(DISTINCT feedback_scope) = 1)
SELECT c.id, o.feedback_scope FROM fx_corrections c JOIN _owners o ON o.skill_name = c.skill_name""")
register("allow_list", ["fx_scopes", "fx_corrections", "fx_invocations"], _SS + """
SELECT s.feedback_scope, c.id FROM fx_corrections c JOIN _ss s ON s.skill_name = c.skill_name
WHERE c.skill_name IN (SELECT skill_name FROM fx_invocations)
  AND c.classification_confidence BETWEEN 0.6 AND 1""")

register("scope_checks", ["fx_scopes"], """
, _k AS (SELECT n_nationkey AS k, n_nationkey % 6 AS d, CAST(n_nationkey AS STRING) AS ks FROM nation)
SELECT feedback_scope, '' AS errors, feedback_server_url AS server_url, array_to_string(reportable_skills, ',') AS skills
FROM fx_scopes
UNION ALL
SELECT CASE WHEN d = 0 THEN concat('bad_scope_', ks) ELSE concat('broken-', ks) END,
  CASE d WHEN 0 THEN 'scope_format' WHEN 1 THEN 'url_unroutable_host' WHEN 2 THEN 'url_query'
         WHEN 3 THEN 'url_fragment' WHEN 4 THEN 'url_scheme,skills_empty' ELSE 'skills_reserved' END,
  CASE d WHEN 1 THEN 'http://0.0.0.0:4321' WHEN 2 THEN concat('http://feedback', ks, '.dev.lan:4321/?token=bad')
         WHEN 3 THEN concat('http://feedback', ks, '.dev.lan:4321/#section') WHEN 4 THEN concat('ftp://feedback', ks, '.dev.lan')
         ELSE concat('http://feedback', ks, '.dev.lan') END,
  CASE d WHEN 5 THEN 'skill-01,feedback-rules-x' WHEN 4 THEN ''
         ELSE concat('skill-', lpad(CAST(k % 20 AS STRING), 2, '0')) END
FROM _k""")

register("upgrade_decisions", ["fx_upgrade_posts", "fx_last_seen"], _MRS + """
, _lm AS (SELECT * FROM fx_mrs ORDER BY opened_at DESC, id DESC LIMIT 1),
_d AS (SELECT s.scope, s.head_commit_hash AS last_seen_hash, _lm.head_commit_hash AS latest_hash,
         CASE WHEN _lm.id IS NULL THEN 'none'
              WHEN _lm.head_commit_hash IS NULL OR _lm.head_commit_hash = '' THEN 'error_missing_hash'
              WHEN s.head_commit_hash = _lm.head_commit_hash THEN 'skip'
              WHEN _lm.status <> 'merged' THEN 'refuse' ELSE 'sync' END AS decision
       FROM fx_last_seen s LEFT JOIN _lm ON true)
SELECT scope, last_seen_hash, latest_hash, decision,
  CASE WHEN decision = 'sync' THEN latest_hash ELSE last_seen_hash END AS new_hash FROM _d""")

_MEM = f"""
, _slots AS (SELECT id, skill_name,
    CAST(floor(date_diff('day', DATE '2024-01-01', CAST(created_at AS DATE)) / {INTERVAL_DAYS}) AS BIGINT) + 1 AS slot
  FROM fx_corrections),
_mem AS (SELECT slot AS iteration_slot, 'minor' AS iteration_type, id, skill_name FROM _slots
         WHERE slot % {MAJOR_EVERY} <> 0
         UNION ALL
         SELECT CAST(ceil(slot / {MAJOR_EVERY}) AS BIGINT) * {MAJOR_EVERY}, 'major', id, skill_name FROM _slots),
_g AS (SELECT iteration_slot, iteration_type, skill_name, count(*) AS feedback_count, min(id) AS feedback_id_start,
         max(id) AS feedback_id_end FROM _mem GROUP BY iteration_slot, iteration_type, skill_name)
"""
register("iteration_skill_groups", ["fx_corrections"], _MEM + "SELECT * FROM _g")
register("iteration_summary", ["fx_corrections"], _MEM + f"""
, _s AS (SELECT iteration_slot, iteration_type, CAST(sum(feedback_count) AS BIGINT) AS feedback_count,
           min(feedback_id_start) AS feedback_id_start, max(feedback_id_end) AS feedback_id_end,
           string_agg(skill_name, ',' ORDER BY skill_name) AS skills
         FROM _g GROUP BY iteration_slot, iteration_type),
_w AS (SELECT *, DATE '2024-01-01' + CAST(((CASE WHEN iteration_type = 'major' THEN iteration_slot - {MAJOR_EVERY} + 1
                                               ELSE iteration_slot END) - 1) * {INTERVAL_DAYS} AS INTEGER) AS window_from,
              DATE '2024-01-01' + CAST(iteration_slot * {INTERVAL_DAYS} - 1 AS INTEGER) AS window_to,
              DATE '2024-01-01' + CAST(iteration_slot * {INTERVAL_DAYS} AS INTEGER) AS run_day
       FROM _s)
SELECT iteration_slot, iteration_type, feedback_count, feedback_id_start, feedback_id_end, skills,
  strftime(window_from, '%Y-%m-%d') AS window_from, strftime(window_to, '%Y-%m-%d') AS window_to,
  concat('[skills-feedback][', iteration_type, '][feedback:', CAST(feedback_id_start AS VARCHAR), '-',
         CAST(feedback_id_end AS VARCHAR), '] ', strftime(run_day, '%Y-%m-%d'), ' ',
         CASE WHEN iteration_type = 'major' THEN 'skill review' ELSE 'skill updates' END) AS mr_title,
  concat('skills-feedback/', iteration_type, '-', strftime(window_from, '%Y-%m-%d'), '-',
         strftime(window_to, '%Y-%m-%d')) AS branch
FROM _w""")

register("skill_catalog", [], r"""
SELECT doc_id, name FROM (
  SELECT doc_id, regexp_replace(regexp_extract(concat('name: ', source, chr(10), text), '(?m)^name:\s*(.+)$', 1),
                                '^\s+|\s+$', '', 'g') AS name
  FROM documents) t
WHERE name <> '' AND NOT regexp_matches(name, '^feedback-rules(?:-.+)?$')""")

SQL["stream_ingest"] = SQL["validate_posts"]
SQL["stream_stats"] = SQL["skill_stats"]
SQL["stream_mr"] = SQL["mr_upsert"]
register("stream_windows", ["fx_corrections"], f"""
, _w AS (SELECT CAST(floor(date_diff('day', DATE '2024-01-01', CAST(created_at AS DATE)) / {INTERVAL_DAYS}) AS BIGINT)
           AS k, id FROM fx_corrections)
SELECT TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST({INTERVAL_DAYS} * k AS INTEGER)) AS window_start,
  TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST({INTERVAL_DAYS} * k + {INTERVAL_DAYS} AS INTEGER)) AS window_end,
  count(*) AS correction_count, min(id) AS feedback_id_start, max(id) AS feedback_id_end
FROM _w GROUP BY k""")
SQL["purge_committed"] = SQL["purge_survivors"]


register("covered_counts_wide", ["fx_corrections"], """
, r AS (SELECT o_orderkey AS id, 1 + o_orderkey * 7 % 5000 AS s,
          CASE o_orderkey % 5 WHEN 0 THEN 9007199254740991 WHEN 1 THEN 1 + o_orderkey * 7 % 5000 + 100000
               ELSE 1 + o_orderkey * 7 % 5000 + o_orderkey % 400 END AS e FROM orders)
SELECT r.id, CAST(count(c.id) AS BIGINT) AS covered_count
FROM r LEFT JOIN fx_corrections c ON c.id BETWEEN r.s AND r.e GROUP BY r.id""")

_WIDE = f"""
, _wide AS (SELECT o_orderkey + 1 AS id, s, CASE o_orderkey % 20 WHEN 0 THEN 9007199254740991 WHEN 1 THEN s + 100000 ELSE s + o_orderkey % 60 END AS e,
              {_PURGED} + INTERVAL 1 HOUR * ((o_orderkey + 1) % 5) AS purged
            FROM (SELECT *, CASE WHEN o_orderkey % 20 < 2 THEN 1500 + o_orderkey * 7 % 5000 ELSE 1 + o_orderkey * 7 % 50 * 100 END AS s FROM orders)
            WHERE o_orderkey % 2 = 0 AND o_orderstatus = 'F' AND (o_orderkey + 1) % 3 < 2),
_wide_own AS (SELECT c.id AS cid, struct_extract(min({{'p': purged, 'i': w.id}}), 'i') AS owner FROM fx_corrections c JOIN _wide w ON c.id BETWEEN w.s AND w.e GROUP BY c.id)
"""
register("purge_wide_survivors", ["fx_corrections"], _WIDE + "SELECT id, skill_name FROM fx_corrections WHERE id NOT IN (SELECT cid FROM _wide_own)")
register("purge_wide_audit", ["fx_corrections"], _WIDE + """
SELECT row_number() OVER (ORDER BY purged, w.id) AS id, w.id AS merge_request_id, s AS feedback_id_start, e AS feedback_id_end,
  CAST(coalesce(n, 0) AS BIGINT) AS deleted_count, purged AS purged_at
FROM _wide w LEFT JOIN (SELECT owner, count(*) AS n FROM _wide_own GROUP BY owner) o ON o.owner = w.id""")

SQL["url_checks"] = """
SELECT o_orderkey AS id, w[1] = 'y' AS is_http, nullif(replace(w[2], '%s', CAST(o_orderkey AS VARCHAR)), '') AS canonical
FROM (SELECT o_orderkey, CASE o_orderkey % 16
  WHEN 0 THEN ['y', 'http://my_host/x%s'] WHEN 1 THEN ['y', 'http://git_lab.internal:3000/mr/%s']
  WHEN 2 THEN ['y', 'https://h/a%20b%s'] WHEN 3 THEN ['y', 'https://h/x?q={%s}'] WHEN 4 THEN ['y', 'https://h/|a%s']
  WHEN 5 THEN ['y', 'https://例子.cn/mr/%s'] WHEN 6 THEN ['y', 'http://ex.com/b/%s/'] WHEN 7 THEN ['y', 'http://h/%s']
  WHEN 8 THEN ['y', 'https://h:8443/%s#f'] WHEN 9 THEN ['n', 'ftp://h/%s'] WHEN 13 THEN ['y', 'https://h/%s']
  WHEN 14 THEN ['y', 'http://h%s/'] ELSE ['n', ''] END AS w FROM orders)"""

SQL["skill_lists"] = "SELECT o_orderkey AS id, concat('a b|技能|', CAST(o_orderkey AS VARCHAR)) AS skills FROM orders"

register("purge_refusals", ["fx_upgrade_posts"], _MRS + """
, q AS (SELECT DISTINCT o_orderkey % 150 AS id FROM orders),
w AS (SELECT q.id, CASE WHEN m.id IS NULL THEN 'not_found' WHEN iteration_type <> 'major' THEN 'not_major'
         WHEN status <> 'merged' THEN 'not_merged' WHEN merged_at IS NULL THEN 'missing_merged_at' END AS reason
      FROM q LEFT JOIN fx_mrs m ON m.id = q.id)
SELECT id, reason FROM w WHERE reason IS NOT NULL""")

register("purge_audit_committed", ["fx_upgrade_posts", "fx_corrections"], _PURGE + """
SELECT e.id AS merge_request_id, e.feedback_id_start, e.feedback_id_end, CAST(count(o.cid) AS BIGINT) AS deleted_count
FROM _elig e LEFT JOIN _own o ON o.owner = e.id
WHERE e.id IN (SELECT o_orderkey % 150 FROM orders) GROUP BY ALL""")

register("mr_by_id", ["fx_upgrade_posts"], _MRS + "SELECT * FROM fx_mrs WHERE id = 5")


_CHANGES = _MRS + """
, _posted AS (SELECT mr_url, min(arrival) * 2 AS first_at, max(arrival) * 2 AS last_at FROM fx_upgrade_posts GROUP BY mr_url),
_sent AS (SELECT 2 * o_orderkey + 1 AS arrival, 1 + o_orderkey * 13 % 120 AS id,
            CASE WHEN o_orderkey % 3 = 0 THEN 'closed' ELSE 'merged' END AS status,
            CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS merged_at FROM orders),
_placed AS (SELECT s.*, p.last_at, coalesce(s.arrival > p.first_at, false) AS found
            FROM _sent s LEFT JOIN fx_mrs m ON m.id = s.id LEFT JOIN _posted p ON p.mr_url = m.mr_url),
_final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY arrival DESC) AS rn FROM _placed
                          WHERE found AND arrival > last_at) WHERE rn = 1)
"""
register("stream_mr_status", ["fx_upgrade_posts"], _CHANGES + """
SELECT m.id, m.mr_url, m.title, coalesce(f.status, m.status) AS status,
  CASE WHEN f.id IS NULL THEN m.merged_at ELSE f.merged_at END AS merged_at
FROM fx_mrs m LEFT JOIN _final f ON f.id = m.id""")
register("stream_mr_status_errors", ["fx_upgrade_posts"], _CHANGES + "SELECT arrival, id, 'not_found' AS error FROM _placed WHERE NOT found")



# ---- ingest, constraints, layouts: forms and defects restated from the fixtures' definition ----

def _case(expr: str, values: list[str | None]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None) + " END"


_INVOCATION_ERRORS = [None, None, "status:enum", "finished_at:format", "skill_name:reserved", "skill_name:empty", "skill_name:missing", "tech_stack:element",
                      "$:type", "started_at:format", "$:type", "working_directory:missing,status:type"]
SQL["ingest_invocations"] = f"""
SELECT arrival, {ASSIGN_HWM} + row_number() OVER (ORDER BY arrival) AS id, 's' || arrival AS skill_name,
  CASE arrival % 12 WHEN 0 THEN 'success' ELSE 'failed' END AS status,
  CASE arrival % 12 WHEN 1 THEN TIMESTAMP '2024-01-05 07:00:00.5' END AS finished_at
FROM (SELECT event_id + 1 AS arrival FROM events) WHERE arrival % 12 < 2"""


def _payload(name: str, forms: int) -> str:
    from ..sources import fixtures

    texts = getattr(fixtures, name)
    return "replace(CASE arrival % {} {} END, '%s', CAST(arrival AS VARCHAR))".format(
        forms, " ".join("WHEN {} THEN '{}'".format(i, t) for i, t in enumerate(texts)))


SQL["rejected_invocations"] = f"""
SELECT arrival, {_payload("INVOCATION_FORMS", 12)} AS payload, {_case("arrival % 12", _INVOCATION_ERRORS)} AS error_fields
FROM (SELECT event_id + 1 AS arrival FROM events) WHERE arrival % 12 >= 2"""

_MR_ERRORS = [None, None, "feedback_id_end:range_order", "merged_at:merged_at_status", "merged_at:merged_at_status", "title:title_payload_mismatch",
              "title:invalid_title", "title:range_order", "feedback_id_start:range", "feedback_id_start:type", "feedback_id_start:type", "mr_url:url",
              "iteration_type:enum,status:missing", "feedback_id_end:type"]
SQL["ingest_mr_posts"] = """
SELECT arrival, CASE arrival % 14 WHEN 0 THEN 'major' ELSE 'minor' END AS iteration_type, arrival AS feedback_id_start,
  arrival * 10 + 9 AS feedback_id_end, CASE arrival % 14 WHEN 0 THEN 'open' ELSE 'merged' END AS status,
  CASE arrival % 14 WHEN 1 THEN TIMESTAMP '2024-01-06 00:00:00' END AS merged_at
FROM (SELECT o_orderkey + 1 AS arrival FROM orders) WHERE arrival % 14 < 2"""
SQL["rejected_mr_posts"] = f"""
SELECT arrival, {_payload("MR_FORMS", 14)} AS payload, {_case("arrival % 14", _MR_ERRORS)} AS error_fields
FROM (SELECT o_orderkey + 1 AS arrival FROM orders) WHERE arrival % 14 >= 2"""
_STATUS_ERRORS = [None, None, "merged_at:merged_at_status", None, "id:invalid_id", "id:not_found", "status:enum", "id:invalid_id", "merged_at:merged_at_status"]
SQL["ingest_status_updates"] = """
SELECT arrival, 1 + arrival % 90 AS id, CASE arrival % 9 WHEN 0 THEN 'merged' WHEN 1 THEN 'closed' ELSE 'open' END AS status,
  CASE arrival % 9 WHEN 0 THEN TIMESTAMP '2024-01-06 00:00:00' END AS merged_at
FROM (SELECT o_orderkey + 1 AS arrival FROM orders) WHERE arrival % 9 IN (0, 1, 3)"""
SQL["rejected_status_updates"] = f"""
SELECT arrival, {_payload("STATUS_FORMS", 9)} AS payload, {_case("arrival % 9", _STATUS_ERRORS)} AS error_fields
FROM (SELECT o_orderkey + 1 AS arrival FROM orders) WHERE arrival % 9 NOT IN (0, 1, 3)"""

# Mandatory columns of the stored tables after the id, in order; failed checks by id % 101.
_MANDATORY = {
    "invocations": "skill_name working_directory tech_stack started_at status",
    "corrections": "skill_name working_directory tech_stack ai_output user_correction_input classification_confidence needs_batch_review created_at",
    "merge_requests": "mr_url title head_commit_hash iteration_type feedback_id_start feedback_id_end status opened_at",
    "purge_audit": "merge_request_id feedback_id_start feedback_id_end deleted_count purged_at",
}
_BROKEN = {"invocations": {50: "check:status"}, "corrections": {51: "check:confidence_range", 52: "check:confidence_range"},
           "merge_requests": {50: "check:status", 53: "check:iteration_type", 54: "check:range_order"}, "purge_audit": {80: "references:merge_request_id"}}


def _violations_sql() -> str:
    parts = []
    for t, cols in _MANDATORY.items():
        ids = "SELECT event_id + 1 AS id FROM events" if t in ("invocations", "corrections") else "SELECT o_orderkey + 1 AS id FROM orders"
        found = {i + 1: f"not_null:{c}" for i, c in enumerate(cols.split())} | _BROKEN[t] | {70: "unique:id"}
        for m, check in found.items():
            parts.append(f"SELECT '{t}' AS table_name, id, '{check}' AS \"check\" FROM ({ids}) WHERE id % 101 = {m}")
        if t == "merge_requests":
            parts.append(f"SELECT '{t}', min(id), 'unique:mr_url' FROM ({ids}) WHERE id % 101 = 60 HAVING count(*) > 1")
            parts.append(f"SELECT '{t}', id, 'unique:mr_url' FROM ({ids}) WHERE id % 101 = 70")
    return "\nUNION ALL ".join(parts)


SQL["constraint_violations"] = _violations_sql()
SQL["corrections_by_day"] = SQL["corrections_in_range"]
SQL["export_by_day"] = SQL["export_csv_lines"]
SQL["purge_by_day"] = SQL["purge_survivors"]
SQL["stream_iterations"] = SQL["iteration_summary"]
register("stored_rows", ["fx_corrections"], "SELECT id, array_to_string(tech_stack, '|') AS tech_stack, needs_batch_review FROM fx_corrections")
register("corrections_in_id_range", ["fx_corrections"], "SELECT id, skill_name FROM fx_corrections WHERE id BETWEEN 20 AND 120")
register("count_in_id_range", ["fx_corrections"], 'SELECT count(*) AS "count" FROM fx_corrections WHERE id BETWEEN 20 AND 120')
_ANY_SIGNAL = " OR ".join(f"instr(text, '{p}') > 0" for phrases in TEXT_SIGNALS.values() for p in phrases)
SQL["reportable_turns"] = f"SELECT conv_id, turn FROM conversations WHERE role = 'user' AND (turn % 3 = 0 OR {_ANY_SIGNAL})"
SQL["skill_files"] = "SELECT DISTINCT source AS path, source AS name FROM documents WHERE source NOT LIKE '%3'"
register("scope_manifests", ["fx_scopes"], """
SELECT feedback_scope, feedback_server_url, array_to_string(reportable_skills, ',') AS skills, feedback_scope AS file FROM fx_scopes""")
SQL["skill_list_files"] = """
SELECT CAST(n_nationkey AS BIGINT) AS list, CASE n_nationkey % 4 WHEN 0 THEN 'a,skill-' || n_nationkey WHEN 1 THEN 'skill-' || n_nationkey WHEN 3 THEN '' END AS skills
FROM nation"""

SQL["turn_pairs_long"] = """
SELECT conv_id, turn, prev_text AS ai_output, text AS user_input
FROM (SELECT *, lag(role) OVER w AS prev_role, lag(text) OVER w AS prev_text
      FROM (SELECT CAST(conv_id AS BIGINT) % 2 AS conv_id, CAST(conv_id AS BIGINT) * 64 + turn AS turn, role, text FROM conversations)
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND prev_role = 'assistant'"""
_HOT = _SS + """, _hot AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'skill-07' ELSE skill_name END AS skill_name FROM fx_corrections)
"""
register("scope_routing_hot", ["fx_scopes", "fx_corrections"], _HOT + """
, _owners AS (SELECT skill_name, min(feedback_scope) AS feedback_scope FROM _ss GROUP BY skill_name HAVING count(DISTINCT feedback_scope) = 1)
SELECT c.id, o.feedback_scope FROM _hot c JOIN _owners o ON o.skill_name = c.skill_name""")
register("allow_list_hot", ["fx_scopes", "fx_corrections", "fx_invocations"], _HOT + """
SELECT s.feedback_scope, c.id FROM _hot c JOIN _ss s ON s.skill_name = c.skill_name WHERE c.skill_name IN (SELECT skill_name FROM fx_invocations)""")
register("upgrade_decisions_all", ["fx_last_seen"], """
, n(newest, hash, status) AS (VALUES ('none', NULL, NULL), ('no_hash', '', 'merged'), ('open', 'hash1', 'open'), ('merged', 'hash2', 'merged'), ('closed', 'hash4', 'closed')),
_d AS (SELECT newest, scope, hash, head_commit_hash,
         CASE WHEN newest = 'none' THEN 'none' WHEN hash = '' THEN 'error_missing_hash' WHEN head_commit_hash = hash THEN 'skip'
              WHEN status <> 'merged' THEN 'refuse' ELSE 'sync' END AS decision FROM fx_last_seen, n)
SELECT newest, scope, decision, CASE WHEN decision = 'sync' AND length(scope) = 7 THEN hash ELSE head_commit_hash END AS new_hash FROM _d""")
SQL["purge_reasons"] = """
SELECT id, major AND status = 'merged' AND merged AND NOT purged AS eligible,
  CASE WHEN NOT major THEN 'not_major' WHEN status <> 'merged' THEN 'not_merged' WHEN NOT merged THEN 'missing_merged_at' WHEN purged THEN 'already_purged' END
    AS refusal_reason,
  CASE WHEN purged THEN 'already_purged' WHEN status = 'closed' THEN 'closed' WHEN status <> 'merged' THEN 'not_merged' WHEN NOT merged THEN 'missing_merged_at'
       WHEN NOT major THEN 'not_major' ELSE 'eligible' END AS display_reason
FROM (SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS major, CASE o_orderkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'merged' ELSE 'closed' END AS status,
        o_orderkey % 5 < 3 AS merged, o_orderkey % 7 < 2 AS purged FROM orders)"""
SQL["tech_stack_empty"] = "SELECT event_id AS id, CASE WHEN event_id % 4 = 1 THEN 'a|b' ELSE 'unknown' END AS tech_stack FROM events"
register("review_flags", ["fx_corrections"], """
SELECT id, (needs_batch_review <> (id % 7 = 0)) = (classification_confidence >= 0.6 AND classification_confidence < 0.8) AS flag_consistent FROM fx_corrections""")
SQL["export_as_sent"] = """
SELECT event_id AS id, event_id || ',s' || event_id || ',/r,a;b,"x, y",no,0.5,false,2024-01-05T06:07' || CASE event_id % 5 WHEN 0 THEN 'Z' WHEN 1 THEN ':08Z' WHEN 2 THEN ':08.5Z'
  WHEN 3 THEN ':08.123456789Z' ELSE ':08.000Z' END AS line FROM events"""
