"""DuckDB oracle SQL for every registered query (see ``__spark_entry__``)."""

from __future__ import annotations

from usertrail.constants import ALIASES
from usertrail.operators.normalize import hmac_pads
from usertrail.plans.oracle import (
    ev_customer,
    ev_named,
    ev_overflow,
    ev_raw,
    ev_untidy,
    fam_events,
    families,
    power,
    profiles,
    sessions,
    with_,
)

TS = "'%Y-%m-%d %H:%M:%S'"
AS_OF = "DATE '2024-03-01'"


def _core(ev: str, gap: int = 30) -> str:
    return with_(ev, families(), sessions(gap), fam_events(), profiles())


def _attrs() -> str:
    """CTE ua(user_id, key, value): first non-null attribute value in time order."""
    return """
ua AS (
  SELECT user_id, 'c_nationkey' AS key,
         CAST(first(c_nationkey ORDER BY ts, event_id) FILTER (WHERE c_nationkey IS NOT NULL) AS VARCHAR) AS value
  FROM ev WHERE user_id IS NOT NULL GROUP BY user_id
  UNION ALL
  SELECT user_id, 'c_mktsegment',
         CAST(first(c_mktsegment ORDER BY ts, event_id) FILTER (WHERE c_mktsegment IS NOT NULL) AS VARCHAR)
  FROM ev WHERE user_id IS NOT NULL GROUP BY user_id)"""


def _cohort_members() -> str:
    return "cm AS (SELECT user_id FROM ua WHERE key = 'c_mktsegment' AND coalesce(value, '') = 'BUILDING')"


def _alias_rows() -> str:
    return ", ".join(f"('{role}', '{name}')" for role, names in ALIASES.items() for name in names)


_PROFILE_COLS = "user_id, events, sessions, first_seen, last_seen"

ORACLE: dict[str, str] = {}

# ---- N / R -------------------------------------------------------------------
ORACLE["normalize_events"] = f"""
SELECT CAST(user_id AS VARCHAR) AS user_id, event_id, coalesce(strftime(ts, {TS}), '') AS ts,
       event_type AS event_name
FROM events"""

ORACLE["normalize_epoch_ms"] = f"""
SELECT CAST(user_id AS VARCHAR) AS user_id, event_id,
       strftime(make_timestamp((epoch_us(ts) // 1000) * 1000), {TS}) AS ts
FROM events"""

ORACLE["normalize_epoch_s"] = f"""
SELECT CAST(user_id AS VARCHAR) AS user_id, event_id,
       strftime(make_timestamp((epoch_us(ts) // 1000000) * 1000000), {TS}) AS ts
FROM events"""

ORACLE["display_timezone"] = f"""
SELECT CAST(user_id AS VARCHAR) AS user_id,
       strftime(timezone('America/New_York', min(ts) AT TIME ZONE 'UTC'), {TS}) AS first_seen,
       strftime(timezone('America/New_York', max(ts) AT TIME ZONE 'UTC'), {TS}) AS last_seen
FROM events WHERE user_id IS NOT NULL GROUP BY 1"""

ORACLE["resolve_schema_alias"] = f"""
WITH cols AS (SELECT column_name, ordinal_position FROM information_schema.columns
              WHERE table_name = 'events'),
al(role, alias) AS (VALUES {_alias_rows()}),
m AS (SELECT al.role, cols.column_name, cols.ordinal_position
      FROM cols JOIN al ON lower(trim(cols.column_name)) = al.alias)
SELECT role, "column", CASE "column" WHEN 'ts' THEN (SELECT count(ts) FROM events) WHEN 'user_id' THEN (SELECT count(user_id) FROM events)
       ELSE (SELECT count(event_type) FROM events) END AS n_values
FROM (SELECT role, arg_min(column_name, ordinal_position) AS "column" FROM m GROUP BY role)"""

# ---- S (round trips through CSV / TSV / JSON / JSONL) -------------------------
_ROUND_TRIP = with_(ev_raw(), sessions(30)) + f"""
SELECT user_id, count(*) AS events, max(session_no) AS sessions,
       strftime(min(ts), {TS}) AS first_seen, strftime(max(ts), {TS}) AS last_seen
FROM se GROUP BY user_id"""
for _k in ("read_csv", "read_tsv", "read_json", "read_jsonl"):
    ORACLE[_k] = _ROUND_TRIP

# ---- C -----------------------------------------------------------------------
_EXTRAS = ("event_id", "value", "props", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def _classify_sql() -> str:
    parts = []
    for c in _EXTRAS:
        parts.append(f"""
  SELECT '{c}' AS "column",
         count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS nu,
         (SELECT bool_and(k) FROM (SELECT count(DISTINCT {c}) <= 1 AS k FROM ev GROUP BY user_id)) AS const
  FROM ev""")
    return with_(
        ev_customer(),
        "u AS (SELECT count(DISTINCT user_id) + max(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END) AS n_users, "
        "count(*) AS n_rows FROM ev)",
        "cap AS (SELECT least(50, CAST(floor(sqrt(greatest(n_users, 1))) AS BIGINT) * 2 + 1) AS cap, n_rows FROM u)",
        "st AS (" + " UNION ALL ".join(parts) + ")",
    ) + """
SELECT "column", CASE WHEN nu > 0.8 * n_rows THEN 'skip'
                      WHEN regexp_matches(lower("column"), '^(user_|u_)') THEN 'attr'
                      WHEN const AND nu <= cap THEN 'attr' ELSE 'prop' END AS class
FROM st, cap"""


ORACLE["classify_columns"] = _classify_sql()

ORACLE["user_attributes"] = with_(ev_customer(), _attrs()) + """
SELECT user_id, key, value FROM ua WHERE value IS NOT NULL"""

ORACLE["attribute_domain"] = with_(ev_customer()) + """
SELECT DISTINCT 'c_nationkey' AS key, CAST(c_nationkey AS VARCHAR) AS value FROM ev WHERE c_nationkey IS NOT NULL
UNION ALL
SELECT DISTINCT 'c_mktsegment', CAST(c_mktsegment AS VARCHAR) FROM ev WHERE c_mktsegment IS NOT NULL"""

ORACLE["event_properties"] = with_(ev_customer()) + """
SELECT event_id, key, value FROM (
  SELECT event_id, 'value' AS key, CAST(value AS VARCHAR) AS value FROM ev
  UNION ALL SELECT event_id, 'props', props FROM ev
  UNION ALL SELECT event_id, 'c_name', c_name FROM ev
  UNION ALL SELECT event_id, 'c_acctbal', CAST(c_acctbal AS VARCHAR) FROM ev
) WHERE value IS NOT NULL"""

ORACLE["redact_columns"] = with_(ev_customer(), _attrs()) + """
SELECT user_id, key, CASE WHEN key = 'c_mktsegment' THEN '<redacted>' ELSE value END AS value
FROM ua WHERE value IS NOT NULL OR key = 'c_mktsegment'"""

# ---- F -----------------------------------------------------------------------
_FAMILY_DIM = """
SELECT nm.event_name, nm.n, coalesce(fd.family, 'other') AS family FROM nm LEFT JOIN fd USING (event_name)"""
ORACLE["event_families"] = with_(ev_named(), families()) + _FAMILY_DIM
ORACLE["event_families_overflow"] = with_(ev_overflow(), families()) + _FAMILY_DIM

ORACLE["family_registry"] = with_(ev_overflow(), families()) + """
SELECT fam AS family, upper(substr(fam, 1, 1)) || substr(fam, 2) AS label FROM kp
UNION ALL
SELECT 'other', 'Other' WHERE EXISTS (SELECT 1 FROM fd WHERE family = 'other')
                           OR (SELECT count(DISTINCT fam) FROM cd WHERE fam IS NOT NULL) > 12"""

ORACLE["family_counts"] = _core(ev_named()) + """
SELECT user_id, family, count(*) AS count FROM fe GROUP BY user_id, family"""

# ---- SS ----------------------------------------------------------------------
for _gap in (30, 1440):
    ORACLE[f"sessionize_gap_{_gap}"] = with_(ev_raw(), sessions(_gap)) + """
SELECT user_id, event_id, session_no, user_id || '_s' || CAST(session_no AS VARCHAR) AS session_id,
       is_start = 1 AS is_start
FROM se"""

ORACLE["sessions_by_column"] = """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS user_id, ts, event_id,
                  coalesce(CAST(CAST(trunc(value) AS BIGINT) % 3 AS VARCHAR), '') AS sid
           FROM events WHERE user_id IS NOT NULL),
l AS (SELECT *, row_number() OVER w AS rn, lag(sid) OVER w AS psid FROM e
      WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id)),
s AS (SELECT *, sum(CASE WHEN rn = 1 OR sid <> psid THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id ROWS UNBOUNDED PRECEDING) AS sno
      FROM l)
SELECT user_id, event_id, CAST(sno AS BIGINT) AS session_no, sid AS session_id FROM s"""

ORACLE["stream_column_sessions"] = ORACLE["sessions_by_column"].replace(
    "AS user_id, ts,", "AS user_id, CASE WHEN event_id % 97 <> 13 THEN ts END AS ts,", 1)

ORACLE["session_table"] = with_(ev_raw(), sessions(30)) + f"""
SELECT user_id, user_id || '_s' || CAST(session_no AS VARCHAR) AS session_id,
       strftime(min(ts), {TS}) AS start, strftime(max(ts), {TS}) AS "end", count(*) AS n_events
FROM se GROUP BY user_id, session_no"""

ORACLE["session_window_agg"] = with_(ev_raw(), sessions(30)) + f"""
SELECT user_id, strftime(min(ts), {TS}) AS start,
       strftime(max(ts) + INTERVAL 30 MINUTE, {TS}) AS "end", count(*) AS n_events
FROM se GROUP BY user_id, session_no"""

ORACLE["session_timeline"] = _core(ev_named()) + """
SELECT user_id, user_id || '_s' || CAST(session_no AS VARCHAR) AS session_id, pos,
       strftime(ts, '%H:%M') AS hhmm, event_name, family
FROM fe"""

ORACLE["timeline_cap"] = with_(ev_raw(), sessions(30)) + """
SELECT user_id, event_id, pos FROM se WHERE pos <= 50"""

# ---- U -----------------------------------------------------------------------
ORACLE["user_totals"] = _core(ev_named()) + f"\nSELECT {_PROFILE_COLS} FROM pr"

ORACLE["user_cap"] = with_(
    ev_named(), families(), sessions(30), fam_events(), profiles(),
    "keep AS (SELECT DISTINCT user_id FROM ev WHERE user_id IS NOT NULL ORDER BY user_id LIMIT 100)",
) + "\nSELECT user_id, events, sessions FROM pr WHERE user_id IN (SELECT user_id FROM keep)"

ORACLE["flat_timeline"] = with_(ev_named(), sessions(30)) + f"""
SELECT user_id, pos, coalesce(strftime(ts, {TS}), '') AS time, event_name FROM se"""

ORACLE["run_summary"] = _core(ev_named()) + """
SELECT (SELECT count(*) FROM ev) AS events, (SELECT count(*) FROM pr) AS users,
       (SELECT CAST(sum(sessions) AS BIGINT) FROM pr) AS sessions"""

ORACLE["top_events"] = with_(ev_named(), families()) + """
SELECT coalesce(nm.event_name, 'None') AS name, nm.n AS count, coalesce(fd.family, 'other') AS family
FROM nm LEFT JOIN fd USING (event_name) ORDER BY count DESC, name LIMIT 50"""

# ---- I -----------------------------------------------------------------------
ORACLE["recency"] = _core(ev_named()) + f"""
SELECT user_id, date_diff('day', CAST(last_ts AS DATE), {AS_OF}) AS days_since_last,
       strftime(first_ts, '%Y-%m-%d') AS first_date, strftime(last_ts, '%Y-%m-%d') AS last_date
FROM pr"""

ORACLE["longest_gap"] = with_(
    ev_named(), sessions(30),
    "st AS (SELECT user_id, session_no, epoch_us(min(ts)) // 1000000 AS sec FROM se GROUP BY 1, 2)",
    "lg AS (SELECT user_id, sec - lag(sec) OVER (PARTITION BY user_id ORDER BY session_no) AS d FROM st)",
) + """
SELECT user_id, CAST(coalesce(max(floor(d / 86400)), 0) AS BIGINT) AS longest_gap_days FROM lg GROUP BY user_id"""

ORACLE["power_score"] = _core(ev_named()) + ",\n" + power().strip() + "\nSELECT user_id, power_score FROM pw"

ORACLE["top_families"] = _core(ev_named()) + """,
uf AS (SELECT user_id, family, count(*) AS c, min(pos) AS fp FROM fe GROUP BY 1, 2),
rk AS (SELECT uf.*, pr.events, row_number() OVER (PARTITION BY uf.user_id ORDER BY c DESC, fp) AS rank
       FROM uf JOIN pr USING (user_id))
SELECT user_id, rank, family, c AS count, CAST(round_even(100.0 * c / events, 0) AS BIGINT) AS pct
FROM rk WHERE rank <= 3"""

ORACLE["stuck_signals"] = with_(ev_raw(), sessions(1440)) + """,
rn AS (SELECT *, CASE WHEN is_start = 1 OR prev_name IS DISTINCT FROM event_name THEN 1 ELSE 0 END AS rs FROM se),
rr AS (SELECT *, sum(rs) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run_id FROM rn),
runs AS (SELECT user_id, run_id, min(event_name) AS ev, min(session_no) AS sno, min(pos) AS start_pos,
                count(*) AS len FROM rr GROUP BY user_id, run_id),
q AS (SELECT * FROM runs
      WHERE ev IS NOT NULL AND len >= CASE WHEN ev IN ('message_sent', 'response_received') THEN 5 ELSE 3 END),
b AS (SELECT user_id, sno, ev, max(len) AS cnt, min(start_pos) AS fp FROM q GROUP BY user_id, sno, ev),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, fp) AS rank FROM b)
SELECT user_id, rank, user_id || '_s' || CAST(sno AS VARCHAR) AS session, ev AS event, cnt AS count
FROM t WHERE rank <= 10"""

ORACLE["family_first_seen"] = _core(ev_named()) + """
SELECT user_id, family, strftime(min(ts), '%Y-%m-%d %H:%M') AS first_seen FROM fe GROUP BY 1, 2"""

# ---- Q -----------------------------------------------------------------------
_LIST_BASE = with_(ev_customer(), families(), sessions(30), fam_events(), profiles(), power().strip(), _attrs(),
                   _cohort_members())
_LIST_COLS = "pr.user_id, pr.events, pr.sessions, pr.first_seen, pr.last_seen, pw.power_score"
for _key, _order in (("events", "pr.events DESC"), ("sessions", "pr.sessions DESC"),
                     ("first_seen", "pr.first_seen ASC"), ("last_seen", "pr.last_seen DESC")):
    ORACLE[f"list_users_by_{_key}"] = _LIST_BASE + f"""
SELECT {_LIST_COLS} FROM pr JOIN pw USING (user_id) ORDER BY {_order}, pr.user_id LIMIT 50"""

ORACLE["list_users_filtered"] = _LIST_BASE + f"""
SELECT {_LIST_COLS} FROM pr JOIN pw USING (user_id) WHERE pr.user_id IN (SELECT user_id FROM cm)
ORDER BY pr.events DESC, pr.user_id LIMIT 50"""

ORACLE["user_profile"] = _LIST_BASE + f"""
SELECT {_PROFILE_COLS}, 'family' AS kind, family AS key, CAST(count(*) AS VARCHAR) AS value
FROM fe JOIN pr USING (user_id) GROUP BY ALL
UNION ALL
SELECT {_PROFILE_COLS}, 'attr', ua.key, ua.value FROM pr JOIN ua USING (user_id) WHERE ua.value IS NOT NULL"""

ORACLE["profile_all_users"] = _LIST_BASE + f"\nSELECT {_LIST_COLS} FROM pr JOIN pw USING (user_id)"

ORACLE["analyze_user_sessions"] = with_(ev_named(), sessions(30)) + f"""
SELECT session_no, user_id || '_s' || CAST(session_no AS VARCHAR) AS session_id,
       coalesce(strftime(min(ts), {TS}), '') AS start, count(*) AS n_events
FROM se WHERE user_id = '7' GROUP BY user_id, session_no"""

ORACLE["analyze_user_top_events"] = _core(ev_named()) + """
SELECT event_name, family, count(*) AS count FROM fe WHERE user_id = '7' GROUP BY 1, 2"""

ORACLE["analyze_user_insights"] = with_(
    ev_named(), families(), sessions(30), fam_events(), profiles(), power().strip(),
    "st AS (SELECT user_id, session_no, epoch_us(min(ts)) // 1000000 AS sec FROM se GROUP BY 1, 2)",
    "lg AS (SELECT user_id, sec - lag(sec) OVER (PARTITION BY user_id ORDER BY session_no) AS d FROM st)",
    "gp AS (SELECT user_id, CAST(coalesce(max(floor(d / 86400)), 0) AS BIGINT) AS longest_gap_days "
    "FROM lg GROUP BY user_id)",
) + f"""
SELECT pr.user_id, pw.power_score, date_diff('day', CAST(pr.last_ts AS DATE), {AS_OF}) AS days_since_last,
       strftime(pr.first_ts, '%Y-%m-%d') AS first_date, strftime(pr.last_ts, '%Y-%m-%d') AS last_date,
       gp.longest_gap_days
FROM pr JOIN pw USING (user_id) JOIN gp USING (user_id) WHERE pr.user_id = '7'"""

ORACLE["user_top_events_pct"] = _core(ev_named()) + """
SELECT f.user_id, f.event_name, f.family, count(*) AS count,
       CAST(round_even(100.0 * count(*) / any_value(p.events), 0) AS BIGINT) AS pct
FROM fe f JOIN pr p USING (user_id) GROUP BY f.user_id, f.event_name, f.family"""

ORACLE["user_event_ranking"] = _core(ev_named()) + """
SELECT user_id, event_name, family, count(*) AS count FROM fe GROUP BY 1, 2, 3"""

ORACLE["taxonomy"] = _core(ev_named()) + """,
te AS (SELECT CAST(sum(events) AS BIGINT) AS total FROM pr),
top AS (SELECT coalesce(nm.event_name, 'None') AS name, nm.n AS count, coalesce(fd.family, 'other') AS family
        FROM nm LEFT JOIN fd USING (event_name) ORDER BY count DESC, name LIMIT 50)
SELECT name, count, family, CAST(CASE WHEN total > 0 THEN round_even(100.0 * count / total, 0) ELSE 0 END AS BIGINT) AS pct
FROM top, te"""

ORACLE["cohort_summary"] = _LIST_BASE + """
SELECT (SELECT count(*) FROM pr) AS total_users, count(*) AS filtered_users,
       CAST(coalesce(sum(events), 0) AS BIGINT) AS total_events,
       coalesce(avg(events), 0.0) AS avg_events_per_user,
       coalesce(CAST(median(sessions) AS DOUBLE), 0.0) AS median_sessions
FROM pr WHERE user_id IN (SELECT user_id FROM cm)"""

ORACLE["cohort_top_events"] = _LIST_BASE + """
SELECT event_name AS name, count(*) AS count FROM fe WHERE user_id IN (SELECT user_id FROM cm)
GROUP BY event_name ORDER BY count DESC, name LIMIT 20"""

ORACLE["cohort_family_distribution"] = _LIST_BASE + """
SELECT family, count(*) AS count FROM fe WHERE user_id IN (SELECT user_id FROM cm) GROUP BY family"""

ORACLE["cohort_power_users"] = _LIST_BASE + """
SELECT user_id, events, sessions, power_score FROM pw WHERE user_id IN (SELECT user_id FROM cm)
ORDER BY activity DESC, user_id LIMIT 10"""

_FIND = _core(ev_named()) + """,
oc AS (SELECT user_id, count(*) FILTER (WHERE contains(lower(event_name), 'purchase_')) AS occurrences
       FROM fe GROUP BY user_id)"""
ORACLE["find_users_by_event"] = _FIND + """
SELECT user_id, occurrences FROM oc WHERE occurrences >= 10 ORDER BY occurrences DESC, user_id LIMIT 20"""
ORACLE["find_users_total"] = _FIND + "\nSELECT count(*) AS total_matched FROM oc WHERE occurrences >= 10"

ORACLE["export_user_subset"] = _LIST_BASE + f"""
SELECT {_PROFILE_COLS} FROM pr WHERE user_id IN (SELECT user_id FROM cm)
  AND user_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey = 7)"""

ORACLE["missing_users"] = """
SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS user_id FROM customer
WHERE c_nationkey = 7 AND CAST(c_custkey AS VARCHAR) NOT IN
      (SELECT DISTINCT CAST(user_id AS VARCHAR) FROM events WHERE user_id IS NOT NULL)"""

ORACLE["quick_report_top_users"] = _core(ev_named()) + """
SELECT user_id, events, sessions FROM pr ORDER BY events DESC, user_id LIMIT 5"""

ORACLE["quick_report_top_events"] = _core(ev_named()) + """
SELECT event_name AS name, count(*) AS count FROM fe GROUP BY event_name ORDER BY count DESC, name LIMIT 5"""

# ---- V -----------------------------------------------------------------------
_HEAT = """,
hf AS (SELECT user_id, CAST(ts AS DATE) AS day, family, count(*) AS n FROM fe WHERE ts IS NOT NULL {flt}
       GROUP BY 1, 2, 3)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, CAST(sum(n) AS BIGINT) AS events,
       first(family ORDER BY n DESC, family) AS dominant_family
FROM hf GROUP BY user_id, day"""
ORACLE["activity_heatmap"] = _core(ev_named()) + _HEAT.format(flt="")
ORACLE["heatmap_one_event"] = _core(ev_named()) + _HEAT.format(flt="AND event_name = 'purchase_viewed'")

_TR = with_(ev_raw(), sessions(1440)) + """,
tr AS (SELECT user_id, prev_name AS from_event, event_name AS to_event FROM se
       WHERE is_start = 0 AND prev_name IS NOT NULL AND event_name IS NOT NULL)"""
ORACLE["transitions"] = _TR + "\nSELECT from_event, to_event, count(*) AS n FROM tr GROUP BY 1, 2"
ORACLE["entry_events"] = with_(ev_raw(), sessions(1440)) + """
SELECT event_name, count(*) AS sessions FROM se WHERE is_start = 1 GROUP BY 1"""
ORACLE["top_transition"] = _TR + """,
ut AS (SELECT user_id, from_event, to_event, count(*) AS n FROM tr GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, from_event, to_event) AS r FROM ut)
SELECT user_id, from_event, to_event, n FROM rk WHERE r = 1"""
ORACLE["path_diversity"] = _TR + """,
ut AS (SELECT user_id, from_event, to_event, count(*) AS n FROM tr GROUP BY 1, 2, 3)
SELECT user_id, count(*) AS distinct_transitions, CAST(sum(n) AS BIGINT) AS transitions,
       round_even(count(*) / sum(n), 9) AS diversity
FROM ut GROUP BY user_id"""
ORACLE["next_event_step"] = with_(ev_raw(), sessions(1440)) + """,
nx AS (SELECT *, lead(event_name, 1) OVER w AS n1, lead(session_no, 1) OVER w AS s1,
              lead(event_name, 2) OVER w AS n2, lead(session_no, 2) OVER w AS s2
       FROM se WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT n2 AS next_event, count(*) AS n FROM nx
WHERE event_name = 'view' AND n1 = 'click' AND s1 = session_no AND s2 = session_no GROUP BY n2"""

_COMP = _core(ev_named()) + """,
cp AS (SELECT f.user_id, f.family, count(*) AS n, count(*) / any_value(p.events) AS share
       FROM fe f JOIN pr p USING (user_id) GROUP BY f.user_id, f.family)"""
ORACLE["composition"] = _COMP + "\nSELECT user_id, family, n, round_even(share, 9) AS share FROM cp"
ORACLE["cohort_index"] = _COMP + """,
ms AS (SELECT family, sum(share) / (SELECT count(*) FROM pr) AS mean_share FROM cp GROUP BY family)
SELECT user_id, family, round_even(share, 6) AS share, round_even(mean_share, 6) AS mean_share,
       round_even(share / mean_share, 6) AS index
FROM cp JOIN ms USING (family)"""

# ---- T (streaming) -------------------------------------------------------------
ORACLE["stream_user_counts"] = with_(ev_untidy()) + f"""
SELECT user_id, count(*) AS events, strftime(max(ts), {TS}) AS last_seen
FROM ev WHERE user_id IS NOT NULL GROUP BY 1"""

ORACLE["stream_totals"] = with_(ev_untidy()) + """
SELECT count(DISTINCT user_id) AS users, count(*) AS events FROM ev WHERE user_id IS NOT NULL"""

ORACLE["stream_profile_refresh"] = with_(ev_untidy(), families()) + f""",
pf AS (SELECT ev.user_id, coalesce(fd.family, 'other') AS family, ev.ts
       FROM ev LEFT JOIN fd USING (event_name) WHERE ev.user_id IS NOT NULL),
ut AS (SELECT user_id, count(*) AS events, strftime(min(ts), {TS}) AS first_seen,
              strftime(max(ts), {TS}) AS last_seen FROM pf GROUP BY 1)
SELECT ut.user_id, ut.events, ut.first_seen, ut.last_seen, pf.family, count(*) AS count
FROM pf JOIN ut USING (user_id) GROUP BY ALL"""

ORACLE["stream_sessions_all"] = with_(ev_untidy().replace("FROM events", "FROM events WHERE event_id % 97 <> 13"), sessions(30)) + f"""
SELECT user_id, strftime(min(ts), {TS}) AS start, strftime(max(ts), {TS}) AS "end", count(*) AS n_events
FROM se GROUP BY user_id, session_no"""

ORACLE["stream_session_balance"] = with_(ev_untidy()) + """
SELECT count(*) AS rows_in, count(ts) AS in_sessions, count(*) - count(ts) AS untimed, CAST(0 AS BIGINT) AS late
FROM ev WHERE user_id IS NOT NULL"""

# closed sessions only: end (last event + gap) at or before the final watermark
ORACLE["stream_sessions"] = with_(ev_raw(), sessions(30)) + f""",
wm AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events WHERE user_id IS NOT NULL)
SELECT user_id, strftime(min(ts), {TS}) AS start, strftime(max(ts) + INTERVAL 30 MINUTE, {TS}) AS "end",
       count(*) AS n_events
FROM se WHERE ts IS NOT NULL GROUP BY user_id, session_no
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT w FROM wm)"""


def _sniff_sql(source: str = "SELECT * FROM events", leave: str = "") -> str:
    """Content sniff over all rows of ``events`` renamed c0..c5, without the column ``leave``."""
    def num(c):
        return (f"count(*) FILTER (WHERE {c} IS NOT NULL AND (({c} > 1000000000 AND {c} < 4000000000) "
                f"OR ({c} > 1000000000000 AND {c} < 4000000000000)))")

    def text(c):
        return f"count(try_cast({c} AS TIMESTAMP))"

    parts = [
        ("c0", 0, "event_id", num("event_id"), "false"),
        ("c1", 1, "ts", "count(ts)", "false"),
        ("c2", 2, "user_id", num("user_id"), "false"),
        ("c3", 3, "event_type", text("event_type"), "true"),
        ("c4", 4, "value", num("value"), "false"),
        ("c5", 5, "props", text("props"), "true"),
    ]
    cols = " UNION ALL ".join(
        f"SELECT '{name}' AS col, {i} AS ord, count({c}) AS nn, {hit} AS tsh, count(DISTINCT {c}) AS nu, "
        f"{is_str} AS is_str FROM s" for name, i, c, hit, is_str in parts if name != leave)
    return f"""
WITH s AS ({source}),
n AS (SELECT count(*) AS nrows FROM s),
cols AS ({cols}),
sc AS (SELECT col, ord, tsh / nn AS ts_score,
              CASE WHEN nu <= 1 OR col = 'c4' /* a DOUBLE */ THEN 0.0 WHEN nu / nrows <= 0.9
                   THEN 0.6 + 0.3 * least(nu / nrows / 0.5, 1.0) ELSE 0.0 END AS user_score,
              CASE WHEN NOT is_str THEN 0.0 WHEN nu = 0 OR nu > 500 THEN 0.0 WHEN nu / nrows > 0.5 THEN 0.0
                   WHEN nu BETWEEN 2 AND 200 THEN 0.7 ELSE 0.3 END AS ev_score
       FROM cols, n WHERE nn > 0),
t AS (SELECT col FROM sc WHERE ts_score > 0.8 ORDER BY ts_score DESC, ord LIMIT 1),
u AS (SELECT col FROM sc WHERE user_score > 0.5 AND col NOT IN (SELECT col FROM t)
      ORDER BY user_score DESC, ord LIMIT 1),
e AS (SELECT col FROM sc WHERE ev_score > 0.5 AND col NOT IN (SELECT col FROM t) AND col NOT IN (SELECT col FROM u)
      ORDER BY ev_score DESC, ord LIMIT 1)
SELECT 'timestamp' AS role, col AS "column" FROM t
UNION ALL SELECT 'user_id', col FROM u
UNION ALL SELECT 'event_name', col FROM e"""


ORACLE["resolve_schema_sniff"] = _sniff_sql()
ORACLE["resolve_schema_repeated"] = _sniff_sql("SELECT events.* FROM events, generate_series(1, 60)", "c0")


# ---- hot users and other paths: the same rows as on the plain path -------------
ORACLE["sessionize_hot"] = ORACLE["sessionize_gap_30"]
ORACLE["sessionize_before_1970"] = with_(ev_raw(), sessions(15)) + """
SELECT user_id, event_id, session_no, user_id || '_s' || CAST(session_no AS VARCHAR) AS session_id,
       is_start = 1 AS is_start
FROM se"""
for _k in ("session_table", "stuck_signals", "transitions", "next_event_step", "longest_gap"):
    ORACLE[f"{_k}_hot"] = ORACLE[_k]
ORACLE["analyze_user_sessions_hot"] = with_(ev_named(), sessions(30)) + f"""
SELECT session_no, user_id || '_s' || CAST(session_no AS VARCHAR) AS session_id,
       strftime(timezone('America/New_York', min(ts) AT TIME ZONE 'UTC'), {TS}) AS start, count(*) AS n_events
FROM se WHERE user_id = '7' GROUP BY user_id, session_no"""

# ---- sources, sinks and records -------------------------------------------------
ORACLE["read_parquet"] = ORACLE["read_parts"] = _ROUND_TRIP
ORACLE["write_profiles"] = _LIST_BASE + f"\nSELECT {_PROFILE_COLS} FROM pr"
_SEVEN = "user_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey = 7)"
ORACLE["export_record"] = _LIST_BASE + f"""
SELECT count(*) AS users_included, CAST(coalesce(sum(events), 0) AS BIGINT) AS total_events FROM pr WHERE {_SEVEN}"""
ORACLE["export_events"] = _LIST_BASE + f"""
SELECT user_id, user_id || '_s' || CAST(session_no AS VARCHAR) AS session_id, pos, strftime(ts, '%H:%M') AS hhmm,
       event_name, family
FROM fe WHERE {_SEVEN}"""
ORACLE["event_properties_reserved"] = " UNION ALL ".join(
    f"SELECT event_id, '{n}' AS key, '{n}' || CAST(event_id % {k + 3} AS VARCHAR) AS value FROM events WHERE user_id IS NOT NULL"
    for k, n in enumerate(["_id", "family", "pos", "bucket", "ord", "ts_key", "props", "session_no"]))
_INNER, _OUTER = (pad.hex() for pad in hmac_pads(b"usertrail registered query"))
ORACLE["redact_roles"] = f"""
SELECT event_id, 'redacted-' || substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(CAST(user_id AS VARCHAR))))), 1, 32) AS user_id,
       CASE WHEN event_type IS NOT NULL THEN '<redacted>' END AS event_name
FROM events"""
ORACLE["no_families"] = with_(ev_named()) + """
SELECT user_id, 'other' AS family, count(*) AS count FROM ev WHERE user_id IS NOT NULL GROUP BY user_id"""
ORACLE["prefix_attributes"] = """
SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(arg_min(event_id % 40, (ts, event_id)) AS VARCHAR) AS user_mark
FROM events WHERE user_id IS NOT NULL GROUP BY 1"""
ORACLE["meta_schema"] = """
SELECT 'user_id' AS role, 'user_id' AS "column", count(DISTINCT user_id) AS n_values FROM events
UNION ALL SELECT 'timestamp', 'ts', count(DISTINCT ts) FROM events
UNION ALL SELECT 'event_name', 'event_type', count(DISTINCT event_type) FROM events"""
ORACLE["analyze_user_stats"] = _core(ev_named()) + f"\nSELECT {_PROFILE_COLS} FROM pr WHERE user_id = '7'"
ORACLE["analyze_user_events"] = _core(ev_named()) + """
SELECT user_id || '_s' || CAST(session_no AS VARCHAR) AS session_id, pos, strftime(ts, '%H:%M') AS hhmm, event_name, family, props
FROM fe WHERE user_id = '7'"""
ORACLE["analyze_user_top_families"] = f"SELECT * FROM ({ORACLE['top_families']}) WHERE user_id = '7'"
ORACLE["list_users_totals"] = _LIST_BASE + """
SELECT (SELECT count(*) FROM pr) AS total, count(*) AS filtered_total FROM pr WHERE user_id IN (SELECT user_id FROM cm)"""
ORACLE["taxonomy_totals"] = _core(ev_named()) + """
SELECT CAST(sum(events) AS BIGINT) AS total_events, count(*) AS total_users FROM pr"""
ORACLE["quick_report_totals"] = _core(ev_named()) + """
SELECT count(*) AS users_included, CAST(coalesce(sum(events), 0) AS BIGINT) AS total_events FROM pr"""
ORACLE["stream_profile_full"] = with_(
    ev_untidy(), families(), sessions(30), fam_events(), profiles(), power().strip(),
    "st AS (SELECT user_id, session_no, epoch_us(min(ts)) // 1000000 AS sec FROM se GROUP BY 1, 2)",
    "lg AS (SELECT user_id, sec - lag(sec) OVER (PARTITION BY user_id ORDER BY session_no) AS d FROM st)",
    "gp AS (SELECT user_id, CAST(coalesce(max(floor(d / 86400)), 0) AS BIGINT) AS longest_gap_days FROM lg GROUP BY user_id)",
) + f"""
SELECT {_PROFILE_COLS}, longest_gap_days, power_score
FROM pr JOIN (SELECT user_id, power_score FROM pw) USING (user_id) JOIN gp USING (user_id)"""

ORACLE["stream_attributes"] = ORACLE["user_attributes"]

# ---- SQL surface ----------------------------------------------------------------
ORACLE["sql_user_profile"] = with_(ev_customer(), families(), sessions(30), fam_events(), profiles()) + """
SELECT p.user_id, p.events, p.sessions, p.first_seen, p.last_seen, c.c_mktsegment AS segment
FROM pr p LEFT JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = p.user_id WHERE p.events >= (SELECT avg(events) FROM pr)"""

ORACLE["sql_segment_sessions"] = with_(ev_customer(), sessions(30)) + """
SELECT segment, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events
FROM (SELECT user_id, session_no, any_value(c_mktsegment) AS segment, count(*) AS n FROM se GROUP BY 1, 2)
WHERE segment IS NOT NULL GROUP BY segment"""

ORACLE["sql_users_by_event"] = with_(ev_customer()) + """
SELECT user_id, count(*) AS occurrences FROM ev WHERE user_id IS NOT NULL AND contains(lower(event_name), 'view')
GROUP BY user_id HAVING count(*) >= 5"""

ORACLE["sql_event_followers"] = with_(ev_customer(), sessions(30)) + """
SELECT event_name, count(*) AS n
FROM (SELECT event_name, prev_name, is_start FROM se) WHERE prev_name = 'view_viewed' AND is_start = 0 GROUP BY event_name"""

# ---- parts of records that other queries leave out --------------------------------
ORACLE["write_profiles_maps"] = _LIST_BASE + """
SELECT user_id, 'family' AS kind, family AS key, CAST(count(*) AS VARCHAR) AS value FROM fe GROUP BY user_id, family
UNION ALL SELECT user_id, 'attribute', key, value FROM ua WHERE value IS NOT NULL"""

ORACLE["export_properties"] = _LIST_BASE + f"""
SELECT user_id, pos, 'props' AS key, props AS value FROM se WHERE props IS NOT NULL AND {_SEVEN}
UNION ALL SELECT user_id, pos, 'c_name', c_name FROM se WHERE c_name IS NOT NULL AND {_SEVEN}"""

ORACLE["taxonomy_record"] = with_(ev_named(), families()) + """
SELECT coalesce(fd.family, 'other') AS family, count(*) AS events, count(DISTINCT event_name) AS names
FROM ev LEFT JOIN fd USING (event_name) GROUP BY 1"""

ORACLE["meta_attributes"] = ORACLE["attribute_domain"]

ORACLE["missing_role"] = """
SELECT true AS refused, true AS names_columns, count(*) AS n_rows FROM conversations"""

ORACLE["read_json_ranges"] = "SELECT event_id, CAST(ts AS VARCHAR) AS ts, user_id, event_type, props FROM events"
