"""DuckDB SQL building blocks for the oracle queries in ``__spark_entry__``.

Written directly in SQL (window functions, group-bys), independently of the
Spark plans; only the fixed lookup values are shared.
"""

from __future__ import annotations

from usertrail.constants import VERB_FAMILIES

K = "TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER)"


def _suffix(k: str) -> str:
    return (f"CASE WHEN ({k}) % 6 = 0 THEN 'viewed' WHEN ({k}) % 6 = 1 THEN 'submitted' "
            f"ELSE 'm' || CAST(({k}) % 6 AS VARCHAR) END")


def ev_raw() -> str:
    return ("ev AS (SELECT CAST(user_id AS VARCHAR) AS user_id, ts, event_type AS event_name, "
            "event_id, value, props FROM events)")


def ev_untidy() -> str:
    """Raw events, every 97th without its time."""
    return ("ev AS (SELECT CAST(user_id AS VARCHAR) AS user_id, CASE WHEN event_id % 97 <> 13 THEN ts END AS ts, "
            "event_type AS event_name, event_id, value, props FROM events)")


def ev_named() -> str:
    return (f"ev AS (SELECT CAST(user_id AS VARCHAR) AS user_id, ts, "
            f"event_type || '_' || {_suffix(K)} AS event_name, event_id, value, props FROM events)")


def ev_overflow() -> str:
    return (f"ev AS (SELECT CAST(user_id AS VARCHAR) AS user_id, ts, "
            f"event_type || CAST({K} % 4 AS VARCHAR) || '_' || {_suffix(K + ' // 4')} AS event_name, "
            f"event_id, value, props FROM events)")


def ev_customer() -> str:
    return (f"ev AS (SELECT CAST(e.user_id AS VARCHAR) AS user_id, e.ts, "
            f"e.event_type || '_' || {_suffix(K)} AS event_name, e.event_id, e.value, e.props, "
            f"c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment "
            f"FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey)")


def families() -> str:
    """CTEs nm/tot/tk/tv/pq/cd/kp/fd over ``ev``: fd(event_name, family)."""
    verbs = ", ".join(f"('{k}', '{v}')" for k, v in VERB_FAMILIES.items())
    return f"""
vb(token, fam) AS (VALUES {verbs}),
nm AS (SELECT event_name, count(*) AS n FROM ev GROUP BY event_name),
tot AS (SELECT sum(n) AS total FROM nm),
tk AS (SELECT event_name, n,
              list_filter(string_split_regex(lower(event_name), '[_.\\-: ]+'), lambda x: x <> '') AS toks
       FROM nm WHERE event_name IS NOT NULL),
tv AS (SELECT tk.event_name, tk.n, vb.fam AS verb,
              CASE WHEN len(toks) > 0 THEN toks[1] END AS first
       FROM tk LEFT JOIN vb ON vb.token = CASE WHEN len(toks) > 0 THEN toks[-1] END),
pq AS (SELECT tv.first FROM tv, tot WHERE tv.verb IS NULL AND tv.first IS NOT NULL
       GROUP BY tv.first, tot.total HAVING count(*) >= 3 AND sum(tv.n) / tot.total >= 0.005),
cd AS (SELECT tv.event_name, coalesce(tv.verb, pq.first) AS fam
       FROM tv LEFT JOIN pq ON tv.verb IS NULL AND pq.first = tv.first),
kp AS (SELECT fam FROM (SELECT DISTINCT fam FROM cd WHERE fam IS NOT NULL) ORDER BY fam LIMIT 12),
fd AS (SELECT cd.event_name, coalesce(kp.fam, 'other') AS family
       FROM cd LEFT JOIN kp ON kp.fam = cd.fam)"""


def sessions(gap: int = 30) -> str:
    """CTEs sq/ss/se over ``ev``: se = events with pos, prev_name, is_start, session_no."""
    gap_us = gap * 60 * 1_000_000
    return f"""
sq AS (SELECT *, row_number() OVER w AS pos, lag(ts) OVER w AS prev_ts, lag(event_name) OVER w AS prev_name
       FROM ev WHERE user_id IS NOT NULL
       WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id)),
ss AS (SELECT *, CASE WHEN pos = 1 OR (epoch_us(ts) - epoch_us(prev_ts) > {gap_us}) THEN 1 ELSE 0 END AS is_start
       FROM sq),
se AS (SELECT *, CAST(sum(is_start) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id
                                          ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no
       FROM ss)"""


def fam_events() -> str:
    """CTE fe: se joined with families (needs families() and sessions())."""
    return "fe AS (SELECT se.*, coalesce(fd.family, 'other') AS family FROM se LEFT JOIN fd USING (event_name))"


def profiles() -> str:
    """CTE pr: per-user profile over fe."""
    return """
pr AS (SELECT user_id, count(*) AS events, CAST(max(session_no) AS BIGINT) AS sessions,
              min(ts) AS first_ts, max(ts) AS last_ts,
              strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen,
              strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen
       FROM fe GROUP BY user_id)"""


def power() -> str:
    """CTE pw: power score over pr."""
    return """
pw AS (SELECT p.user_id, p.events, p.sessions, p.events * p.sessions AS activity,
              CAST(least(100, round_even(100.0 * (SELECT count(*) FROM pr q
                                                  WHERE q.events * q.sessions < p.events * p.sessions)
                                          / (SELECT count(*) FROM pr), 0)) AS BIGINT) AS power_score
       FROM pr p)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)
