"""The driver contract: entry(), queries() and oracle_sql()."""

from __future__ import annotations

import duckdb

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"user_id", "events", "sessions", "power_score"} <= set(df.columns)


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    own = {q for q in E.queries() if q not in E._corpus()[0]}
    assert own <= set(E.oracle_sql())


def _duck(sf):
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def test_sample_queries_match_oracle(spark):
    sf = "/root/testdata/sf0.001"
    con = _duck(sf)
    sql = E.oracle_sql()
    for name in ("sessionize_gap_30", "user_totals", "power_score", "event_families", "stuck_signals",
                 "classify_columns", "top_families", "transitions"):
        df = E.queries()[name](spark, sf)
        mine = sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())
        res = con.execute(sql[name])
        cols = [d[0] for d in res.description]
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        theirs = sorted(tuple(str(r[i]) for i in order) for r in res.fetchall())
        assert sorted(df.columns) == sorted(cols), name
        assert mine == theirs, name
