"""Sources: suffix dispatch, errors, round trips, multi-part union; sinks."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from usertrail import Options, analyze
from usertrail.sources import ReadError, read_events, read_parts, write_profiles

from .conftest import TINY


def _write_tiny(path, sep=","):
    with open(path, "w") as fh:
        fh.write(sep.join(["user_id", "timestamp", "event_name"]) + "\n")
        for r in TINY:
            fh.write(sep.join(r) + "\n")


@pytest.mark.parametrize("suffix,sep", [(".csv", ","), (".tsv", "\t"), (".CSV", ",")])
def test_delimited(spark, tmp_path, suffix, sep):
    p = str(tmp_path / f"ev{suffix}")
    _write_tiny(p, sep)
    a = analyze(spark, read_events(spark, p))
    assert a.n_events == 20 and a.core_profiles.count() == 3


def test_json_array_and_jsonl(spark, tmp_path):
    recs = [dict(zip(("user_id", "timestamp", "event_name"), r)) for r in TINY]
    pj = tmp_path / "ev.json"
    pj.write_text(json.dumps(recs))
    pl = tmp_path / "ev.ndjson"
    pl.write_text("\n".join(json.dumps(r) for r in recs))
    for p in (pj, pl):
        a = analyze(spark, read_events(spark, str(p)))
        assert a.n_events == 20


def test_parquet_directory_and_union(spark, tmp_path, tiny):
    d1, d2 = str(tmp_path / "p1.parquet"), str(tmp_path / "p2.parquet")
    tiny.where("user_id = '101'").write.parquet(d1)
    tiny.where("user_id <> '101'").withColumn("extra", tiny.user_id).write.parquet(d2)
    df = read_parts(spark, [d1, d2])
    assert df.count() == 20 and "extra" in df.columns


def test_errors(spark, tmp_path):
    with pytest.raises(ReadError, match="nothing to read"):
        read_events(spark, str(tmp_path / "missing.csv"))
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(ReadError, match="no data"):
        read_events(spark, str(empty))
    odd = tmp_path / "x.xlsx"
    odd.write_text("x")
    with pytest.raises(ReadError, match="no reader"):
        read_events(spark, str(odd))


def test_profile_sink(spark, tmp_path, tiny):
    out = str(tmp_path / "profiles")
    write_profiles(analyze(spark, tiny).profiles, out)
    recs = [json.loads(line) for f in os.listdir(out) if f.endswith(".json")
            for line in open(os.path.join(out, f))]
    assert {r["user_id"] for r in recs} == {"101", "102", "103"}
    assert {r["user_id"]: r["sessions"] for r in recs}["101"] == 3


def test_epoch_columns(spark):
    for scale, val in ((1, 1775034000), (1000, 1775034000000)):
        df = spark.createDataFrame([("u", val, "e")], "user_id string, timestamp long, event_name string")
        a = analyze(spark, df, Options())
        assert a.core_profiles.first()["first_seen"] == "2026-04-01 09:00:00", scale


def test_scoped_export_sink(spark, tmp_path, tiny):
    from usertrail.operators.profiles import session_events
    from usertrail.plans import queries as Q
    from usertrail.sources import export_users

    a = analyze(spark, tiny)
    chosen, missing = Q.export_subset(a, ["101", "103"])
    Q.check_export(chosen, missing)
    out = str(tmp_path / "export")
    export_users(chosen, session_events(a.tl), out)
    prof = spark.read.json(out + "/profiles")
    ev = spark.read.json(out + "/events")
    assert sorted(r["user_id"] for r in prof.collect()) == ["101", "103"]
    assert ev.count() == 11


def test_meta_record(spark, with_attrs):
    a = analyze(spark, with_attrs)
    meta = a.meta()
    assert {r["role"]: r["column"] for r in meta["schema"].collect()}["user_id"] == "user_id"
    assert sorted((r["key"], r["value"]) for r in meta["attributes"].collect()) == [
        ("user_country", "PL"), ("user_country", "UA"), ("user_plan", "free"), ("user_plan", "premium")]
    assert meta["top_events"].first()["name"] == "page_viewed"


def test_file_scheme_and_glob(spark, tmp_path):
    p = tmp_path / "part-1.csv"
    _write_tiny(str(p))
    assert read_events(spark, "file://" + str(p)).count() == 20
    assert read_events(spark, str(tmp_path / "part-*.csv")).count() == 20


def test_analyze_with_explicit_schema(spark, tmp_path):
    p = str(tmp_path / "ev.csv")
    _write_tiny(p)
    a = analyze(spark, p, schema="user_id string, timestamp timestamp, event_name string")
    assert a.raw.schema["timestamp"].dataType.simpleString() == "timestamp"
    assert a.core_profiles.count() == 3


def test_d6_float_epochs(spark):
    df = spark.createDataFrame([("u", 1775034000.5, "e"), ("u", 1775034060.0, "e")],
                               "user_id string, timestamp double, event_name string")
    a = analyze(spark, df, Options())
    r = a.core_profiles.first()
    assert (r["first_seen"], r["last_seen"], r["sessions"]) == ("2026-04-01 09:00:00", "2026-04-01 09:01:00", 1)


NASTY = [{"id": i, "a": a, "n": {"deep": [{"x": "}{][\\"}], "s": 'quo"te\\'}, "list": [{"k": i}] * (i % 3)} for i, a in enumerate(
    ["plain", "br{ace", "br}ace", '"}', "[]", "\\", "\\\"", "ünï\u2581", "", None, "x" * 300, "}" * 40, "line\nend"] * 5)]


@pytest.mark.parametrize("size", ["97b", "1k", "128m"])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays_in_byte_ranges(spark, tmp_path, size, indent):
    from usertrail.sources import read_json_array

    name = "spark.sql.files.maxPartitionBytes"
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps([{**r, "file": k} for r in NASTY], indent=indent, ensure_ascii=False))
    (tmp_path / "in" / "empty.json").write_text(" [ ] \n")
    (tmp_path / "in" / "one.json").write_text('{"id": 1000, "a": "}", "file": 2}')
    (tmp_path / "in" / "mixed.json").write_text('[1, "}{", null, {"id": 1001, "a": "b", "file": 3}, 2.5]')
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        got = read_json_array(spark, str(tmp_path / "in"))
        rows = [json.loads(r) for r in got.toJSON().collect()]
    finally:
        spark.conf.set(name, before)
    want = [{**r, "file": k} for k in range(2) for r in NASTY] + [{"id": 1000, "a": "}", "file": 2}, {"id": 1001, "a": "b", "file": 3}]
    (tmp_path / "lines.jsonl").write_text("\n".join(map(json.dumps, want)))
    lines = spark.read.json(str(tmp_path / "lines.jsonl"))
    assert got.schema == lines.schema
    key = lambda r: json.dumps(r, sort_keys=True)
    assert sorted(map(key, rows)) == sorted(key(json.loads(r)) for r in lines.toJSON().collect())


def test_large_json_arrays_are_dispatched_to_byte_ranges(spark, tmp_path):
    path = tmp_path / "big.json"
    path.write_text(json.dumps([{"user_id": f"u{i % 5}", "ts": "2026-01-01 10:00:00", "event": "a", "i": i} for i in range(3000)]))
    plain = read_events(spark, str(path))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "20k")
    try:
        ranges = read_events(spark, str(path))
        typed = read_events(spark, str(path), schema="i long, user_id string")
        parts = ranges.select(F.spark_partition_id()).distinct().count()
        assert parts > 1
        assert sorted(map(tuple, ranges.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
        assert typed.agg(F.sum("i")).first()[0] == sum(range(3000)) and typed.columns == ["i", "user_id"]
        cut = tmp_path / "cut.json"
        cut.write_text(path.read_text()[:-40])
        with pytest.raises(ReadError, match="cut.json"):
            read_events(spark, str(cut))
    finally:
        spark.conf.set(name, before)


def test_small_byte_ranges_share_tasks(spark, tmp_path):
    from usertrail.sources import json_array as J

    path, rows = tmp_path / "small.json", 4000
    path.write_text(json.dumps([{"i": i, "a": "}{" * (i % 3)} for i in range(rows)]))
    name, cores = "spark.sql.files.maxPartitionBytes", spark.sparkContext.defaultParallelism
    assert path.stat().st_size > 1024 * 4 * (cores + 10) and J._tasks(spark, str(path)) == cores
    before = {k: spark.conf.get(k, None) for k in (name, J._MAX_PARTS)}
    spark.conf.set(name, "1k")
    try:
        assert J._fragments(spark, str(path), cores).select(F.spark_partition_id()).distinct().count() <= cores
        got = J.read_json_array(spark, str(path))
    finally:
        spark.conf.set(name, before[name])
    assert spark.conf.get(J._MAX_PARTS, None) == before[J._MAX_PARTS]
    # a file a task, and those of the objects that were joined from pieces
    assert len(got.inputFiles()) <= cores + 10
    assert got.agg(F.sum("i"), F.count("i"), F.sum(F.length("a"))).first()[:] == (
        rows * (rows - 1) // 2, rows, sum(2 * (i % 3) for i in range(rows)))
