"""Event family rules (verb suffix, prefix clustering, cap, registry)."""

from __future__ import annotations

from pyspark.sql import functions as F

from usertrail.operators.families import FamilyPlan, plan_families


def _plan(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "event_name string")
    return df, plan_families(df)


def _assign(spark, names):
    df, plan = _plan(spark, names)
    dim = df.distinct().select("event_name", plan.family(F.col("event_name")).alias("f")).collect()
    return {r["event_name"]: r["f"] for r in dim}, plan


def test_verb_suffix(spark):
    a, _ = _assign(spark, ["page_viewed", "signup_clicked", "signup_submitted", "settings_closed"])
    assert a == {"page_viewed": "view", "signup_clicked": "click", "signup_submitted": "submit",
                 "settings_closed": "close"}


def test_error_start_success(spark):
    a, _ = _assign(spark, ["checkout_failed", "payment_started", "payment_succeeded"])
    assert (a["checkout_failed"], a["payment_started"], a["payment_succeeded"]) == ("error", "start", "success")


def test_tokeniser_separators_and_case(spark):
    a, _ = _assign(spark, ["Page.Viewed", "button:CLICKED", "form-- submitted", "__"])
    assert a == {"Page.Viewed": "view", "button:CLICKED": "click", "form-- submitted": "submit", "__": "other"}


def test_prefix_clustering(spark):
    a, plan = _assign(spark, ["ai_reply", "ai_draft", "ai_retry", "ai_send"] * 10)
    assert set(a.values()) == {"ai"} and "ai" in plan.kept


def test_prefix_below_min_distinct(spark):
    a, _ = _assign(spark, ["ai_reply", "ai_draft"] * 10)
    assert set(a.values()) == {"other"}


def test_prefix_below_min_share(spark):
    names = ["ai_reply", "ai_draft", "ai_retry"] + ["page_viewed"] * 1000
    a, _ = _assign(spark, names)
    assert a["ai_reply"] == "other"


def test_unknown_to_other_and_registry(spark):
    a, plan = _assign(spark, ["some_random_action", "another_weird_one"])
    assert set(a.values()) == {"other"}
    assert [r[0] for r in plan.registry_rows()] == ["other"]


def test_no_families(spark):
    df = spark.createDataFrame([("page_viewed",), ("item_clicked",)], "event_name string")
    plan = plan_families(df, no_families=True)
    assert df.select(plan.family(F.col("event_name")).alias("f")).distinct().first()["f"] == "other"
    assert [r[0] for r in plan.registry_rows()] == ["other"]


def test_cap_keeps_first_twelve_alphabetically(spark):
    names = [f"{p}_{s}" for p in "abcdefghijklmno" for s in ("x1", "x2", "x3")]
    a, plan = _assign(spark, names)
    assert list(plan.kept) == list("abcdefghijkl")
    assert a["m_x1"] == "other" and a["a_x1"] == "a"
    assert plan.has_other


def test_registry_is_stable(spark):
    _, p1 = _plan(spark, ["page_viewed", "item_clicked"])
    _, p2 = _plan(spark, ["item_clicked", "page_viewed"])
    assert p1.registry_rows() == p2.registry_rows()
    assert {r[0]: r[1] for r in p1.registry_rows()} == {"click": "Click", "view": "View"}


def test_broadcast_and_expression_paths_agree(spark):
    names = ["page_viewed", "ai_reply", "ai_draft", "ai_retry", "zz_top", None]
    df, plan = _plan(spark, names)
    via_join = {r["event_name"]: r["family"] for r in plan.apply(df, names=df).collect()}
    big = FamilyPlan(plan.kept, plan.prefixes, plan.has_other, n_names=10**9)
    via_expr = {r["event_name"]: r["family"] for r in big.apply(df, names=df).collect()}
    assert via_join == via_expr
    assert via_join[None] == "other"


def test_names_are_broadcast_by_count_and_bytes(spark):
    names = ["page_viewed", "ai_reply", "é_viewed", None]
    df, plan = _plan(spark, names)
    assert plan.name_bytes == sum(len(n.encode()) for n in names if n) and plan.broadcastable
    assert not FamilyPlan(plan.kept, plan.prefixes, True, n_names=3, name_bytes=1 << 30).broadcastable


def test_user_cap_takes_the_first_ids_without_a_join(spark):
    from usertrail.operators.profiles import cap_users

    df = spark.createDataFrame([("10",), ("9",), ("é",), (None,), ("Z",), ("10",), ("1",)], "user_id string")
    for n, want in ((1, ["1"]), (2, ["1", "10", "10"]), (4, ["1", "10", "10", "9", "Z"]), (9, ["1", "10", "10", "9", "Z", "é"])):
        capped = cap_users(df, n)
        assert sorted(r.user_id for r in capped.collect()) == want
    assert "Join" not in capped._jdf.queryExecution().optimizedPlan().toString()
    assert cap_users(df.where("user_id is null"), 3).count() == 0
