"""Many requests at once against the operators that take one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import catalog, requests, sweep

MODULES = "scope string, dir string, resource_types array<string>, reuse_count int"
TYPES = "aws_instance aws_db_instance aws_s3_bucket aws_security_group aws_lb aws_vpc aws_subnet aws_eks_cluster aws_iam_role aws_sns_topic azurerm_vm google_sql".split()
INTENTS = ["create an s3 bucket", "database", "a new vm like prod", "", "zebra", "security group for the lb in vpc", "db instance", "kubernetes cluster with iam role and sns topic and subnet and lb", "iam role", "the", None]
WANTED = ["s3_bucket", "AWS_LB", "db", "", None, "instance", "lb", "x", "modules/m1", "nothing", "b"]


def modules(spark, scopes=6):
    r = random.Random(5)
    rows = [(f"r{s}", f"modules/{r.choice(['database', 'net', 'web-lb', 'main', 'queue'])}/m{k}", r.sample(TYPES, r.randint(0, 4)), r.randint(0, 3), "x") for s in range(scopes) for k in range(4 * s)]
    return spark.createDataFrame([*rows, (None, "modules/lost", ["aws_lb"], 9, "x"), ("r1", "modules/null", None, 0, "x")], "scope string, dir string, resource_types array<string>, reuse_count int, intent string")


def test_ranks_as_one_request_at_a_time(spark):
    m = modules(spark).cache()
    asked = spark.createDataFrame([(f"r{s}", t, k) for s in range(6) for k, t in enumerate(INTENTS * 2)] + [(None, "lb", 99)], "scope string, intent string, score_ int")
    got = {}
    for r in sweep.rank_requests(asked, m).collect():
        got.setdefault((r["scope"], r["score_"]), []).append((r["rank"], r["dir"], r["score"]))
    for s in (1, 3, 5):
        own = m.filter(F.col("scope") == f"r{s}")
        for k, t in enumerate(INTENTS):
            want = [(n + 1, x["id"], x["score"]) for n, x in enumerate(catalog.planner_rank(own, "dir", F.col("dir"), F.col("resource_types"), F.col("reuse_count"), t or "").collect())]
            assert sorted(got.get((f"r{s}", k), [])) == want == sorted(got.get((f"r{s}", k + len(INTENTS)), [])), (s, t)
    assert (None, 99) not in got and any(got.values())


def test_finds_as_one_request_at_a_time(spark):
    m = modules(spark).cache()
    asked = spark.createDataFrame([(f"r{s}", t, k) for s in range(6) for k, t in enumerate(WANTED)], "scope string, resource_type string, k int")
    got = {(r["scope"], r["k"]): r["dir"] for r in sweep.find_modules(asked, m).collect()}
    for s in (1, 3, 5):
        for k, t in enumerate(WANTED):
            one = requests.find_module(m.filter(F.col("scope") == f"r{s}"), t or "").first()
            assert got.get((f"r{s}", k)) == (one and one["dir"]), (s, t)


@pytest.mark.parametrize("few", [0, 8, 64])
def test_small_and_large_repositories_are_ranked_alike(spark, monkeypatch, few):
    monkeypatch.setattr(sweep, "FEW", few)
    test_ranks_as_one_request_at_a_time(spark)
    test_finds_as_one_request_at_a_time(spark)


def test_modules_of_unknown_reuse_come_last_and_twins_twice(spark, monkeypatch):
    m = spark.createDataFrame([("r", "m/a", ["aws_lb"], None), ("r", "m/b", ["aws_lb"], 0), ("r", "m/c", ["aws_lb"], 2), ("r", "m/c", ["aws_lb"], 2), ("r", None, ["aws_lb"], 9)], MODULES)
    asked = spark.createDataFrame([("r", "lb", "aws_lb", 1, 2)], "scope string, intent string, resource_type string, want int, ask_ int")
    got = {}
    for few in (0, 64):
        monkeypatch.setattr(sweep, "FEW", few)
        got[few] = sorted(map(str, sweep.rank_requests(asked, m, top=9).collect())), sorted(map(str, sweep.find_modules(asked, m).collect()))
    assert got[0] == got[64] and [r["dir"] for r in sweep.rank_requests(asked, m, top=9).orderBy("rank").collect()] == ["m/c", "m/c", "m/b", "m/a"]


def test_small_repositories_shuffle_no_words(spark):
    m = sweep.written(modules(spark).select("scope", "dir", "resource_types", "reuse_count"), "modules")
    asked = spark.createDataFrame([("r1", "lb", "lb")], "scope string, intent string, resource_type string")
    for rows in (sweep.rank_requests(asked, m), sweep.find_modules(asked, m)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") <= 3 and "posexplode(ask" not in plan  # by repository: the requests, and modules as arrays


def test_a_frequent_word_is_no_candidate(spark):
    m = spark.range(3000).selectExpr("'r' AS scope", "concat('modules/k', id) AS dir", "array('aws_cluster', concat('aws_t', id)) AS resource_types", "0 AS reuse_count")
    asked = spark.createDataFrame([("r", ["cluster", "t7"])], "scope string, ask array<string>")
    words = F.flatten(F.transform("resource_types", lambda t: F.split(t, "_")))
    assert sweep.candidates(asked, F.transform("ask", lambda w: F.array(w)), F.lit(1), m, words).count() == 1
    assert sweep.candidates(asked, F.transform("ask", lambda w: F.array(w)), F.lit(2), m, words).count() == 3000


def test_cases_share_no_word(spark):
    m = modules(spark, 12).cache()
    c = {(r["scope"], r["kind"]): r["want"] for r in sweep.cases(m).collect()}
    assert c == {(r["scope"], r["kind"]): r["want"] for r in sweep.cases(m.repartition(7), 42).collect()} != {(r["scope"], r["kind"]): r["want"] for r in sweep.cases(m, 7).collect()}
    own: dict[str, list] = {}
    for r in m.collect():
        own.setdefault(r["scope"], []).append((r["dir"], r["resource_types"] or []))
    tokens = lambda s: {w for w in "".join(x if x.isalnum() else " " for x in s.lower()).split()}
    aws = lambda ts: sorted(t for t in ts if t.startswith("aws_"))
    usable = {s for s, ms in own.items() if s and sum(bool(aws(t)) for _, t in ms) >= 2}
    vocabulary = {t for s in usable for _, ts in own[s] for t in aws(ts)}
    for s in own:
        said = {w for d, ts in own[s] for w in tokens(" ".join([d, *ts]))}
        free = {t for t in vocabulary if not tokens(t[4:]) & said}
        assert ((s, "positive") in c) == (s in usable) and ((s, "negative") in c) == (s in usable and bool(free))
        if s in usable:
            assert c[s, "positive"] in {aws(ts)[0] for _, ts in own[s] if aws(ts)}
            assert (s, "negative") not in c or c[s, "negative"] in free


def test_a_sweep_of_small_repositories_is_a_short_plan(spark):
    """The driver holds the plan, and again for each change that adaptive execution makes."""
    rows = sweep.report(sweep.sweep(modules(spark)))
    assert len(rows._jdf.queryExecution().executedPlan().toString()) < 60_000 and {r["who"] for r in rows.collect()} == {"planner", "compose"}


@pytest.mark.parametrize(("few", "types"), [(64, 256), (8, 256), (0, 256), (64, 3)])
def test_a_sweep_decides_as_its_cases_do(spark, monkeypatch, few, types):
    lost = spark.createDataFrame([(None, "modules/lost", ["aws_lb"], 9), ("r9", "modules/a", ["x", None, "aws_lb"], None), ("r9", "modules/b-db", ["aws_lb", "aws_db_lb"], 1), ("r9", None, ["aws_lb"], 3), ("r9", "modules/c", [], 3)], MODULES)
    m = sweep.written(modules(spark, 9).select(*sweep.MODULES).unionByName(lost), "modules")
    want = sorted(map(str, sweep.decisions(sweep.written(sweep.cases(m), "cases"), m).collect()))
    monkeypatch.setattr(sweep, "FEW", few)
    monkeypatch.setattr(sweep, "FEW_TYPES", types)
    assert sorted(map(str, sweep.sweep(m).collect())) == want and len(want) > 20


def test_a_sweep_of_small_repositories_shuffles_modules_once(spark):
    """Cases are drawn and decided beside a repository's array: nothing but the few types' words is moved."""
    rows = sweep.sweep(modules(spark))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(scope" not in plan and "SortMergeJoin" not in plan and sweep.lots(modules(spark).select(*sweep.MODULES))._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_report_and_thresholds(spark):
    rows = [("a", "positive", "aws_x", "planner", "m", True, True), ("b", "positive", "aws_x", "planner", "m", False, True), ("a", "negative", "aws_y", "planner", None, False, False), ("b", "negative", "aws_y", "planner", "m", False, False), ("a", "positive", "aws_x", "compose", "m", True, True)]
    df = spark.createDataFrame(rows, "scope string, kind string, want string, who string, dir string, strict boolean, lenient boolean")
    got = {r["who"]: tuple(r)[1:] for r in sweep.report(df).collect()}
    assert got == {"planner": (2, 0.5, 1.0, 2, 0.5, False), "compose": (1, 1.0, 1.0, 0, 0.0, True)}
    assert {r["who"]: r["ok"] for r in sweep.report(df, 0.9, 0.5).collect()} == {"planner": True, "compose": True}


def test_no_rows(spark):
    none = modules(spark).filter("false")
    asked = sweep.cases(none)
    assert asked.count() == 0 and sweep.report(sweep.decisions(asked, none)).count() == 0
    assert sweep.sweep(none.select(*sweep.MODULES)).count() == 0 and sweep.sweep(modules(spark).withColumn("resource_types", F.array(F.lit("x")))).count() == 0
