"""Types, environments, references and modules that a request means, and the tools for agents."""

from __future__ import annotations

import pytest

from quarrymill import tools
from quarrymill.functions import hcl
from quarrymill.functions import text as T
from quarrymill.operators import requests as R
from quarrymill.sources import trees


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_types_named_in_a_request(spark):
    v = spark.createDataFrame([("vpc",), ("security-group",), ("ec2",), ("rds",), ("a.b",), ("",)], "component string")
    assert [r[0] for r in rows(R.named_types(v, "An RDS beside a Security Group, then ec2-x and myvpc; axb", "rds"))] == ["rds", "security-group", "ec2"]
    assert [r[0] for r in rows(R.named_types(v, "nothing", "subnet"))] == ["subnet"]
    assert rows(R.real_type(v, "a subnet in the vpc", "subnet")) == [("vpc", True)]
    assert rows(R.real_type(v, "a vpc and an rds", "rds")) == [("rds", False)]
    assert rows(R.real_type(v, "a thing", "thing")) == [("thing", False)]
    assert rows(R.real_type(v.limit(0), "a thing", "thing")) == [("thing", False)]


def component_files(spark):
    names = ["pay/aws/pay_dev/web/inputs.hcl", "pay/aws/pay_prod/web/inputs.hcl", "pay/aws/pay_prod/db/inputs.hcl", "ops/aws/ops_dev/web/inputs.hcl"]
    return trees.components(spark.createDataFrame([(n, "inputs = {\n  name = \"x\"\n}\n") for n in names], "file string, text string"))


def test_references_and_environments(spark):
    c = component_files(spark)
    hits = spark.createDataFrame([("live/none.tf", 0), ("pay/aws/pay_prod/web/main.tf", 1), ("pay/aws/pay_dev/db/main.tf", 2)], "file string, rank int")
    pick = lambda **k: rows(R.reference(c, hits, project="pay", provider="aws", component="web", **k).select("env", "how"))
    assert pick(env="Pay-Dev") == [("pay_dev", "requested")]
    assert pick(env="elsewhere") == [("pay_prod", "retrieved")]
    assert rows(R.reference(c, hits.limit(1), project="pay", provider="aws", component="web").select("env", "how")) == [("pay_dev", "any")]
    assert rows(R.reference(c, hits, project="pay", provider="aws", component="nope")) == []
    assert rows(R.pick_env(hits, ["pay_dev", "pay_prod"])) == [("pay_prod",)]
    assert rows(R.pick_env(hits, ["qa"])) == []
    assert sorted(rows(R.envs_with(c, "db"))) == [("pay", "aws", "pay_prod")]


MODULES = [
    ("modules/aws/infrastructure/main/web", "web", ["aws_instance", "aws_security_group"], 2),
    ("modules/aws/infrastructure/main/db", "db", ["aws_db_instance"], 5),
    ("modules/aws/other/queue", "queue", ["aws_sqs_queue"], 0),
]


def test_modules_for_a_type(spark):
    m = spark.createDataFrame(MODULES, "dir string, name string, resource_types array<string>, reuse_count int")
    one = lambda df: [r["name"] for r in df.collect()]
    assert one(R.find_module(m, "aws_instance")) == ["web"]
    assert one(R.find_module(m, "INSTANCE")) == ["db"]  # in part, the most reused
    assert one(R.find_module(m, "lambda")) == one(R.find_module(m, "")) == []
    hits = spark.createDataFrame([("modules/aws/other/queue/main.tf", 0), ("modules/aws/infrastructure/main/db/main.tf", 1)], "file string, rank int")
    assert one(R.nearest_module(hits, m, "rds")) == ["db"]
    assert one(R.entry_of(m, "db", "main")) == ["db"] and one(R.entry_of(m, "web", "elsewhere")) == ["web"] and one(R.entry_of(m, "sqs", "x")) == ["queue"]


def test_the_whole_path_says_what_a_module_is(spark):
    m = spark.createDataFrame([("modules/aws/infrastructure/database/main1", "main1", [], 0)], "dir string, name string, resource_types array<string>, reuse_count int")
    hits = spark.createDataFrame([("modules/aws/infrastructure/database/main1/main.tf", 0)], "file string, rank int")
    assert R.nearest_module(hits, m, "database").first()["name"] == R.entry_of(m, "database", "x").first()["name"] == "main1"


def test_verdicts_and_samples(spark):
    s = spark.createDataFrame([("a", "fmt", True, False), ("a", "plan", False, True), ("b", "fmt", False, False), ("b", "plan", True, False), ("c", "plan", False, True)], "run string, stage string, ok boolean, skipped boolean")
    assert sorted(rows(R.verdict(s, ("run",)))) == [("a", True, []), ("b", False, ["fmt"]), ("c", True, [])]
    d = spark.range(100)
    assert rows(R.sample(d, "id", 5)) == rows(R.sample(d.repartition(7), "id", 5)) != rows(R.sample(d, "id", 5, seed=1))


@pytest.mark.parametrize(("value", "kind", "want"), [("5.0", "number", 5), ("5.5", "number", 5.5), ("x", "number", "x"), (True, "number", True), ("12", "int", 12), ("on", "bool", False), ("YES", "bool", True), (1, "bool", True), (5, "string", "5"), ("[1]", "list(string)", "[1]"), ("7", "number # count", 7)])
def test_values_are_coerced_as_declared(value, kind, want):
    got = hcl.coerce(value, kind)
    assert got == want and type(got) is type(want)


def test_ties_of_keywords_go_by_the_table(spark):
    said = spark.createDataFrame([("a vm with sg",), ("one ECS cluster",), ("nothing",)], "t string")
    assert rows(said.select(T.guess_type(said["t"], longest=True), T.guess_type(said["t"]))) == [("aws_instance", "aws_security_group"), ("aws_ecs_cluster", "aws_RESOURCE"), ("UNKNOWN_RESOURCE", "aws_RESOURCE")]


def test_tools_answer_with_text(spark):
    texts = {"modules/web/main.tf": 'variable "ami" {}\nresource "aws_instance" "web" {\n  ami = var.ami\n}\n', "app/main.tf": 'module "web" {\n  source = "../modules/web"\n}\n'}
    t = tools.tools(spark.createDataFrame(list(texts.items()), "file string, text string"))
    assert t["find"]("AMI") == "variable ami modules/web/main.tf:1"
    assert t["find"]("zzz").startswith("no symbol")
    assert t["outline"]("app/main.tf") == "module web 1-3"
    assert t["related"]("modules/web/main.tf") == "importer app/main.tf\nimports var_ref ami"
    assert t["search"]("web ami instance").startswith("[retrieved] modules/web/main.tf:2")
    assert "modules/web" in t["catalog"]("web instance") and t["plan"]("an ec2 instance for web").startswith("reuse: modules/web")
