"""Bundles, prompts, missing files, whole requests; the blob store and its cache."""

from __future__ import annotations

import time

import pytest

from quarrymill.operators import grounding as G
from quarrymill.sources import trees
from quarrymill.sources.store import Store, TextCache

TEXTS = {
    "modules/aws/web/variables.tf": 'variable "size" {\n  type = number\n}\nvariable "name" {\n  type = string\n  default = "x"\n}\n',
    "modules/aws/web/main.tf": 'resource "aws_instance" "web" {\n  size = var.size\n}\n',
    "pay/aws/pay_dev/web/inputs.hcl": 'inputs = {\n  name = "w"\n  size = 1\n}\n',
    "pay/aws/pay_dev/web/terragrunt.hcl": 'terraform {\n  source = "../../../../modules/aws/web"\n}\n',
    "ops/aws/ops_prod/web/inputs.hcl": 'inputs = {\n  name = "o"\n  size = 2\n}\n',
    "ops/aws/ops_prod/db/inputs.hcl": 'inputs = {\n  name = "d"\n}\n',
    "ops/aws/common.hcl": 'inputs = {\n  account_id = "123"\n  team = "ops"\n}\n',
    "ops/aws/ops_prod/config.yml": "terraform_module: main\nregion: eu-west-1\naccount_id: 123\n",
}


@pytest.fixture(scope="module")
def code(spark):
    return G.Code.of(spark.createDataFrame(list(TEXTS.items()), "file string, text string").cache())


def test_a_bundle_and_its_prompt(code):
    b = G.gather(code, "web", "ops", "aws", query="web instance size", component_dir="pay/aws/pay_dev/web")
    assert b.decision == "reuse" and b.module["dir"] == "modules/aws/web" and b.variables == ["size", "name"]
    assert [s["file"] for s in b.siblings] == ["ops/aws/ops_prod/web/inputs.hcl"]
    said = G.prompt(b)
    assert "required inputs: size" in said and "optional inputs: name" in said and 'team = "ops"' in said and "== precedent " in said
    none = G.gather(code, "queue", "nope", "aws")
    assert none.decision == "net-new" and G.prompt(none).startswith("resource type: queue\ndecision: net-new")


def test_a_failing_search_costs_its_hits_only(code):
    def broken(query, k):
        raise RuntimeError("down")

    b = G.gather(code, "web", "ops", "aws", query="web", dense=broken)
    assert b.decision == "reuse" and b.precedents == [] and b.notes == ["search left out: RuntimeError"]


def test_environments(code):
    c = trees.components(code.files)
    assert G.resolve_env(c, "pay", "aws", "pay_dev") == ("pay_dev", "")
    assert G.resolve_env(c, "pay", "aws", "Pay-Dev")[0] == "pay_dev"
    assert G.resolve_env(c, "pay", "aws", "qa") == ("qa", "no environment qa among pay_dev")
    assert G.resolve_env(c, "new", "aws", "dev") == ("dev", "")


def test_files_that_a_new_project_lacks(code):
    assert G.missing(code.files, "ops", "aws", "ops_prod") == {}
    got = G.missing(code.files, "pay", "aws", "pay_new")
    assert got["pay/aws/pay_new/config.yml"] == "terraform_module: main\nenvironment: pay_new\nregion: eu-west-1\naccount_id: TODO\n"
    assert got["pay/aws/common.hcl"] == 'inputs = {\n  account_id = "TODO"\n  team = "ops"\n}\n'


def test_requests_become_components(code):
    ask = lambda **k: lambda text: {"project": "pay", "env": "pay_dev", "resource_type": "web"} | k
    (path, done), = G.from_text(code, "set the size of web to 5", ask(operation="update", specifics={"size": "5"}))
    assert path == "pay/aws/pay_dev/web/inputs.hcl" and "size = 5" in done.text and done.changed
    (path, done), = G.from_text(code, "change the box of the web", ask(resource_type="box", operation="update", specifics={"size": 7}))
    assert path == "pay/aws/pay_dev/web/inputs.hcl" and "size = 7" in done.text
    got = dict(G.from_text(code, "a db and a web like in ops", ask(project="ops", env="ops_new", operation="create", reference={"project": "ops"}, specifics={"name": "n"})))
    assert set(got) == {"ops/aws/ops_new/db/inputs.hcl", "ops/aws/ops_new/web/inputs.hcl"}
    (_, done), = G.from_text(code, "resize the queue", ask(resource_type="queue", operation="update", specifics={"size": 1}))
    assert done.refused == "the component does not exist"


def test_blobs_and_their_cache(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/blobs")
    assert s.keys() == [] and s.read("a/x") is None and not s.exists("a/x")
    s.write("a/x", b"\x00\xff1")
    s.write("a/x", "é".encode())
    s.write("b", b"2")
    assert s.read("a/x") == "é".encode() and s.keys() == ["a/x", "b"] and s.keys("a/") == ["a/x"]
    with pytest.raises(ValueError):
        s.read("../x")
    c = TextCache(s, most=1)
    assert [c.get("a/x"), c.get("a/x"), c.get("b"), c.get("a/x"), c.get("none")] == ["é", "é", "2", "é", None]
    assert c.stats() == {"hits": 1, "misses": 4, "hit_rate": 0.2, "size": 1}
    time.sleep(0.01)
    s.write("a/x", b"longer")
    assert c.get("a/x") == "longer"
    c.forget()
    s.delete("a")
    assert c.get("a/x") is None and s.keys() == ["b"]
