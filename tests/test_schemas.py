"""Root schemas, and edits as a table."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import hcl
from quarrymill.operators import catalog, edits, index, layout

TEXT = 'inputs = {\n  name = "a" # keep\n  on = true\n  nets = [\n    {\n      name = "n1"\n    },\n  ]\n}\n'


@pytest.mark.parametrize(
    "source, want",
    [
        ("${get_parent_terragrunt_dir()}/modules//aws/infrastructure/${local.env_cfg.terraform_module}/${basename(get_original_terragrunt_dir())}/", "modules/aws/infrastructure/{terraform_module}/{component}"),
        ("../../../../modules/aws/resource/ec2", "modules/aws/resource/ec2"),
        ("${get_repo_root()}/modules/net/", "modules/net"),
        ("git::https://x/y.git", None),
        ("modules/", None),
    ],
)
def test_templates(spark, source, want):
    got = spark.createDataFrame([(source,)], "s string").select(layout.source_template(F.col("s")).alias("t"), layout.static_prefix(layout.source_template(F.col("s"))).alias("p")).first()
    assert got.t == want and got.p == (want and want.split("/{")[0])


def test_roots_are_looked_for_by_each_rows_own_name(spark):
    files = [("a/b/c/terragrunt.hcl", "find_in_parent_folders('x.hcl')"), ("a/x.hcl", ""), ("x.hcl", ""), ("a/b/terragrunt.hcl", "find_in_parent_folders( )"), ("terragrunt.hcl", ""), (".t/terragrunt.hcl", "find_in_parent_folders()"), ("z/terragrunt.hcl", "find_in_parent_folders(\"no.hcl\")")]
    df = spark.createDataFrame([("r", *f) for f in files] + [("other", "a/b/x.hcl", "")], "repo string, file string, text string")
    got = {(r.file, r.target, r.found) for r in layout.included_roots(df).collect()}
    assert got == {("a/b/c/terragrunt.hcl", "x.hcl", "a/x.hcl"), ("a/b/terragrunt.hcl", "terragrunt.hcl", "terragrunt.hcl")}


def test_texts_and_contracts(spark):
    one = spark.range(1).select(layout.include_block(F.lit("root.hcl")).alias("a"), layout.include_block(F.lit("terragrunt.hcl")).alias("b"), layout.fill(F.lit(layout.TEMPLATE), F.lit("aws"), F.lit("env"), F.lit("ec2")).alias("c")).first()
    assert one.a == 'include {\n  path = find_in_parent_folders("root.hcl")\n}\n' and one.b == "include {\n  path = find_in_parent_folders()\n}\n" and one.c == "modules/aws/infrastructure/env/ec2"
    facts = index.parse(spark.createDataFrame([("m/v.tf", 'variable "a" {\n  default = 1\n}\nvariable "b" {\n  type = list(string)\n}\n')], "file string, text string"))
    made = catalog.build(index.blocks(facts), index.edges(facts)).select(catalog.contract(F.col("inputs")).alias("c")).first().c
    assert made == {"b": "list(string)", "a": ""}


def test_environments_of_plain_repositories(spark):
    files = spark.createDataFrame([("pay/envs/prod/main.tf",), ("prod/x.tf",), ("live/qa/a/b.tf",)], "file string")
    find = lambda p, e: [r.dir for r in layout.plain_env_dirs(files, p, e).collect()]
    assert find("pay", "prod") == ["prod"] and find("", "qa") == ["live/qa"] and find("pay", "dev") == []
    assert [r.dir for r in layout.plain_env_dirs(files.filter("file like 'pay%'"), "pay", "prod").collect()] == ["pay/envs/prod"]


def test_edits_of_files(spark):
    rows = [
        ("a", 1, "name", "set", '"b"', None, None, None), ("a", 2, "name", "set", '"b"', None, None, None), ("a", 3, "size", "set", '"7"', None, None, "number"), ("a", 4, "nets", "remove", None, None, '{"name": "n1"}', None),
        ("a", 5, "nets", "remove", None, 3, None, None), ("a", 6, "on", None, "false", None, None, "bool"), ("a", 7, None, "set", "1", None, None, None), ("a", 8, "x", "set", "{", None, None, None), ("a", 9, "size", "turn", "1", None, None, None),
        ("b", None, "k", "set", "1", None, None, None), ("none", 1, "k", "set", "1", None, None, None),
    ]
    files = spark.createDataFrame([("a", TEXT), ("b", None), ("c", TEXT)], "file string, text string").withColumn("seq", F.lit("clash"))
    got = edits.apply_edits(files, spark.createDataFrame(rows, edits.EDITS).repartition(3)).collect()
    how = [(r.file, r.seq, r.how, r.verified) for r in got if r.how]
    assert sorted(how, key=str) == sorted([("a", 1, "replaced", True), ("a", 2, "unchanged", True), ("a", 3, "injected", True), ("a", 4, "removed", True), ("a", 5, "skipped", False), ("a", 6, "replaced", True), ("a", 7, "skipped", False), ("a", 8, "skipped", False), ("a", 9, "skipped", False), ("b", None, "injected", True), ("none", 1, "skipped", False)], key=str)
    texts = {r.file: r.text for r in got if r.text is not None}
    assert texts == {"a": 'inputs = {\n  name = "b" # keep\n  on = false\n  nets = [\n  ]\n  size = 7\n}\n', "b": "k = 1\n"}
    assert edits.apply_edits(files, spark.createDataFrame([], edits.EDITS)).collect() == []


def test_many_edits_of_one_file_are_streamed_in_order(spark):
    rows = [("a", k, f"k{k % 50}", "set", json.dumps(k), None, None, None) for k in range(400)]
    got = edits.apply_edits(spark.createDataFrame([("a", "")], "file string, text string"), spark.createDataFrame(rows, edits.EDITS).repartition(4))
    text = got.filter("text is not null").first().text
    assert {k: int(v) for k, v in hcl.read_values(text).items()} == {f"k{k}": 350 + k for k in range(50)}
