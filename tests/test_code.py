"""The code index on a small tree written here: symbols, edges, catalog, planner, expansion, inventory, layout."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import hcl
from quarrymill.functions import text as T
from quarrymill.operators import catalog, index, inventory, layout, retrieval
from quarrymill.sources import trees

TREE = {
    "live/nonprod/pay/web/terragrunt.hcl": 'include "root" {\n  path = find_in_parent_folders("root.hcl")\n}\n\nterraform {\n  source = "../../../../modules/aws/web"\n}\n\ndependency "net" {\n  config_path = "../net"\n}\n\n'
    'inputs = {\n  sg = module.remote_state.components[var.upstream_modules.sg]["sg_id"]\n  vpc = dependency.net.outputs.vpc_id\n}\n',
    "live/nonprod/pay/db/terragrunt.hcl": 'terraform {\n  source = "../../../../modules/aws/web"\n}\n',
    "modules/aws/web/main.tf": '# two resources\nresource "aws_instance" "web" {\n  ami = var.ami\n  dynamic "ebs_block_device" {\n    for_each = var.disks\n    content {\n      size = 1\n    }\n  }\n}\n\nresource "aws_eip" "ip" {\n}\n\nlocals {\n  o = { a = 1 }\n}\n',
    "modules/aws/web/variables.tf": 'variable "ami" {\n  type = string\n  description = "An image"\n}\n\nvariable "disks" {\n  type = list(object({\n    size = number\n  }))\n  default = []\n}\n',
    "modules/aws/web/outputs.tf": 'output "id" {\n  value = aws_instance.web.id\n}\n',
    "modules/aws/sg/main.tf": 'resource "aws_security_group" "sg" {\n  text = <<EOF\nresource "no" "block" {\nEOF\n}\n',
    "bill/aws/bill_nonprod/web/inputs.hcl": 'inputs = {\n  name = "w1"\n  size = "t3.large"\n  on = TRUE\n  nets = [{ name = "a" }]\n}\n',
    "auth/aws/auth_nonprod/web/inputs.hcl": 'inputs = {\n  name = "w2"\n  size = "t3.small"\n}\n',
    "root.hcl": 'remote_state {\n  backend = "s3"\n}\ngenerate "p" {\n  contents = "provider \\"aws\\" {"\n}\nlocals {\n  c = find_in_parent_folders("config.yml")\n  r = local.env_cfg.region\n}\n',
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in (TREE | {".terraform/x.tf": "a {\n}\n", "notes.md": "x"}).items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return trees.read_tree(spark, str(root)).cache()


@pytest.fixture(scope="module")
def facts(files):
    return index.parse(files).cache()


@pytest.fixture(scope="module")
def blocks(facts):
    return index.blocks(facts).cache()


@pytest.fixture(scope="module")
def edges(facts):
    return index.edges(facts).cache()


def test_files_are_listed(files):
    assert {r.file for r in files.collect()} == set(TREE)


def test_symbols(blocks):
    s = {(r.file, r.name, r.kind, r.parent) for r in index.symbols(blocks).collect()}
    main = "modules/aws/web/main.tf"
    assert (main, "aws_instance.web", "resource", None) in s
    assert (main, "ebs_block_device", "dynamic", "aws_instance.web") in s
    assert (main, "content", "content", "ebs_block_device") in s
    assert ("modules/aws/web/variables.tf", "ami", "variable", None) in s
    assert not any(name == "no.block" for _, name, *_ in s)


def test_all_five_edge_types(edges):
    web = "live/nonprod/pay/web/terragrunt.hcl"
    e = {(r.edge_type, r.module, r.name, r.output) for r in edges.collect() if r.file == web}
    assert ("module_source", "modules/aws/web", "terraform", None) in e
    assert ("remote_state", "sg", "sg", "sg_id") in e
    assert ("output_ref", "net", "net", "vpc_id") in e
    assert ("terragrunt", "find_in_parent_folders", "find_in_parent_folders", None) in e
    assert ("terragrunt", "include", "root", None) in e
    assert ("terragrunt", "live/nonprod/pay/net", "net", None) in e
    assert ("var_ref", "ami", "ami", None) in {(r.edge_type, r.module, r.name, r.output) for r in edges.collect()}


def test_lookups(files, blocks, edges):
    users = {"live/nonprod/pay/web/terragrunt.hcl", "live/nonprod/pay/db/terragrunt.hcl"}
    for name, found in (("modules/aws/web", users), ("web", users), ("other/web", set()), ("sg", set())):
        assert {r.file for r in index.find_importers(edges, name).collect()} == found
    assert {r.file for r in index.related(edges, "modules/aws/web/main.tf").filter("how = 'importer'").collect()} == users
    out = {(r.edge_type, r.name) for r in index.related(edges, "live/nonprod/pay/web/terragrunt.hcl").filter("how = 'imports'").collect()}
    assert {("module_source", "terraform"), ("remote_state", "sg"), ("output_ref", "net"), ("terragrunt", "root"), ("terragrunt", "net")} <= out
    assert index.normalise_key(files, "aws/sg/main.tf").first().file == "modules/aws/sg/main.tf"
    assert {r.dir for r in index.module_dirs(index.symbols(blocks)).collect()} == {"modules/aws/web", "modules/aws/sg"}
    assert {r.name for r in index.find_symbol(index.symbols(blocks), "AWS_", "resource").collect()} == {"aws_instance.web", "aws_eip.ip", "aws_security_group.sg"}


def test_catalog_and_planner(blocks, edges):
    c = catalog.build(blocks, edges, "modules/")
    web = c.filter("dir = 'modules/aws/web'").first()
    assert web.resource_types == ["aws_instance", "aws_eip"] and web.outputs == ["id"] and web.reuse_count == 2
    assert [(i.name, i.required) for i in web.inputs] == [("ami", True), ("disks", False)]
    assert web.inputs[0].description == "An image" and web.inputs[1].type == "list(object({"
    assert [r.r for r in c.filter("dir = 'modules/aws/web'").select(catalog.required_inputs(F.col("inputs")).alias("r")).collect()] == [["ami"]]
    ask = lambda q: catalog.plan(c, "dir", F.col("dir"), F.col("resource_types"), F.col("reuse_count"), q).first()
    assert ask("create an ec2 instance for pay nonprod project").candidates == ["modules/aws/web"]
    assert ask("a kinesis stream").decision == "write_new"
    assert {r.dir: r.names for r in catalog.upstream_pattern(c, edges).collect()} == {"modules/aws/web": ["sg", "net"]}
    deep = c.withColumn("dir", F.lit("modules/aws/infrastructure/database/main1")).withColumn("name", F.lit("main1"))
    assert catalog.plan(deep, "dir", F.col("dir"), F.array(), F.col("reuse_count"), "a database").first().decision == "reuse"
    found = catalog.match(c, "dir", catalog.document(F.col("name"), F.col("dir"), F.col("resource_types"), F.col("inputs"), F.col("outputs")), T.plain_tokens(F.col("name")), F.col("reuse_count"), "nothing alike")
    assert [r.id for r in found.collect()] == ["modules/aws/web"]  # reuse alone suffices


def test_outputs_alone_are_no_module(spark):
    files = spark.createDataFrame([("m/a/outputs.tf", 'output "x" {\n}\n'), ("m/b/main.tf", 'data "d" "e" {\n}\n'), ("m/b/outputs.tf", 'output "y" {\n}\n')], "file string, text string")
    blocks = index.parse_blocks(files)
    assert [(r.dir, r.outputs) for r in catalog.build(blocks, index.edges(index.parse(files))).collect()] == [("m/b", ["y"])]


def test_expansion_meets_each_file_once(spark, files, edges):
    hits = spark.createDataFrame([("live/nonprod/pay/web/terragrunt.hcl",), ("modules/aws/web/main.tf",)], "file string")
    e = edges.filter("edge_type = 'module_source'").select("file", F.col("module").alias("target"))
    assert {r.file for r in retrieval.expand(hits, e, files).collect()} == {"modules/aws/web/variables.tf", "modules/aws/web/outputs.tf"}


def test_expansion_of_crowded_directories(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SHARE_FILES", 20)
    tree = [(f"live/m{k % 3}/d{k}/main.tf",) for k in range(300)] + [("top.tf",)]
    hits = [(f"live/m0/d{k}/main.tf",) for k in range(0, 300, 3)]
    files, named = spark.createDataFrame(tree, "file string"), spark.createDataFrame(hits, "file string")
    for targets in (["live/m1"], ["live", "live/m1", "none"], ["", "live/m2/d2"], ["live/m1/d4"]):
        edges = spark.createDataFrame([(f, t) for (f,) in hits for t in targets if (f, t) != ("live/m0/d0/main.tf", "live/m2/d2")], "file string, target string")
        got = retrieval.expand(named, edges, files)
        below = lambda f, t: t == "" or f.startswith(t + "/")
        want = {}
        for f, t in edges.collect():
            for (x,) in tree:
                if below(x, t) and (x,) not in hits:
                    want[x] = min(want.get(x, f), f)
        assert {r.file: r.via for r in got.collect()} == want
    made = joined_rows(retrieval.expand(named, spark.createDataFrame([(f, "live") for (f,) in hits], "file string, target string"), files))
    assert made and max(made) <= 4 * len(tree)  # files with their ancestors, not files times hits


def joined_rows(df):
    """What each join of a plan gave, counted as it ran."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "Join" in name and node.metrics().contains("numOutputRows"):
            out.append(node.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            children = node.children()
            todo += [children.apply(k) for k in range(children.size())]
    return out


def test_inventory(files):
    comps = trees.components(files)
    rows, missing = inventory.find(comps, "web", where=["size=t3.large"])
    assert [(r.project, r.env, r["name"]) for r in rows.collect()] == [("bill", "bill_nonprod", "w1")] and missing.count() == 0
    rows, missing = inventory.find(comps, "web", where=["on=true"])
    assert rows.count() == 1
    rows, missing = inventory.find(comps, "web", where=["on!=true"])
    assert rows.count() == 0  # missing keys match neither = nor !=
    rows, missing = inventory.find(comps, "web", where=["nets.name=a"])
    assert rows.count() == 0 and [r.key for r in missing.collect()] == ["nets.name"]
    assert inventory.find(comps, "web", project="nope")[0].count() == 0


def test_layout(spark, files):
    got = layout.convention(files.withColumn("repo", F.lit("r"))).first()
    assert (got.kind, got.confidence) == ("terragrunt", "high")
    flat = spark.createDataFrame([("a", "main.tf", 'resource "x" "y" {}'), ("b", "main.tf", 'module "m" {'), ("c", "x.md", "")], "repo string, file string, text string")
    assert {tuple(r) for r in layout.convention(flat).collect()} == {("a", "tf-flat", "medium"), ("b", "tf-modules", "high"), ("c", "tf-flat", "low")}
    root = files.filter("file = 'root.hcl'").select(layout.root_schema(F.regexp_replace("text", r'\\"', '"')).alias("s")).first().s
    assert (root.env_config, root.fields, root.backend, root.provider, root.confidence) == ("config.yml", ["region"], "s3", "aws", "full")
    envs = spark.createDataFrame([("pay_nonprod", ""), ("pay_prod", "live")], "env string, config_env string")
    for word, want in (("pay-nonprod", {"pay_nonprod"}), ("live", {"pay_prod"}), ("nonprod", {"pay_nonprod"}), ("prod", {"pay_nonprod", "pay_prod"}), ("qa", set())):
        assert {r.env for r in layout.match_env(envs, word).collect()} == want
    p = spark.range(1).select(*[layout.component_path(F.lit("auth"), F.lit("aws"), F.lit(e), F.lit("ec2")).alias(e) for e in ("prod", "auth_prod")]).first()
    assert p.prod == p.auth_prod == "auth/aws/auth_prod/ec2"
    near = layout.nearest_above(files.filter("file like 'live/%'"), files, "root.hcl")
    assert {r.found for r in near.collect()} == {"root.hcl"}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.tokenize_code(F.lit("My_var x"))) == ["my_var", "my", "var", "x", "x"]
    assert one(T.resolve_relative(F.lit("a/b/c.tf"), F.lit("../m//${local.x}/n"))) == "a/m/n"
    assert one(T.resolve_relative(F.lit("c.tf"), F.lit("../m"))) == "../m"
    assert one(T.norm_value(F.lit(" 'True' "))) == "true"
    assert one(T.guess_type(F.lit("an RDS instance"))) == "aws_instance" and one(T.guess_type(F.lit("a key vault"), longest=True)) == "azurerm_key_vault"
    assert one(T.strip_fence(F.lit("```hcl\na = 1\n```"))) == "a = 1"
    assert one(T.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(trees.flat_yaml(F.lit('a: 1\nb: "x y" \n# c: 2\na: 3 # last\n'))) == {"a": "3", "b": "x y"}
    assert one(inventory.parse_request(F.lit("list EC2 in billing named web"))).asDict() == {"type": "ec2", "project": "billing", "name": "web"}


@pytest.mark.parametrize(("text", "n"), [('a { b = "}" } # }\nc = <<E\n}\nE\n', 0), ("a {", 1), ("a ]", 1), ("[1)", 1), ('a = "x', 1), ("/* x", 1), ("a = <<E\nx", 1), ('a = "x\\"y"', 0), ("", 0)])
def test_structural_problems(text, n):
    assert len(hcl.problems(text)) == n


def test_refresh_of_named_paths(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "file string, v int")
    new = spark.createDataFrame([("a", 2), ("c", 2)], "file string, v int")
    named = spark.createDataFrame([("a",), ("b",)], "file string")
    assert {tuple(r) for r in index.refresh(old, new, named).collect()} == {("a", 2), ("c", 1)}


def test_search_and_its_expansion(files, blocks, edges):
    from quarrymill.operators import search

    chunks = search.build_chunks(files, blocks, edges)
    assert {(r.symbol, r.kind) for r in chunks.collect()} >= {("aws_instance.web", "resource"), ("inputs.hcl", "component")}
    assert all(r.text.startswith(r.file + " " + r.symbol + "\n") for r in chunks.collect())
    got = search.search_and_expand(chunks, files, edges, "find the aws_instance web ami").collect()
    assert got[0].file == "modules/aws/web/main.tf" and got[0].reason == "retrieved"
    assert len({r.file for r in got}) == len(got)
    left = search.residual_tokens(files.filter("file like 'bill/%'").select("text"), ["bill", "T3.large", "w1"])
    assert [tuple(r) for r in left.collect()] == [(3, "t3.large")]


def test_expansion_meets_the_files_that_define_variables(spark):
    from quarrymill.operators import index, search

    rows = [
        ("app/main.tf", 'resource "aws_instance" "web" {\n  ami = var.image\n  size = var.size\n}\n'),
        ("app/settings.tf", 'variable "image" {\n  type = string\n}\n'),
        ("app/twice.tf", 'variable "image" {\n  type = string\n}\nvariable "unused" {}\n'),
        ("other/settings.tf", 'variable "size" {\n  type = string\n}\n'),
    ]
    files = spark.createDataFrame(rows, "file string, text string")
    blocks = index.parse_blocks(files)
    edges = index.edges(index.parse(files))
    got = search.search_and_expand(search.build_chunks(files, blocks, edges), files, edges, "aws_instance web").collect()
    assert [(r.file, r.reason) for r in got] == [("app/main.tf", "retrieved"), ("app/settings.tf", "dep:var_ref")]


def test_verbs(files):
    from quarrymill import cli

    ask = lambda verb, *words, **kw: cli.answer(files, verb, list(words), **kw).collect()
    assert {r.kind for r in ask("stats")} >= {"resource", "module_source", "var_ref"}
    assert {r.file for r in ask("importers", "modules/aws/web")} == {r.file for r in ask("related", "modules/aws/web/main.tf") if r.how == "importer"}
    assert [r.name for r in ask("outline", "modules/aws/web/outputs.tf")] == ["id"]
    assert ask("find", "sg", kind="resource")[0].name == "aws_security_group.sg"
    assert {r.edge_type for r in ask("imports", "modules/aws/web/main.tf")} == {"var_ref"}
    assert ask("plan", "an", "ec2", "instance")[0].decision == "reuse"
    assert ask("catalog", "security", "group")[0].id in ("modules/aws/sg", "modules/aws/web")
    assert len(ask("list", "web", project="bill")) == 1
    assert ask("convention")[0].kind == "terragrunt"
    assert ask("search", "aws_eip")[0].file == "modules/aws/web/main.tf"


def test_postings_as_a_table_and_counts_without_arrays(spark, tmp_path):
    texts = ["Foo_bar foo FOO__BAR _x_ éfoo foo", "", None, "foo foo_foo\tbar-foo", "Kelvin foo a_b a b", "nothing here", "_", "foo"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string").cache()
    same = lambda c: F.array_sort(c)
    equal = lambda t: lambda x: x == t
    for r in docs.select("text", same(T.tokenize_code(F.col("text"))).alias("a"), same(T.token_bag(F.col("text"))).alias("b"), *[F.size(F.filter(T.tokenize_code(F.col("text")), equal(t))).alias(f"n_{t}") for t in ("foo", "foo_bar", "b")], *[T.term_count(T.spaced(F.col("text")), T.spaced(F.col("text"), "A-Za-z0-9"), t).alias(f"m_{t}") for t in ("foo", "foo_bar", "b")], T.token_count(F.col("text")).alias("dl")).collect():
        if r.text is not None:
            assert r.a == r.b and r.dl == len(r.a)
            assert all(r[f"n_{t}"] == r[f"m_{t}"] for t in ("foo", "foo_bar", "b")), r.text
    path = f"file://{tmp_path}/index"
    retrieval.build_postings(docs, "k", F.col("text"), path, buckets=4)
    for said in ("foo bar", "the foo_bar", "create", "zzz"):
        want = [tuple(r) for r in retrieval.bm25(docs, "k", F.col("text"), said).collect()]
        got = [tuple(r) for r in retrieval.bm25_indexed(spark, path, said).collect()]
        assert [g[0] for g in got] == [w[0] for w in want] and all(abs(g[1] - w[1]) < 1e-9 for g, w in zip(got, want, strict=True))
    stats = {r.term: (r.df, r.tf) for r in retrieval.term_stats(docs, F.col("text")).collect()}
    assert stats["foo_bar"] == (1, 1) and stats["foo"][0] == 4


def test_references_run_over_line_ends_and_inputs_are_marked(spark):
    texts = {"a/b/inputs.hcl": "x = 1\n", "a/b/terragrunt.hcl": 'include {\n  path = find_in_parent_folders\n  (\n"r")\n}\ndependency "d" {\n}\ny = module.remote_state.components[\n  var.upstream_modules.sg\n]["id"] # var.no\nz = var.k + var.k\n'}
    files = spark.createDataFrame(list(texts.items()), "file string, text string")
    got = {tuple(r) for r in index.edges(index.parse(files)).collect()}
    t = "a/b/terragrunt.hcl"
    assert ("a/b/inputs.hcl", "terragrunt", "inputs.hcl", "inputs.hcl", None, 1, "inputs.hcl", None) in got
    assert (t, "terragrunt", "include", "", None, 1, "path = find_in_parent_folders", None) in got
    assert (t, "terragrunt", "dependency", "d", None, 6, "dependency", None) in got
    assert (t, "terragrunt", "find_in_parent_folders", "find_in_parent_folders", None, 2, "find_in_parent_folders\n  ()", None) in got
    assert {(r[1], r[2], r[4], r[5]) for r in got if r[1] in ("remote_state", "output_ref", "var_ref")} == {("remote_state", "sg", "id", 8), ("var_ref", "upstream_modules", None, 9), ("var_ref", "k", None, 11)}


def test_edges_of_some_types_are_those_of_all(spark):
    texts = {
        "a/terragrunt.hcl": 'include "root" {\n  path = find_in_parent_folders("root.hcl")\n}\ndependency "net" {\n  config_path = "../n"\n}\nterraform {\n  source = "../m"\n}\n',
        "a/main.tf": 'module "m" {\n  source = "../../m"\n  v = var.x\n  w = module.n.id\n  z = module.remote_state.components[var.upstream_modules.sg]["id"]\n}\nmodule "none" {\n}\n',
        "a/inputs.hcl": "inputs = {\n}\n", "inputs.hcl": "", "a/no_inputs.hcl": "",
    }
    facts = index.parse(spark.createDataFrame(list(texts.items()), "file string, text string")).cache()
    all_ = sorted(index.edges(facts).collect(), key=str)
    kinds = ("module_source", "remote_state", "var_ref", "output_ref", "terragrunt")
    assert {r.edge_type for r in all_} == set(kinds)
    for only in [(k,) for k in kinds] + [("remote_state", "output_ref"), ("module_source", "terragrunt")]:
        assert sorted(index.edges(facts, only=only).collect(), key=str) == [r for r in all_ if r.edge_type in only]


def test_names_and_folders_of_odd_paths(spark):
    from quarrymill.functions.text import basename, dirname

    paths = ["a", "a/b", "/a", "a/", "", "a//b", "é/ü/🙂.tf", "a/b\n", "/", None]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", basename(F.col("p")).alias("b"), dirname(F.col("p")).alias("d")).collect()
    assert [(r.b, r.d) for r in rows] == [(p and p.rsplit("/", 1)[-1], p.rsplit("/", 1)[0] if p and "/" in p else "") if p is not None else (None, "") for p in paths]


def test_importers_by_key_and_by_name(spark):
    """Of a key that is a module's, of one that only ends like it, of a name alone; each importer once."""
    define = 'variable "v" {\n}\n'
    texts = {"live/vpc/main.tf": define, "x/vpc/main.tf": define, "vpc/main.tf": define, "lone/main.tf": define, "main.tf": define} | {
        "u/1.tf": 'module "a" {\n  source = "../live/vpc"\n}\nmodule "b" {\n  source = "../x/vpc"\n}\n', "u/2.tf": 'module "a" {\n  source = "vpc"\n}\n', "u/3.tf": 'module "a" {\n  source = "git/elsewhere/vpc"\n}\n',
        "u/4.tf": 'module "a" {\n  source = "git/other"\n}\n',
    }
    facts = index.parse(spark.createDataFrame(list(texts.items()), "file string, text string")).cache()
    made = catalog.build(index.blocks(facts), index.edges(facts))
    got = {r.dir: (r.used_by, r.reuse_count) for r in made.collect()}
    every = ["u/1.tf", "u/2.tf", "u/3.tf"]
    assert got == {"live/vpc": (every, 3), "x/vpc": (every, 3), "vpc": (every, 3), "lone": ([], 0), "": ([], 0)}
    assert made.select("dir", "used_by")._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") == 2  # blocks once, edges once
