from __future__ import annotations

import pytest

from quarrymill.functions import hcl
from quarrymill.operators import compose, edits
from quarrymill.sources import sinks

TEXT = 'inputs = {\n  name = "a" # keep\n  on = true\n  nets = [\n    {\n      name = "n1"\n      size = 2\n    },\n  ]\n  ids = ["x", "y"]\n}\n'


def test_values_are_flattened():
    assert hcl.read_values(TEXT) == {"name": "a", "on": "true", "nets": '[{"name": "n1", "size": 2}]', "nets[0]": '{"name": "n1", "size": 2}', "nets[0].name": "n1", "nets[0].size": "2", "ids": '["x", "y"]', "ids[0]": "x", "ids[1]": "y"}
    assert hcl.top_scalars('a = "x"\nb = 2\nc = [1]\nd = var.x\n') == {"a": "x", "b": "2"}


def test_edits_leave_other_bytes_alone():
    text, results = hcl.apply_edits(TEXT, [{"path": "name", "op": "set", "value": "b"}])
    assert text == TEXT.replace('"a"', '"b"') and results[0]["ok"]
    text, _ = hcl.apply_edits(TEXT, [{"path": "ids", "op": "add", "value": "z"}])
    assert text == TEXT.replace('"y"]', '"y", "z"]')
    text, _ = hcl.apply_edits(TEXT, [{"path": "ids", "op": "remove", "index": 1}])
    assert text == TEXT.replace(', "y"', "")
    text, _ = hcl.apply_edits(TEXT, [{"path": "on", "op": "remove"}])
    assert text == TEXT.replace("  on = true\n", "")
    text, _ = hcl.apply_edits(TEXT, [{"path": "nets", "op": "remove", "match": {"name": "n1"}}])
    assert hcl.read_values(text)["nets"] == "[]"


def test_edits_are_verified_and_failures_recorded():
    edits = [{"path": "new", "op": "set", "value": 3}, {"path": "nets", "op": "add", "value": {"name": "n2"}}, {"path": "name", "op": "add", "value": 1}, {"path": "gone.x", "op": "remove"}]
    text, results = hcl.apply_edits(TEXT, edits)
    assert [r["ok"] for r in results] == [True, True, False, False]
    assert [v["ok"] for v in hcl.verify_edits(text, edits[:2])] == [True, True] and not hcl.problems(text)


def test_each_text_is_read_once(monkeypatch):
    read, reads = hcl.read_tree, []
    monkeypatch.setattr(hcl, "read_tree", lambda text: reads.append(text) or read(text))
    text, tree = TEXT, None
    for path, op, value in [("name", "set", '"b"'), ("no.such[1]", "remove", None), ("ids", "add", '"z"'), ("on", "remove", None)]:
        text, tree, how, verified, error = edits._apply(text, tree, {"path": path, "op": op, "value": value, "index": None, "match": None, "kind": None})
        assert verified == (not error) == (how != "skipped")
    assert len(reads) == len(set(reads)) == 4 and reads[-1] == text and tree == read(text)


def test_few_edits_are_dealt_to_several_tasks(spark):
    files = spark.createDataFrame([(f"f{k}", TEXT) for k in range(12)], "file string, text string").coalesce(1)
    asked = files.selectExpr("file", "1L AS seq", "'name' AS path", "'set' AS op", "'\"b\"' AS value", "cast(null AS int) AS index", "cast(null AS string) AS match", "cast(null AS string) AS kind")
    rows = edits.apply_edits(files, asked).selectExpr("*", "spark_partition_id() AS task").collect()
    assert len(rows) == 24 and len({r["task"] for r in rows}) > 1 and all(r["verified"] or r["text"] == TEXT.replace('"a"', '"b"') for r in rows)


def test_coercion():
    assert hcl.coerce("Yes", "bool") is True and hcl.coerce("12", "number") == 12 and hcl.coerce(5, "string") == "5" and hcl.coerce("x", "number") == "x"


def test_chunks_end_where_no_brace_is_open():
    text = "a {\n  x = 1\n}\n\nb {\n}\n"
    assert hcl.smart_chunks(text, 5) == ["a {\n  x = 1\n}", "\nb {\n}"] and hcl.smart_chunks(text, 100) == [text]
    assert hcl.smart_chunks("}\n}\n{\n" * 3, 2) == ["}\n}\n{\n}\n}\n{\n}\n}\n{"]  # a stray brace is no end
    assert hcl.smart_chunks("x = 1\n   \n" * 3, 4)[0] == "x = 1"


@pytest.mark.parametrize("line, n", [("a { b {", 2), ("} # {{", -1), ("// {", 0), ("a /* { */ {", 1), ("/* { /*/ {", 1), ("*// {", 0), ('"{" {', 2), ('# "{" {', 1), ("# \\{", 1), ('"\\"{" }', 0), ('"open { # {', 2), ("/* a\n", 0), ("\\", 0)])
def test_depths_of_lines(line, n):
    assert hcl.depth_change(line) == n


def intent(text="", **kw):
    return compose.normalise_intent({"resource_type": "EC2 box", "project": "p", "env": "prod"} | kw, text)


def test_intents():
    i = intent("please delete it")
    assert i["resource_type"] == "ec2_box" and i["operation"] == "delete" and compose.is_ambiguous(i)
    assert compose.missing_fields(compose.normalise_intent({}, "")) == ["resource_type", "project", "env"]
    assert compose.parse_json('```json\n{"a": 1}\n```') == {"a": 1}


def test_a_declared_scalar_needs_no_model():
    c = compose.compose(intent(operation="update", specifics={"name": "b"}), TEXT, {"name": "string"})
    assert c.changed and c.text == TEXT.replace('"a"', '"b"')
    assert not compose.compose(intent(operation="update", specifics={"name": "a"}), TEXT, {"name": "string"}).changed


def test_an_add_keeps_only_additions():
    plan = lambda text, left: [{"path": "ids", "op": "add", "value": "z"}, {"path": "name", "op": "set", "value": "no"}]
    c = compose.compose(intent(operation="add", specifics={"ids": "z"}), TEXT, {"ids": "list"}, plan_edits=plan)
    assert '"z"' in c.text and '"no"' not in c.text and c.notes == ["dropped set of name"]


def test_guards(tmp_path):
    assert compose.compose(intent(operation="update", specifics={"a": 1}), None, {}).refused
    assert compose.compose(intent(), None, {}, generate=lambda p: "```hcl\na = {\n```").refused
    write = lambda text, before="": sinks.write_to_tree(sinks.Artifact("d/x.hcl", text, before), str(tmp_path))
    assert write("a = 1\n", "a = 1\n")[0] == "unchanged" and write('a = "x\n')[0] and write("a = 1 # TODO\n") == ("", ["TODO left in the text"])
    assert write("a = 2\n")[0] == "exists" and sinks.write_to_tree(sinks.Artifact("../x", "a"), str(tmp_path))[0] == "outside the tree"
    assert "+b" in sinks.unified_diff("a\n", "b\n", "x")


def test_rendering():
    inputs = [{"name": "ami", "required": True, "type": "string"}, {"name": "n", "required": True, "type": "number"}, {"name": "o", "required": False}]
    text = compose.module_call("m", "../x", inputs, {"n": 2})
    assert text == 'module "m" {\n  source = "../x"\n  ami = "" # TODO\n  n = 2\n}\n' and not hcl.problems(text)
    assert all(not hcl.problems(t) for t in compose.module_scaffold("aws_x", "y").values())
    assert "account_id: TODO" in compose.env_config("m", "prod", "eu")


def test_embedding_table_reuses_vectors(spark, tmp_path):
    t = sinks.EmbeddingTable(spark, str(tmp_path / "v"))
    t.clear()
    chunks = spark.createDataFrame([("a", "x", "1"), ("b", "y", "2")], "chunk_id string, text string, hash string")
    assert t.missing(chunks, "m").count() == 2
    t.append(spark.createDataFrame([("m", "a", "1", [1.0])], "model string, chunk_id string, hash string, vector array<float>"))
    assert [r.chunk_id for r in t.missing(chunks, "m").collect()] == ["b"] and t.missing(chunks, "other").count() == 2
