"""The kept index and the one-pass files job."""

from __future__ import annotations

import io
import tarfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrymill import cli
from quarrymill.functions import hcl
from quarrymill.operators import corpus, grounding, index
from quarrymill.operators.kept import KeptIndex
from quarrymill.plans import queries
from quarrymill.sources import archives

TREE = {f"m/d{k}/main.tf": f'variable "v{k}" {{\n}}\nresource "aws_r" "x" {{\n  a = var.v{k}\n}}\n' for k in range(20)} | {"m/empty.tf": "", "live/inputs.hcl": "inputs = {\n}\n"}


def table(spark, texts):
    return spark.createDataFrame(list(texts.items()), "file string, text string")


def same(kept, spark, texts):
    got = sorted(map(str, kept.facts().collect()))
    assert got == sorted(map(str, index.parse(table(spark, texts)).collect()))


def test_only_changes_are_parsed(spark, tmp_path, monkeypatch):
    kept = KeptIndex(spark, f"file://{tmp_path}/index", buckets=4)
    assert kept.facts().collect() == [] and kept.refresh(table(spark, TREE)) == {"parsed": 22, "gone": 0}
    same(kept, spark, TREE)
    later = {k: v for k, v in TREE.items() if "d3" not in k} | {"m/d1/main.tf": 'variable "w" {\n}\n', "m/new.tf": "locals {\n}\n", "m/empty.tf": None}
    assert kept.refresh(table(spark, later)) == {"parsed": 2, "gone": 1}
    same(kept, spark, later)
    monkeypatch.setattr(index, "parse", lambda files: pytest.fail("nothing has changed"))
    assert KeptIndex(spark, f"file://{tmp_path}/index", buckets=4).refresh(table(spark, later).repartition(5)) == {"parsed": 0, "gone": 0}


def test_named_paths_only(spark, tmp_path):
    kept = KeptIndex(spark, str(tmp_path / "index"), buckets=3)
    kept.refresh(table(spark, TREE))
    changed = {k: v + "# more\n" for k, v in TREE.items() if k != "m/d2/main.tf"}
    paths = spark.createDataFrame([("m/d1/main.tf",), ("m/d2/main.tf",), ("m/nowhere.tf",)], "file string")
    assert kept.refresh(table(spark, changed), paths) == {"parsed": 1, "gone": 1}
    same(kept, spark, {k: v for k, v in TREE.items() if k != "m/d2/main.tf"} | {"m/d1/main.tf": changed["m/d1/main.tf"]})
    assert kept.refresh(table(spark, {"a": ""}).limit(0)) == {"parsed": 0, "gone": 21} and kept.facts().collect() == []
    assert kept.refresh(table(spark, TREE)) == {"parsed": 22, "gone": 0}


def test_a_bucket_of_many_texts_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quarrymill.operators.kept.SHARE_CHARS", 200)
    kept = KeptIndex(spark, f"file://{tmp_path}/index", buckets=2)
    assert kept.refresh(table(spark, TREE)) == {"parsed": 22, "gone": 0}
    same(kept, spark, TREE)
    assert max(len(list(b.glob("*.parquet"))) for b in (tmp_path / "index").glob("bucket=*")) > 1
    later = TREE | {"m/d1/main.tf": None}
    del later["m/d2/main.tf"]
    assert kept.refresh(table(spark, later)) == {"parsed": 1, "gone": 1}
    same(kept, spark, later)
    assert max(len(list(b.glob("*.parquet"))) for b in (tmp_path / "index").glob("bucket=*")) > 1  # those that stay are dealt as well


def test_a_split_of_many_texts_is_parsed_by_several_tasks(spark):
    one = table(spark, TREE).coalesce(1)
    parsed = index.parse(one)
    assert len(set(r["p"] for r in parsed.select(F.spark_partition_id().alias("p")).collect())) > 1
    assert sorted(map(str, parsed.collect())) == sorted(map(str, index.parse(table(spark, TREE)).collect()))


@pytest.mark.parametrize("name", ["expand_hop", "module_choice", "reuse_count", "upstream_names"])
def test_queries_deal_texts_before_they_parse_them(spark, monkeypatch, name):
    parse, plans = index.parse, []

    def seen(files, *carry):
        out = parse(files, *carry)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(index, "parse", seen)
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert plans and all("REPARTITION_BY_NUM" in p.split("MapInArrow", 1)[1] for p in plans)


def test_a_first_index_joins_nothing(spark, tmp_path, monkeypatch):
    parse, plans = index.parse, []

    def seen(files, *carry):
        plans.append(files._jdf.queryExecution().executedPlan().toString())
        return parse(files, *carry)

    monkeypatch.setattr(index, "parse", seen)
    kept = KeptIndex(spark, str(tmp_path / "index"), buckets=4)
    twice = table(spark, TREE).unionByName(table(spark, {"m/d1/main.tf": 'variable "again" {\n}\n'}))
    assert kept.refresh(twice.unionByName(spark.createDataFrame([(None, "x {\n}\n")], "file string, text string"))) == {"parsed": 22, "gone": 0}
    assert len(plans) == 1 and "Join" not in plans[0] and "md5" not in plans[0]
    assert sorted(map(str, kept.facts().collect())) == sorted(map(str, parse(twice).collect()))
    some = KeptIndex(spark, str(tmp_path / "some"), buckets=4)
    assert some.refresh(twice, spark.createDataFrame([("m/d1/main.tf",), ("m/d2/main.tf",), ("none",)], "file string")) == {"parsed": 2, "gone": 0}
    assert {r.file for r in some.files().collect()} == {"m/d1/main.tf", "m/d2/main.tf"}


def test_equal_texts_are_parsed_once(monkeypatch):
    texts = ['resource "a" "b" {\n  c = var.d\n}\n', None, 'x {\n}\n', 'resource "a" "b" {\n  c = var.d\n}\n', "", "# none", 'x {\n}\n']
    scan, seen = hcl.scan, []
    monkeypatch.setattr(index, "FACT_ROWS", 2)
    monkeypatch.setattr(hcl, "scan", lambda text: seen.append(text) or scan(text))
    files = pa.RecordBatch.from_pydict({"file": [f"f{k}" for k in range(7)], "text": texts, "version": list(range(7))})
    names = ["file", "fact", "file_hash", "block_id", "type", "labels", "body", "edge_type", "module", "raw"]
    schema = pa.schema([(n, pa.list_(pa.string()) if n == "labels" else pa.int32() if n == "block_id" else pa.string()) for n in names] + [("version", pa.int64())])
    got = [row for batch in index._facts_of_all(files, schema) for row in batch.to_pylist()]
    assert sorted(seen) == sorted({t or "" for t in texts})
    assert got == [{n: None for n in names} | {k: v for k, v in fact.items() if k in names} | {"file": f"f{k}", "version": k} for k, t in enumerate(texts) for fact in index._facts_of(t or "")]


def test_a_large_first_index_shuffles_texts_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quarrymill.operators.kept.SHARE_CHARS", 200)
    save, plans = KeptIndex._save, []
    monkeypatch.setattr(KeptIndex, "_save", lambda self, rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or save(self, rows))
    kept = KeptIndex(spark, f"file://{tmp_path}/index", buckets=3)
    assert kept.refresh(table(spark, TREE)) == {"parsed": 22, "gone": 0}
    assert len(plans) == 1 and "Exchange" not in plans[0].split("MapInArrow")[0] and plans[0].count("Exchange") == 1
    same(kept, spark, TREE)
    later = {k: v for k, v in TREE.items() if "d3" not in k}
    assert kept.refresh(table(spark, later)) == {"parsed": 0, "gone": 1}
    same(kept, spark, later)


def test_a_lost_bucket_is_parsed_again(spark, tmp_path):
    import shutil

    kept = KeptIndex(spark, str(tmp_path / "index"), buckets=4)
    kept.refresh(table(spark, TREE))
    lost = next((tmp_path / "index").glob("bucket=*"))
    shutil.rmtree(lost)
    assert kept.refresh(table(spark, TREE))["parsed"] > 0
    same(kept, spark, TREE)


def test_answers_from_kept_facts(spark, tmp_path):
    kept = KeptIndex(spark, str(tmp_path / "index"))
    files = table(spark, TREE)
    kept.refresh(files)
    for verb, words in (("stats", []), ("outline", ["m/d5/main.tf"]), ("imports", ["m/d5/main.tf"]), ("catalog", ["v5"])):
        assert sorted(map(str, cli.answer(files, verb, words, facts=kept.facts()).collect())) == sorted(map(str, cli.answer(files, verb, words).collect()))
    assert grounding.Code.of(files, kept.facts()).modules.count() == 20


@pytest.mark.parametrize("verb", ["imports", "outline"])
def test_one_python_pass(spark, verb):
    df = cli.answer(table(spark, TREE), verb, ["m/d5/main.tf"])
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_archives_are_opened_once(spark, tmp_path):
    for repo, members in {1: {"a.tf": "a {\n}\n", "b.tf": "b {\n"}, 2: {"a.tf": "a {\n}\n", "k.tf": 'k = "AKIA' + "A" * 16 + '"\n', "c.hcl": "c = 1\n"}}.items():
        with tarfile.open(tmp_path / f"{repo}_x.tar.gz", "w:gz") as tar:
            for name, text in members.items():
                info = tarfile.TarInfo(name)
                info.size = len(text)
                tar.addfile(info, io.BytesIO(text.encode()))
    opened = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            opened.add(len(batch))
            yield batch

    files = archives.read_archives(spark, str(tmp_path))
    files = files.mapInPandas(counted, files.schema)
    got = corpus.run_files_job(files, str(tmp_path / "out")).first()
    assert got.asDict() == {"files": 5, "parse_ok": 4, "no_secret": 3, "unique": 2} and opened.value == 5
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.repo_id, r.path, r.ext) for r in rows.collect()} == {(1, "a.tf", ".tf"), (2, "c.hcl", ".hcl")}
    empty = corpus.run_files_job(files.limit(0).withColumn("x", F.lit(1)), str(tmp_path / "none")).first()
    assert empty.asDict() == {"files": 0, "parse_ok": 0, "no_secret": 0, "unique": 0}
