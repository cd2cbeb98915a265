from __future__ import annotations

from pathlib import Path

import pytest

import corpus_pipeline
from quarrymill.llm import bagminhash, mixing, pii, toxicity
from quarrymill.llm import queries as llm_queries
from quarrymill.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def test_stages_one_after_another(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = list(corpus_pipeline.COLUMNS)
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if k < 4:
            assert docs.columns == columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = seen["toxicity"]
    bad = {r.doc_id for r in toxicity.score_toxicity(before, table(spark, SF, "labels")).filter("predicted = 1").collect()}
    assert ids(after) == ids(before) - bad
    before, after = seen["near_duplicates"]
    assert ids(after) == {r.class_id for r in bagminhash.near_duplicates(before).collect()} and after.count() == len(ids(after))
    before, after = seen["pii"]
    assert ids(after) == ids(before) and pii.find_pii(after).agg({"n_email": "sum"}).first()[0] == 0
    before, after = seen["mixing"]
    target = {r.source: r.target for r in mixing.copies(before).collect()}
    largest = {r.source: r.n for r in before.select("source", mixing.word_count(before["text"]).alias("n")).groupBy("source").agg({"n": "max"}).withColumnRenamed("max(n)", "n").collect()}
    words = {r.source: r.n for r in after.select("source", mixing.word_count(after["text"]).alias("n")).groupBy("source").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert all(abs(words.get(s, 0) - target[s]) <= largest[s] for s in target)
    before, after = seen["packing"]
    assert after.filter("start = 0").count() == before.count()


def test_run_and_odd_documents(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    schema = "doc_id long, text string, lang string, source string, n_chars long, TEXT_2 string, score double"
    odd = spark.createDataFrame([(1, None, None, None, None, "a", 0.1), (None, "", "en", "s", 0, None, None), (2, "word " * 30_000, "en", "s", 150_000, None, None), (3, "a b c", "en", None, 5, None, None), (3, "a b c", "en", None, 5, None, None)], schema)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, SF)
            assert docs.columns == list(corpus_pipeline.COLUMNS), name
        corpus_pipeline.STAGES[4][1](spark, docs, SF).count()


def test_thirteen_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in llm_queries.queries()) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "packing"]
