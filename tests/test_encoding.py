"""Encoding that goes on where it stopped: what the encoder was asked, and what is kept."""

from __future__ import annotations

import uuid
from collections import Counter
from pathlib import Path

import pytest

from quarrymill.operators.encoding import EncodedTexts, EncodingFailed, attempt


def encoder_into(log: Path, refuse: str = "", die: str = ""):
    """An encoder that writes down each batch it has encoded; it refuses a text for good or breaks the whole job at one."""

    def encode(texts: list[str]) -> list[list[float]]:
        if die and die in texts:
            raise SystemExit(die)  # not an error of the batch: the task ends
        if refuse and refuse in texts:
            raise ValueError("refused")
        (log / uuid.uuid4().hex).write_text("\x01".join(texts))
        return [[float(len(t)), float(t.count("a"))] for t in texts]

    return encode


def asked(log: Path) -> Counter:
    return Counter(t for f in log.iterdir() for t in f.read_text().split("\x01"))


def texts(spark, *values):
    return spark.createDataFrame([(k, t, "clash") for k, t in enumerate(values)], "id long, text string, vector_ string")


def test_equal_texts_once_and_again_nothing(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    e = EncodedTexts(spark, str(tmp_path / "v"), "m")
    rows = texts(spark, "aa", "b", "aa", None, "", "banana" * 2000, "aa")
    assert e.encode(rows, encoder_into(log), commits=3, batch=2) == 4
    assert asked(log) == {"aa": 1, "b": 1, "": 1, "banana" * 2000: 1}
    got = {r["id"]: r["vector"] for r in e.lookup(rows).collect()}
    assert got == {0: [2, 2], 1: [1, 0], 2: [2, 2], 3: [0, 0], 4: [0, 0], 5: [12000, 6000], 6: [2, 2]}
    assert e.encode(rows, encoder_into(log)) == 0 and sum(asked(log).values()) == 4
    assert e.encode(texts(spark, "b", "c"), encoder_into(log)) == 1  # only what is new
    other = EncodedTexts(spark, str(tmp_path / "v"), "n")
    assert other.encode(texts(spark, "b"), encoder_into(log)) == 1 and asked(log)["b"] == 2  # another model's vectors are its own
    assert e.vectors().count() == 5 and other.vectors().count() == 1


def test_a_batch_that_fails_leaves_the_others(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    e = EncodedTexts(spark, str(tmp_path / "v"), "m")
    rows = texts(spark, *[f"t{k}" for k in range(40)])
    with pytest.raises(EncodingFailed, match="1 texts have no vector, 39 were encoded; ValueError: refused"):
        e.encode(rows, encoder_into(log, refuse="t7"), batch=1, commits=4, retries=1, backoff=0.01)
    assert e.vectors().count() == 39 and "t7" not in asked(log)
    assert e.lookup(rows.filter("text = 't7'")).first()["vector"] is None
    assert e.encode(rows, encoder_into(log), commits=4) == 1
    assert set(asked(log).values()) == {1} and len(asked(log)) == 40


def test_a_run_that_dies_goes_on(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    e = EncodedTexts(spark, str(tmp_path / "v"), "m")
    rows = texts(spark, *[f"t{k}" for k in range(60)])
    with pytest.raises(Exception):
        e.encode(rows, encoder_into(log, die="t7"), batch=1, commits=8)
    kept = {r["hash"] for r in e.vectors().collect()}
    assert 0 < len(kept) < 60
    before = asked(log)
    assert e.encode(rows, encoder_into(log), commits=8) == 60 - len(kept)
    assert e.vectors().count() == 60 == e.vectors().select("hash").distinct().count()
    hashed = {r["text"]: r["h"] for r in rows.selectExpr("text", r"sha1(concat(cast('m\0' as binary), cast(text as binary))) AS h").collect()}
    assert kept < set(hashed.values())
    assert all(asked(log)[t] == before[t] for t, h in hashed.items() if h in kept)  # what was kept is not encoded again


def test_attempts(tmp_path):
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise OSError("busy")
        return [[1]] * len(texts)

    assert attempt(flaky, ["a", "b"], 3, 0.001) == ([[1.0], [1.0]], "") and len(calls) == 3
    calls.clear()
    assert attempt(flaky, ["a"], 1, 0.001) == ([None], "OSError: busy") and len(calls) == 2
    assert attempt(lambda t: [], ["a"], 0, 0) == ([None], "ValueError: 0 vectors for 1 texts")


def test_no_rows(spark, tmp_path):
    e = EncodedTexts(spark, str(tmp_path / "v"), "m")
    none = texts(spark, "a").filter("id < 0")
    assert e.encode(none, lambda t: 1 / 0) == 0 and e.lookup(none).count() == 0
