from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quarrymill.llm import mixing, packing

public_tokenizers = pytest.importorskip("public_tokenizers")


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute_targets(sizes):
    """Shares by weight, excess over three times a source's size shared again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, rest = {}, set(order), float(sum(sizes.values()))
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s] or sizes[s] == 0}
        if not full:
            return target | share
        for s in full:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
        open_ -= full
    return target


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    out = []
    for k in range(1500):
        source = "hot" if k % 3 == 0 else f"s{rng.integers(9)}"
        out.append((k, "w " * int(rng.lognormal(4, 1)), source))
    out += [(2000, "one two", "tiny"), (2001, None, "s1"), (2002, "", None), (2003, "a b c\td\x0be", None), (None, "x y z", "s2"), (2004, "w " * 40_000, "long"), (2005, "t t t", "Źle"), (2006, "t t t", "emptyish"), (2007, "", "void")]
    return out + out[:40]


def test_targets_and_taken_words(spark, rows):
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = brute_targets(sizes)
    source = {(r[0], size(r[1])): r[2] for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert mixing.mix(df.limit(0)).count() == 0


def test_blocks_and_the_tree(spark, rows, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(df)
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in got.collect():
        taken[r.source] += r["size"] * r.copies
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in taken)


def test_rounding_keeps_expectations():
    sizes = np.array([50, 40, 30, 20, 10, 10, 10, 5, 5, 5])
    due = np.full(10, 0.37)
    total = np.zeros(10)
    for seed in range(4000):
        p, left = mixing.settle(sizes, due, np.random.default_rng(seed))
        assert abs((p * sizes).sum() - (due * sizes).sum()) < 1e-6
        assert sum(0 < x < 1 for x in p) <= 1 and (left < 0 or 0 < p[left] < 1)
        total += p
    assert np.abs(total / 4000 - 0.37).max() < 0.03


def test_rows_are_repeated(spark, rows):
    df = spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id long, text string, source string, lang string, n_chars int")
    out = mixing.repeat_rows(df)
    assert out.columns == df.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.source] += size(r.text)
    target = {r.source: r.target for r in mixing.copies(df).collect()}
    largest = defaultdict(int)
    for _, t, s in rows:
        largest[s] = max(largest[s], size(t))
    assert all(abs(words[s] - target[s]) <= largest[s] for s in target)


def check_pieces(got, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    by_sequence, ids_of = defaultdict(list), {}
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 2048
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for i, text in texts.items():
        ids_of[i] = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids_of[i])
            assert r.ids_crc32 == zlib.crc32(ids_of[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids_of[i])
    total = [sum(n for _, n in p) for p in by_sequence.values()]
    return sum(0 if not n & (n - 1) else 2048 - n for n in total) / sum(total)


def test_packing_round_trip(spark, rows):
    texts = {r[0]: r[1] for r in rows[: len(rows) - 40] if r[0] is not None}
    texts |= {3000: "a  b\n\n c\t\td   ", 3001: "it's <|endoftext|> 'll\r\nx", 3002: "x. y, z.\n(w) é. 日本.", 3003: " lead", 3004: "trail ", 3005: "\n", 3006: "Ab.c,d. e., f", 3007: "   x", 3008: "a\0b c"}
    df = spark.createDataFrame([(k, v, "p") for k, v in texts.items()], "doc_id long, text string, part string")
    assert check_pieces(packing.pack(df).collect(), texts) < 0.05
    again = packing.pack(df.union(df.limit(5)).union(spark.createDataFrame([(None, "x", "p")], df.schema)))
    assert again.filter("start = 0").count() == len(texts) + 6
    assert packing.pack(df.limit(0)).count() == 0


def test_few_open_windows_are_emitted_fullest_first():
    w = packing.OpenWindows(100, 2)
    assert [w.place(n) for n in (60, 70, 35, 50, 30)] == [(0, 0), (1, 0), (0, 60), (2, 0), (1, 70)]
    # window 0 (95 of 100) was the fullest when 50 fitted nowhere
    assert w.free == [(50, 2)]


def test_repeated_rows_keep_columns_that_look_like_the_operators_own(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], "doc_id long, text string, source string, __n int, __tag string, _k string, Copies string")
    out = mixing.repeat_rows(df)
    assert out.columns == df.columns
    assert {tuple(r)[3:] for r in out.collect()} == {(1, "x", "y", "z")}
    assert out.count() == mixing.repeat_rows(df.select("doc_id", "text", "source")).count()


def test_many_rows_of_one_id_or_none_go_to_many_blocks(spark, monkeypatch):
    """Null ids, one id with one text, and rows without words: blocks stay small, counts stay right, reruns agree."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 50)
    monkeypatch.setattr(mixing, "_ALIKE", 16)
    rows = [(None, f"w{k} x", "a") for k in range(400)] + [(7, "same words here", "a")] * 300 + [(None, None, "a")] * 200 + [(k, "y z", "b") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = []
    settle = mixing.settle
    monkeypatch.setattr(mixing, "settle", lambda size, due, rng: seen.append(len(size)) or settle(size, due, rng))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(5)).collect()), key=str)
    for s, n in (("a", 1700), ("b", 60)):
        mine = [r for r in got if r.source_size == n]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1, s
    blocks = mixing._numbered(df.selectExpr("doc_id", "xxhash64(text) AS tag", "source", "1L AS size")).selectExpr("pmod(xxhash64(doc_id, tag, nth, 1), 18) AS b").groupBy("b").count().collect()
    assert max(r["count"] for r in blocks) < 100


def test_texts_without_words_are_never_taken(spark):
    rows = [(k, "" if k % 8 == 0 else None if k % 8 == 1 else "a few words", "abc"[k % 3]) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert all(r.text for r in mixing.repeat_rows(docs, weights=(1,)).collect())
    assert {r.copies for r in mixing.copies(docs, weights=(1,)).filter("size = 0").collect()} == {0}
