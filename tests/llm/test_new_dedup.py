"""Merkle manifest, collocations and line dedup, against brute force and against their SQL."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import collocations, linededup, merkle
from quarrymill.llm import queries as llm_queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = llm_queries.queries()[name](spark, SF)
    want = db.execute(llm_queries.oracle_sql()[name]).to_arrow_table().select(got.columns).to_pylist()
    assert sorted(map(str, (r.asDict() for r in got.collect()))) == sorted(map(str, want))


def test_paths_are_those_of_the_whole_tree():
    for n in (1, 2, 3, 4, 5, 7, 8, 13, 16, 31, 32, 33):
        leaves = [sha(str(k)).encode() for k in range(n)]
        for height in {merkle.block_height(n, 10), 6}:
            levels = [leaves]
            for _ in range(height):
                level = levels[-1]
                levels.append([merkle.parent(level[k], level[k + 1] if k + 1 < len(level) else b"") for k in range(0, len(level), 2)])
            assert merkle.top(leaves, height) == levels[-1][0]
            for subtree in (1, 2, 3):
                for s, path in enumerate(merkle.paths(leaves, height, subtree)):
                    assert path == [level[(s >> k) ^ 1] if (s >> k) ^ 1 < len(level) else b"" for k, level in enumerate(levels[:-1])]


def test_traversal_keeps_few_nodes(monkeypatch):
    kept = []
    grow = merkle.Growing.grow

    def watched(self, steps):
        grow(self, steps)
        kept.append(len(self.nodes) + len(self.stack))

    monkeypatch.setattr(merkle.Growing, "grow", watched)
    assert sum(1 for _ in merkle.paths([b"%064d" % k for k in range(1 << 12)], 12, 2)) == 1 << 12
    assert max(kept) <= 2 * 4 + 13


def naive_manifest(rows):
    def leaf(r):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))

    def tree(nodes):  # (root, siblings of each)
        sides = [[] for _ in nodes]
        place = list(range(len(nodes)))
        while len(nodes) > 1:
            for k, p in enumerate(place):
                if p ^ 1 < len(nodes):
                    sides[k].append(nodes[p ^ 1])
            nodes = [sha("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]
            place = [p // 2 for p in place]
        return nodes[0], sides

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: tree([x[2] for x in sorted(groups[g])]) for g in order}
    root, upper = tree([own[g][0] for g in order])
    out = []
    for g, up in zip(order, upper, strict=True):
        for (known, i, x), side in zip(sorted(groups[g]), own[g][1], strict=True):
            out.append((i if known else None, x, own[g][0], root, sha("".join(side + up))))
    return out


def test_manifest_of_odd_rows(spark):
    big = (1 << 60) + 1
    rows = [(k, "s", ["en", "fr", None][k % 3], k, f"text {k}") for k in range(70)]
    rows += [(None, None, None, None, None), (None, "s", "en", 1, "x"), (5, "s", "en", 1, "x"), (5, "s", "en", 1, "x"), (5, "s", "en", 2, "x"), (big, "ß", "Ω", 3, "é" * 40_000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("steps", F.lit(1)).withColumn("pos", F.lit("clash")).repartition(5)
    for height in (2, 10):
        got = merkle.manifest(docs, height=height, carry={"n": merkle.tampered_leaf(docs)})
        found = [(r.doc_id, r.leaf, r.subroot, r.root, sha("".join(x[1:] for x in r.steps))) for r in got.collect()]
        assert sorted(map(str, found)) == sorted(map(str, naive_manifest(rows)))
        assert all(merkle.follow(r.leaf, r.steps) == r.root for r in got.collect())
    assert merkle.manifest(docs.limit(0)).collect() == []
    audit = merkle.audit(docs).collect()
    import zlib

    hit = lambda r: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
    assert all(r.verified != hit(r) for r in audit) and sum(map(hit, audit)) > 3
    lone = merkle.audit(spark.createDataFrame(rows[:1], DOCS)).first()
    assert lone.leaf == lone.subroot == lone.root and lone.proof_sha256 == sha("")


def naive_lines(rows, least=10):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    rank = lambda i: (i is None, i or 0)
    holder = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            holder[key(x)] = min(holder.get(key(x), rank(i)), rank(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or holder[key(x)] == rank(i)]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def test_lines(spark, monkeypatch):
    common = "A line that is all over the place"
    rows = [(k, f"{common}\nown line number {k:05}\n  {common.upper()}\t\r\nshort\n{common}") for k in range(300, 0, -1)]
    rows += [(None, common), (None, f"x\n{common}"), (7, "another text\nof seven lines"), (9, "another text\nof seven lines"), (9, "another text\nof seven lines")]
    rows += [(1000, None), (1001, ""), (1002, "ééééééééé"), (1003, "ééééééééé"), (1004, "éééééééééé"), (1005, " éééééééééé"), (1006, "Éééééééééé"), (1007, "\x1c" + "a" * 12), (1008, "a" * 12), (1009, "word " * 40_000 + "\n" + common)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep", F.lit(0)).withColumn("TAG", F.lit(0)).repartition(7)
    want = naive_lines(rows)
    for size in (linededup.SLICE_BYTES, 200):
        monkeypatch.setattr(linededup, "SLICE_BYTES", size)
        got = linededup.dedup_lines(docs).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert linededup.dedup_lines(docs.limit(0)).collect() == []
    texts = {r.doc_id: r.text for r in linededup.drop_lines(docs.filter("doc_id < 300")).collect()}
    assert texts[1].split("\n").count(common) == 2 and texts[2] == "own line number 00002\nshort"


def naive_collocations(rows, least, top, share=100, longest=5):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= share * counts[p[i : i + k]]:
                        covered.add(p[i : i + k])
        best = []
        for p, a in candidates.items():
            if p not in covered:
                score, cut = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        out += [(lang, rank + 1, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out, key=str)


def test_phrases(spark):
    import random

    rng = random.Random(5)
    words = ["der", "Die", "haus", "éa", "New", "york", "x y", "\x1cq", "a" * 40, "in"]
    rows = [(rng.choice(["en", "fr", None]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", ".\n"]) for _ in range(rng.randrange(60)))) for _ in range(300)]
    rows += [("en", "we the people of these united states form")] * 40 + [("en", None), ("fr", ""), ("xx", " . "), ("en", "the very long " * 3000)]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit(1)).withColumn("n", F.lit("a")).repartition(6)
    for least, share, bits in ((10, 100, 26), (3, 80, 6), (300, 100, 26)):
        got = collocations.collocations(docs, least=least, top=50, share=share, most_bits=bits).collect()
        assert sorted(map(tuple, got), key=str) == naive_collocations(rows, least, 50, share)
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_scores_beyond_64_bits(spark):
    a, l, r, n = 10**13, 3 * 10**13, 2 * 10**13 + 1, 10**14
    row = spark.createDataFrame([(a, l, r, n)], "a long, l long, r long, n long").selectExpr("cast(a as decimal(38, 0)) * 1000 * n div (cast(l as decimal(38, 0)) * r) as s").first()
    assert row.s == 1000 * a * n // (l * r)


def test_pruning_skips_what_cannot_be_frequent(spark):
    """Two words are frequent, their pair is not: it is counted in a bucket only."""
    rows = [("en", f"alpha z{k}. beta y{k}. alpha beta") if k < 5 else ("en", f"alpha z{k}. beta y{k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    phrases, words = collocations.frequent_phrases(docs, least=50)
    assert sorted((r.phrase, r.f) for r in phrases.collect()) == [("alpha", 205), ("beta", 205)] and words.first().n == 810
