"""Toxicity, quality and nearest neighbours: held-out accuracy, recall, restoration, odd inputs."""

from __future__ import annotations

import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest

from quarrymill.llm import ann, quality, toxicity
from quarrymill.llm.common import table

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(0)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    bad = ["idiot", "moron", "trash", "worthless"]
    docs, labels = [], []
    for k in range(600):
        words = [rng.choice(vocabulary) for _ in range(60)]
        toxic = k % 4 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(60), rng.choice(bad))
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    disguised = ["1d10t", "i d i o t", "m.o.r.o.n", "mooooron", "tr@sh", "w0rthle$s"]
    for k, d in enumerate(disguised):
        docs.append((1000 + k, " ".join([*(rng.choice(vocabulary) for _ in range(30)), "the", d, "so", *(rng.choice(vocabulary) for _ in range(30))])))
    docs += [(2000, None), (2001, ""), (2002, "idiot " * 30_000), (None, "idiot moron trash"), (2003, "a a a a a a"), (2003, "a a a a a a")]
    labels += [(3000, 1), (1, None), (None, 1)]
    return spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int"), docs


def test_toxicity_on_held_out_and_disguised_rows(corpus):
    docs, labels, rows = corpus
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id)) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    out = [k for k in range(600) if held(k)]
    assert np.mean([by[k].predicted == (k % 4 == 0) for k in out]) > 0.95
    assert sum(by[1000 + k].predicted for k in range(6)) >= 5
    assert not by[2000].predicted and not by[2001].predicted and by[2002].predicted
    assert toxicity.score_toxicity(docs.limit(0), labels.limit(0)).count() == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in got)


def test_labels_of_held_out_rows_are_never_read(corpus):
    docs, labels, _ = corpus
    flipped = labels.rdd.map(lambda r: (r[0], 1 - r[1] if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[1])).toDF("doc_id long, toxic int")
    score = lambda x: sorted(((r.doc_id, r.score) for r in toxicity.score_toxicity(docs, x).collect()), key=str)
    assert score(labels) == score(flipped)


def test_one_kind_of_label(corpus):
    docs, labels, _ = corpus
    got = toxicity.score_toxicity(docs, labels.filter("toxic = 0"))
    assert all(r.score < 0.01 for r in got.collect())


def test_restoration_is_the_best_path():
    """Against all readings of short lattices."""
    from itertools import product

    rng = np.random.default_rng(0)
    model = toxicity.smoothed(rng.integers(0, 50, 27**3).astype(float))
    for word in ("a1b", "0o.d", "x$$a", "b@d"):
        options, drop = toxicity._lattice(word)
        best, said = -1e18, ""
        for choice in product(*[[*o, (None, d)] for o, d in zip(options, drop, strict=True)]):
            a = b = 0
            score = 0.0
            letters = []
            for c, p in choice:
                score += p
                if c is not None:
                    score += model[a, b, c]
                    a, b = b, c
                    letters.append(c)
            score += model[a, b, 0]
            if score > best:
                best, said = score, "".join(chr(96 + x) if x else " " for x in letters).strip()
        assert toxicity.restore(model, [word]) == [said]


def test_every_kind_of_disguise_reaches_the_lattice():
    plain = "loser idiot asshole bloody shit pathetic blöder scum moron consectetur dumb the said "
    model = toxicity.smoothed(toxicity.trigram_counts([plain * 200]).astype(float))
    hidden = {"sc" + "u" * 25 + "m": "scum", "l053r": "loser", "1053r": "loser", "idi07": "idiot", "455hole": "asshole", "b100dy": "bloody", "shi+": "shit", "pathet1(": "pathetic", "blöd3r": "blöder", "(idi0t!!)": "idiot", "dumb-1d10t": "idiot", "1d-10t": "idiot"}
    for word, want in hidden.items():
        assert want in toxicity.restore(model, toxicity.disguised(word, {word})), word
    long = "consectetur" * 9 + "m0r0n" + "consectetur" * 9
    found = toxicity.disguised(long, {long})
    assert max(map(len, found)) <= 64 and any("moron" in x for x in toxicity.restore(model, found))
    for word in ("idiot", "...", "5"):
        assert toxicity.disguised(word, {word}) == []


@needs_data
def test_quality_on_held_out_rows(spark):
    got = {r.doc_id: r for r in quality.score_quality(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    assert len(got) == 1000
    out = [(r.doc_id, r.quality) for r in table(spark, SF, "labels").collect() if held(r.doc_id)]
    assert np.mean([got[i].keep == q for i, q in out]) > 0.97


def test_quality_shrinks_sparse_sites(spark):
    rng = random.Random(0)
    rows = []
    for k in range(900):
        site, path = ("bad", "x") if k % 3 == 0 else ("good", "y")
        junk = rng.random() < (0.9 if site == "bad" else 0.05)
        words = ["zz%%%"] * 40 if junk else [rng.choice("abcdefgh") * 4 for _ in range(40)]
        rows.append((k, " ".join(words), site, path, int(not junk)))
    rows += [(2000, None, None, None, None), (2001, "", "tiny", "x", None), (2002, "w " * 50_000, "good", None, None), (None, "aaaa bbbb", "bad", "x", None), (2003, "aaaa bbbb cccc", "bad", "x", None), (2003, "aaaa bbbb cccc", "good", "y", None)]
    df = spark.createDataFrame([(*r[:4], 1.0) for r in rows], "doc_id long, text string, source string, lang string, score double")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[4] is not None], "doc_id long, quality int")
    got = quality.score_quality(df, labels).collect()
    assert len(got) == len(rows)
    site = {r.doc_id: r.host_rate for r in got}
    mean = np.mean([r.doc_score for r in got])
    assert site[0] < site[2001] < site[1] and abs(site[2001] - mean) < abs(site[0] - mean)
    twin = sorted(r.score for r in got if r.doc_id == 2003)
    assert twin[1] > twin[0]  # the same text counts for more on the better site
    assert quality.score_quality(df.limit(0), labels).count() == 0


@needs_data
def test_recall_of_neighbours(spark):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    got = ann.nearest(vectors).collect()
    e = vectors.toPandas().sort_values("vec_id")
    ids, x = e["vec_id"].to_numpy(), np.stack(e["embedding"]).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit, queries = 0, [i for i in ids if i % 50 == 0]
    for q in queries:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        s = u @ u[np.searchsorted(ids, q)]
        s[np.searchsorted(ids, q)] = -2
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert np.allclose([r.score for r in mine], s[np.searchsorted(ids, [r.vec_id for r in mine])], atol=1e-12)
        hit += len({r.vec_id for r in mine} & set(ids[np.argsort(-s)[:5]]))
    assert hit / (5 * len(queries)) >= 0.9


def test_sites_of_urls(spark):
    rows = [("https://Me:pw@Ex.org:8080/blog/2020/a.html?x=/y/", "ex.org", "/blog"), ("http://ex.org", "ex.org", "/"), ("http://ex.org/a.html", "ex.org", "/"), ("http://ex.org?q=/a/b", "ex.org", "/"), ("http://[::1]:80/a/b", "[::1]", "/a"), ("no url", None, None), ("", None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "url string, host string, path string")
    assert all(r[0] == r[2] and r[1] == r[3] for r in df.select(*quality.site_of(df["url"]), "host", "path").collect())


def recall(vectors, got, every=50):
    ids, x = np.array([v[0] for v in vectors]), np.array([v[1] for v in vectors])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for at in np.flatnonzero(ids % every == 0):
        s = u @ u[at]
        s[at] = -2
        hits.append(len(found[ids[at]] & set(ids[np.argsort(-s)[:5]].tolist())) / 5)
    return np.mean(hits)


@pytest.mark.parametrize(("n", "parts"), [(500, 8), (26_000, 260)])
def test_small_and_large_tables_are_dealt_alike(spark, monkeypatch, n, parts):
    """Production parameters; vectors like the test data's, noise around few centres."""
    asked, fit = [], ann.Router.fit.__func__
    monkeypatch.setattr(ann.Router, "fit", classmethod(lambda cls, x, graph, label, parts, rng: asked.append(parts) or fit(cls, x, graph, label, parts, rng)))
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 64))
    x = (centres[rng.integers(20, size=n)] + 0.5 * rng.normal(size=(n, 64))).astype(np.float32)
    vectors = [(k, v.tolist()) for k, v in enumerate(x)]
    got = ann.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<float>")).collect()
    assert asked == [parts]
    assert recall(vectors, got) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, float("nan")]), (7, [1.0, None]), (100, [float("inf"), 1.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (150, [])]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in sorted(ann.nearest(df).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    assert got == {0: [(1, 1.0), (2, 1.0), (3, 0.707107), (50, 0.0)], 50: [(3, 0.707107), (0, 0.0), (1, 0.0), (2, 0.0)]}
    assert ann.nearest(df.limit(0)).count() == 0


def test_ids_of_many_rows_lose_no_neighbours(spark):
    def found(rows, query):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        return [(r.vec_id, round(r.score, 6)) for r in sorted(ann.nearest(df).collect(), key=lambda r: r["rank"]) if r.query_id == query]

    others = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 1.0]), (4, [0.0, 1.0])]
    want = [(1, 1.0), (2, 1.0), (3, 0.707107), (4, 0.0)]
    assert found([(0, [1.0, 0.0])] * 9 + others, 0) == want  # equal rows of the query's id
    own = [(0, [1.0, k / 1000]) for k in range(9)]  # differing ones: the smallest asks
    assert found(own[::-1] + others, 0) == want
    assert found([(50, [1.0, 0.0])] * 2 + others, 50) == want and found([(50, [1.0, 0.0])] + others + [(1, [1.0, 0.0])], 50) == [(1, 1.0), *want]


def test_hot_vectors_keep_the_smallest_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[200:500] = x[200]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, rows_per_part=100).collect() if r.query_id in (200, 250, 450)]
    assert sorted(got) == [(200, k + 1, v) for k, v in enumerate((201, 202, 203, 204, 205))] + [(q, k + 1, 200 + k) for q in (250, 450) for k in range(5)]


@pytest.mark.parametrize(("n", "centres", "most"), [(3000, 0, 1.0), (12_000, 0, 0.75), (40_000, 0, 0.6), (12_000, 200, 0.05), (40_000, 200, 0.03)])
def test_the_share_of_rows_visited_falls(n, centres, most):
    """Production parameters, queries out of the sample: recall holds without structure and with it, and fewer rows are visited."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 64))
    if centres:
        x = rng.normal(size=(centres, 64))[rng.integers(centres, size=n)] + 0.4 * x
    router, parts, least = ann.fit(x[: ann.SAMPLE], n)
    part, u = router.logits(x).argmax(1), ann.unit(x)
    queries = np.arange(n - 200, n)
    s = u[queries] @ u.T
    s[np.arange(200), queries] = -2
    near = np.argpartition(-s, 5, axis=1)[:, :5]
    visited = np.argsort(-router.logits(x[queries]), axis=1)[:, :least]
    hit = np.mean([np.isin(part[a], b).mean() for a, b in zip(near, visited, strict=True)])
    share = np.bincount(part, minlength=parts)[visited].sum(1).mean() / n
    assert hit >= 0.9 and share <= most


def test_quality_against_plain_sums(spark):
    """Strengths, rates and posteriors from the operator's own document scores, taken with plain loops."""
    rng = random.Random(4)
    rows = []
    for k in range(700):
        host = rng.choice(["big", "big", "mid", None, f"h{rng.randrange(60)}"])
        path = rng.choice(["/a", "/b", None])
        good = rng.random() < {"big": 0.9, "mid": 0.3}.get(host, 0.6)
        rows.append((k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) if good else "x%%" for _ in range(rng.randrange(5, 60))), host, path, int(good)))
    df = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score_quality(df, labels).collect()}
    p = {r[0]: got[r[0]].doc_score for r in rows}
    hosts, paths = {}, {}
    for i, _, h, q, _ in rows:
        hosts.setdefault(h, []).append(p[i])
        paths.setdefault((h, q), []).append(p[i])
    mean = sum(p.values()) / len(p)

    def strength(groups):
        """groups: (sum, number, centre)."""
        g = [x for x in groups if x[1] > 1]
        n, k = sum(x[1] for x in g), len(g)
        scale = sum(x[1] * x[2] * (1 - x[2]) for x in g)
        between = (sum(m * (s / m - c) ** 2 for s, m, c in g) - sum(c * (1 - c) for _, _, c in g)) / n
        return min(max(scale / n / max(between, 1e-9) - 1, 1.0), 1e4) if k >= 2 and n > k and scale else 100.0

    k_host = strength([(sum(v), len(v), mean) for v in hosts.values()])
    rate = {h: (sum(v) + k_host * mean) / (len(v) + k_host) for h, v in hosts.items()}
    k_path = strength([(sum(v), len(v), rate[h]) for (h, _), v in paths.items()])
    for i, _, h, q, _ in rows:
        v = paths[h, q]
        rest = min(max((sum(v) - p[i] + k_path * rate[h]) / (len(v) - 1 + k_path), 1e-6), 1 - 1e-6)
        odds = p[i] / (1 - p[i]) * (rest / (1 - rest)) / (mean / (1 - mean))
        assert got[i].host_rate == pytest.approx(rate[h], rel=1e-9) and got[i].path_rate == pytest.approx(rest, rel=1e-9)
        assert got[i].score == pytest.approx(odds / (1 + odds), rel=1e-6) and got[i].keep == (got[i].score >= 0.5)


@needs_data
def test_stretched_words_score_like_plain_ones(spark):
    """Held-out toxic documents with the vowels of every word repeated: however often, the scores hold."""
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    bad = {r.doc_id for r in labels.filter("toxic = 1").collect() if held(r.doc_id)}
    texts = [r.text for r in docs.select("doc_id", "text").collect() if r.doc_id in bad]
    plain = np.array(model.scores(texts))
    caught = [np.mean(np.array(model.scores([re.sub("([aeiou])", lambda m, n=n: m[1] * n, t) for t in texts])) >= 0.5) for n in (3, 12, 40)]
    assert len(texts) >= 10 and (plain >= 0.5).mean() > 0.85
    assert min(caught) >= 0.95 * (plain >= 0.5).mean() and max(caught) - min(caught) <= 0.1


@pytest.mark.parametrize("word", ["455", "4$$", "@55", "5#1+", "2024", "$50"])
def test_words_of_signs_alone_are_decoded(word):
    """Numbers, too: nothing but the score tells a number from a disguise."""
    assert toxicity.disguised(word, {word})


def test_a_word_of_signs_becomes_letters():
    counts = toxicity.trigram_counts(["the ass of an ass passes as an ass"] * 50)
    assert toxicity.restore(toxicity.smoothed(counts.astype(float)), ["455", "@$$"]) == ["ass", "ass"]
