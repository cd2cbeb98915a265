"""BagMinHash and suffix dedup against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrymill.llm import bagminhash as B
from quarrymill.llm import suffixdedup as S

LAST = (1 << 63) - 1


def words_of(t):
    import re

    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def bag(t):
    w = words_of(t)
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def weighted_jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def brute_classes(rows):
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [bag(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or weighted_jaccard(bags[i], bags[j]) >= 0.8:
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        least[r] = min(least.get(r, LAST), LAST if i is None else i)
    return sorted(((i, None if least[root(k)] == LAST else least[root(k)]) for k, (i, _) in enumerate(rows)), key=str)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        a = [f"w{k}" for k in rng.integers(0, 300, 250)]
        b = list(a)
        for k in rng.integers(0, 250, 8):
            b[k] = f"z{k}"
        texts = [" ".join(a + a[:30] * 3), " ".join(b + a[:30] * int(rng.integers(0, 6)))]
        s = B.signatures(*B.shingles(texts), 2, 128)
        errors.append((s[0] == s[1]).mean() - weighted_jaccard(bag(texts[0]), bag(texts[1])))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_exact_overlap_is_that_of_multisets():
    texts = ["a b c d e f g " * 3, "a b c d e f g " * 5, "A, b; c d-e f g", "x"]
    sets = B.occurrence_sets(texts)
    for i in range(4):
        for j in range(4):
            want = weighted_jaccard(bag(texts[i]), bag(texts[j]))
            assert B.jaccard(sets[i], sets[j]) == pytest.approx(want) or want < 0.5


def near_rows():
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(120)) for _ in range(25)]
    rows = []
    for t in base:
        w = t.split()
        for _ in range(rng.randrange(1, 9)):  # near copies of many similarities
            v = list(w)
            for _ in range(rng.randrange(0, 6)):
                v[rng.randrange(len(v))] = f"q{rng.randrange(9999)}"
            rows.append((len(rows) * 3, " ".join(v)))
    rows += [(1, None), (2, ""), (4, "%%%"), (5, "%%%"), (7, "One two three"), (8, "one TWO three!"), (10, base[0]), (None, base[1]), (None, "alone in the world it stands"), (10, base[0]), (10, base[2]), (11, "x y z " * 30_000), (13, "x y z " * 30_000 + "w")]
    rng.shuffle(rows)
    return rows


def test_classes_against_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame([(*r, "c", "k") for r in rows], "doc_id long, text string, class_id string, key string")
    assert sorted((tuple(r) for r in B.near_duplicates(df).collect()), key=str) == brute_classes(rows)
    assert B.near_duplicates(df.limit(0)).count() == 0


def test_large_groups_in_blocks(spark, monkeypatch):
    """Small blocks, so that groups are cut; the classes stay the same."""
    monkeypatch.setattr(B, "BLOCK_ROWS", 3)
    monkeypatch.setattr(B, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(B, "STAR_ROUNDS", 1)
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in B.near_duplicates(df).collect()), key=str) == brute_classes(rows)


def test_one_of_each_class_is_kept(spark):
    rows = near_rows()
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    kept = B.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({c for _, c in brute_classes(rows)}, key=str)


def test_components(spark):
    rng = random.Random(0)
    links = [(a, a + 1) for a in range(0, 40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)]
    got = dict(map(tuple, B.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got[k] == 0 for k in range(41))
    assert all(got[a] == got[b] for a, b in links if a != b)


def brute_removal(rows, n=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - n + 1):
            first[b[s : s + n]] = min(first.get(b[s : s + n], LAST + 1), LAST if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        goes = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if first[b[s : s + n]] < (LAST if i is None else i):
                goes[s : s + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, goes, strict=True) if not g)
        out.append((i, len(b), sum(goes), sum(goes[k] and not (k and goes[k - 1]) for k in range(len(goes))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_removal_against_brute_force(spark):
    p = "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf today. "
    rng = random.Random(5)
    rows = [(3, p + p), (1, "x" * 200), (2, "y" + "x" * 120 + "z"), (4, None), (5, ""), (6, p), (6, "q" + p), (6, "r" + p), (None, p), (None, p + "x"), (7, p), (8, "ü" * 40 + p[:60]), (9, "ü" * 40), (10, "short"), (10, "short"), (3, p + p), (11, "ab" * 30_000)]
    for k in range(60):
        parts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(80))) if rng.random() < 0.6 else p[rng.randrange(30) :][: rng.randrange(40, 90)] for _ in range(6)]
        rows.append((20 + k, "".join(parts)))
    df = spark.createDataFrame([(*r, "t", "c") for r in rows], "doc_id long, text string, tag string, copy string")
    assert sorted((tuple(r) for r in S.remove_repeats(df).collect()), key=str) == brute_removal(rows)
    assert S.remove_repeats(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=0, max_size=400), st.integers(1, 3))
def test_suffixes_are_sorted(data, letters):
    text = bytes(b % letters + 97 for b in data)
    order = S.suffix_array(text)
    padded = text + bytes(60)
    assert sorted(order.tolist()) == list(range(len(text)))
    assert all(padded[a : a + 52] <= padded[b : b + 52] for a, b in zip(order[:-1], order[1:], strict=True))


def test_the_cover_is_perfect():
    assert S.SHIFT.max() < S.PERIOD
    for a in range(S.PERIOD):
        for b in range(S.PERIOD):
            d = S.SHIFT[a, b]
            assert (a + d) % S.PERIOD in S.COVER and (b + d) % S.PERIOD in S.COVER


def test_equal_windows_share_their_anchor():
    rng = random.Random(1)
    shared = bytes(rng.choice(b"abc ") for _ in range(90))
    texts = [bytes(rng.choice(b"abc ") for _ in range(rng.randrange(100))) + shared + bytes(rng.choice(b"abc ") for _ in range(50)) for _ in range(6)]
    text, start, windows, name, _ = S.anchors(texts)
    of = {}
    for t, s, n, a in zip(text, start, windows, name, strict=True):
        for k in range(s, s + n):
            of.setdefault(texts[t][k : k + 50], set()).add(int(a))
    assert all(len(v) == 1 for v in of.values())
    assert sum(windows) == sum(len(t) - 49 for t in texts)


def test_a_chance_match_of_short_names_loses_no_pair(spark):
    from quarrymill.llm import bagminhash as bag

    rng = np.random.default_rng(0)
    names = np.tile(rng.integers(1, 1 << 63, 128, dtype=np.uint64), (2, 1))
    names[1, :4] ^= np.uint64(1)  # the first band is shared by its leading 16 bits only
    keys = bag.band_keys(names, 32, 4).view(np.int64)
    assert keys[0, 0] != keys[1, 0] and keys[0, 1] == keys[1, 1]
    grams = np.arange(50, dtype=np.uint64).tobytes()
    short = bag.short_signatures(names, 32, 4)
    rows = [(int(keys[k, 1]), 1, 2, 800, 50, k, k, bytearray(short[k]), bytearray(grams)) for k in range(2)]
    members = spark.createDataFrame(rows, "bucket long, band int, n long, bytes long, size long, node long, component long, short binary, grams binary")
    assert [tuple(r) for r in bag._bucket_links(members, 32, 4, 0.8).collect()] == [(0, 1)]


def test_long_texts_in_pieces_and_the_largest_id(spark, monkeypatch):
    """Pieces of a text that is longer than a slice, many partitions, and the largest id beside a null one."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcde") for _ in range(6)) for _ in range(400)]
    long_ = " ".join(rng.choice(words) for _ in range(300))
    rows = [(5, long_), (7, "x" + long_[300:1500] + "y"), (LAST, long_[:700]), (None, "q" * 70 + long_[:100]), (9, "q" * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_removal(rows)
    assert sorted((tuple(r) for r in S.remove_repeats(df).collect()), key=str) == want
    tables = pa.table({"doc_id": [LAST if i is None else i for i, _ in rows], "none": [i is None for i, _ in rows], "tag": list(range(5)), "text": [t for _, t in rows]})
    monkeypatch.setattr(S, "SLICE_BYTES", 128)
    group = S.Group(tables, 50)
    group.enter(3)
    entries = [(p, 0, *(x[group.cuts[p] : group.cuts[p + 1]].tobytes() for x in (group.key, group.context, group.holder))) for p in range(3)]
    said = pa.concat_tables([S.replies(p, pa.Table.from_pylist([dict(zip(S._ENTRIES.names, entries[p], strict=True))], S._ENTRIES)) for p in range(3)])
    found = S.surroundings(0, group, said, 3)
    marks = pa.concat_tables([S.sorted_marks(found.filter(pc.equal(found["p"], p)), 50) for p in range(3)])
    assert sorted((tuple(r.values()) for r in S.cut(group, marks).to_pylist()), key=str) == want


def test_columns_that_look_like_the_operators_own(spark):
    rows = near_rows()
    names = ["doc_id", "text", "__own", "__key", "_id", "KEY", "___n"]
    df = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], "doc_id long, text string, __own string, __key string, _id string, KEY string, ___n string")
    got = B.keep_one(df)
    assert got.columns == names
    assert all(tuple(r)[2:] == ("a", "b", "c", "d", "e") for r in got.collect())
    assert got.count() == B.keep_one(df.select("doc_id", "text")).count()
