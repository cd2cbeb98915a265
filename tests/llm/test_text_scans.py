"""Licence scan and personal data."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from quarrymill.llm import licenses, pii


def brute_base(text):
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


MIT = licenses.TEMPLATES["mit"]


def test_licenses_against_brute_force(spark):
    rng = random.Random(0)
    vocabulary = "cc by general public license all rights reserved x CC-BY Ünder".split()
    rows = [(k, " ".join(rng.choice(vocabulary) + rng.choice(["", ".", "\n", "-"]) for _ in range(60))) for k in range(80)]
    rows += [(100, None), (101, ""), (102, "General-Public... LICENSE"), (103, "all rights reserved " * 5000), (None, "cc by"), (104, "cc by"), (104, "cc by")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, labels string")
    got = licenses.scan_licenses(df).collect()
    assert len(got) == len(rows)
    want = sorted(((i, *brute_base(t)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == want
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def labels(text, **kw):
    scanner = licenses.Scanner.of(licenses.PHRASES, kw.get("templates", licenses.TEMPLATES))
    return licenses.scan_text(scanner.triggers(), text)[5]


def test_optional_wording_may_be_missing_mandatory_may_not():
    plain = re.sub(r"<<optional>>|<<end>>", "", MIT)
    without = re.sub(r"<<optional>>.*?<<end>>", "", MIT, flags=re.S)
    assert "mit" in labels(plain) and "mit" in labels(without)
    assert labels(without.replace("sublicense", "relicense")) == ""
    assert labels("Copyright (c) 2020 A. B. and C. All rights reserved.") == "copyright-notice,reserved"
    assert labels("Copyright one two three four five six seven eight nine all rights reserved") == "reserved"


def test_a_licence_is_its_whole_mandatory_wording():
    whole = {k: re.sub(r"<<any \d+>>", "Some Name", re.sub(r"<<optional>>|<<end>>", "", v)) for k, v in licenses.TEMPLATES.items()}
    licences = [k for k in whole if not k.endswith(("-reference", "-notice"))]
    assert {"mit", "isc", "0bsd", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "unlicense"} == set(licences)
    for k in licences:
        assert labels(whole[k]) == k
        tokens = licenses.words(whole[k])
        assert labels(" ".join(tokens[:-1])) == "" and labels(" ".join([*tokens[:-12], "changed", *tokens[-11:]])) == "", k
    assert labels("Licensed under the Apache License, Version 2.0") == "apache-2.0-reference"
    assert labels("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.") == "mpl-2.0-reference"


def test_nested_and_adjacent_regions():
    t = {"n": "a <<optional>>b <<optional>>c<<end>> <<end>> <<optional>>d<<end>> <<any 2>> e"}
    for text, ok in (("a e", 1), ("a b e", 1), ("a b c d e", 1), ("a x y e", 1), ("a c x y e", 0), ("a x y z e", 0), ("a b c d x y e", 1)):
        assert (labels(text, templates=t) == "n") == bool(ok), text
    for bad in ("<<optional>>a<<end>>", "a <<optional>> b", "a <<end>>", "<<any 3>> a"):
        with pytest.raises(ValueError):
            licenses.compile_template("bad", bad)


PATTERNS = {
    0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    2: r"[0-9]([\x20-]?[0-9])+",
    3: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub(r"\D", "", m.group())
            if kind == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == 2 and not (12 <= len(d) <= 19 and sum((2 * int(c) - 9 * (int(c) > 4)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_against_the_patterns():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice("aA1234567890.. @@+-() é\n_%") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("4111 1111 1111 1111") == [(0, 2, 19)]


def test_base_spans_stay_linear():
    for text in ("a" * 400_000, "1" * 400_000, "a@" * 100_000, "+1 " * 100_000, "1." * 200_000, "@" * 300_000):
        pii.base_spans(text)


def test_pii_table(spark):
    rows = [(1, "é Mail a.b@c.de or 10.0.0.1, thanks"), (2, None), (3, ""), (4, "Please contact Mrs. Julia Stone at +1 (017) 555-7713."), (5, "plain words only. " * 20_000), (6, None), (None, "x@y.zz"), (4, "x@y.zz")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, Spans string")
    got = {(r.doc_id, r.n_email): r for r in pii.find_pii(df).collect()}
    assert pii.find_pii(df).count() == len(rows)
    r = got[1, 1]
    assert r.n_ip == 1 and r.base_sha256 == hashlib.sha256(b"email:7:15,ip:19:27").hexdigest()
    assert got[2, 0].base_sha256 == hashlib.sha256(b"").hexdigest() and got[5, 0].spans == ""
    assert "phone:35:52" in got[4, 0].spans and any(x.startswith("name:") for x in got[4, 0].spans.split(","))
    assert pii.find_pii(df.limit(0)).count() == 0


def test_the_field_finds_what_it_learned_and_unseen_spans():
    model = pii.train()
    rows = pii.parse_labelled(pii.LABELLED)
    found = pii.model_spans(model, [t for t, _ in rows])
    right = sum(sorted((a, 4 + k, b) for a, b, k in spans) == got for (_, spans), got in zip(rows, found, strict=True))
    assert right >= 0.95 * len(rows)
    text = "We wrote to Mr. Oliver Grant. He lives at 77 Birch Lane today. SSN 222-33-4444 is his."
    spans = {(pii.KINDS[k], text[a:b]) for a, k, b in pii.model_spans(model, [text])[0]}
    assert {("name", "Mr. Oliver Grant"), ("address", "77 Birch Lane"), ("identifier", "222-33-4444")} <= spans


def test_pruned_viterbi_is_exact():
    import numpy as np

    w, tr = model = pii.train(steps=60)
    rng = np.random.default_rng(0)
    seq = np.sort(rng.integers(0, 300, 4000))
    seq = np.unique(seq, return_inverse=True)[1]
    obs = rng.integers(1, pii.N_OBS, 4000)
    got = pii.viterbi(model, obs, seq)
    near = pii._around(obs, seq)
    score = sum(w[k][x] for k, x in enumerate(near))
    for s in range(seq.max() + 1):
        at = np.flatnonzero(seq == s)
        best = score[at[0]].copy()
        best[2::2] = -1e4
        for t in at[1:]:
            best = (best[:, None] + tr).max(0) + score[t]
        mine = score[at[0], got[at[0]]] + sum(tr[got[a], got[b]] + score[b, got[b]] for a, b in zip(at[:-1], at[1:], strict=True))
        assert abs(mine - best.max()) < 1e-2


def test_redaction_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a a@b.cc!", "en", "s", 9), (2, None, None, None, None), (3, "no", "en", "s", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[1].text == "a <EMAIL>!" and got[1].n_chars == 10 and got[2].text is None and got[3].text == "no"
    assert pii.redact(df).columns == df.columns


def planted_rows(n):
    """Sentences of words, names and numbers that the labelled table doesn't hold, with their spans."""
    rng = random.Random(3)
    first, last = "Oliver Noah Ruth Ines Felix Clara Otto Nora".split(), "Grant Berger Costa Lind Moreau Fisher Novak Sato".split()
    out = []
    for _ in range(n):
        name = f"{rng.choice(['Mr.', 'Mrs.', 'Dr.', 'Ms.'])} {rng.choice(first)} {rng.choice(last)}"
        street = f"{rng.randrange(2, 999)} {rng.choice('Birch Mill Church Elm Station'.split())} {rng.choice('Street Lane Road Avenue'.split())}"
        ssn = f"{rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"
        key = "".join(rng.choices("0123456789abcdef", k=rng.choice([32, 40, 64])))
        mixed = "A1" + "".join(rng.choices("ABCDEFGHabcdefgh0123456789", k=20))
        out += [
            (f"We wrote to {name} last week.", name),
            (f"The house at {street} is old.", street),
            (f"Her SSN {ssn} was found.", ssn),
            (f'cfg token = "{key}" and more', key),
            (f'cfg token = "{key.upper()}" and more', key.upper()),
            (f"api_key: {mixed}", mixed),
            (f"The commit {key} was merged.", None),
            (f"There were {rng.randrange(2, 99)} of them on the road to {rng.choice(last)}.", None),
            (f"Chapter {rng.randrange(2, 99)}, table {rng.randrange(10**6, 10**8)}.", None),
        ]
    return out


def test_precision_and_recall_on_planted_rows():
    rows = planted_rows(60)
    found = pii.model_spans(pii.train(), [t for t, _ in rows])
    wanted = sum(s is not None for _, s in rows)
    exact = sum(s is not None and any(t[a:b] == s for a, _, b in got) for (t, s), got in zip(rows, found, strict=True))
    assert exact >= 0.9 * wanted
    assert exact >= 0.9 * sum(map(len, found))


def test_redaction_leaves_no_part_of_a_token(spark):
    rows = [(k, t) for k, (t, s) in enumerate(planted_rows(20)) if s and "token" in t]
    df = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, n_chars int")
    out = pii.redact(df)
    assert out.schema == df.schema
    assert {(r.text, r.n_chars) for r in out.collect()} == {('cfg token = "<SECRET>" and more', 31)}


def test_many_spans_stay_linear():
    text = "Mr. John Smith wrote a@b.cc and é. " * 30_000
    base, spans = next(pii.all_spans(pii.train(), [text]))
    assert len(base) == 30_000 and len(spans) >= 45_000
    assert all(text[a:b] in ("a@b.cc", "Mr. John Smith") for a, _, b in spans)
