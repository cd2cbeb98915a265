"""Training examples of files, against the plain way to build them."""

from __future__ import annotations

import json
import os
import random

import pytest

from quarrymill import cli
from quarrymill.functions import hcl
from quarrymill.operators import dataset


def plain_examples(files, max_chars, grouped=True):
    groups, out = {}, []
    for file, text in files:
        name, dir_ = os.path.basename(file), os.path.dirname(file)
        if name in dataset.SKIP_FILES or os.path.splitext(name)[1] not in dataset.VALID_EXTENSIONS or len((text or "").strip()) < 15 or set(dir_.split("/")) & set(dataset.SKIP_DIRS):
            continue
        if grouped and name in dataset.GROUPED and dir_:
            groups.setdefault(dir_, []).append((dataset.GROUPED.index(name), file, text))
        else:
            out.append((file, text))
    for dir_, members in groups.items():
        out.append((dir_, "\n\n".join(f"# file: {f}\n{t.rstrip()}" for _, f, t in sorted(members))))
    rows = []
    for label, text in out:
        chunks = hcl.smart_chunks(text, max_chars)
        for k, c in enumerate(chunks):
            own = f"{label}::part{k}" if len(chunks) > 1 else label
            rows.append((own, c if grouped else f"# file: {own}\n{c}"))
    return sorted(rows)


def some_files():
    rng = random.Random(3)
    names = [*dataset.GROUPED, "config.yml", "a.tfvars", "root.hcl", "README.md", "terragrunt.hcl", "x.py"]
    files = []
    for d in ("", "m/a", "m/b", "m/c", "live/x", ".terraform/m", "a/.git"):
        for name in rng.sample(names, 11):
            blocks = "".join(f'resource "r" "n{k}" {{ # }}\n  tags = {{\n    a = "{"x" * rng.randrange(30)}"\n  }}\n}}\n{" " * rng.randrange(3)}\n' for k in range(rng.randrange(12)))
            files.append((os.path.join(d, name), rng.choice(["", "\n\n", "  "]) + blocks + rng.choice(["", "\r\n \u2003", "}", "{\n"])))
    return [*files, ("m/a/short.tf", "a = 1         \n"), ("m/a/null.tf", None), ("live/x/exact.tfvars", "y" * 300), ("live/x/over.tfvars", "y" * 299 + "\n \n")]


@pytest.mark.parametrize("max_chars", [1, 300, 400_000])
@pytest.mark.parametrize("grouped", [True, False])
def test_examples(spark, max_chars, grouped):
    files = some_files()
    df = spark.createDataFrame(files, "file string, text string").repartition(3).selectExpr("*", "1 as label", "'a' as place")
    got = dataset.build(df, max_chars=max_chars, grouped=grouped, out_chars=500)
    assert sorted(map(tuple, got.collect())) == plain_examples(files, max_chars, grouped)
    assert dataset.build(df.limit(0)).collect() == []


def test_repositories_stay_apart_and_long_directories_are_streamed(spark):
    long = "".join(f"a{k} {{\n  x = {k}\n}}\n" for k in range(20_000))
    files = [(repo, f"m/{name}", long) for repo in (None, "r1", "r2") for name in ("main.tf", "variables.tf")]
    got = dataset.build(spark.createDataFrame(files, "repo string, file string, text string"), by=("repo",), max_chars=50_000).collect()
    want = plain_examples([(f, t) for r, f, t in files if r == "r1"], 50_000)
    for repo in (None, "r1", "r2"):
        assert sorted((r.label, r.text) for r in got if r.repo == repo) == want and len(want) > 10
    assert max(len(r.text) for r in got) < 50_100


def test_json_lines_from_the_command(spark, tmp_path):
    files = some_files()
    said = json.loads(cli.write_dataset(spark.createDataFrame(files, "file string, text string"), str(tmp_path / "out"), max_chars=300))
    lines = [json.loads(x)["text"] for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    want = [t for _, t in plain_examples(files, 300)]
    assert sorted(lines) == sorted(want) and said["examples"] == len(want) and said["chars"] == sum(map(len, want))
