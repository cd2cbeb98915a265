"""Ignore rules, against git itself."""

from __future__ import annotations

import shutil
import subprocess

import pytest

from quarrymill.sources import ignore, trees

RULES = {
    ".gitignore": "# comment\n\n*.log\n!keep.log\n/top.tf\nbuild/\n**/deep/x.tf\na/**/z.tf\nlogs/**\nfoo/*.tf\n[ab]?.hcl\n[!ab]c.tfvars\n\\#odd\n\\!odd\ntrail.txt   \nspace\\ \nq*q\n",
    "a/.gitignore": "!b.log\n/own.tf\n!build/\nout\n",
    "a/b/.gitignore": "*\n!*.tf\n!sub/\n",
}
PATHS = """x.log keep.log a/keep.log a/b.log a/c.log a/b/b.log top.tf a/top.tf build/m.tf build/keep.log a/build/m.tf a/build/sub/m.tf m/build deep/x.tf a/deep/x.tf a/m/deep/x.tf
a/z.tf a/m/z.tf a/m/n/z.tf b/a/z.tf logs/x.tf logs/a/b/y.tf m/logs/x.tf foo/x.tf foo/a/x.tf m/foo/x.tf ax.hcl cx.hcl axx.hcl cc.tfvars ac.tfvars m/cc.tfvars #odd !odd trail.txt a/own.tf a/m/own.tf a/out/x.tf
out/x.tf a/m/out a/b/x.tf a/b/x.hcl a/b/sub/y.tf a/b/sub/y.hcl a/b/other/y.tf qq q1q q/q m/qzzq/t.tf plain.tf a/b/c.log""".split()


@pytest.mark.skipif(shutil.which("git") is None, reason="no git")
def test_as_git_has_it(spark, tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    for name, text in RULES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    asked = sorted(set(PATHS))
    said = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "--no-index", "--stdin"], input="\n".join(asked), capture_output=True, text=True).stdout.split("\n")
    want = {x.strip('"') for x in said if x}
    files = spark.createDataFrame([(p, None) for p in asked] + list(RULES.items()), "file string, text string")
    got = {r.file for r in ignore.ignored(files).collect()}
    assert got & set(asked) == want and 20 < len(want) < len(asked)
    assert {r.file for r in ignore.listed(files).collect()} == (set(asked) | set(RULES)) - got


def test_stronger_names_and_no_rules(spark):
    files = spark.createDataFrame([(".gitignore", "*.tf\n"), (".ignore", "!a.tf\n"), ("a.tf", ""), ("b.tf", ""), ("c.hcl", None)], "file string, text string")
    assert {r.file for r in ignore.ignored(files).collect()} == {"b.tf"}
    assert ignore.ignored(files.filter("file like '%.hcl'")).collect() == [] == ignore.listed(files.limit(0)).collect()


def test_trees_heed_rules_if_asked(spark, tmp_path):
    for name, text in {".gitignore": "gen/\n", "a.tf": "a = 1", "gen/b.tf": "a = 1", "m/gen/c.tf": "a = 1", "m/d.tf": "a = 1", "x/y/.gitignore": "*\n!w.tf\n", "x/y/z.tf": "a = 1", "x/y/w.tf": "a = 1"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {r.file for r in trees.read_tree(spark, str(tmp_path), ignore_files=ignore.NAMES).collect()} == {"a.tf", "m/d.tf", "x/y/w.tf"}
    assert trees.read_tree(spark, str(tmp_path)).count() == 6
