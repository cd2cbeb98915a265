from __future__ import annotations

import io
import sqlite3
import tarfile

from pyspark.sql import functions as F

from quarrymill.operators import corpus
from quarrymill.sources import archives, sqlite


def archive(path, members):
    with tarfile.open(path, "w:gz") as tar:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


KEY = b"AKIA" + b"ABCDEFGHIJKLMNOP"
SOUND = b'resource "a" "b" {\n}\n'


def test_files_job(spark, tmp_path):
    archive(tmp_path / "1.tar.gz", {"1/main.tf": SOUND, "1/vars.tf": b"x = 1\n", "1/broken.tf": b"a {\n"})
    archive(tmp_path / "2.tar.gz", {"2/main.tf": SOUND, "2/leak.tf": b'k = "' + KEY + b'"\n', "2/e.tfvars": b"y = 2\n"})
    archive(tmp_path / "3.tar.gz", {"3/notes.md": b"# x"})
    kept, counts = corpus.files_job(archives.read_archives(spark, str(tmp_path)))
    assert counts.first().asDict() == {"files": 6, "parse_ok": 5, "no_secret": 4, "unique": 3}
    assert {(r.repo_id, r.path) for r in kept.collect()} == {(1, "1/main.tf"), (1, "1/vars.tf"), (2, "2/e.tfvars")}
    archives.write_files(kept, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"ext=.tf", "ext=.tfvars"}


def test_archive_members_are_chosen(spark, tmp_path):
    archive(tmp_path / "42.tar.gz", {"main.tf": SOUND, "README.md": b"x", ".terraform/x.tf": b"", "broken.TF": b"a {", "creds.tf": KEY, "bin.tf": b"a\0b", "big.tf": b" " * 1_000_001, "bad.tf": b"a = \xff\n"})
    (tmp_path / "7.tar.gz").write_bytes(b"not an archive")
    whole = (tmp_path / "42.tar.gz").read_bytes()
    (tmp_path / "x8.tar.gz").write_bytes(whole[: len(whole) // 2])
    rows = {r.path: r for r in archives.read_archives(spark, str(tmp_path)).filter("repo_id = 42").collect()}
    assert set(rows) == {"main.tf", "broken.TF", "creds.tf", "bad.tf"}
    assert not rows["broken.TF"].parse_ok and rows["creds.tf"].has_secret and not rows["main.tf"].has_secret
    assert rows["bad.tf"].text == "a = �\n"
    assert {r.repo_id for r in archives.read_archives(spark, str(tmp_path)).select("repo_id").distinct().collect()} <= {42, -1}


def metadata(spark, tmp_path):
    path = str(tmp_path / "meta.db")
    with sqlite3.connect(path) as c:
        c.execute("create table Repositories (Id INTEGER, FullName TEXT, License TEXT, StarCount INTEGER, Archived INTEGER, SizeInKb INTEGER)")
        c.executemany("insert into Repositories values (?,?,?,?,?,?)", [(1, "a/x", "MIT", 5, 0, 100), (2, "a/x", "MIT", 9, 0, 100), (3, "b/y", "GPL-3.0", 1, 0, 100), (4, "c/z", "MIT", 1, 1, 100), (5, "d/w", "Apache-2.0", 1, 0, 3), (6, "e/v", "BSD-3-Clause", 1, 0, 50)])
        c.execute("create table Modules (Id INTEGER, RepositoryId INTEGER, Path TEXT)")
        c.executemany("insert into Modules values (?,?,?)", [(10, 1, "m"), (11, 2, "m"), (12, 6, "m"), (13, 3, "m")])
        c.execute("create table Resources (Id INTEGER, ModuleId INTEGER, ResourceType TEXT, Provider TEXT)")
        c.executemany("insert into Resources values (?,?,?,?)", [(100 + k, 10 + k, "t", "p") for k in range(4)])
    return [sqlite.read_table(spark, path, t, 3) for t in ("Repositories", "Modules", "Resources")]


def test_metadata_job(spark, tmp_path):
    repos, modules, resources = metadata(spark, tmp_path)
    assert dict(repos.dtypes)["Id"] == "bigint" and dict(repos.dtypes)["FullName"] == "string"
    counts = corpus.metadata_counts(repos, modules, resources).first().asDict()
    assert counts == {"raw": 6, "licensed": 5, "active": 4, "deduped": 3, "sized": 2, "modules": 2, "resources": 2}
    sized = corpus.metadata_stages(repos)["sized"]
    assert {r.Id for r in sized.collect()} == {2, 6}
    joined = corpus.metadata_join(sized, modules, resources)
    assert sorted(joined.columns) == sorted(["ModuleId", "RepositoryId", "Path", "RepoId", "FullName", "License", "StarCount", "ResourceId", "ResourceType", "Provider"])


def test_a_small_most_starred_copy_hides_its_name(spark):
    rows = [(1, "a", "MIT", 5, 0, 100), (2, "a", "MIT", 9, 0, 1), (3, "b", None, 1, 0, 100)]
    repos = spark.createDataFrame(rows, "Id long, FullName string, License string, StarCount long, Archived int, SizeInKb int")
    assert corpus.metadata_stages(repos)["sized"].count() == 0


def test_top_groups_break_ties_by_name(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "k string")
    assert [tuple(r) for r in corpus.top_groups(df, "k", 2).collect()] == [("c", 2), ("a", 1)]
    assert corpus.exact_dedup(df, F.col("k").cast("binary"), F.col("k")).count() == 3
