"""Trees of code files as tables, and small readers over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, dirname, extension
from . import ignore

# Directories never looked into, and files of interest.
IGNORE_PARTS = (".git", ".terraform", ".terragrunt-cache", "node_modules")
EXTENSIONS = (".tf", ".hcl", ".tfvars")


def read_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, *, ignore_files: tuple[str, ...] = ()) -> DataFrame:
    """(file, text, file_hash, modified) of the files under a root; bytes that are no UTF-8 are replaced. With ignore_files,
    names such as .gitignore, files that the rules in them leave out are left out. Spark lists no empty files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = "/" + root.split("://", 1)[-1].strip("/") + "/"
    path = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    file = F.expr(f"substring(regexp_replace(path, '^[a-z0-9]+:/+', '/'), {len(base) + 1})") if base else path
    rows = raw.select(file.alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("modificationTime").alias("modified"))
    skip = F.arrays_overlap(F.split("file", "/"), F.array(*map(F.lit, IGNORE_PARTS)))
    wanted = extension(F.col("file")).isin(*extensions)
    if ignore_files:
        rows = ignore.listed(rows.filter(wanted), ignore_files, hidden_files(spark, root, ignore_files))
    return rows.filter(wanted & ~skip).withColumn("file_hash", F.md5(F.col("text").cast("binary")))


def hidden_files(spark: SparkSession, root: str, names: tuple[str, ...], deepest: int = 64) -> DataFrame:
    """(file, text) of the files of a few names in a tree, hidden ones, which Spark never lists, included. They are found level
    by level by the file system's globs and are few and short, one for each folder that has rules at most."""
    jvm = spark._jvm
    there = jvm.org.apache.hadoop.fs.Path(root)
    system = there.getFileSystem(spark._jsc.hadoopConfiguration())
    base = system.getFileStatus(there).getPath().toString().rstrip("/") + "/"
    rows = []
    for depth in range(deepest):
        level = base + "*/" * depth
        for name in names:
            for found in system.globStatus(jvm.org.apache.hadoop.fs.Path(level + name)) or []:
                stream = system.open(found.getPath())
                rows.append((found.getPath().toString().removeprefix(base), jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
                stream.close()
        if not len(system.globStatus(jvm.org.apache.hadoop.fs.Path(level + "*")) or []):
            break
    return spark.createDataFrame(rows, "file string, text string")


def named(files: DataFrame, *names: str) -> DataFrame:
    return files.filter(basename(F.col("file")).isin(*names))


def flat_yaml(text: Column) -> Column:
    """`key: value` lines as a map; quotes and comments go, the last of equal keys wins."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:"))
    pair = lambda x: F.struct(F.regexp_extract(x, r"^([A-Za-z_][\w-]*):", 1).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(F.regexp_extract(x, r"^[^:]*:(.*)$", 1), r"\s+#.*$", "")), "^([\"'])(.*)\\1$", "$2").alias("v"))
    entries = F.transform(lines, pair)
    last = F.filter(F.transform(entries, lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), i.alias("i"))), lambda e: ~F.exists(F.slice(entries, e["i"] + 2, F.size(entries)), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))


def variable_names(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r'variable\s+"([^"]+)"'), F.lit(1))


def line_range(text: Column, first: Column, last: Column, limit: int = 1200) -> Column:
    return F.substring(F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n"), 1, limit)


def components(files: DataFrame) -> DataFrame:
    """(project, provider, env, component, dir, file, text) of <project>/<provider>/<env>/<type>/inputs.hcl, apart from modules and dot directories."""
    p = F.split("file", "/")
    rows = files.filter((basename(F.col("file")) == "inputs.hcl") & (F.size(p) == 5))
    rows = rows.select(p[0].alias("project"), p[1].alias("provider"), p[2].alias("env"), p[3].alias("component"), dirname(F.col("file")).alias("dir"), "file", "text")
    return rows.filter((F.col("project") != "modules") & ~F.col("project").startswith(".") & ~F.col("env").startswith("."))


def siblings(files: DataFrame, component: str, *, exclude_dir: str = "", limit: int = 2) -> DataFrame:
    """Up to `limit` examples of a component elsewhere, in path order."""
    return files.filter(F.col("file").rlike(rf"(^|/){component}/(inputs\.hcl|main\.tf)$") & ~F.col("file").startswith("modules/") & (dirname(F.col("file")) != exclude_dir)).orderBy("file").limit(limit)
