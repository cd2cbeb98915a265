"""Ignore files of a tree: which paths their rules leave out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ancestors, basename, dirname

#: Names of ignore files; of one folder's the later ones are stronger.
NAMES = (".gitignore", ".ignore")

_PART = re.compile(r"\\(.)|(^|/)\*\*(?:/|$)|\*+|\?|\[((?:!|\^)?\]?(?:\\.|[^\]])*)\]|(.)", re.S)


def pattern_of(glob: str) -> str:
    """The regular expression for a path below the rule's folder that a glob matches: a glob with a slash but at its end is
    bound to the folder, any other fits at every depth; `**` spans folders, other signs stay within one."""
    anchored = "/" in glob.rstrip("/")
    out = "" if anchored else "(?:.*/)?"
    glob = glob.removeprefix("/").rstrip("/")
    for m in _PART.finditer(glob):
        escaped, span, group, plain = m.groups()
        if escaped is not None:
            out += re.escape(escaped)
        elif span is not None:
            out += "(?:.*/)?" if m[0].endswith("/") and not span else "/(?:.*/)?" if m[0].endswith("/") else f"{span}.+"
        elif group is not None:
            negated, body = group[:1] in "!^" and group[:1] != "", group.lstrip("!^") if group[:1] in "!^" else group
            out += "(?!/)[" + "^" * negated + body.replace("[", "\\[").replace("&&", "&\\&").replace("]", "\\]") + "]"
        else:
            out += "[^/]*" if m[0].startswith("*") else "[^/]" if m[0] == "?" else re.escape(plain)
    return out


def rules_of(text: str) -> Iterator[tuple[int, bool, bool, str]]:
    """(line, negated, for folders only, pattern) of each rule in an ignore file."""
    for k, line in enumerate((text or "").splitlines()):
        rule = re.sub(r"(?<!\\)[ \t]+$", "", line)
        if rule.startswith("#") or not rule.strip("/ "):
            continue
        negated = rule.startswith("!")
        rule = rule[negated:]
        yield k, negated, rule.endswith("/"), pattern_of(rule)


def rules(files: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """(dir, rank, line, negated, folders, pattern) of all ignore files among (file, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, r, *x) for d, r, t in zip(batch["dir"], batch["rank"], batch["text"], strict=True) for x in rules_of(t)]
            yield pd.DataFrame(rows, columns=["dir", "rank", "line", "negated", "folders", "pattern"])

    rank = F.array_position(F.array(*map(F.lit, names)), basename(F.col("file"))).cast("int")
    mine = files.filter(basename(F.col("file")).isin(*names)).select(dirname(F.col("file")).alias("dir"), rank.alias("rank"), "text")
    return mine.mapInPandas(run, "dir string, rank int, line int, negated boolean, folders boolean, pattern string")


def ignored(files: DataFrame, names: tuple[str, ...] = NAMES, given_in: DataFrame | None = None) -> DataFrame:
    """(file): the paths among (file, text) that rules leave out; given_in: (file, text) with the ignore files, if not among them.

    A path and each folder above it are judged by the rules of all folders above them, by one equi-join on folders: the last
    rule that fits wins, those of deeper folders after those of higher ones. A path is out if it or a folder above it is,
    so nothing below an ignored folder can be taken back.

    Edge cases: null texts have no rules; blank lines and comments are none; a class that isn't closed stands for itself.
    """
    given = rules(files if given_in is None else given_in, names)
    paths = files.select("file").distinct()
    up = paths.select("file", F.explode(F.filter(ancestors(F.col("file")), lambda d: d != "")).alias("of"), F.lit(True).alias("folder"))
    judged = paths.select("file", F.col("file").alias("of"), F.lit(False).alias("folder")).unionByName(up)
    subjects = judged.select("of", "folder").distinct().withColumn("dir", F.explode(ancestors(F.col("of"))))
    below = F.when(F.col("dir") == "", F.col("of")).otherwise(F.expr("substring(of, length(dir) + 2)"))
    hit = subjects.join(given, "dir").filter((F.col("folder") | ~F.col("folders")) & F.regexp_like(below, F.concat(F.lit("^(?:"), "pattern", F.lit(")$"))))
    last = hit.groupBy("of", "folder").agg(F.max_by("negated", F.struct(F.length("dir"), "rank", "line")).alias("negated")).filter("not negated")
    return judged.join(last, ["of", "folder"], "left_semi").select("file").distinct()


def listed(files: DataFrame, names: tuple[str, ...] = NAMES, given_in: DataFrame | None = None) -> DataFrame:
    """The rows of files that no rule leaves out."""
    return files.join(ignored(files, names, given_in), "file", "left_anti")
