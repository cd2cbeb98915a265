"""python -m quarrymill.cli ROOT VERB ...: the code index from a shell. Rows are printed as JSON lines."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import catalog, dataset, index, inventory, layout, search
from .operators.kept import KeptIndex
from .session import build_session
from .sources import sinks, trees

VERBS = ("stats", "outline", "find", "imports", "importers", "related", "search", "catalog", "plan", "list", "convention", "dataset")


def answer(files: DataFrame, verb: str, words: list[str], *, kind: str | None = None, project: str | None = None, where: list[str] | None = None, facts: DataFrame | None = None) -> DataFrame:
    """The rows of a verb over a table of files; facts are those of a kept index, or else parsed here."""
    said = " ".join(words)
    if verb == "convention":
        return layout.convention(files.withColumn("repo", F.lit(".")))
    if verb == "list":
        found, unresolved = inventory.find(trees.components(files), words[0], project=project, where=where)
        warnings = unresolved.select(F.concat(F.lit("no component has "), "key").alias("warning"))
        return found.unionByName(warnings, allowMissingColumns=True)
    facts = index.parse(files) if facts is None else facts
    blocks = index.blocks(facts)
    if verb in ("outline", "find"):
        s = index.symbols(blocks)
        return s.filter(F.col("file") == said) if verb == "outline" else index.find_symbol(s, said, kind)
    edges = index.edges(facts)
    if verb == "stats":
        n = index.symbols(blocks).groupBy("kind").agg(F.count("*").alias("n"))
        return n.unionByName(edges.groupBy(F.col("edge_type").alias("kind")).agg(F.count("*").alias("n"))).orderBy(F.desc("n"), "kind")
    if verb == "imports":
        return edges.filter(F.col("file") == said)
    if verb == "importers":
        return index.find_importers(edges, said)
    if verb == "related":
        return index.related(edges, said)
    if verb == "search":
        return search.search_and_expand(search.build_chunks(files, blocks, edges), files, edges, said)
    schema = layout.repo_schemas(files.select(F.lit("").alias("repo"), "file", "text")).first()  # one repository
    modules = catalog.build(blocks, edges, schema["prefix"] if schema else "")
    if verb == "plan":
        return catalog.plan(modules, "dir", F.col("dir"), F.col("resource_types"), F.col("reuse_count"), said)
    doc = catalog.document(F.col("name"), F.col("dir"), F.col("resource_types"), F.col("inputs"), F.col("outputs"))
    return catalog.match(modules, "dir", doc, T.plain_tokens(F.col("name")), F.col("reuse_count"), said)


def write_dataset(files: DataFrame, path: str, **options: object) -> str:
    """Write the training examples of files as JSON lines; what was written, as JSON."""
    sinks.write_jsonl(dataset.build(files, **options), path)
    written = files.sparkSession.read.schema("text string").json(path)
    return dataset.totals(written, F.col("text")).toJSON().first()


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("root")
    p.add_argument("verb", choices=VERBS)
    p.add_argument("words", nargs="*")
    p.add_argument("--index", help="a folder to keep what was parsed in, from call to call")
    p.add_argument("--ignore-file", action="append", default=[], help="heed the rules in files of this name, .gitignore say")
    p.add_argument("--kind")
    p.add_argument("--project")
    p.add_argument("--where", action="append", default=[])
    p.add_argument("--max-chars", type=int, default=dataset.MAX_CHARS)
    p.add_argument("--no-grouping", action="store_true")
    a = p.parse_args(argv)
    if a.verb == "dataset":
        files = trees.read_tree(build_session("cli"), a.root, dataset.VALID_EXTENSIONS, ignore_files=tuple(a.ignore_file))
        print(write_dataset(files, a.words[0], max_chars=a.max_chars, grouped=not a.no_grouping))
        return
    spark = build_session("cli")
    files = trees.read_tree(spark, a.root, ignore_files=tuple(a.ignore_file))
    facts = None
    if a.index:
        kept = KeptIndex(spark, a.index)
        kept.refresh(files)
        facts = kept.facts()
    for row in answer(files, a.verb, a.words, kind=a.kind, project=a.project, where=a.where, facts=facts).toJSON().toLocalIterator():
        print(row)


if __name__ == "__main__":
    main()
