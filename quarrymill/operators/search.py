"""Hybrid search over a code tree: chunks, fused ranks, locality, collapse, one hop along dependencies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, dirname
from . import index, retrieval

# Top-level kinds that are chunks of their own, and the room of a chunk.
PRIMARY_KINDS = ("resource", "module", "data")
MAX_CHARS, MIN_CHARS = 6000, 500
SCHEMA = "file string, symbol string, line_start int, line_end int, score double, rrf double, locality double, reason string"


def build_chunks(files: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(chunk_id, file, symbol, kind, text, line_start, line_end, type_hint, source_dir).

    Chunks are top-level blocks of the primary kinds, and component files (inputs.hcl, *.tfvars) as a whole, each cut into
    windows of lines. A component's hint is the module its sibling terragrunt.hcl takes its source from.
    """
    lines = files.select("file", F.split("text", "\n").alias("lines"))
    top = blocks.filter((F.col("depth") == 0) & F.col("type").isin(*PRIMARY_KINDS))
    a = top.select("file", index.symbol_name().alias("symbol"), F.col("type").alias("kind"), "header", "line_start", "line_end")
    whole = files.filter((basename(F.col("file")) == "inputs.hcl") | F.col("file").endswith(".tfvars"))
    b = whole.select("file", basename(F.col("file")).alias("symbol"), F.lit("component").alias("kind"), F.col("file").alias("header"), F.lit(1).alias("line_start"), F.size(F.split("text", "\n")).alias("line_end"))
    source = index.first_of(edges.filter("edge_type = 'module_source'").filter(basename(F.col("file")) == "terragrunt.hcl"), ["file"], F.col("line")).select(dirname(F.col("file")).alias("dir"), F.col("module").alias("source_dir"))
    rows = a.unionByName(b).join(lines, "file").withColumn("dir", dirname(F.col("file"))).join(source, "dir", "left")
    body = F.array_join(F.slice("lines", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n")
    room = F.greatest(F.lit(MAX_CHARS) - F.length("header") - 1, F.lit(MIN_CHARS))
    rows = rows.withColumn("body", body).withColumn("w", F.explode(retrieval.chunk_windows(F.col("body"), room)))
    part = F.array_join(F.slice(F.split("body", "\n"), F.col("w.first"), F.col("w.last") - F.col("w.first") + 1), "\n")
    text = F.concat(F.col("file"), F.lit(" "), F.col("symbol"), F.lit("\n"), F.col("header"), F.lit("\n"), part)
    first = F.col("line_start") + F.col("w.first") - 1
    out = rows.select("file", "symbol", "kind", text.alias("text"), first.alias("line_start"), (F.col("line_start") + F.col("w.last") - 1).alias("line_end"), basename(F.col("source_dir")).alias("type_hint"), "source_dir")
    return out.withColumn("chunk_id", F.concat_ws("#", "file", "line_start"))


def search(chunks: DataFrame, query: str, *, top_k: int = retrieval.TOP_K, candidates: int = retrieval.CANDIDATES, dense: Callable[[str, int], DataFrame] | None = None, rerank: Callable[[str, DataFrame], DataFrame] | None = None) -> DataFrame:
    """The best chunk of each file for a query, best first.

    dense gives (id, score) of chunks for a query; rerank gives (id, rerank) for candidate chunks, which counts as it is.
    Both are optional, and without a reranker its weight is nothing.
    """
    lists = [retrieval.bm25(chunks, "chunk_id", F.col("text"), query, top=candidates)]
    if dense is not None:
        lists.append(dense(query, candidates))
    found = retrieval.fuse(lists).orderBy(F.desc("rrf"), "seen").limit(candidates)
    hits = chunks.join(F.broadcast(found), chunks["chunk_id"] == found["id"])  # forty rows
    hits = hits.withColumn("locality", retrieval.locality(F.lit(query), F.col("file"), F.coalesce("type_hint", F.lit("")), F.coalesce("source_dir", F.lit("")), F.col("symbol")))
    hits = hits.withColumn("n", retrieval.normalised(F.col("rrf")))
    if rerank is None:
        score = retrieval.blend(F.col("n"), F.col("locality"))
    else:
        hits = hits.join(rerank(query, hits), "id", "left").withColumn("r", F.coalesce("rerank", F.lit(0.0)))
        score = retrieval.blend(F.col("n"), F.col("locality"), F.col("r"))
    return retrieval.collapse(hits.withColumn("score", score), "file", "score", "seen", top_k)


def search_and_expand(chunks: DataFrame, files: DataFrame, edges: DataFrame, query: str, **options: object) -> DataFrame:
    """Hits with rounded scores, then what one hop along their module sources, templates and variables meets besides."""
    found = search(chunks, query, **options)
    hits = found.sparkSession.createDataFrame(found.collect(), found.schema)  # top_k rows, used several times
    shown = hits.select("file", "symbol", "line_start", "line_end", F.round("score", 5).alias("score"), F.round("rrf", 5).alias("rrf"), F.round("locality", 3).alias("locality"), F.lit("retrieved").alias("reason"))
    source = edges.filter("edge_type = 'module_source'").select("file", F.col("module").alias("target")).join(hits.select("file"), "file", "left_semi")
    template = hits.filter("source_dir is not null").select("file", F.col("source_dir").alias("target"))
    steps = [(template, "dep:template", F.col("file").endswith(".tf")), (source, "dep:module_source", F.col("file").rlike(r"(^|/)(variables|outputs)\.tf$"))]
    out = shown
    seen = hits.select("file")
    for edge, reason, keep in steps:
        more = retrieval.expand(hits, edge, files.filter(keep)).join(seen, "file", "left_anti")
        out = out.unionByName(more.select("file", F.lit(reason).alias("reason")), allowMissingColumns=True)
        seen = seen.unionByName(more.select("file"))
    # the first file of a hit's own directory that defines a variable the hit names
    named = edges.filter("edge_type = 'var_ref'").join(hits.select("file"), "file", "left_semi").select(dirname(F.col("file")).alias("dir"), "name").distinct()
    near = files.withColumn("dir", dirname(F.col("file"))).join(named.select("dir").distinct(), "dir", "left_semi")
    variables = index.symbols(index.parse_blocks(near)).filter("kind = 'variable'").select("file", dirname(F.col("file")).alias("dir"), "name")
    more = named.join(variables, ["dir", "name"]).groupBy("dir", "name").agg(F.min("file").alias("file")).select("file").distinct().join(seen, "file", "left_anti")
    return out.unionByName(more.select("file", F.lit("dep:var_ref").alias("reason")), allowMissingColumns=True)


def residual_tokens(text: DataFrame, tokens: list[str]) -> DataFrame:
    """(line, token): lines of (text) that still hold tokens, of four letters at least, of what was copied from."""
    long = [t.lower() for t in tokens if len(t) >= 4]
    lines = text.select(F.posexplode(F.split("text", "\n")).alias("line", "code"))
    hit = F.filter(F.array(*map(F.lit, long)) if long else F.array().cast("array<string>"), lambda t: F.contains(F.lower("code"), t))
    return lines.select((F.col("line") + 1).alias("line"), F.explode(hit).alias("token"))
