"""Retrieval: BM25 over postings, dense scores, rank fusion, locality, blending, collapse and chunking."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import QUERY_STOPWORDS, ancestors, cosine, query_terms, spaced, term_count, token_bag, token_count, tokenize_code

K1, B = 1.5, 0.75
RRF_K = 60
CANDIDATES, TOP_K = 40, 8
MIN_WINDOW = 500
#: Files below one directory that a task joins.
SHARE_FILES = 100_000
RERANK_WEIGHT, RRF_WEIGHT, PATH_WEIGHT = 0.45, 0.15, 0.40


def postings(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, term, tf, dl) of every document with a token."""
    t = docs.select(F.col(id_col).alias("id"), token_bag(text).alias("tokens"))
    return t.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))


def term_stats(docs: DataFrame, text: Column) -> DataFrame:
    """(term, df, tf) over documents that are rows. Distinct terms and all tokens of a row are exploded side by side, so
    one shuffle, of partial sums by term, is all."""
    t = docs.select(token_bag(text).alias("tokens"))
    kinds = F.array(F.struct(F.lit(1).alias("df"), F.lit(0).alias("tf"), F.array_distinct("tokens").alias("terms")), F.struct(F.lit(0).alias("df"), F.lit(1).alias("tf"), F.col("tokens").alias("terms")))
    rows = t.select(F.explode(kinds).alias("k")).select("k.df", "k.tf", F.explode("k.terms").alias("term"))
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def query_weights(spark: SparkSession, query: str) -> list[tuple[str, int]]:
    """(term, times) of a query as the tokeniser gives it, without stop words unless there is nothing else."""
    tokens = spark.range(1).select(tokenize_code(F.lit(query)).alias("t")).first()["t"]
    return sorted(Counter([t for t in tokens if t not in QUERY_STOPWORDS] or tokens).items())


def _score(terms: list[tuple[str, int]], tf: list[Column], df: list[Column], dl: Column, n: Column, avgdl: Column) -> Column:
    """BM25 of one document from its counts of the query's terms."""
    def part(times: int, f: Column, d: Column) -> Column:
        idf = F.log(1 + (n - d + 0.5) / (d + 0.5))
        return times * idf * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))

    return sum((F.when(f > 0, part(times, f, d)).otherwise(0.0) for (_, times), f, d in zip(terms, tf, df, strict=True)), F.lit(0.0))


def bm25(docs: DataFrame, id_col: str, text: Column, query: str, *, top: int | None = CANDIDATES) -> DataFrame:
    """(id, score) of documents that hold a query term, best first, ties by id, by one scan of the texts.

    Each document becomes its length and its counts of the query's terms, which are dealt out once and read twice: for
    document frequencies, N and the mean length, and for the scores. A term counts as often as the tokeniser gives it in
    the query. Texts without any of the terms are not spelled out. For more than a query or two, build_postings makes a
    table that a query reads a few buckets of.
    """
    terms = query_weights(docs.sparkSession, query)
    names = [f"tf{k}" for k in range(len(terms))]
    low = F.lower(text)
    maybe = reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t, _ in terms], F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), token_count(text).alias("dl"), F.when(maybe, spaced(text)).alias("words"), F.when(maybe, spaced(text, "A-Za-z0-9")).alias("runs"))
    counts = [F.coalesce(term_count(F.col("words"), F.col("runs"), t), F.lit(0)).alias(c) for (t, _), c in zip(terms, names, strict=True)]
    dealt = rows.select("id", "dl", *counts).repartition("id")  # one exchange, used by both
    stats = dealt.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(c) > 0).alias(f"df_{c}") for c in names])
    score = _score(terms, [F.col(c) for c in names], [F.col(f"df_{c}") for c in names], F.col("dl"), F.col("n"), F.col("avgdl"))
    scored = dealt.join(F.broadcast(stats)).select("id", score.alias("score")).filter("score > 0").groupBy("id").agg(F.sum("score").alias("score")).filter("score > 0")  # one row
    return scored if top is None else scored.orderBy(F.desc("score"), "id").limit(top)


BUCKETS = 64


def build_postings(docs: DataFrame, id_col: str, text: Column, path: str, buckets: int = BUCKETS) -> None:
    """Write the postings under path, partitioned by a hash of the term and sorted by term, and the one row of (n, avgdl).

    The folder has to be one that all executors share."""
    rows = postings(docs, id_col, text).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    docs.agg(F.count("*").alias("n"), F.avg(token_count(text)).alias("avgdl"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/stats")


def bm25_indexed(spark: SparkSession, path: str, query: str, *, top: int | None = CANDIDATES) -> DataFrame:
    """What bm25 gives, from a table of build_postings: only the buckets of the query's terms are read."""
    terms = query_weights(spark, query)
    stats = spark.read.parquet(f"{path}/stats")
    words = [t for t, _ in terms]
    buckets = stats.first()["buckets"]
    wanted = [r[0] for r in spark.createDataFrame([(w,) for w in words], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).distinct().collect()]
    hits = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(wanted) & F.col("term").isin(words)).select("id", "dl", "term", "tf")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    times = F.create_map(*[x for t, n in terms for x in (F.lit(t), F.lit(n))])[F.col("term")]
    part = times * _score([("", 1)], [F.col("tf")], [F.col("df")], F.col("dl"), F.col("n"), F.col("avgdl"))
    scored = hits.join(F.broadcast(df), "term").join(F.broadcast(stats)).groupBy("id").agg(F.sum(part).alias("score")).filter("score > 0")  # a row per query term; one row
    return scored if top is None else scored.orderBy(F.desc("score"), "id").limit(top)


def dense(vectors: DataFrame, id_col: str, vector_col: str, query: Column, k: int) -> DataFrame:
    """(id, score) by cosine, ties by id."""
    return vectors.select(F.col(id_col).alias("id"), cosine(F.col(vector_col), query).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def ranks(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., id, rank from 0) of short ranked lists, one for each value of by, or one in all."""
    return scored.select(*by, "id", (F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id")) - 1).alias("rank"))


def fuse(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(id, rrf, seen): reciprocal rank fusion; seen tells where an id first stood, list by list, for ties."""
    all_ = None
    for n, x in enumerate(lists):
        one = ranks(x).withColumn("list", F.lit(n))
        all_ = one if all_ is None else all_.unionByName(one)
    return all_.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("rrf"), F.min(F.struct("list", "rank")).alias("seen"))


def normalised(value: Column) -> Column:
    """Min-max over all rows of a short list; a range of 0 counts as 1."""
    w = Window.partitionBy()
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return (value - lo) / F.coalesce(F.nullif(hi - lo, F.lit(0.0)), F.lit(1.0))


def locality(query: Column, *fields: Column) -> Column:
    """The share of the query's distinctive terms that occur in the given fields."""
    terms = query_terms(query)
    hay = F.lower(F.concat_ws(" ", *fields))
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(hay, t))) / F.size(terms)).otherwise(0.0)


def blend(rrf: Column, path: Column, rerank: Column | None = None) -> Column:
    """Without a reranker its weight is 0 and the others stay as they are."""
    out = RRF_WEIGHT * rrf + PATH_WEIGHT * path
    return out if rerank is None else out + RERANK_WEIGHT * rerank


def collapse(hits: DataFrame, file_col: str, score_col: str, position_col: str, k: int = TOP_K) -> DataFrame:
    """The best chunk of each file, the earlier of equals, then the k best."""
    w = Window.partitionBy(file_col).orderBy(F.desc(score_col), position_col)
    return hits.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn").orderBy(F.desc(score_col), position_col).limit(k)


def chunk_windows(text: Column, max_chars: int | Column) -> Column:
    """Lines gathered greedily into windows: (first, last, chars) of each, lines from 1.

    A line counts a character more than it has, for its end; a window holds as many as max_chars (500 at least) allows,
    and a longer line stands alone, never split. chars: what the window's lines count together.
    A fold, as each window's start depends on the one before: the last entry is the open window.
    """
    room = F.greatest(max_chars if isinstance(max_chars, Column) else F.lit(max_chars), F.lit(MIN_WINDOW))
    start = F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(0).alias("chars")))

    def step(acc: Column, line: Column) -> Column:
        last = F.element_at(acc, -1)
        size = F.length(line) + 1
        number = last["last"] + 1
        grown = F.struct(F.greatest(last["first"], F.lit(1)).alias("first"), number.alias("last"), (last["chars"] + size).alias("chars"))
        fresh = F.struct(number.alias("first"), number.alias("last"), size.alias("chars"))
        joins = (last["chars"] == 0) | (last["chars"] + size <= room)
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(fresh)))

    return F.aggregate(F.split(text, "\n"), start, step)


def expand(hits: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """One hop along dependency edges from retrieved files: each file met that way, once, unless it was retrieved.

    hits: (file, ...); edges: (file, target); files: (file). Targets are directories, so files are joined by their
    ancestors, not by a prefix test. A target counts once, however many hits name it. The files below a directory near the
    root, asked for or not, are dealt in shares of about SHARE_FILES, so that no task has all of them.
    """
    asked = hits.select("file").distinct().join(edges, "file").groupBy("target").agg(F.min("file").alias("via"))
    under = files.select("file", F.explode(ancestors(F.col("file"))).alias("target"))
    crowded = under.groupBy("target").count().filter(F.col("count") > SHARE_FILES).select("target", F.ceil(F.col("count") / SHARE_FILES).cast("int").alias("shares"))
    crowded = F.broadcast(crowded)  # a directory for SHARE_FILES paths and level at most
    asked = asked.join(crowded, "target", "left").select("target", "via", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share"))
    under = under.join(crowded, "target", "left").select("file", "target", F.pmod(F.xxhash64("file"), F.coalesce("shares", F.lit(1))).cast("int").alias("share"))
    found = under.join(asked, ["target", "share"])
    return found.join(hits.select("file"), "file", "left_anti").groupBy("file").agg(F.min("via").alias("via"))
