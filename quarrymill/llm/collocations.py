"""Phrases of two to five words that stand together more often than their parts would, by hashed passes.

Each pass over the texts counts the phrases of one length exactly and, in buckets, those of the next length (PCY). A
phrase is counted only if its bucket came to `least` in the pass before (DHP) and if both phrases it consists of but for
one word are frequent (Apriori). Two bitmaps of bounded size say so in every task; a bit that is set by chance costs a
count, never a phrase. Buckets are counted in one array a task, up to `least`, and added up in a tree of blocks; only
what a bitmap holds comes to the driver. Texts are read once a pass, tokenised in numpy, and counts are folded before they
are shuffled, so that a frequent phrase is a row for each fold of each task.

A cut of a phrase compares it with its two parts: floor(1000 * a * n / (l * r)), in decimals of 38 digits. The lowest cut
counts, of equal ones the first.

Edge cases: a null language is `und`; null and empty texts have no words; rows may repeat, each counts; phrases never
reach over the end of a piece or a text; no rows give none; other columns are ignored; ids play no part.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tidy

LEAST = 100
LONGEST = 5
TOP = 2000
#: A longer phrase with so many hundredths of a phrase's count makes it dispensable.
SHARE = 100
#: Buckets grow with the text, one for about twenty words, up to 2^26: 64 MB of counts in a task, 8 MB of bits.
MOST_BITS = 26
FEWEST_BITS = 15
CHUNK_BITS = 15
FAN_IN = 64
SLICE_BYTES = 4_000_000
FOLD = 300_000
UNKNOWN = "und"

#: Bytes between words, and bytes that end a piece; A-Z are lower-cased before.
BLANKS = b" \t"
ENDS = b".,;:!?\n\v\f\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(ENDS)] = 2
_STEP = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_PASS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("chunk", pa.int64()), ("task", pa.int64()), ("counts", pa.binary())])


def words_of(data: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(codes, dictionary, piece) of each word of a lower-cased text."""
    raw = np.frombuffer(data, np.uint8)
    kind = _KIND[raw]
    inside = kind == 0
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    encoded = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary.to_pylist(), piece


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang)
    return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], np.uint64)


def buckets_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def has(bitmap: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bitmap[buckets >> 3] >> (buckets & 7).astype(np.uint8)) & 1 == 1


def distinct_phrases(codes: np.ndarray, at: np.ndarray, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each different phrase of k words that begins at one of `at`, how often it does)."""
    key = codes[at]
    for j in range(1, k):
        key = np.unique(key, return_inverse=True)[1] if j > 1 else key
        key = key * size + codes[at + j]
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return at[first], n


def _count(k: int, longest: int, least: int, bits: int, known_bits: int, known: Broadcast | None, likely: Broadcast | None):
    """The pass that counts phrases of k words and buckets of k + 1. known: bits of the frequent phrases of k - 1 words,
    likely: bits of the buckets of k words that came to `least`; both absent in the first pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        total: Counter = Counter()
        counts = np.zeros(1 << bits, np.uint8 if least < 256 else np.int64) if k < longest else None
        task = xxhash.xxh3_64_intdigest(np.random.default_rng().bytes(16)) >> 1

        def work(lang: str, texts: list[bytes]) -> None:
            codes, words, piece = words_of(b"\n".join(texts).lower())
            if k == 1:
                total[lang] += len(codes)
            if len(codes) < k:
                return
            hashes = word_hashes(words, lang)[codes]

            def longer(h: np.ndarray, j: int) -> np.ndarray:
                """Hashes of j words from those of j - 1."""
                return h[: len(codes) - j + 1] * np.uint64(_STEP) + hashes[j - 1 :]

            h = hashes
            for j in range(2, k):
                h = longer(h, j)
            fine = np.ones(len(codes), bool)
            if k > 1:
                ok = has(known.value, buckets_of(h, known_bits))
                h = longer(h, k)
                fine = ok[:-1] & ok[1:] & (piece[: len(h)] == piece[k - 1 :])
                fine[fine] = has(likely.value, buckets_of(h[fine], bits))
            at = np.flatnonzero(fine)
            if not len(at):
                return
            place, n = distinct_phrases(codes, at, k, len(words))
            for p, c in zip(place.tolist(), n.tolist(), strict=True):
                tally[lang, b" ".join([words[x] for x in codes[p : p + k]])] += c
            if counts is not None:
                both = fine[:-1] & fine[1:]
                both &= piece[: len(both)] == piece[k : k + len(both)]
                bucket, n = np.unique(buckets_of(longer(h, k + 1)[both], bits), return_counts=True)
                counts[bucket] = np.minimum(counts[bucket].astype(np.int64) + n, least)

        def rows(found: Counter) -> pa.RecordBatch:
            null = pa.nulls(len(found))
            names = pa.array([x[1] for x in found], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), names, pa.array(list(found.values()), pa.int64()), null.cast(pa.int64()), null.cast(pa.int64()), null.cast(pa.binary())], schema=_PASS)

        waiting: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                data = text.as_py()
                if data:
                    waiting.setdefault(lang, []).append(data)
                    size += len(data)
                if size >= SLICE_BYTES:
                    for name, texts in waiting.items():
                        work(name, texts)
                    waiting, size = {}, 0
                    if len(tally) > FOLD:
                        yield rows(tally)
                        tally.clear()
        for name, texts in waiting.items():
            work(name, texts)
        if tally:
            yield rows(tally)
        if total:
            yield rows(Counter({(lang, None): n for lang, n in total.items()}))
        if counts is not None:
            for chunk in range(0, len(counts), 1 << CHUNK_BITS):
                part = counts[chunk : chunk + (1 << CHUNK_BITS)]
                if part.any():
                    yield pa.RecordBatch.from_pylist([{"chunk": chunk >> CHUNK_BITS, "task": task, "counts": zlib.compress(part.tobytes(), 1)}], schema=_PASS)
        waiting = {}
        tidy()

    return run


def _bucket_bits(parts: DataFrame, tasks: int, least: int, bits: int, scratch: Scratch, label: str) -> np.ndarray:
    """The bitmap of buckets that come to `least`: chunks are added in a tree, so a task gets at most FAN_IN parts of a
    chunk, times a little, at once."""
    kind = np.uint8 if least < 256 else np.int64

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << min(CHUNK_BITS, bits), np.int64)
        for x in group["counts"]:
            total += np.frombuffer(zlib.decompress(x), kind)
        total = np.minimum(total, least).astype(kind)
        return pd.DataFrame({"chunk": [key[0]], "task": [key[1]], "counts": [zlib.compress(total.tobytes(), 1)]})

    schema = "chunk long, task long, counts binary"
    width = tasks
    while width > 1:
        width = -(-width // FAN_IN)
        parts = scratch(parts.withColumn("task", F.col("task") % width).groupBy("chunk", "task").applyInPandas(add, schema), label)

    @F.pandas_udf("binary")
    def packed(counts: pd.Series) -> pd.Series:
        return counts.map(lambda x: np.packbits(np.frombuffer(zlib.decompress(x), kind) >= least, bitorder="little").tobytes())

    out = np.zeros(max((1 << bits) >> 3, 1), np.uint8)
    size = (1 << CHUNK_BITS) >> 3
    for chunk, data in parts.select("chunk", packed("counts")).collect():  # as many bytes as the bitmap has
        out[chunk * size : chunk * size + len(data)] |= np.frombuffer(data, np.uint8)
    return out


def _phrase_bits(phrases: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of a table of phrases, folded in Spark; 4 KB for every 32,768 bits come to the driver."""

    @F.pandas_udf("long")
    def bucket(lang: pd.Series, phrase: pd.Series) -> pd.Series:
        out = []
        for name, text in zip(lang, phrase, strict=True):
            h = 0
            for w in text.encode().split(b" "):
                h = (h * _STEP + xxhash.xxh3_64_intdigest(w, xxhash.xxh3_64_intdigest(name))) % (1 << 64)
            out.append(h)
        return pd.Series(buckets_of(np.array(out, np.uint64), bits))

    b = phrases.select((bucket("lang", "phrase") + 1).alias("b"))
    folded = b.groupBy(F.bitmap_bucket_number("b").alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    out = np.zeros(max(1 << bits, 1 << 15) >> 3, np.uint8)
    for chunk, data in folded.collect():
        out[(chunk - 1) * 4096 : chunk * 4096] |= np.frombuffer(data, np.uint8)
    return out


def frequent_phrases(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, k, phrase, f) of phrases of up to `longest` words that occur `least` times, (lang, n) with all words)."""
    spark = docs.sparkSession
    scratch = Scratch()
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit(UNKNOWN)).alias("lang"), docs[text_col].cast("string").alias("text"))
    length = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max((length >> 7).bit_length(), FEWEST_BITS), most_bits)
    known_bits = min(bits + 3, max(most_bits, FEWEST_BITS))
    out, words = None, None
    known = likely = None
    for k in range(1, longest + 1):
        counted = scratch(texts.mapInArrow(_count(k, longest, least, bits, known_bits, known, likely), "lang string, phrase string, n long, chunk long, task long, counts binary"), f"pass-{k}")
        rows = counted.filter("chunk is null")
        if k == 1:
            words = scratch(rows.filter("phrase is null").groupBy("lang").agg(F.sum("n").alias("n")), "words")
        found = rows.filter("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        found = scratch(found.select("lang", F.lit(k).alias("k"), "phrase", "f"), f"phrases-{k}")
        out = found if out is None else out.unionByName(found)
        if k < longest:
            parts = counted.filter("chunk is not null").select("chunk", "task", "counts")
            tasks = parts.agg(F.approx_count_distinct("task")).first()[0]
            likely = spark.sparkContext.broadcast(_bucket_bits(parts, max(tasks, 2), least, bits, scratch, f"buckets-{k}"))
            known = spark.sparkContext.broadcast(_phrase_bits(found, known_bits))
    return out, words


def collocations(docs: DataFrame, *, top: int = TOP, share: int = SHARE, **options: object) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases. Of phrases that stand inside a longer one,
    those go that have hardly more occurrences; as counts never grow with length, the next longer ones tell."""
    phrases, words = frequent_phrases(docs, **options)
    candidates = phrases.filter("k > 1").withColumn("w", F.split("phrase", " "))
    longer = candidates.filter("k > 2").select("lang", "f", F.explode(F.array(F.expr("slice(w, 1, k - 1)"), F.expr("slice(w, 2, k - 1)"))).alias("w"))
    covers = longer.groupBy("lang", F.array_join("w", " ").alias("phrase")).agg(F.max("f").alias("covered"))
    kept = candidates.join(covers, ["lang", "phrase"], "left").filter(F.coalesce(F.col("covered") * 100 < F.col("f") * share, F.lit(True)))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.expr("slice(w, 1, cut)"), " ").alias("left"), F.array_join(F.expr("slice(w, cut + 1, size(w))"), " ").alias("right"))
    left, right = phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    whole = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(words, "lang")
    score = F.expr("cast(a as decimal(38, 0)) * 1000 * n div (cast(l as decimal(38, 0)) * r)")
    best = whole.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")).select("lang", "phrase", "a", "n", "best.score", "best.l", "best.r")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
