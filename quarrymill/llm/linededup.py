"""Line dedup: every line that an earlier document holds goes.

Each slice of documents is split once. Inside a slice the smallest document that holds a line is known, so that of each
line only that document's occurrence leaves the slice, however often the line stands there; the others are settled at
once. What leaves, a 128-bit hash of the line's key with document and positions, is dealt by ranges of the hash and
sorted by hash and document; one pass over the sorted rows keeps each hash's first document and reports the others. The
reports become one compressed bitmap for each document that loses lines; texts are joined to them only at the end.

A line's key is the line without blanks, tabs, line feeds, vertical tabs, form feeds and carriage returns at both ends,
A-Z lower-cased. Keys of under `least` code points are never dropped.

Edge cases: a null text is an empty one, which is one empty line; rows that share an id are one document and never cost
each other lines; rows without an id count as one document after all others; a line that a document repeats is kept or
dropped in all its places; no rows give none; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import Scratch, batch_slices, id_text

LEAST = 10
SLICE_BYTES = 4_000_000

_LINES = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("n_lines", pa.int32()), ("at", pa.list_(pa.int32()))])
_DROPPED = "doc_id long, tag long, n_lines int, at array<int>"


def key_of(line: bytes) -> bytes:
    """bytes.strip and bytes.lower know ASCII only, which is the definition."""
    return line.strip().lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def _rows(found: list[tuple[bytes, int | None, int, int, list[int]]]) -> pa.RecordBatch:
    """found: (hash or nothing, doc_id, tag, n_lines, places)."""
    settled = np.array([not x[0] for x in found], bool)
    halves = np.frombuffer(b"".join(x[0] or bytes(16) for x in found), ">i8").reshape(-1, 2).astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(halves[:, 0], mask=settled), pa.array(halves[:, 1], mask=settled), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.int32()), pa.array([x[4] for x in found], pa.list_(pa.int32()))],
        schema=_LINES,
    )


def _first_in_slice(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches, 2, SLICE_BYTES):
            ids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2).cast(pa.binary())
            holder: dict[bytes, int | None] = {}
            found = []
            for k in sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0)):
                lines = (texts[k].as_py() or b"").split(b"\n")
                places: dict[bytes, list[int]] = {}
                for at, line in enumerate(lines):
                    key = key_of(line)
                    if long_enough(key, least):
                        places.setdefault(xxhash.xxh3_128_digest(key), []).append(at)
                gone = []
                for name, at in places.items():
                    if holder.setdefault(name, ids[k]) == ids[k]:
                        found.append((name, ids[k], tags[k], len(lines), at))
                    else:
                        gone += at
                if gone:
                    found.append((b"", ids[k], tags[k], len(lines), gone))
                if len(found) > 50_000:
                    yield _rows(found)
                    found = []
            if found:
                yield _rows(found)

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash and document, those whose document is not the first with their hash."""
    before: tuple = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        high, low = (batch.column(k).to_numpy() for k in (0, 1))
        none = batch.column(2).is_null().to_numpy(zero_copy_only=False)
        doc = batch.column(2).fill_null(0).to_numpy()
        new = np.ones(len(doc), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        if before and (high[0], low[0]) == before[:2]:
            new[0] = False
        start = np.maximum.accumulate(np.where(new, np.arange(len(doc)), -1))
        open_ = start < 0  # goes on from the batch before
        first, first_none = doc[np.maximum(start, 0)], none[np.maximum(start, 0)]
        if open_.any():
            first, first_none = np.where(open_, before[2], first), np.where(open_, before[3], first_none)
        before = (high[-1], low[-1], first[-1], first_none[-1])
        yield batch.filter(pa.array((doc != first) | (none != first_none))).select(["doc_id", "tag", "n_lines", "at"])


@F.pandas_udf(BinaryType())
def keep_bits(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    """Compressed bits, the first line first: 1 keeps a line."""

    def bits(n: int, at: np.ndarray) -> bytes:
        keep = np.ones(n, np.uint8)
        keep[at] = 0
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([bits(n, np.asarray(at, int)) for n, at in zip(n_lines, dropped, strict=True)], dtype=object)


def line_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, tag, n_lines, n_dropped, keep) of each document that loses lines; tag is a 64-bit hash of its text, which
    tells rows of one id apart. Rows alike in id and text have one bitmap."""
    scratch = Scratch()
    rows = id_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("tag"), "text")
    lines = scratch(rows.mapInArrow(_first_in_slice(least), "high long, low long, doc_id long, tag long, n_lines int, at array<int>"), "lines")
    dealt = lines.filter("high is not null").repartitionByRange("high").sortWithinPartitions("high", "low", F.col("doc_id").asc_nulls_last())
    gone = dealt.mapInArrow(_later, _DROPPED).unionByName(lines.filter("high is null").select("doc_id", "tag", "n_lines", "at"))
    each = gone.select("doc_id", "tag", "n_lines", F.explode("at").alias("at"))
    per_doc = each.groupBy("doc_id", "tag", "n_lines").agg(F.collect_set("at").alias("dropped"))
    out = per_doc.select("doc_id", "tag", "n_lines", F.size("dropped").alias("n_dropped"), keep_bits("n_lines", "dropped").alias("keep"))
    return scratch.keep(out, "bitmaps")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batch_slices(batches, 1):
        counts, dropped, kept = [], [], []
        for text, keep in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = (text or b"").split(b"\n")
            counts.append(len(lines))
            if keep is not None:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
                lines = [x for x, k in zip(lines, bits.tolist(), strict=True) if k]
            dropped.append(counts[-1] - len(lines))
            kept.append(b"\n".join(lines))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])


def drop_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of every row, text being the lines that stay."""
    bitmaps = line_bitmaps(docs, id_col=id_col, text_col=text_col, least=least).select(F.col("doc_id").alias("of"), F.col("tag").alias("named"), "keep")
    rows = id_text(docs, id_col, text_col).withColumn("tag", F.xxhash64("text"))
    joined = rows.join(bitmaps, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tag") == F.col("named")), "left")
    return joined.select("doc_id", "text", "keep").mapInArrow(_apply, "doc_id long, n_lines long, n_dropped long, text string")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """What is left of each document, as a digest."""
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
