"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text are worked on in slices of about this many characters, whatever Arrow hands over at once.
SLICE_CHARS = 2_000_000
BATCH_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns a text operator needs; other columns, whatever their names, never reach it."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local one serves a local
    master, as in tests; on a cluster it has to be set, as executors would write to their own disks."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or "file:///tmp/checkpoints/quarrymill").rstrip("/")


def _path(spark: SparkSession, name: str) -> tuple:
    there = spark._jvm.org.apache.hadoop.fs.Path(name)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


class Scratch:
    """Tables written to the shared folder on the way to a result, and deleted as soon as that is written itself."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        """Write df and read it back: lineage is cut, and a lost executor costs no rerun of what came before."""
        spark = df.sparkSession
        name = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(name)
        there, system = _path(spark, name)
        system.deleteOnExit(there)  # results may read it as long as the driver lives
        self.paths.append(name)
        return spark.read.schema(df.schema).parquet(name)

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Write df, delete what was written before."""
        before, self.paths = self.paths, []
        out = self(df, label)
        for name in before:
            there, system = _path(df.sparkSession, name)
            system.delete(there, True)
        return out


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back; it stays there as long as the driver lives."""
    return Scratch()(df, label)


def tidy() -> None:
    """Give freed memory back at a task's end: Python workers live on and serve later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], chars: int = SLICE_CHARS, rows: int = 4096) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of a bounded number of characters and rows; null texts are empty."""
    ids: list = []
    texts: list[str] = []
    n = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or "")
            n += len(t or "")
            if n >= chars or len(ids) >= rows:
                yield ids, texts
                ids, texts, n = [], [], 0
    if ids:
        yield ids, texts
    ids, texts = [], []
    tidy()


def batch_slices(batches: Iterator[pa.RecordBatch], column: int, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a bounded number of bytes in one column, a single longer text alone."""
    for batch in batches:
        total = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, end - at)
            at = end
    tidy()


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for columns to add, which none of df's has: longer rows of underscores, then each name."""
    most = max([len(c) - len(c.lstrip("_")) for c in df.columns], default=0)
    return ["_" * (most + 1) + n for n in names]


def held_out_remainder(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(id_col).cast("string")) % 5
