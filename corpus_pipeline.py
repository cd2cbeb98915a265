"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Run as
a job, each stage's rows are written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm import bagminhash, mixing, packing, pii, toxicity
from quarrymill.llm.common import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. Null and empty texts are scored as texts without words; null ids and repeated rows are
    judged by their text; columns beside those of documents are dropped; no rows give none."""
    return toxicity.drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of the smallest id, null ids last; of repeated rows, any. Null and empty texts
    are copies of each other, texts without words only of equal ones; columns beside those of documents are dropped; no rows
    give none."""
    return bagminhash.keep_one(docs.select(*COLUMNS))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, overlapping spans by one. Null texts stay null, empty ones empty; ids play no
    part, so null and repeated ones don't matter; columns beside those of documents are dropped; no rows give none."""
    return pii.redact(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it, which may be not at all. A null source is a source of its own;
    null and empty texts have no words and are never taken; rows alike in id, source and text share their copies; columns
    beside those of documents are dropped; no rows give none."""
    return mixing.repeat_rows(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each row lies in the sequences. Null and empty texts are one piece, the end id; every row is
    packed, null and repeated ids included; no rows give none."""
    return packing.pack(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the models nor the signatures; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    written = Scratch()  # holds the last stage's rows only
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written.keep(docs, f"pipeline-{name}")
    return docs
