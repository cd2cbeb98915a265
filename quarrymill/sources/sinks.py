"""Sinks: tables, JSON lines, embeddings, and guarded writes into a tree."""

from __future__ import annotations

import difflib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hcl


def overwrite(df: DataFrame, path: str, *, by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_jsonl(df: DataFrame, path: str, column: str = "text") -> None:
    df.select(F.col(column).alias("text")).write.mode("overwrite").json(path)


class EmbeddingTable:
    """Vectors keyed by (model, chunk_id, hash), grown by appending; only texts without a vector are encoded."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def load(self) -> DataFrame:
        return self.spark.read.schema("model string, chunk_id string, hash string, vector array<float>").parquet(self.path)

    def missing(self, chunks: DataFrame, model: str) -> DataFrame:
        """chunks: (chunk_id, text, hash)."""
        return chunks.join(self.load().filter(F.col("model") == model), ["chunk_id", "hash"], "left_anti")

    def append(self, vectors: DataFrame) -> None:
        vectors.write.mode("append").parquet(self.path)

    def clear(self) -> None:
        self.spark.createDataFrame([], "model string, chunk_id string, hash string, vector array<float>").write.mode("overwrite").parquet(self.path)


@dataclass
class Artifact:
    """A file to be written: what was there, what is to stand there, and whether its making was refused."""

    path: str
    text: str
    before: str = ""
    refused: str = ""


def unified_diff(before: str, after: str, path: str) -> str:
    return "".join(difflib.unified_diff(before.splitlines(True), after.splitlines(True), f"a/{path}", f"b/{path}"))


def write_refusal(a: Artifact, exists: bool, overwrite_: bool) -> str:
    """Why a file must not be written; empty if it may."""
    if a.refused:
        return a.refused
    if a.text == a.before:
        return "unchanged"
    if found := hcl.problems(a.text):
        return found[0]
    return "exists" if exists and not overwrite_ else ""


def write_to_tree(a: Artifact, root: str, *, overwrite_: bool = False) -> tuple[str, list[str]]:
    """(refusal, warnings). A TODO left in the text only warns; paths out of the root are refused."""
    base = Path(root).resolve()
    target = (base / a.path).resolve()
    if base not in target.parents:
        return "outside the tree", []
    if reason := write_refusal(a, target.exists(), overwrite_):
        return reason, []
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(a.text)
    return "", ["TODO left in the text"] if "TODO" in a.text else []
