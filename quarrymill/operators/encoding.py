"""Vectors of texts: each different text is encoded once, and what is encoded stays though a later batch fails."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import scratch_path

#: Texts to an encoder's vectors, one each and in their order; raises if it can't.
Encoder = Callable[[list[str]], Sequence[Sequence[float]]]

_ROWS = "hash string, vector array<float>, error string"
#: Fixed value: no wait between two attempts is longer, in seconds.
LONGEST_WAIT = 20.0


class EncodingFailed(RuntimeError):
    """Texts that no attempt could encode; the others' vectors are kept."""


def text_hash(model: str, text: Column) -> Column:
    return F.sha1(F.concat(F.lit(model + "\0").cast("binary"), F.coalesce(text, F.lit("")).cast("binary")))


def attempt(encoder: Encoder, texts: list[str], retries: int, backoff: float) -> tuple[list, str]:
    """(vectors, ""), or (nothing for each text, why) when the first try and all retries failed."""
    for n in range(retries + 1):
        try:
            vectors = [[float(x) for x in v] for v in encoder(texts)]
            if len(vectors) != len(texts):
                raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
            return vectors, ""
        except Exception as e:  # an encoder is somebody else's code, often a network call
            why = f"{type(e).__name__}: {e}"
            if n < retries:
                time.sleep(min(backoff * 2**n, LONGEST_WAIT) + random.uniform(0, backoff))
    return [None] * len(texts), why


class EncodedTexts:
    """Vectors by (model, hash of the text) in a shared folder, partitioned by model.

    A run folds equal texts by hash, leaves out those that have a vector, and deals the rest by hash into commits, each
    encoded in batches by all tasks and appended when it is complete. What is appended is not encoded again, so a run that
    died goes on with the commits that are missing; of the commit in work, at most one share is lost. A batch that fails
    after its retries leaves its texts without vectors and the others' in place; the run then raises, and the next run
    tries just these. One run at a time.

    Edge cases: a null text counts as an empty one; texts alike get the same vector; a null vector can't be told from a
    failure, and an empty one is a vector; another encoder needs another model name; no rows start nothing.
    """

    def __init__(self, spark: SparkSession, path: str, model: str) -> None:
        self.spark, self.path, self.model = spark, path, model

    def vectors(self) -> DataFrame:
        """(hash, vector)"""
        if not self._written(self.path):
            return self.spark.createDataFrame([], "hash string, vector array<float>")
        return self.spark.read.schema("hash string, vector array<float>, model string").parquet(self.path).filter(F.col("model") == self.model).drop("model")

    def missing(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """(hash, text) of each different text without a vector."""
        hashed = texts.select(text_hash(self.model, F.col(text)).alias("hash"), F.coalesce(text, F.lit("")).alias("text"))
        return hashed.dropDuplicates(["hash"]).join(self.vectors().select("hash"), "hash", "left_anti")  # folded before rows are dealt

    def encode(self, texts: DataFrame, encoder: Encoder, *, text: str = "text", batch: int = 64, commits: int = 16, retries: int = 3, backoff: float = 0.5) -> int:
        """Vectors for all texts; how many texts were encoded. Raises EncodingFailed after everything else is kept."""
        share = F.pmod(F.xxhash64("hash"), F.lit(commits)).cast("int")
        waiting = scratch_path(self.spark, "waiting")
        self.missing(texts, text).withColumn("share", share).write.partitionBy("share").parquet(waiting)  # a run's texts are read and folded once
        done, failed, why = 0, 0, ""
        for n in range(commits):
            if not self._written(f"{waiting}/share={n}"):
                continue
            part = self.spark.read.schema("hash string, text string").parquet(f"{waiting}/share={n}")
            seen = Observation()
            rows = self._encoded(part, encoder, batch, retries, backoff).observe(seen, F.count("vector").alias("done"), F.count("error").alias("failed"), F.max("error").alias("why"))
            rows.filter("vector is not null").select("hash", "vector", F.lit(self.model).alias("model")).write.mode("append").partitionBy("model").parquet(self.path)
            got = seen.get
            done, failed, why = done + got["done"], failed + got["failed"], got["why"] or why
        if failed:
            raise EncodingFailed(f"{failed} texts have no vector, {done} were encoded; {why}")
        return done

    def lookup(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """The rows with the vectors of their texts; without one, null."""
        return texts.withColumn("__hash", text_hash(self.model, F.col(text))).join(self.vectors().select(F.col("hash").alias("__hash"), "vector"), "__hash", "left").drop("__hash")

    def _written(self, path: str) -> bool:
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there)

    def _encoded(self, part: DataFrame, encoder: Encoder, batch: int, retries: int, backoff: float) -> DataFrame:
        schema = to_arrow_schema(self.spark.createDataFrame([], _ROWS).schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for at in range(0, rows.num_rows, batch):
                    some = rows.slice(at, batch)
                    vectors, why = attempt(encoder, some.column(1).to_pylist(), retries, backoff)
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(vectors, schema.field(1).type), pa.array([why or None] * some.num_rows, pa.string())], schema=schema)

        return part.mapInArrow(run, _ROWS)
