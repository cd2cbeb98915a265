"""Quality by hierarchical empirical Bayes: a document's own evidence, and what its path and host are like.

A logistic model over surface measures gives each document a log-odds of being good (fitted on the driver from a bounded
sample of labelled rows, ``max_train``, 8,000). Sums of those probabilities are evidence about a path and a host. A
host's rate is shrunk toward the global mean and a path's toward its host's, by beta-binomial strengths that the method
of moments takes from the spread between groups: sparse sites end near what stands above them. A document's posterior
odds are its own odds times how its path, itself left out, differs from the whole.

All group figures come from grouped sums with partial aggregation; only four scalars reach the driver. Edge cases: null
hosts and paths are groups of their own; null and empty texts are scored by their measures (all 0); null labels teach
nothing; with labels of one kind only, the document's odds are the labelled share's; extra columns are ignored; repeated
rows repeat; tables without rows give none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out_remainder, materialise, slices

MAX_TRAIN = 8000
_LETTER_WORD = re.compile(r"[^\W\d_]+")
_SIGN = re.compile(r"[^\w\s.,;:!?'\"()\-]")
MEASURES = ("words", "word length", "signs", "capitals", "digits", "distinct words", "distinct lines", "commonest word", "clean words", "immediate repeats")


def measures(text: str) -> list[float]:
    """Surface measures of a text, each about 0 to 1."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(MEASURES)
    lines = [x for x in text.split("\n") if x]
    count = Counter(words)
    chars = len(text)
    clean = len(_LETTER_WORD.findall(text))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        np.log1p(n) / 10,
        min(1.0, (chars - n) / n / 20),
        len(_SIGN.findall(text)) / chars * 5,
        sum(map(str.isupper, text)) / chars * 5,
        sum(map(str.isdigit, text)) / chars * 5,
        len(count) / n,
        len(set(lines)) / len(lines) if lines else 0.0,
        max(count.values()) / n,
        min(1.0, clean / n / 2),
        repeats / n,
    ]


def expanded(x: np.ndarray) -> np.ndarray:
    """The measures, their squares and products, and 1."""
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate((x, x[:, i] * x[:, j], np.ones((len(x), 1))), axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, *, steps: int = 60, penalty: float = 0.1) -> np.ndarray:
    """Weights by Newton's method."""
    if not len(y) or y.min() == y.max():
        w = np.zeros(x.shape[1])
        share = y.mean() if len(y) else 0.5
        w[-1] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return w
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _measured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, texts in slices(iter([batch])):
                x = np.array([measures(t) for t in texts], np.float64)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * len(MEASURES)), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column(2).slice(at, len(ids)), batch.column(3).slice(at, len(ids)), values], names=["doc_id", "host", "path", "x"])
                at += len(ids)

    return docs.mapInArrow(run, "doc_id long, host string, path string, x array<double>")


def _strength(groups: DataFrame, rate: F.Column, centre: F.Column) -> float:
    """The beta-binomial strength of groups (s, n) around a centre: from the weighted spread beyond what counts explain."""
    g = groups.filter("n > 1").agg(
        F.sum(F.col("n") * (rate - centre) ** 2), F.sum(centre * (1 - centre)), F.sum(F.col("n") * centre * (1 - centre)), F.sum("n"), F.count("*")
    ).first()
    spread, chance, scale, n, k = (float(v or 0) for v in g)
    if k < 2 or n <= k or not scale:
        return 100.0
    between = (spread - chance) / n
    return float(np.clip(scale / n / max(between, 1e-9) - 1, 1.0, 1e4))


def site_of(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host, path prefix) of a URL: the host in lower case without user and port, and the first folder of the path, "/" if
    there is none; both null for what has no host."""
    host = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1))
    folder = F.regexp_extract(url, r"^\s*[^/?#]+//[^/?#]*(/[^/?#]+)/", 1)
    known = F.coalesce(host, F.lit("")) != ""
    return F.when(known, host), F.when(known, F.when(folder == "", "/").otherwise(folder))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host: F.Column | None = None,
    path: F.Column | None = None,
    label_col: str = "quality",
    max_train: int = MAX_TRAIN,
    threshold: float = 0.5,
    seed: int = 5,
) -> DataFrame:
    """(doc_id, doc_score, host_rate, path_rate, score, keep) of every row; host and path default to source and lang."""
    host = docs["source"] if host is None else host
    path = docs["lang"] if path is None else path
    mine = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    x = materialise(_measured(mine), "measures")
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).filter("doc_id is not null and label is not null").filter(held_out_remainder() != 0)
    n = known.count()
    share = min(1.0, max_train / n) if n else 0.0
    sample = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).groupBy("doc_id").agg(F.min("label").alias("label"))
    # about max_train rows of two numbers, so it can be broadcast
    rows = x.join(F.broadcast(sample), "doc_id").select("x", "label").toPandas()
    w = fit_logistic(expanded(np.array(rows["x"].tolist(), float).reshape(-1, len(MEASURES))), rows["label"].to_numpy(float))

    def odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(np.clip(expanded(m) @ w, -12, 12))], names=["doc_id", "host", "path", "odds"])

    scored = materialise(x.mapInArrow(odds, "doc_id long, host string, path string, odds double").withColumn("p", 1 / (1 + F.exp(-F.col("odds")))), "odds")
    paths = materialise(scored.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    total, count = hosts.agg(F.sum("s"), F.sum("n")).first()
    mean = float(np.clip(total / count, 1e-6, 1 - 1e-6)) if count else 0.5
    rate = F.col("s") / F.col("n")
    k_host = _strength(hosts, rate, F.lit(mean))
    hosts = hosts.select(F.col("host").alias("of"), ((F.col("s") + k_host * mean) / (F.col("n") + k_host)).alias("host_rate"))
    under = materialise(paths.join(hosts, F.col("host").eqNullSafe(F.col("of"))).drop("of"), "under")
    k_path = _strength(under, rate, F.col("host_rate"))
    under = under.withColumnsRenamed({"host": "h", "path": "q"})
    joined = scored.join(under, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    rest = (F.col("s") - F.col("p") + k_path * F.col("host_rate")) / (F.col("n") - 1 + k_path)
    rest = F.least(F.greatest(rest, F.lit(1e-6)), F.lit(1 - 1e-6))
    shift = F.log(rest / (1 - rest)) - float(np.log(mean / (1 - mean)))
    score = 1 / (1 + F.exp(-(F.col("odds") + shift)))
    return joined.select("doc_id", F.col("p").alias("doc_score"), "host_rate", rest.alias("path_rate"), score.alias("score"), (score >= threshold).cast("int").alias("keep"))
