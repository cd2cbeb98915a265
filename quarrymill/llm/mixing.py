"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share by weight, at most a number of times its size; excess is shared again until none is
above. Each document of a source is due target / size copies. The whole part is certain; the fractional parts are
settled in pairs: words move at random from one document's fraction to another's until one of the two is whole, which
keeps each document's expectation and the pair's words exactly. Blocks of a source, dealt by a hash, are settled side by
side, largest documents first, so what each block leaves over is one small document; those residuals meet in a
reduction tree. A hot source is just more blocks.

Edge cases: a null source is a source of its own, last in order; null or empty texts have size 0 and are never taken;
repeated rows are settled each on its own, and rows alike in id, source and text are interchangeable; without rows or words every target is 0; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialise, spare

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_ROWS = 4096
FAN_IN = 64
SEED = 20240229

#: Fixed value: a word is a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank, from 0, by source in code point order, null last: sorted by range, numbered in each partition, shifted by the partitions before."""
    parts = materialise(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    n = sorted(parts.groupBy("part").count().collect())  # one row per partition
    before, shift = 0, {}
    for p, count in n:
        shift[p] = before
        before += count
    shifts = parts.sparkSession.createDataFrame(list(shift.items()) or [(0, 0)], "part int, shift long")
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return parts.withColumn("own", own).join(shifts, "part").select("source", "source_size", "n_docs", (F.col("own") - 1 + F.col("shift")).alias("rank"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) of every source."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    table = materialise(ranked(totals).withColumn("weight", weight).drop("rank"), "targets")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        cap = F.col("source_size") * most
        full = (cap <= F.col("weight") * level) if capped >= 0 else F.lit(False)
        n, held, open_weight = table.agg(F.count(F.when(full, 1)), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not open_weight:
            break
        level, capped = (total - (held or 0)) / open_weight, n
    return table.withColumn("target", F.least(F.col("source_size") * float(most), F.col("weight") * level)).drop("weight")


def settle(size: np.ndarray, due: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Fractions, in the given order, made 0 or 1 but for one at most, whose place is returned (-1: none is left)."""
    p = due.tolist()
    s = size.tolist()
    draw = rng.random(len(p)).tolist()
    u = -1
    for v in range(len(p)):
        if p[v] <= 1e-12 or p[v] >= 1 - 1e-12:
            p[v] = round(p[v])
            continue
        if u < 0:
            u = v
            continue
        up = min((1 - p[u]) * s[u], p[v] * s[v])
        down = min(p[u] * s[u], (1 - p[v]) * s[v])
        move = up if draw[v] * (up + down) < down else -down
        p[u] += move / s[u]
        p[v] -= move / s[v]
        left = -1
        for k in (u, v):
            if p[k] <= 1e-9:
                p[k] = 0.0
            elif p[k] >= 1 - 1e-9:
                p[k] = 1.0
            else:
                left = k
        u = left
    return np.array(p, float), u


_ROW = "doc_id long, tag long, nth long, source string, size long, source_size long, target double, block long, sure long, due double, left boolean"
_ALIKE = 1 << 16


def _numbered(sized: DataFrame) -> DataFrame:
    """Each row with nth, its number among rows that are alike, which are counted rather than brought together."""
    counted = sized.groupBy("doc_id", "tag", "source", "size").agg(F.count("*").alias("alike"))
    runs = counted.withColumn("run", F.explode(F.expr(f"sequence(0L, (alike - 1) div {_ALIKE})")))  # many alike become rows in two steps
    rows = runs.withColumn("nth", F.explode(F.expr(f"sequence(run * {_ALIKE}, least(alike, (run + 1) * {_ALIKE}) - 1)")))
    return rows.drop("alike", "run")


def copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, cut_last: bool = False) -> DataFrame:
    """(doc_id, tag, source, size, source_size, target, copies, part) of each row; tag is a 64-bit hash of its text.

    The one document of each source that the tree's root leaves over is taken or not at random by its due or, with
    cut_last, cut: part is how many of its words are taken besides its copies, so that the source meets its target.
    """
    sized = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("tag"), docs[source_col].cast("string").alias("source"), word_count(docs[text_col]).alias("size"))
    scratch = Scratch()
    sized = scratch(_numbered(sized), "sizes")
    targets = source_targets(sized, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = F.greatest(F.ceil(F.col("n_docs") / BLOCK_ROWS), F.lit(1))
    t = targets.withColumnRenamed("source", "of")
    rows = (
        sized.join(t, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("sure", F.when(F.col("size") > 0, F.floor(ratio + 1e-12)).otherwise(0).cast("long"))
        .withColumn("due", F.when(F.col("size") > 0, F.greatest(ratio - F.col("sure"), F.lit(0.0))).otherwise(0.0))
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "tag", "nth", F.lit(seed)), blocks).cast("long"))
        .withColumn("left", F.lit(True))
        .select(*[x.split()[0] for x in _ROW.split(", ")])
    )

    def pair(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((group["nth"], group["tag"], group["doc_id"].fillna(-1), -group["size"]))
        group = group.iloc[order].reset_index(drop=True)
        name = 0 if key[0] is None or key[0] != key[0] else int.from_bytes(str(key[0]).encode("utf-8", "surrogatepass"), "big") + 1
        due, at = settle(group["size"].to_numpy(), group["due"].to_numpy(), np.random.default_rng([seed, int(key[1]), name]))
        group["due"] = due
        group["left"] = np.arange(len(group)) == at
        group["block"] //= FAN_IN
        return group

    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(largest / BLOCK_ROWS, 1), FAN_IN) - 1e-9) + 1)
    out = rows.filter("due <= 0").withColumn("left", F.lit(False))  # whole already: without words, or due whole copies
    rows = rows.filter("due > 0")
    for level in range(levels):
        settled = scratch(rows.groupBy("source", "block").applyInPandas(pair, _ROW), f"level{level}")
        out = out.unionByName(settled.filter("not left"))
        rows = settled.filter("left")
    draw = F.pmod(F.xxhash64("doc_id", "tag", "source", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    last = rows.withColumn("part", F.round(F.col("due") * F.col("size")).cast("long"))
    last = last.withColumn("due", F.when((draw < F.col("due")) & ~F.lit(cut_last), 1.0).otherwise(0.0)).withColumn("part", F.when(F.lit(cut_last), F.col("part")).otherwise(F.lit(0)))
    out = out.withColumn("part", F.lit(0).cast("long")).unionByName(last)
    return scratch.keep(out.select("doc_id", "tag", "source", "size", "source_size", "target", (F.col("sure") + F.round("due").cast("long")).alias("copies"), "part"), "copies")


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """One row per document: its words, its source's words and target, and the words the mix takes of it."""
    out = copies(docs, cut_last=True, **options)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies") + F.col("part")).alias("taken"))


def repeat_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it. The text joins the copies in one exchange; rows
    alike in id, text and source share their copies evenly. A source's last document is taken or not, never cut."""
    tag, ident, source, text, n_copies, alike, n, k = spare(docs, "tag", "id", "source", "text", "copies", "alike", "n", "k")
    counted = copies(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    counted = counted.groupBy(F.col("doc_id").alias(ident), F.col("source").alias(source), F.col("tag").alias(text)).agg(F.sum("copies").alias(n_copies), F.count("*").alias(alike)).filter(F.col(n_copies) > 0)
    rows = docs.withColumn(tag, F.xxhash64(docs[text_col]))
    match = rows[id_col].cast("long").eqNullSafe(counted[ident]) & rows[source_col].cast("string").eqNullSafe(counted[source]) & (rows[tag] == counted[text])
    joined = rows.join(counted, match)
    single = joined.filter(F.col(alike) == 1).withColumn(n, F.col(n_copies))
    order = Window.partitionBy(ident, source, text).orderBy(F.lit(0))
    several = joined.filter(F.col(alike) > 1).withColumn(n, F.expr(f"`{n_copies}` div `{alike}`") + (F.row_number().over(order) <= F.col(n_copies) % F.col(alike)).cast("long"))
    out = single.unionByName(several)
    return out.withColumn(k, F.explode(F.array_repeat(F.lit(0), F.col(n).cast("int")))).select(*[out[c] for c in docs.columns])
