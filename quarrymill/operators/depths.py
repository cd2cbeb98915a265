"""Depth of brackets at each line of texts of any length: lines as functions of the state they start in, composed over blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines in a block; a text's blocks are summed up in one sorted pass.
BLOCK = 4096

_QUOTED = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_HIDDEN = rf"{_QUOTED}|(?:#|//).*"
_TO_QUOTE = r'(?s)^[^"\\]*+(?:\\.[^"\\]*+)*+"'


def lines_of(texts: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, line, code): the lines of texts, from 1; a null text has none."""
    return texts.select(key, F.posexplode(F.split(text, "\n", -1)).alias("at", "code")).select(key, (F.col("at") + 1).cast("long").alias("line"), "code")


def _plain(code: Column) -> tuple[Column, Column]:
    """What a line that starts outside a string changes in depth, and whether it ends inside one."""
    seen = F.regexp_replace(code, _HIDDEN, "")  # a quote that is left begins a string that the line doesn't end
    outside = F.substring_index(seen, '"', 1)
    count = lambda signs: F.length(outside) - F.length(F.translate(outside, signs, ""))
    return (count("{[(") - count("}])")).cast("long"), F.contains(seen, F.lit('"')).cast("int")


def transitions(lines: DataFrame, code: str = "code") -> DataFrame:
    """The lines' functions in place of their text: for entry outside (0) and inside a string (1), the change in depth (d0, d1)
    and the state at the end (s0, s1). Strings run on over lines, a backslash in them hides a character, comments (`#`, `//`)
    end with the line."""
    c = F.coalesce(F.col(code), F.lit(""))
    after = F.regexp_replace(c, _TO_QUOTE, "")
    closes = F.regexp_like(c, F.lit(_TO_QUOTE))
    (d0, s0), (d_rest, s_rest) = _plain(c), _plain(after)
    f = F.struct(d0.alias("d0"), s0.alias("s0"), F.when(closes, d_rest).otherwise(0).cast("long").alias("d1"), F.when(closes, s_rest).otherwise(1).alias("s1"))
    return lines.select(*[x for x in lines.columns if x != code], f.alias("f")).select("*", "f.*").drop("f")


def _run(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """For entry 0 and 1: the state (b0, b1) and depth (e0, e1) before each row, and the change (g0, g1) and the state (t0, t1)
    after it, along the order of a group. The state is the last row's that forgets its entry, turned by the rows since that
    swap the states; the depth adds up what each row changes in the state it is met in."""
    past = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    swaps = (F.col("s0") > F.col("s1")).cast("int")
    rows = rows.withColumn("turned", F.sum(swaps).over(upto))
    forgets = F.when(F.col("s0") == F.col("s1"), (F.col("s0") + F.col("turned")) % 2)
    rows = rows.withColumn("fixed", F.last(forgets, ignorenulls=True).over(past)).withColumn("parity", F.col("turned") - swaps)
    for e in (0, 1):
        b = (F.coalesce("fixed", F.lit(e)) + F.col("parity")) % 2
        rows = rows.withColumn(f"b{e}", b.cast("int"))
        rows = rows.withColumn(f"g{e}", F.when(F.col(f"b{e}") == 0, F.col("d0")).otherwise(F.col("d1"))).withColumn(f"t{e}", F.when(F.col(f"b{e}") == 0, F.col("s0")).otherwise(F.col("s1")))
    for e in (0, 1):
        rows = rows.withColumn(f"e{e}", F.coalesce(F.sum(f"g{e}").over(past), F.lit(0)))
    return rows.drop("turned", "fixed", "parity")


def _summed(lines: DataFrame, key: str, block: int) -> tuple[DataFrame, DataFrame]:
    """The lines with their states and depths inside their blocks, and each block as one function."""
    rows = transitions(lines.select(key, "line", "code")).withColumn("block", F.floor(F.col("line") / block))
    inner = _run(rows, [key, "block"], "line")
    return inner, inner.groupBy(key, "block").agg(F.sum("g0").alias("d0"), F.sum("g1").alias("d1"), F.max_by("t0", "line").alias("s0"), F.max_by("t1", "line").alias("s1"))


def line_depths(lines: DataFrame, key: str = "file", block: int = BLOCK) -> DataFrame:
    """(key, line, depth): the depth of `{ [ (` at the start of each line of (key, line, code), strings and comments left out.

    Texts are spread by blocks of lines: each block is summed up as a function of the state it starts in, the functions of a
    text - one row a block - are composed in order, and each block's lines are then read from the state it really starts in.
    No task holds more than a block's lines or a text's blocks, whatever the text's length; everything is built-in functions.

    Edge cases: a null line is an empty one; line numbers may have gaps, their order counts, and must not repeat in a text;
    depth goes below zero where more is closed than was opened; a null key is a text of its own; no rows give none.
    """
    inner, blocks = _summed(lines, key, block)
    starts = _run(blocks, [key], "block").select(F.col(key).alias("__key"), F.col("block").alias("__block"), F.col("b0").alias("state"), F.col("e0").alias("base"))
    joined = inner.join(starts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("block") == F.col("__block")))
    return joined.select(key, "line", (F.col("base") + F.when(F.col("state") == 0, F.col("e0")).otherwise(F.col("e1"))).cast("long").alias("depth"))


def balances(lines: DataFrame, key: str = "file", block: int = BLOCK) -> DataFrame:
    """(key, depth, open_string): what is left open at the end of each text; a text's blocks suffice, its lines are read once."""
    _, blocks = _summed(lines, key, block)
    ends = _run(blocks, [key], "block")
    return ends.groupBy(key).agg(F.sum("g0").cast("long").alias("depth"), (F.max_by("t0", "block") == 1).alias("open_string"))
