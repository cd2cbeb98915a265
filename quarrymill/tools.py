"""The code index as plain functions that answer with text, for agents."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cli
from .operators import index

#: How many rows an answer shows.
SYMBOLS, NEIGHBOURS = 30, 20


def _lines(df: DataFrame, line: object, most: int | None, none: str) -> str:
    """The first `most` rows as lines; without it all, where a file bounds them."""
    lines = df.select(line.alias("line"))
    rows = (lines if most is None else lines.limit(most + 1)).collect()
    shown = [r["line"] for r in rows[:most]] + ["..."] * (most is not None and len(rows) > most)
    return "\n".join(shown) if rows else none


def tools(files: DataFrame, facts: DataFrame | None = None) -> dict[str, Callable[..., str]]:
    """find, outline, related, search, catalog and plan over a table of files, which is parsed once; facts: those of a kept index."""
    facts = index.parse(files).persist() if facts is None else facts
    answer = partial(cli.answer, facts=facts)
    at = F.concat_ws(":", "file", "line_start")

    def find(query: str, kind: str = "") -> str:
        """Symbols by a part of their name or signature."""
        got = answer(files, "find", [query], kind=kind or None).orderBy("file", "line_start")
        return _lines(got, F.concat_ws(" ", "kind", "name", at), SYMBOLS, f"no symbol holds {query!r}")

    def outline(path: str) -> str:
        """The symbols of a file."""
        got = answer(files, "outline", [path]).orderBy("line_start", F.desc("line_end"))
        return _lines(got, F.concat(F.when(F.col("parent").isNull(), "").otherwise("  "), F.concat_ws(" ", "kind", "name", F.concat_ws("-", "line_start", "line_end"))), None, f"nothing in {path!r}")

    def related(path: str) -> str:
        """What a file imports and what imports its directory."""
        return _lines(answer(files, "related", [path]).orderBy("how", "file", "line", "name"), F.concat_ws(" ", "how", F.coalesce("file", F.concat_ws(" ", "edge_type", "module"))), NEIGHBOURS, f"nothing is related to {path!r}")

    def search(query: str) -> str:
        """Hits of the hybrid search, then what they depend on."""
        return _lines(answer(files, "search", [query]), F.concat_ws(" ", F.concat(F.lit("["), "reason", F.lit("]")), at, "symbol"), SYMBOLS, f"no match for {query!r}")

    def catalog(intent: str) -> str:
        """Reusable modules for an intent, best first."""
        return _lines(answer(files, "catalog", [intent]), F.concat_ws(" ", F.round("score", 3).cast("string"), "id"), NEIGHBOURS, "no reusable module")

    def plan(intent: str) -> str:
        """Whether to reuse a module or to write one."""
        return _lines(answer(files, "plan", [intent]), F.concat(F.col("decision"), F.lit(": "), F.array_join("candidates", ", ")), 1, "no plan")

    return {"find": find, "outline": outline, "related": related, "search": search, "catalog": catalog, "plan": plan}
