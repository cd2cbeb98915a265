"""Windows over the event stream, and refresh by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import index


def event_time(events: DataFrame) -> DataFrame:
    """Watermarks need a timestamp with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total): works on tables and, with `late`, on streams."""
    e = event_time(events)
    e = e.withWatermark("ts", late) if late else e
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    e = event_time(events)
    e = e.withWatermark("ts", late) if late else e
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "user_id", "n")


def stream_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def refresh_stream(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch of changed files to apply (see operators.index.refresh), exactly as far as the checkpoint says."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: An edge of a file that came (added) or went (retracted).
EDGE_CHANGES = "file string, change string, edge_type string, module string, name string, output string, line int, raw string, target_file string"
_KEY = ("edge_type", "module", "name", "output", "line")
_EDGE = (*_KEY, "raw", "target_file")


def _nulls_first(values: tuple) -> tuple:
    return tuple((x is not None, x if x is not None else 0) for x in values)


class _FileEdges(StatefulProcessor):
    """Keeps, for a path, the version and hash seen last and the edges it had; gives out what a newer content changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "version long, hash string")
        self.held = handle.getListState("held", ", ".join(f"{c} {'int' if c == 'line' else 'string'}" for c in _EDGE))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, found = self.seen.get() if self.seen.exists() else None, []
        newest = tuple(last) if last else None
        for part in rows:
            for version, hash_, pos, *edge in part[["version", "hash", "pos", *_EDGE]].itertuples(index=False):
                if newest is None or (version, hash_) > newest:
                    newest, found = (int(version), hash_), []
                if (version, hash_) == newest and not pd.isna(pos):
                    found.append((int(pos), *(None if pd.isna(x) else int(x) if c == "line" else x for c, x in zip(_EDGE, edge, strict=True))))
        if last and newest == tuple(last):
            return
        self.seen.update(newest)
        if last and newest[1] == last[1]:
            return
        first: dict[tuple, tuple] = {}
        for _, *edge in sorted(found, key=_nulls_first):
            first.setdefault(tuple(edge[: len(_KEY)]), tuple(edge))
        old, new = set(map(tuple, self.held.get())) if self.held.exists() else set(), set(first.values())
        if new:
            self.held.put(sorted(new, key=_nulls_first))
        elif old:
            self.held.clear()
        if changes := [(key[0], how, *e) for how, es in (("retracted", old - new), ("added", new - old)) for e in sorted(es, key=_nulls_first)]:
            yield pd.DataFrame(changes, columns=["file", "change", *_EDGE], dtype=object).astype({"line": "Int32"})

    def close(self) -> None:
        pass


def edge_changes(changes: DataFrame) -> DataFrame:
    """EDGE_CHANGES of a stream of files (file, version, text): the edges that each newer content of a path adds and retracts.

    Texts are parsed where they arrive; only their edges are dealt by path. Rows added less rows retracted are what
    `index.edges` gives of the newest files. The session has to name the RocksDB state store.

    Edge cases: a null text is a file that is gone, whose edges are retracted; a version older than the one seen changes
    nothing; of two contents with one version the greater hash counts, whichever comes first; the content that was there
    already gives no rows; other columns are ignored; a null version is older than any.
    """
    texts = changes.select("file", "text", F.coalesce(F.col("version").cast("long"), F.lit(-(1 << 63))).alias("version"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("hash"))
    edge = F.when(F.col("hash") != "", index.edge_of()).alias("e")
    rows = index.parse(texts, ("version", "hash")).select("file", "version", "hash", "fact", edge).filter("fact = 'file' or e is not null")
    return rows.select("file", "version", "hash", "e.*").groupBy("file").transformWithStateInPandas(_FileEdges(), EDGE_CHANGES, "Append", "None")
