"""A DataSource for SQLite tables: one partition per range of row ids."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_TYPES = {"INTEGER": "long", "INT": "long", "BIGINT": "long", "REAL": "double", "FLOAT": "double", "DOUBLE": "double", "BLOB": "binary"}


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        super().__init__(None)
        self.low, self.high = low, high


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteSource(DataSource):
    """Options: path, dbtable, partitions (8)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            columns = c.execute(f"PRAGMA table_info({_quoted(self.options['dbtable'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['dbtable']}")
        return ", ".join(f"`{n}` {_TYPES.get((t or '').upper().split('(')[0], 'string')}" for _, n, t, *_ in columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema.names)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]) -> None:
        self.path, self.table, self.names = options["path"], options["dbtable"], names
        self.parts = int(options.get("partitions", 8))

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = max(1, -(-(high + 1 - low) // self.parts))
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            yield from c.execute(f"SELECT {', '.join(map(_quoted, self.names))} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high))


def read_table(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("dbtable", table).option("partitions", partitions).load()
