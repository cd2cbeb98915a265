"""Exact inventory: predicates over the values of components."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hcl
from ..functions.text import norm_value, pick_name


def parse_where(where: list[str]) -> list[tuple[str, str, str | None]]:
    """(key, operator, value) of `k=v`, `k!=v` or `k` (is there)."""
    out = []
    for w in where:
        if "!=" in w:
            k, _, v = w.partition("!=")
            out.append((k.strip(), "!=", v.strip()))
        elif "=" in w:
            k, _, v = w.partition("=")
            out.append((k.strip(), "=", v.strip()))
        else:
            out.append((w.strip(), "exists", None))
    return out


def predicate(values: Column, where: list[str]) -> Column:
    """All predicates over a map of values. Both = and != are false where the key is missing."""
    out = F.lit(True)
    for k, op, v in parse_where(where):
        have = norm_value(values[k])
        test = values[k].isNotNull() if op == "exists" else (have == norm_value(F.lit(v))) if op == "=" else (have != norm_value(F.lit(v)))
        out = out & F.coalesce(test, F.lit(False))
    return out


def unresolved(rows: DataFrame, values: Column, where: list[str]) -> DataFrame:
    """(key): predicate keys that no row, matching or not, has."""
    keys = rows.sparkSession.createDataFrame([(k,) for k in sorted({k for k, _, _ in parse_where(where)})], "key string")  # the request's own
    return keys.join(rows.select(F.explode(F.map_keys(values)).alias("key")).distinct(), "key", "left_anti")


def with_values(components: DataFrame) -> DataFrame:
    """components (…, text) with a map of all their values by dotted and indexed path, and their names."""
    fields = components.schema.fields

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["values"] = [hcl.read_values(t or "") for t in batch["text"]]
            yield batch

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", values map<string,string>"
    return components.mapInPandas(run, schema).withColumn("name", pick_name(F.col("values")))


def find(components: DataFrame, component: str, *, project: str | None = None, provider: str | None = None, where: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, unresolved keys) of a component type."""
    rows = components.filter(F.col("component") == component)
    for c, v in (("project", project), ("provider", provider)):
        rows = rows if v is None else rows.filter(F.col(c) == v)
    rows = with_values(rows)
    where = where or []
    found = rows.filter(predicate(F.col("values"), where)).orderBy("project", "env", "dir")
    columns = [F.coalesce(F.col("values")[k], F.lit("—")).alias(k) for k, _, _ in parse_where(where)]
    return found.select("project", "env", "dir", "name", "values", *columns), unresolved(rows, F.col("values"), where)


# Component types that plain requests may name.
KNOWN_TYPES = ("ec2", "rds", "s3", "eks", "network", "vpc", "lambda", "alb", "sqs", "security_group")


def parse_request(text: Column) -> Column:
    """(type, project, name) of a plain request such as `list ec2 in billing named web`."""
    low = F.lower(text)
    kind = F.regexp_extract(low, r"\b(" + "|".join(KNOWN_TYPES) + r")s?\b", 1)
    return F.struct(F.nullif(kind, F.lit("")).alias("type"), F.nullif(F.regexp_extract(low, r"\bin\s+([a-z0-9_-]+)", 1), F.lit("")).alias("project"), F.nullif(F.regexp_extract(low, r"\bnamed\s+([a-z0-9_-]+)", 1), F.lit("")).alias("name"))
