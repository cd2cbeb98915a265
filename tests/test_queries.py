"""Every query with SQL gives the same rows as DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from quarrymill.functions.text import SECRET_PATTERNS
from quarrymill.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(r[k] for k in order) for r in data], key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_same_rows(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    got = db.execute(plans.ORACLE[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, got.fetchall())


def test_secret_patterns_compile():
    assert len(SECRET_PATTERNS) == 5
