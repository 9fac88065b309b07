"""Every query with SQL gives what DuckDB gives on the same tables; the others give rows."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from sievemark.plans import contract_queries, integrity_queries, source_queries  # noqa: F401
from sievemark.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows_of(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NA:
            return "null"
        return f"{float(v):.9g}" if isinstance(v, int | float) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype != bool else str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, engine, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLE_SQL:
        expected = engine.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows_of(got) == rows_of(expected)
    else:
        assert len(got) > 0
