"""Each registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from plumbline.plans import payloads as _payloads  # noqa: F401
from plumbline.plans import queries as _queries  # noqa: F401
from plumbline.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = df.collect()
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    columns = sorted(rel.columns)
    expected = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    key = lambda rows: sorted([tuple(plain(r[c]) for c in columns) for r in rows], key=repr)
    assert key(got) == key(expected)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
