"""Every query against DuckDB over the same tables, in the same rounding."""

import math

import duckdb
import pytest

from tessera.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = ("part", "supplier", "lineitem", "embeddings", "events")


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (int, bool)):
        return int(value)
    return round(float(value), 5) if isinstance(value, float) or type(value).__name__ == "Decimal" else value


def rows(columns, found):
    return sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found), key=repr)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, db, name):
    out = catalog.queries()[name](spark, D)
    result = db.execute(catalog.oracle_sql()[name])
    columns = [x[0] for x in result.description]
    assert sorted(columns) == sorted(out.columns)
    assert rows(out.columns, [tuple(r) for r in out.collect()]) == rows(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows(spark, name):
    assert catalog.queries()[name](spark, D).count() > 0
