"""Every query with SQL against DuckDB on the same tables."""

import datetime
import decimal
from collections import Counter

import duckdb
import pytest
from tallyforge.plans import board, ingest, ledger, text, views

PLANS = (ledger, views, ingest, board, text)
QUERIES, SQL = {k: q for p in PLANS for k, q in p.QUERIES.items()}, {k: q for p in PLANS for k, q in p.SQL.items()}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    d = duckdb.connect()
    for t in TABLES:
        d.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return d


def plain(x):
    return int(x) if isinstance(x, decimal.Decimal) and x == int(x) else x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else x


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    out = QUERIES[name](spark, sf_dir)
    cursor = duck.execute(SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(out.columns)
    want = Counter(tuple(map(plain, r)) for r in cursor.fetchall())
    got = Counter(tuple(map(plain, r)) for r in out.select(*(f"`{n}`" for n in names)).collect())
    assert want
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
