"""Every registered query against its SQL, over the smallest tables."""

from collections import Counter

import duckdb
import pytest

from ledgerline import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, small, name):
    df = catalog.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert got
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name])
        assert sorted(want.columns) == columns
        places = [want.columns.index(c) for c in columns]
        assert got == Counter(repr(tuple(plain(r[i]) for i in places)) for r in want.fetchall())


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
