"""Every catalogue query that has SQL equals it on the smallest tables."""

import duckdb
import pytest

from tidemark.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, D)
    want = duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    key = lambda rows, cols: sorted(repr([plain(v) for _, v in sorted(zip(cols, r, strict=True))]) for r in rows)
    assert key([tuple(r) for r in df.collect()], df.columns) == key(want.fetchall(), want.columns)
