"""Queries over whole tables, above the smallest scale, where narrower ones say nothing."""

import duckdb

from tidemark.plans import catalog

D = "/root/testdata/sf0.01"


def both(spark, name, tables):
    c = duckdb.connect()
    for t in tables:
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, D)
    want = c.sql(f"SELECT {', '.join(df.columns)} FROM ({catalog.SQL[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return got


def test_alias_bridge_finds_entities(spark):
    rows = both(spark, "alias_bridge", ["lineitem", "orders"])
    assert sum(r[2] is not None for r in rows) > len(rows) // 2


def test_row_sets_are_whole(spark):
    n = {t: spark.read.parquet(f"{D}/{t}.parquet").count() for t in ("orders", "lineitem")}
    lines = ["lineitem"]
    size = catalog.QUERIES["cluster_coherence"](spark, D).columns.index("size")
    assert sum(r[size] for r in both(spark, "cluster_coherence", lines)) == n["lineitem"]
    keys = spark.read.parquet(f"{D}/lineitem.parquet").selectExpr("l_orderkey * 10 + l_linenumber").distinct().count()
    assert len(both(spark, "parser_vote", lines)) == keys
    films = both(spark, "film_pairing", ["orders", "part"])
    assert {r[2] for r in films} == {1, 2, 3}


def test_split_numberings_have_fallbacks_and_shifts(spark):
    assert both(spark, "absolute_fallback", ["orders", "part"])
    assert any(r[2] for r in both(spark, "numbering_shift", ["orders", "part"]))
