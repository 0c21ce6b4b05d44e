import datetime
import os

import duckdb

from tidemark.plans import catalog


def test_a_bucket_ends_to_the_microsecond(spark, tmp_path):
    at = [datetime.datetime(2024, 1, 1, 0, 1, 59, 999700), datetime.datetime(2024, 1, 1, 0, 2), datetime.datetime(1969, 12, 31, 23, 59, 30)]
    spark.createDataFrame([("x", t) for t in at], "event_type string, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    want = {("x", "2024-01-01 00:00:00", 1), ("x", "2024-01-01 00:02:00", 1), ("x", "1969-12-31 23:58:00", 1)}
    assert {tuple(r) for r in catalog.QUERIES["stream_buckets"](spark, str(tmp_path)).collect()} == want
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{os.fspath(tmp_path)}/events.parquet/*.parquet'")
    assert set(c.sql(catalog.SQL["stream_buckets"]).fetchall()) == want
