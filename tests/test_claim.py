from pyspark.sql import functions as F

from tidemark.operators import pairing


def test_paths_meet_roots_by_their_folders(spark):
    paths = spark.createDataFrame([("a",), ("/a",), ("/x/y/z",), ("/x/y/z",), ("/x",), ("x/q",), ("",), ("/x/yy/z",)], "path string")
    roots = spark.createDataFrame([("a", 1), ("", 2), ("/x", 3), ("/x/y", 4), ("x", 5)], "root string, side int")
    got = sorted(map(tuple, pairing.claim(paths, roots).collect()))
    assert got == [("", 2), ("/a", 2), ("/x", 2), ("/x/y/z", 4), ("/x/yy/z", 3), ("a", 1), ("x/q", 5)]


def test_few_folders_of_many_files_are_few_rows(spark):
    # rows that meet roots are those of folders, whatever the number of files
    paths = spark.range(5000).select(F.concat(F.lit("/lib/f"), (F.col("id") % 3).cast("string"), F.lit("/v"), F.col("id").cast("string")).alias("path"))
    claimed = pairing.claim(paths, spark.createDataFrame([("/lib", 1), ("/lib/f1", 2)], "root string, side int"))
    plan = claimed._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Generate explode", 1)[1]
    assert "Aggregate [folder" in below, plan
    assert {r["side"]: r["count"] for r in claimed.groupBy("side").count().collect()} == {1: 3333, 2: 1667}
