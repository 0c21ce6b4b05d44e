from pyspark.sql import functions as F

from tidemark.streaming import windows


def test_bucket_counts_close_with_the_watermark(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = windows.bucket_counts(stream, ["event_type"]).writeStream.format("memory").queryName("buckets").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    n = spark.sql("select sum(n) n from buckets").first()["n"]
    assert 0 < n <= src.count()
    assert windows.islands(src, ["event_type"]).agg(F.sum("n")).first()[0] == src.count()
