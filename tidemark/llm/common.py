"""Shared plumbing: table access, shared scratch tables, connected components."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where none is set and all runs in one process."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone at exit
        return


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{scratch_root(spark)}/tidemark-{tag}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def written(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Cut lineage with a table in the shared folder and read it back; ``discard`` removes it."""
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that no later plan reads."""
    for t in tables:
        remove(t.sparkSession, t.scratch)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Large-star / small-star components over long ids.

    Returns ``node, component`` for every node that stands in an edge, component
    being the smallest node reachable.  Each round is written to the shared
    folder; rounds grow with the logarithm of the longest path.  Null ends and
    self loops are ignored, repeated edges count once.
    """
    spark = edges.sparkSession
    cur = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct(),
        "edges",
    )
    seen = None
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: link a node's smaller neighbours and itself to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("x"), "m")
            .union(least.select(F.col("u").alias("x"), "m"))
            .where("x <> m")
            .select(F.col("x").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        last, cur = cur, written(small, "edges")
        discard(last)
        mark = cur.agg(
            F.count("*").alias("n"),
            F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h"),
        ).first()
        if seen == mark:
            break
        seen = mark
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
