"""Tables that cut a plan's lineage, in the folder that all executors share.

The folder is ``spark.checkpoint.dir``; a temporary one is taken only where none
is set and all runs in one process.  Tables go when the program ends, or earlier
with ``discard``.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder in any file system; one that isn't there is no fault."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        remove(spark, path)


def stored(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """The rows of ``df``, written once and read back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tidemark-{tag}-{uuid.uuid4().hex}"
    atexit.register(_at_exit, spark, path)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``stored`` that no later plan reads."""
    for t in tables:
        remove(t.sparkSession, t.scratch)
