"""What a run recorded, and whether the next one has anything to do.

Records are rows in Parquet: output, video and source digests, language, run
shape, and what was considered with which outcome.  Deletion is an anti-join,
a later record of an output replaces the earlier one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = 2
CONSIDERED = "array<struct<digest:string,outcome:string,survived:boolean>>"
RECORD = f"output_digest string, video_digest string, source_digest string, lang string, shape map<string,string>, considered {CONSIDERED}, written_at timestamp, version int"


def content_key(content: Column, sample: int = 65536) -> Column:
    """SHA-256 of size and both ends of a file."""
    size = F.octet_length(content).cast("long")
    head, tail = F.substring(content, 1, sample), F.substr(content, F.greatest(size - sample + 1, F.lit(1)).cast("int"), F.lit(sample))
    return F.sha2(F.concat(F.encode(size.cast("string"), "utf-8"), head, tail), 256)


def full_key(content: Column) -> Column:
    return F.sha2(content, 256)


def append(records: DataFrame, path: str) -> None:
    records.withColumn("version", F.lit(VERSION)).write.mode("append").parquet(path)


def current(spark: SparkSession, path: str, version: int = VERSION) -> DataFrame:
    """The latest record of each output; other versions are misses."""
    r = spark.read.schema(RECORD).parquet(path).where(F.col("version") == version)
    w = Window.partitionBy("output_digest").orderBy(F.col("written_at").desc(), "video_digest", "lang")
    return r.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def forget(records: DataFrame, outputs: DataFrame) -> DataFrame:
    return records.join(outputs.select("output_digest"), "output_digest", "left_anti")


def recordable(results: DataFrame) -> DataFrame:
    """Only what was written, is confident and was not forced."""
    return results.where("written and outcome = 'CONFIDENT' and not forced")


def work_left(records: DataFrame, present: DataFrame, shape: dict[str, str]) -> DataFrame:
    """``video, settled, added, gone`` for videos of ``present`` (video, video_digest, digest per file).

    Expected per video and language: what survived, shared by the records of a
    language (the most any of them has), and what each record wrote.  Settled
    means that just those files are there.
    """
    want = F.create_map(*[F.lit(x) for kv in sorted(shape.items()) for x in kv]) if shape else F.create_map().cast("map<string,string>")
    entries = lambda m: F.array_sort(F.map_entries(m))
    ours = records.where(entries(F.col("shape")) == entries(want))
    here = present.select("video", "video_digest", "digest")
    used = ours.join(here.select(F.col("digest").alias("output_digest"), "video_digest", "video").distinct(), ["output_digest", "video_digest"])
    kept = used.select("video", "lang", "output_digest", F.explode("considered").alias("c")).where("c.survived").groupBy("video", "lang", "output_digest", F.col("c.digest").alias("digest")).agg(F.count("*").alias("n"))
    shared = kept.groupBy("video", "lang", "digest").agg(F.max("n").alias("n")).select("video", "digest", "n")
    wrote = used.where(~F.exists("considered", lambda c: c["survived"] & (c["digest"] == F.col("output_digest")))).select("video", F.col("output_digest").alias("digest"), F.lit(1).cast("long").alias("n"))
    expected = shared.union(wrote).groupBy("video", "digest").agg(F.sum("n").alias("e"))
    there = here.groupBy("video", "digest").agg(F.count("*").alias("p"))
    both = there.join(expected, ["video", "digest"], "full")
    over = lambda a, b: F.sum(F.greatest(F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)), F.lit(0)))
    g = both.groupBy("video").agg(over("p", "e").alias("added"), over("e", "p").alias("gone"))
    known = used.select("video").distinct().withColumn("known", F.lit(True))
    out = g.join(known, "video", "left")
    return out.select("video", (F.coalesce("known", F.lit(False)) & (F.col("added") == 0) & (F.col("gone") == 0)).alias("settled"), "added", "gone")


def undecided(pairs: DataFrame, decisions: DataFrame, key: str = "seq") -> DataFrame:
    """Accepted pairs without a decision; nothing may be written while there are any."""
    return pairs.join(decisions.select(key).distinct(), key, "left_anti")


def hit_statistics(wanted: DataFrame, records: DataFrame, key: str = "output_digest", version: int = VERSION) -> DataFrame:
    """One row: hits, stale (another version), misses, hit_rate of looking up ``wanted`` in all ``records``."""
    r = records.groupBy(key).agg(F.bool_or(F.col("version") == version).alias("fresh"))
    w = wanted.join(r, key, "left")
    hit, stale = F.coalesce("fresh", F.lit(False)), F.coalesce(~F.col("fresh"), F.lit(False))
    n = w.agg(F.count_if(hit).alias("hits"), F.count_if(stale).alias("stale"), F.count_if(F.col("fresh").isNull()).alias("misses"), F.count("*").alias("all"))
    return n.select("hits", "stale", "misses", F.when(F.col("all") > 0, F.col("hits") / F.col("all")).otherwise(0.0).alias("hit_rate"))
