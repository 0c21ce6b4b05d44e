"""A run with its records: what is settled is not measured again, what is written is recorded.

    done = perform(items, references, files, digests, store, trash, dry_run=False)

``digests`` (path, digest) tells the bytes of cue files, ``references`` may hold a
``video_digest``; ``store`` is a table of ``operators.keyed``.  A record is a claim
that a file with these bytes exists: it is made from what was written, never from
what was planned, and of confident pairs that were not forced alone.  A dry run
records nothing.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..operators import applying, keyed, outcomes, rewrite, state
from . import run

KIND = "record"
PAYLOAD = f"video_digest string, source_digest string, lang string, shape map<string,string>, considered {state.CONSIDERED}"


class Done(NamedTuple):
    decided: DataFrame
    outcomes: DataFrame
    results: DataFrame


def read_records(spark: SparkSession, store: str, version: int = keyed.VERSION) -> DataFrame:
    """Records as ``operators.state`` takes them; those of another version and damaged ones are none."""
    rows = keyed.read(spark, store)
    if rows is None:
        return spark.createDataFrame([], f"output_digest string, {PAYLOAD}, written_at timestamp, version int")
    sound = rows.where((F.col("kind") == KIND) & (F.col("version") == version) & (F.col("check") == keyed.check()))
    return sound.select(F.col("digest").alias("output_digest"), F.from_json("payload", PAYLOAD).alias("p"), "written_at", "version").where("p is not null").select("output_digest", "p.*", "written_at", "version")


def _video_digest(references: DataFrame) -> Column:
    return F.col("video_digest") if "video_digest" in references.columns else F.sha2("video", 256)


def settled(records: DataFrame, references: DataFrame, digests: DataFrame, shape: dict[str, str]):
    """A function from candidates (video, subtitle) to the videos of which just what was left is there."""
    videos = references.select("video", _video_digest(references).alias("video_digest")).distinct()

    def of(candidates: DataFrame) -> DataFrame:
        here = candidates.select("video", F.col("subtitle").alias("path")).distinct().join(digests.select("path", "digest"), "path").join(videos, "video")
        return state.work_left(records, here, shape).where("settled").select("video")

    return of


def new_records(decided: DataFrame, done: DataFrame, rendered: DataFrame, references: DataFrame, digests: DataFrame, shape: dict[str, str]) -> DataFrame:
    """Rows for the store: of every file written under a confident verdict, with all that its slot considered and what of it is still there."""
    last = applying.final(done)
    slot = F.concat_ws("\n", F.coalesce("video", F.lit("")), F.coalesce("lang", F.lit("")))
    d = decided.withColumn("slot", slot).join(digests.select(F.col("path").alias("subtitle"), F.col("digest").alias("source_digest")), "subtitle")
    gone = last.where("status = 'done' and (kind = 'trash' or source = target)").select(F.col("source").alias("subtitle"), F.lit(True).alias("gone")).distinct()
    entry = F.struct(F.col("source_digest").alias("digest"), F.coalesce("outcome", F.lit("ERROR")).alias("outcome"), F.col("gone").isNull().alias("survived"))
    considered = d.join(gone, "subtitle", "left").groupBy("slot").agg(F.array_sort(F.collect_list(entry)).alias("considered"))
    wrote = last.where("kind = 'write' and status = 'done'").select("slot", F.col("source").alias("subtitle"), F.col("digest").alias("output_digest"))
    w = d.where("action = 'write' and outcome = 'CONFIDENT'").join(wrote, ["slot", "subtitle"]).join(considered, "slot")
    w = w.join(references.select("video", _video_digest(references).alias("video_digest")).distinct(), "video")
    w = w.join(rendered.select(F.col("path").alias("subtitle"), F.octet_length("content").cast("long").alias("size")), "subtitle")
    pairs = [F.lit(x) for kv in sorted(shape.items()) for x in kv]
    how = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    payload = F.to_json(F.struct("video_digest", "source_digest", "lang", how.alias("shape"), "considered"))
    return keyed.entries(w.select(F.col("output_digest").alias("digest"), "size", payload.alias("payload"), F.current_timestamp().alias("written_at")), KIND)


def perform(
    items: DataFrame, references: DataFrame, files: DataFrame, digests: DataFrame, store: str, trash: str, dry_run: bool = True, shape: dict[str, str] | None = None, name: str = "", **more
) -> Done:
    """Measure what is not settled, write, trash, and record; ``more`` goes to ``run.sync``."""
    shape, spark = shape or {}, items.sparkSession
    records = scratch.stored(read_records(spark, store), "records")
    digests = scratch.stored(digests.select("path", "digest"), "digests")  # as the files are now, before any of them moves
    decided = scratch.stored(run.sync(items, references, files, settled=settled(records, references, digests, shape), **more), "decided")
    wins = decided.where("action = 'write'").select(F.col("subtitle").alias("path"), "segments").dropDuplicates(["path"])
    rendered = scratch.stored(rewrite.render_files(files.drop("segments").join(wins, "path")), "rendered")
    done = run.apply(decided, rendered, trash, dry_run, name=name)
    if not dry_run:
        keyed.upsert(store, new_records(decided, done, rendered, references, digests, shape))
    return Done(decided, done, outcomes.result_rows(decided, applying.final(done), dry_run))
