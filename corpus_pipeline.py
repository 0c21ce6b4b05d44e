"""Corpus pipeline: documents to tokens in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return the
columns of documents; other columns, whatever their names, are left out first.

Defined results of all stages: an empty table gives an empty one; null ids,
languages and sources are values like others; texts are taken whole, however
long; rows that repeat are documents of their own but where a stage drops copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, near, substring, toxicity
from tidemark.llm.common import remove, scratch_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring below the threshold; the text alone decides.

    Null and empty texts score as texts without features, which no class prior
    below the threshold rejects; equal texts stay or go together.
    """
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model, keep=COLUMNS).where(F.col("score") < toxicity.THRESHOLD).drop("score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more the document with the smallest id.

    Null and empty texts are copies of each other, shorter texts are one shingle;
    of equal documents with one id a single row stays, the least by text, source
    and language; a null id stays only where its component has no other.
    """
    docs = docs.select(*COLUMNS)
    groups = near.components(docs)
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = groups.groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("rows"), F.bool_or(own).alias("own")).where("own")
    kept = ids.select("kept_id", "rows").hint("shuffle_hash")
    out = docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "inner").select(*COLUMNS, "rows")
    once = out.where("rows = 1").drop("rows")
    if ids.where("rows > 1").isEmpty():
        return once
    # rows that share an id: one of each shingle set that names its group stays
    many = near.digests(out.where("rows > 1"), keep=COLUMNS)
    named = groups.where(own).select(F.col("doc_id").alias("n_id"), F.col("fp").alias("n_fp")).distinct()
    many = many.join(named, many["doc_id"].eqNullSafe(named["n_id"]) & (many["fp"] == named["n_fp"]), "left_semi")
    first = Window.partitionBy("doc_id", "fp").orderBy("text", "source", "lang")
    return once.union(many.withColumn("r", F.row_number().over(first)).where("r = 1").select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated windows; others stay as they are.

    A text of which nothing repeats is kept to the letter, null too; what is left
    of another is joined by one space and may be empty.
    """
    docs = docs.select(*COLUMNS)
    out = substring.remove_repeats(docs, keep=("doc_id", "lang", "source"), rewrite=True)
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target takes it.

    Documents without words have size 0 and are taken by their source's share like
    others; rows of one id and source share the copies drawn for them, the first by
    text and language having one more where they don't come out even.
    """
    docs = docs.select(*COLUMNS)
    copies = mixing.mix(docs).groupBy(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source")).agg(
        F.sum("copies").alias("copies"), F.count("*").alias("rows")
    ).hint("shuffle_hash")
    out = docs.join(copies, docs["doc_id"].eqNullSafe(copies["m_id"]) & docs["source"].eqNullSafe(copies["m_source"])).select(*COLUMNS, "copies", "rows")
    # rows that share id and source share the copies taken of them
    order = Window.partitionBy("doc_id", "source").orderBy("text", "lang")
    share = F.floor(F.col("copies") / F.col("rows")) + (F.row_number().over(order) <= F.col("copies") % F.col("rows")).cast("int")
    one = out.where("rows = 1").select(*COLUMNS, F.col("copies").cast("int").alias("take"))
    if not copies.where("rows > 1").isEmpty():
        one = one.union(out.where("rows > 1").select(*COLUMNS, share.cast("int").alias("take")))
    return one.where("take > 0").select(*COLUMNS, F.explode(F.array_repeat(F.lit(1), F.col("take"))).alias("copy")).drop("copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every copy, with the digests of ids and of the text decoded from them; null and empty texts have none."""
    return bpe.encode_documents(docs.select(*COLUMNS), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Learning, hashing rounds and seeded draws aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents").select(*COLUMNS), None
    for name, stage in STAGES:
        path = scratch_path(spark, name.split()[0])
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
