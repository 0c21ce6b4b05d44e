"""Alias tables, vocabularies and pair manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_alias(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(key, entity) and (entity, name) of an alias file: lines ``key TAB ids``, ``##``, ``id TAB name``.

    Lines are told apart by whether they stand after the mark; the file is one
    that a tool wrote, so its lines are numbered in one pass over it.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    mark = lines.where("line = '##'").agg(F.min("n").alias("mark"))
    all_lines = lines.crossJoin(F.broadcast(mark)).where("n > 0 or not startswith(line, '{')")  # one row on the right
    part = F.split("line", "\t")
    pair = all_lines.where(F.size(part) >= 2).withColumn("a", part[0]).withColumn("b", part[1])
    keys = pair.where("mark is null or n < mark").select(F.col("a").alias("key"), F.explode(F.split("b", "[ ,]+")).alias("entity")).where("entity <> ''")
    return keys.distinct(), pair.where("n > mark").select(F.col("a").alias("entity"), F.col("b").alias("name"))


def read_vocabulary(spark: SparkSession, path: str, protected: DataFrame | None = None) -> DataFrame:
    """Tokens of a JSON file ``{"tokens": [...]}`` but for protected ones."""
    v = spark.read.option("multiLine", "true").schema("tokens array<string>").json(path).select(F.explode("tokens").alias("token")).distinct()
    return v.join(protected, "token", "left_anti") if protected is not None else v


def _listed_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """``seq, entry`` of a JSON list with a line for each entry, whose pieces may be several files in the order of their names; None for other forms."""
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("id"))
    lines = spark.read.text(path).select(F.trim("value").alias("value"), at.alias("at"))
    more, sign = F.endswith("value", F.lit(",")), F.col("value").isin("[", "]")
    body = F.when(more, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    # one whole value and nothing else: what is put behind it is the second of two
    two = F.from_json(F.concat(F.lit("["), body, F.lit(",0]")), "array<string>")
    x = lines.select("value", "at", sign.alias("sign"), more.alias("more"), F.when(~sign, two).alias("two"))
    entry = ~F.col("sign")
    whole = (F.size("two") == 2) & (F.get("two", F.lit(1)) == "0")
    c = x.agg(
        F.count_if(entry & ~F.coalesce(whole, F.lit(False))).alias("bad"), F.count_if(F.col("sign")).alias("signs"), F.count_if(entry & ~F.col("more")).alias("ends"),
        F.min_by("value", "at").alias("first"), F.max_by("value", "at").alias("last"), F.max_by("more", F.when(entry, F.col("at"))).alias("open"),
    ).first()
    if (c["bad"], c["signs"], c["ends"], c["first"], c["last"], c["open"]) != (0, 2, 1, "[", "]", False):
        return None
    rows = x.where(entry).select(F.col("at.f").alias("f"), F.col("at.b").alias("b"), F.col("at.id").alias("id"), F.get("two", F.lit(0)).alias("entry"))
    blocks = rows.groupBy("f", "b").agg(F.count("*").alias("n"))
    before = blocks.select("f", "b", (F.sum("n").over(Window.orderBy("f", "b")) - F.col("n")).alias("before"))
    own = rows.withColumn("r", F.row_number().over(Window.partitionBy("f", "b").orderBy("id")))
    return own.join(F.broadcast(before), ["f", "b"]).select((F.col("before") + F.col("r") - 1).cast("int").alias("seq"), "entry")  # a row a block


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``seq, video, subtitle, fault`` of a JSON list of pairs or of objects; faults stay rows.

    A list with a line for each entry is read in blocks, other forms as one text.
    """
    rows = _listed_lines(spark, path)
    if rows is None:
        text = spark.read.text(path, wholetext=True)
        rows = text.select(F.posexplode_outer(F.from_json("value", "array<string>")).alias("seq", "entry"))
    pair, named = F.from_json("entry", "array<string>"), F.from_json("entry", "struct<video:string,subtitle:string>")
    listed = F.col("entry").startswith("[")
    video, sub = F.when(listed, F.get(pair, F.lit(0))).otherwise(named["video"]), F.when(listed, F.get(pair, F.lit(1))).otherwise(named["subtitle"])
    fault = F.when(F.col("seq").isNull(), "not a list").when(listed & (F.size(pair) != 2), "not a pair").when(video.isNull() | sub.isNull(), "video or subtitle missing")
    return rows.select("seq", video.alias("video"), sub.alias("subtitle"), fault.alias("fault"))


def pair_fault(video: Column, subtitle: Column, files: Column, video_kind: Column, subtitle_kind: Column, size: Column, most: int = 268435456) -> Column:
    """The first fault of an asserted pair; ``files``: whether both exist."""
    return (
        F.when(video == subtitle, "the same file twice")
        .when(~files, "missing file")
        .when((video_kind == "subtitle") & (subtitle_kind == "video"), "swapped")
        .when(F.coalesce(video_kind, F.lit("")) != "video", "not a video")
        .when(F.coalesce(subtitle_kind, F.lit("")) != "subtitle", "not a subtitle")
        .when(size > most, "too large")
    )
