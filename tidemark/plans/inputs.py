"""Inputs of the catalogue's queries, derived from the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, side (0 reference, 1 subtitle), t in seconds of a two-hour clock."""
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    e = table(spark, sf_dir, "events").where("ts is not null")
    return e.select((F.col("user_id") % 20).alias("pair_id"), (F.col("event_id") % 2).alias("side"), (F.pmod(ms, F.lit(7200000)) / 1000.0).alias("t"))


MOMENTS = """
moments AS (
  SELECT user_id % 20 AS pair_id, event_id % 2 AS side,
         ((date_diff('millisecond', TIMESTAMP '2024-01-01', ts) % 7200000)::DOUBLE / 1000e0) AS t
  FROM events WHERE ts IS NOT NULL)"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = moments(spark, sf_dir)
    return m.where("side = 0").select("pair_id", "t"), m.where("side = 1").select("pair_id", "t")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, side, start, end: cue lines of two to five seconds."""
    return moments(spark, sf_dir).select("pair_id", "side", F.col("t").alias("start"), (F.col("t") + 2.0 + F.floor(F.col("t")) % 4).alias("end"))


LINES = MOMENTS + """,
lines AS (
  SELECT pair_id, side, t AS start, t + 2e0 + floor(t) % 4 AS "end" FROM moments)"""


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, dir, title, season (null for some), episode, seconds, cues."""
    k = F.col("o_orderkey")
    show = (F.col("o_custkey") % 25).cast("string")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("/lib/show "), show, F.lit("/s"), (k % 3).cast("string"), F.lit("/v"), k.cast("string"), F.lit(".mkv")).alias("path"),
        F.concat(F.lit("show "), show).alias("title"),
        F.when(k % 3 != 0, k % 3).alias("season"), (k % 26).alias("episode"),
        F.when(k % 11 != 0, 1200.0 + k % 600).alias("seconds"), k.alias("id"),
    )


VIDEOS = """
videos AS (
  SELECT '/lib/show ' || (o_custkey % 25) || '/s' || (o_orderkey % 3) || '/v' || o_orderkey || '.mkv' AS path,
         'show ' || (o_custkey % 25) AS title,
         CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 3 END AS season, o_orderkey % 26 AS episode,
         CASE WHEN o_orderkey % 11 <> 0 THEN 1200e0 + o_orderkey % 600 END AS seconds, o_orderkey AS id
  FROM orders)"""


def subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    show = (k * 7 % 25).cast("string")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("/lib/show "), show, F.lit("/subs/p"), k.cast("string"), F.lit(".srt")).alias("path"),
        F.concat(F.lit("show "), show).alias("title"),
        F.when(k % 4 != 0, k % 3).alias("season"), (k % 31).alias("episode"),
        F.when(k % 13 != 0, 1100.0 + k % 900).alias("last"), (k % 40).alias("cues"), k.alias("id"),
        F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "und"))), (k % 4 + 1).cast("int")).alias("lang"),
    )


SUBTITLES = """
subtitles AS (
  SELECT '/lib/show ' || (p_partkey * 7 % 25) || '/subs/p' || p_partkey || '.srt' AS path,
         'show ' || (p_partkey * 7 % 25) AS title,
         CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 3 END AS season, p_partkey % 31 AS episode,
         CASE WHEN p_partkey % 13 <> 0 THEN 1100e0 + p_partkey % 900 END AS last, p_partkey % 40 AS cues, p_partkey AS id,
         (['en', 'de', 'fr', 'und'])[p_partkey % 4 + 1] AS lang
  FROM part)"""


def spliced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(ref, sub) of pair_id, t: all events of a user, and nine tenths of them moved by one offset in the first hour and another in the second."""
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    u, t = F.col("user_id"), F.pmod(ms, F.lit(7200000)) / 1000.0
    e = table(spark, sf_dir, "events").where("ts is not null").select(u.alias("pair_id"), t.alias("t"), "event_id")
    first = F.col("pair_id") % 5 * 1.5
    moved = F.col("t") - F.when(F.col("t") < 3600, first).otherwise(first + F.col("pair_id") % 3 * 4.25)
    return e.select("pair_id", "t"), e.where("event_id % 10 > 0").select("pair_id", moved.alias("t"))


SPLICED = """
ref AS (
  SELECT user_id AS pair_id, ((date_diff('millisecond', TIMESTAMP '2024-01-01', ts) % 7200000)::DOUBLE / 1000e0) AS t, event_id FROM events WHERE ts IS NOT NULL),
sub AS (
  SELECT pair_id, t - CASE WHEN t < 3600 THEN pair_id % 5 * 15e-1 ELSE pair_id % 5 * 15e-1 + pair_id % 3 * 425e-2 END AS t FROM ref WHERE event_id % 10 > 0)"""
