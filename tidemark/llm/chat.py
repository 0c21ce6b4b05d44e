"""Chat logs: cumulative snapshots collapse to maximal conversations.

Logging services store a conversation again after every turn.  Turns are
numbered in order and each carries a rolling hash of the prefix that ends with
it: running sums of hashes of (place, role, text), so a window function rolls
it along.  A conversation whose last hash is an inner prefix hash of another is
an anti-join away from being dropped; of equal conversations the smallest
conv_id stays.  What is left is rendered.  Everything runs in the JVM.

Prefix hashes are four running sums of 32-bit halves of two 64-bit hashes, with
the number of turns.  Defined results: turns are ordered by (turn, role, text),
nulls first, and repeated rows are turns of their own; null roles and texts
render as empty but differ from empty ones; null conv_ids form a conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

PREFIX = ("k", "h1", "h2", "h3", "h4")


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, k, h1..h4, n, role, text``: the hash of the first k of n turns."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rolling = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = turns.select("conv_id", "turn", "role", "text", F.row_number().over(order).alias("k"))
    # xxhash64 passes over nulls, so these are told apart by flags
    parts = ["k", F.col("role").isNull(), F.col("text").isNull(), "role", "text"]
    a, b = F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)
    low = F.lit(0xFFFFFFFF)
    t = t.select(
        "conv_id", "k", "role", "text",
        *[F.sum(x).over(rolling).alias(n) for x, n in (
            (a.bitwiseAND(low), "h1"), (F.shiftrightunsigned(a, 32), "h2"), (b.bitwiseAND(low), "h3"), (F.shiftrightunsigned(b, 32), "h4"),
        )],
    )
    return t.withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))


def maximal(turns: DataFrame) -> DataFrame:
    """The turns of conversations that prefix no longer one, one of equals."""
    spark_rows = written(prefixes(turns), "prefixes")
    ends = spark_rows.where("k = n").groupBy(*PREFIX).agg(F.min_by("conv_id", F.struct(F.col("conv_id").isNull(), "conv_id")).alias("conv_id"))
    inner = spark_rows.where("k < n").select(*PREFIX).distinct()
    keep = ends.join(inner, list(PREFIX), "left_anti").select(F.col("conv_id").alias("kept_id"))
    return spark_rows.join(keep, spark_rows["conv_id"].eqNullSafe(keep["kept_id"]), "left_semi")


def render(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, chat``: turns in order between role and end marks."""
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    lines = F.sort_array(F.collect_list(F.struct("k", line.alias("line"))))
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("chat"))


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(maximal(table(spark, sf_dir, "conversations")))


OP1_SQL = """
WITH t AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
p AS (
  SELECT *, string_agg(sha256(coalesce('r' || role, 'n')) || sha256(coalesce('t' || text, 'n')), '') OVER (
           PARTITION BY conv_id ORDER BY k) AS prefix
  FROM t),
e AS (
  SELECT prefix, min(conv_id) AS conv_id FROM p WHERE k = n GROUP BY prefix),
m AS (
  SELECT conv_id FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.prefix = e.prefix))
SELECT conv_id, count(*) AS n_turns,
       string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY k) AS chat
FROM t WHERE EXISTS (SELECT 1 FROM m WHERE m.conv_id IS NOT DISTINCT FROM t.conv_id)
GROUP BY conv_id
"""
