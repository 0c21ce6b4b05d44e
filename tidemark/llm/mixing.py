"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted ``target / source_size`` times.  The whole
part is taken as it is; the fractional parts are rounded by the pivotal method:
two documents of like size exchange probability until one of them is 0 or 1,
and the one that is left fractional meets the next.  Documents are dealt to
leaves of about LEAF_ROWS rows by (source, size class, hash), each leaf is
rounded by itself and leaves one fractional document at most, and these residuals
climb a tree until one is left per source, which a seeded draw settles.  A hot
source has more leaves, not larger ones, and no group but a leaf or a node of
bounded fan-in is ever gathered.  Rows of equal doc_id, source and size are
counted and numbered, and dealt by their numbers, so they spread like any others.

Targets follow from sums over sources in two orders.  Sources may be many, hosts
for example: the sums run within ranges of sources, and only a row per range is
summed in one place.

Defined results: null text has size 0; null sources are a source of their own
that sorts last; a source without words has target 0; repeated rows are
documents of their own, and which of them is taken means nothing; an empty table
gives an empty result.  Draws depend on (seed, source, node) alone and rows are
ordered by (size, doc_id) within a node, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

#: By position in code-point order, repeating.
WEIGHTS = (3, 1, 2)
LEAF_ROWS = 1024
FAN_IN = 256


def running(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """``df`` with ``rank`` (from 1, in a total order) and the sums of the rows before each, as named by ``sums``.

    Rows are dealt to ranges and summed there; a row per range is summed over all.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = Window.partitionBy("__range").orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    dealt = written(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    per = dealt.groupBy("__range").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    over = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    per = per.select("__range", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(c) for c in ("__n", *[f"__{n}" for n in sums])])
    out = dealt.join(F.broadcast(per), "__range")
    got = [(F.coalesce(F.sum(c).over(before), F.lit(0)) + F.col(f"__{n}")).alias(n) for n, c in sums.items()]
    return out.select(*df.columns, (F.row_number().over(own) + F.col("__n")).alias("rank"), *got)


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """``source, source_size, n_docs, target``: weighted shares of ``share`` times all
    words, none above ``limit`` times its source, the excess reshared by weight."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = running(per, [F.col("source").isNull(), F.col("source")], {}).withColumn("w", w).withColumnRenamed("rank", "k")
    # the sources that reach their limit are those of least limit per weight
    per = written(running(per, [F.col("source_size") / F.col("w"), F.col("k")], {"capped_before": "source_size", "w_before": "w"}), "ratios")
    size, mass = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    level = (F.lit(float(size) * share) - F.col("capped_before") * F.lit(limit)) / (F.lit(mass) - F.col("w_before"))
    free = F.col("source_size") * F.lit(limit) >= level * F.col("w")
    first = per.agg(F.min_by(F.when(free, level), F.when(free, F.col("rank")))).first()[0]
    most = F.col("source_size") * F.lit(limit)
    return per.select("source", "source_size", "n_docs", F.least(most, F.coalesce(F.lit(first).cast("double") * F.col("w"), most)).alias("target"))


def pivotal(p: np.ndarray, rng: np.random.Generator, last: bool = False) -> np.ndarray:
    """Round probabilities in order; one entry at most stays fractional (none if last)."""
    out, eps, held = np.array(p, dtype=float), 1e-9, -1
    draws = rng.random(len(out) + 1)
    for i in range(len(out)):
        if out[i] <= eps or out[i] >= 1 - eps:
            out[i] = round(out[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = out[held], out[i]
        total = a + b
        if total <= 1:
            # the mass meets in one of the two, in proportion to what each had
            keep, gone = (held, i) if draws[i] * total < a else (i, held)
            out[keep], out[gone] = total, 0.0
        else:
            full, keep = (held, i) if draws[i] * (2 - total) < 1 - b else (i, held)
            out[full], out[keep] = 1.0, total - 1
        held = keep
        if out[held] <= eps or out[held] >= 1 - eps:
            out[held] = round(out[held])
            held = -1
    if last and held >= 0:
        out[held] = float(draws[-1] < out[held])
    return out


def _round(seed: int, last: bool):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "base", "p"], kind="stable", ascending=False)
        at = f"{pdf['source'].iloc[0]!r}|{pdf['class'].iloc[0]}|{pdf['node'].iloc[0]}|{len(pdf)}|{last}"
        rng = np.random.default_rng(xxhash.xxh64_intdigest(at.encode("utf-8", "surrogatepass"), seed))
        return pdf.assign(p=pivotal(pdf["p"].to_numpy(), rng, last))

    return one


def mix(docs: DataFrame, seed: int = 11, leaf_rows: int = LEAF_ROWS, fan_in: int = FAN_IN, **target) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken``, a row per input row.

    Of ``docs`` only doc_id, text and source are read.
    """
    spark = docs.sparkSession
    sized = written(
        docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sized"
    )
    goal = written(source_targets(sized, **target), "targets")
    # size classes of half an octave, so that like sizes meet
    alike = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    ranked = alike.withColumn("number", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("class", F.floor(2 * F.log2(F.col("size") + 1)).cast("int"))
    leaves = alike.withColumn("class", F.floor(2 * F.log2(F.col("size") + 1)).cast("int")).groupBy("source", "class").agg(F.ceil(F.sum("n") / leaf_rows).cast("long").alias("leaves"))
    g = goal.withColumnRenamed("source", "g_source")
    parts = leaves.join(g, leaves["source"].eqNullSafe(g["g_source"])).select(
        F.col("source").alias("l_source"), F.col("class").alias("l_class"), "leaves", "source_size", "target"
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    cur = (
        ranked.join(parts, ranked["source"].eqNullSafe(parts["l_source"]) & (ranked["class"] == parts["l_class"]))
        .withColumn("ratio", ratio)
        .select(
            "doc_id", "source", "size", "source_size", "target", "class",
            F.pmod(F.xxhash64(F.lit(seed), "doc_id", "number"), F.col("leaves")).alias("node"),
            F.floor("ratio").cast("long").alias("base"), (F.col("ratio") - F.floor("ratio")).alias("p"),
        )
    )
    most = leaves.agg(F.max("leaves")).first()[0] or 1
    climbs = max(1, math.ceil(math.log(most, fan_in))) if most > 1 else 0
    settled, schema = [], cur.schema
    for level in range(climbs + 2):
        last = level == climbs + 1
        done = written(cur.groupBy("source", "class", "node").applyInPandas(_round(seed + level, last), schema), f"mix{level}")
        settled.append(done.where("p = 0 or p = 1"))
        if last:
            break
        rest = done.where("p > 0 and p < 1")
        up = F.floor(F.col("node") / fan_in) if level < climbs else F.lit(0)
        cur = rest.withColumn("node", up.cast("long"))
        if level >= climbs:  # the classes of a source meet at its root
            cur = cur.withColumn("class", F.lit(-1))
    out = settled[0]
    for x in settled[1:]:
        out = out.union(x)
    copies = (F.col("base") + F.col("p").cast("long")).alias("copies")
    return out.select("doc_id", "source", "size", "source_size", "target", copies, (copies * F.col("size")).cast("long").alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
