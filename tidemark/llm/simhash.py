"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint within k differing bits of another, cut into k//2 + 1
segments, agrees with it in one segment up to one bit at most.  So every
segment is indexed under each of its variants with one bit struck out; equal
variants are joined and the distance is verified.  Members of a variant are
linked to each other by edges that span their links, never by all pairs.

Variants that hold more than ``dense`` fingerprints take another exact way: the
whole fingerprint is indexed under its variants with k bits struck out.  Any two
that share such a variant differ in k bits at most, so an edge to the smallest
of them suffices and rows grow in proportion to the fingerprints.

Only distinct fingerprints are indexed; copies join at the end.  Defined
results: null and empty texts have fingerprint zero and link like any other;
repeated rows keep a row each; null doc_ids get a component like others do but
never name one unless it has no other id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, table, written

SEED = 42
WORDS = 3
MAX_BITS = 2
DENSE = 256


def fingerprint(text: str | None, words: int = WORDS, block: int = 1 << 16) -> int:
    """Majority of the XXH64 bits of word shingles, as an unsigned 64-bit number."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, block):  # in blocks, for very long texts
        part = w[k : k + block + words - 1]
        if len(part) <= words:
            shingles = [b" ".join(part)]
        else:
            shingles = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False))
        h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``fp``; fp is the fingerprint as a signed long."""
    schema, k = docs.select(*keep).schema, len(keep)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), words) for x in b.column(k)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(fp)], names=[*keep, "fp"])

    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema)
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, f"{ddl}fp long")


def segments(bits: int, width: int = 64) -> list[tuple[int, int]]:
    """(shift, width) of bits // 2 + 1 segments that cover a fingerprint."""
    n = bits // 2 + 1
    cuts = [width * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def variants(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """``slot, value, fp``: each segment under each of its one-wildcard variants."""
    keys, slot = [], 0
    for shift, width in segments(bits):
        mask = (1 << width) - 1
        for i in range(width):
            keep = (mask & ~(1 << i)) << shift
            keep -= (1 << 64) if keep >= 1 << 63 else 0
            keys.append(F.struct(F.lit(slot).alias("slot"), F.col("fp").bitwiseAND(F.lit(keep).cast("long")).alias("value")))
            slot += 1
    # a number of parts, so that the few bytes of the fingerprints aren't gathered in few tasks before they grow
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return fps.repartition(parts, "fp").select("fp", F.explode(F.array(*keys)).alias("k")).select("k.slot", "k.value", "fp")


def spanning(fps: np.ndarray, bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Edges that span the links (distance within ``bits``) among few fingerprints."""
    todo, out = np.unique(fps), []
    while len(todo):
        front, todo = todo[:1], todo[1:]
        while len(front) and len(todo):
            far = np.bitwise_count(todo ^ front[0]) > bits
            near = todo[~far]
            out += [(int(x), int(front[0])) for x in near]
            front, todo = np.concatenate([front[1:], near]), todo[far]
    return out


def _verify(bits: int):
    def run(batches):
        for b in batches:
            edges = [e for x in b.column(0) for e in spanning(np.array(x.as_py(), np.int64).view(np.uint64), bits)]
            a = np.array([x for x, _ in edges], np.uint64).view(np.int64)
            c = np.array([y for _, y in edges], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], names=["a", "b"])

    return run


def links(fps: DataFrame, bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """``a, b``: edges between distinct fingerprints whose components are those of all links."""
    index = variants(fps, bits)
    held = written(index.groupBy("slot", "value").agg(F.count("*").alias("n")).where("n > 1"), "held")
    # a merge join at every size, so that small inputs tell how large ones grow
    shared = written(index.join(held.hint("merge"), ["slot", "value"]), "variants")
    few = shared.where(F.col("n") <= dense).groupBy("slot", "value").agg(F.collect_list("fp").alias("fps"))
    found = few.select("fps").mapInArrow(_verify(bits), "a long, b long").distinct()
    crowd = shared.where(F.col("n") > dense).select("fp").distinct()
    struck = [sum(1 << i for i in c) for c in combinations(range(64), bits)]
    masks = [m - (1 << 64) if (m := ~s & ((1 << 64) - 1)) >= 1 << 63 else m for s in struck]
    array = F.array(*[F.lit(m).cast("long") for m in masks])
    wide = crowd.select("fp", F.posexplode(array).alias("slot", "mask")).select("fp", "slot", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))
    if crowd.isEmpty():
        return found
    star = wide.groupBy("slot", "value").agg(F.min("fp").alias("least"))
    return found.union(wide.join(star, ["slot", "value"]).where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))).distinct()


def components(docs: DataFrame, words: int = WORDS, bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``."""
    rows = written(fingerprints(docs, words), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    edges = written(links(classes.select("fp"), bits, dense), "links")
    # components over fingerprints, named afterwards by their smallest document
    comp = connected_components(edges)
    named = classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    names = named.groupBy("c").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(names, "c").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
