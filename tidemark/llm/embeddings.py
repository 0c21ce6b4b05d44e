"""Embedding near-duplicates: random-hyperplane hashing, exact cosine, components.

Sound vectors are reduced to distinct ones with their number of copies.  Each of
several tables cuts the sign pattern of ``bits`` random hyperplanes; ``bits``
grows with the logarithm of the rows, so buckets keep their size, and the number
of tables follows from it so that a pair at the threshold is missed with a
probability of MISS at most.  Vectors that share a bucket are compared in double
precision; a pair counts in the first table in which it meets, so link counts
are sums and no pair is ever emitted.  Small buckets are compared many to a
group, larger ones than BLOCK block by block, in tasks of their own: nothing is
capped.

A distinct vector goes by a number of its own, given once when the table of
distinct vectors is written.  Rows find their vector by two 64-bit hashes, and
the run stops if two distinct vectors share both.

Defined results: null, empty and zero vectors and those with null or non-finite
components link with nothing and are their own component; vectors of unlike
length never link; vec_ids that repeat are vectors of their own; null ids never
name a component that has another id, and one of null ids alone keeps them all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, discard, table, written

THRESHOLD = 0.95
MISS = 0.03
BUCKET_ROWS = 16
BLOCK = 2048
#: Buckets of a table are compared about 2**TOGETHER to a group.
TOGETHER = 6
SEED = 5


def plan_tables(rows: int, threshold: float = THRESHOLD, miss: float = MISS, bucket_rows: int = BUCKET_ROWS) -> tuple[int, int]:
    """(bits, tables) for so many vectors."""
    bits = max(4, math.ceil(math.log2(max(rows, 2) / bucket_rows)))  # a bucket is 64 bits: enough for 10**19 rows
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - same)))


def signatures(x: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """One bucket number per vector and table."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], bits * tables))
    signs = (x @ planes > 0).reshape(len(x), tables, bits)
    return (signs * (np.int64(1) << np.arange(bits, dtype=np.int64))).sum(2)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the scale is taken out first so that nothing over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sound(c: str = "embedding"):
    """Whether a vector has a direction: components, none null or not finite, not all zero."""
    good = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(c) > 0) & good & F.exists(c, lambda x: x != 0), F.lit(False))


def _hash(bits: int, tables: int):
    def run(batches):
        for b in batches:
            v = b.column(1)
            size, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            start = np.r_[0, np.cumsum(size)[:-1]]
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                rows = pa.array(at)
                sig = signatures(flat[start[at][:, None] + np.arange(dim)], bits, tables)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * tables, pa.int32()), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), v.take(rows), b.column(2).take(rows), lists], names=["rep", "embedding", "copies", "sig"])

    return run


def spanning(near: np.ndarray, left: list[int], right: list[int], same: bool) -> list[tuple[int, int]]:
    """Edges that span the links of a block: each vector is visited once, its row of links looked at once."""
    if same:
        near = near | near.T
    sides = [(near, left, right), (near.T, right, left)]
    new = [np.ones(len(left), bool)] * 2 if same else [np.ones(len(left), bool), np.ones(len(right), bool)]
    out = []
    for start in np.flatnonzero(near.any(1)).tolist():
        if not new[0][start]:
            continue
        new[0][start] = False
        todo = [(0, start)]
        while todo:
            side, i = todo.pop()
            links, own, other = sides[side]
            far = 0 if same else 1 - side
            for k in np.flatnonzero(links[i] & new[far]).tolist():
                new[far][k] = False
                out.append((own[i], other[k]))
                todo.append((far, k))
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _compare(threshold: float):
    """(rows of links, rows of edges) of a group: small buckets, each in itself, or two blocks of a large one."""

    def run(t: pa.Table) -> pa.Table:
        table, i, j = (t[c][0].as_py() for c in ("table", "i", "j"))
        bucket, block, rep, copies = (t[c].to_numpy() for c in ("bucket", "block", "rep", "copies"))
        x, sig = unit(_matrix(t["embedding"]).astype(np.float64)), _matrix(t["sig"])[:, :table]
        order = np.lexsort((block, bucket))
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        total = np.zeros(len(rep), np.int64)
        edges: list[tuple[int, int]] = []
        for of in np.split(order, cuts):
            a = of if i == j else of[block[of] == i]
            b = of if i == j else of[block[of] == j]
            if not len(a) or not len(b) or (i == j and len(a) < 2):
                continue
            near = x[a] @ x[b].T >= threshold
            if i == j:
                near &= np.triu(np.ones(near.shape, bool), 1)
            p, q = np.nonzero(near)
            if not len(p):
                continue
            edges += [(max(u, v), min(u, v)) for u, v in spanning(near, rep[a].tolist(), rep[b].tolist(), i == j)]
            if table:
                first = (sig[a[p]] != sig[b[q]]).all(1)
                p, q = p[first], q[first]
            np.add.at(total, a[p], copies[b[q]])
            np.add.at(total, b[q], copies[a[p]])
        at = np.flatnonzero(total)
        none = pa.nulls
        return pa.table({
            "rep": pa.concat_arrays([pa.array(rep[at]), pa.array([u for u, _ in edges], pa.int64())]),
            "links": pa.concat_arrays([pa.array(total[at]), none(len(edges), pa.int64())]),
            "other": pa.concat_arrays([none(len(at), pa.int64()), pa.array([v for _, v in edges], pa.int64())]),
        })

    return run


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, bucket_rows: int = BUCKET_ROWS, block: int = BLOCK, together: int = TOGETHER
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``."""
    # -0.0 and 0.0 are one value, as grouping has it
    kind = vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.select("vec_id", F.when(sound(), F.transform("embedding", lambda x: x + F.lit(0).cast("float")).cast(kind)).alias("embedding"))
    names = [F.xxhash64(F.lit(k), "embedding") for k in (SEED, SEED + 1)]
    classes = rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = written(classes.select("embedding", "least", "copies", names[0].alias("h1"), names[1].alias("h2"), F.monotonically_increasing_id().alias("rep")), "vectors")
    if not classes.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("two distinct vectors share both hashes; take another SEED")
    bits, tables = plan_tables(classes.count(), threshold, miss, bucket_rows)
    hashed = written(classes.select("rep", "embedding", "copies").mapInArrow(_hash(bits, tables), f"rep long, embedding {kind}, copies long, sig array<long>"), "hashed")
    dim = F.size("embedding")
    keys = hashed.select("rep", dim.alias("dim"), F.posexplode("sig").alias("table", "bucket"))
    held = written(keys.groupBy("dim", "table", "bucket").agg(F.count("*").alias("n")).where("n > 1"), "held")
    blocks = F.ceil(F.col("n") / block).cast("int")
    member = keys.join(held, ["dim", "table", "bucket"]).select("rep", "dim", "table", "bucket", "n", blocks.alias("blocks"))
    member = member.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(SEED)), F.col("blocks")).cast("int"))
    # small buckets go many to a group, the others have groups of their own; a block meets itself and every other one once
    groups = max(1, 1 << max(0, bits - together))
    chunk = F.when(F.col("n") <= 4 * bucket_rows, F.pmod(F.xxhash64("bucket"), F.lit(groups))).otherwise(F.xxhash64("bucket", F.lit(SEED)))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = member.withColumn("o", other).select(
        "rep", "dim", "table", "bucket", "blocks", chunk.alias("chunk"), "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j")
    )
    data = pairs.join(hashed, "rep")
    found = data.groupBy("dim", "table", "blocks", "chunk", "i", "j").applyInArrow(_compare(threshold), "rep long, links long, other long")
    found = written(found, "pairs")
    discard(hashed, held)
    links = found.where("links is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    comp = connected_components(found.where("other is not null"), "rep", "other").select(F.col("node").alias("rep"), "component")
    named = classes.select("rep", "least", "copies", "h1", "h2").join(comp, "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    per = named.join(least, "c").join(links, "rep", "left")
    per = written(per.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component_id"), "classes")
    keyed = rows.select("vec_id", F.col("embedding").isNotNull().alias("sound"), *[F.when(F.col("embedding").isNotNull(), h).alias(c) for h, c in zip(names, ("h1", "h2"), strict=True)])
    out = keyed.join(per, ["h1", "h2"], "left")
    out = out.select(
        "vec_id", F.when(F.col("sound"), F.col("links")).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
