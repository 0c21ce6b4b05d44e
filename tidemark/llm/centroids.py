"""Centroid clustering of distinct quantised vectors with their multiplicities.

Components become integers, rows of one quantised vector are one weighted row of
a table written once, and Lloyd's rounds run over that table alone: a task finds
the nearest centroid of its vectors and sends one weighted integer sum per
cluster and component, so that a round shuffles (tasks x clusters x components)
numbers whatever the rows.  At the end each vec_id finds its vector's assignment
by a join.  Only centroids and sums per cluster, bounded by ``k`` times ``dim``,
reach the driver.

All numbers are integers, so results don't depend on the order of sums: sums are
decimals between tasks, divisions are floors.

Defined results: vectors of another length than ``dim``, null ones and those with
a null or non-finite component have no row; quantised components beyond
+-LARGEST are taken as +-LARGEST, so that distances fit 64 bits; an inertia that
doesn't fit is null; vec_ids that repeat are vectors of their own, with equal ids
in the order of their vectors among the starts; a null id starts only after all
others; with fewer than ``k`` vectors there are as many centroids as vectors; an
empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written

K = 16
DIM = 64
ROUNDS = 3
SCALE = 64
SEED = 1
LARGEST = 2**27


def quantised(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``vec_id, q``: integers floor(scale * x) of every vector of ``dim`` finite components."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = float(LARGEST)
    one = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-most)), F.lit(most))).cast("int")
    sound = vectors.where((F.size("embedding") == dim) & good)
    return sound.select("vec_id", F.transform("embedding", one).alias("q"))


def starts(rows: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors of least hash, in the order of their hashes."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(h.alias("h"), "q").orderBy(F.col("h").asc_nulls_last(), "q").limit(k)
    return np.array([r["q"] for r in first.collect()], np.int64)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid, the smaller number of ties; exact."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    most = max(int(np.abs(x).max()), int(np.abs(centres).max()))
    if x.shape[1] * 4 * most * most < 2**52:  # all sums are integers that a double holds
        f, c = x.astype(np.float64), centres.astype(np.float64)
        d = (f * f).sum(1)[:, None] - 2 * (f @ c.T) + (c * c).sum(1)
    else:
        d = np.stack([((x - c) ** 2).sum(1) for c in centres], 1)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at].astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


#: Vectors held as a matrix at a time.
PIECE = 4096


def _sums(centres: np.ndarray):
    """Of a task: per cluster and component the weighted sum, with the weight of the cluster."""

    def run(batches):
        total, weight = np.zeros(centres.shape, object), np.zeros(len(centres), object)
        for b in batches:
            for k in range(0, b.num_rows, PIECE):
                part = b.slice(k, PIECE)
                x, n = _matrix(part.column(0)), part.column(1).to_numpy()
                at, _ = nearest(x, centres)
                exact = int(np.abs(x).max(initial=0)) * int(n.sum()) < 2**62
                for c in np.unique(at).tolist():
                    own = at == c
                    a, w = (x[own], n[own]) if exact else (x[own].astype(object), n[own].astype(object))
                    total[c] += (a * w[:, None]).sum(0).astype(object)
                    weight[c] += int(n[own].sum())
        full = np.flatnonzero(weight)
        clusters, dims = np.repeat(full, centres.shape[1]), np.tile(np.arange(centres.shape[1]), len(full))
        kind = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(clusters, pa.int32()), pa.array(dims, pa.int32())]
            + [pa.array([Decimal(int(v)) for v in vs], kind) for vs in (total[full].ravel(), np.repeat(weight[full], centres.shape[1]))],
            names=["cluster", "place", "total", "weight"],
        )

    return run


def _assign(centres: np.ndarray):
    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, PIECE):
                part = b.slice(k, PIECE)
                at, d = nearest(_matrix(part.column(0)), centres)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(at, pa.int32()), pa.array(d)], names=["q", "copies", "cluster", "distance"])

    return run


def lloyd(classes: DataFrame, centres: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after ``rounds`` rounds over weighted distinct vectors (``q, copies``)."""
    for _ in range(rounds):
        part = classes.mapInArrow(_sums(centres), "cluster int, place int, total decimal(38,0), weight decimal(38,0)")
        sums = part.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
        centres = centres.copy()
        for r in sums.collect():  # k * dim rows at most
            centres[r["cluster"], r["place"]] = int(r["total"]) // int(r["weight"])
    return centres


def cluster(vectors: DataFrame, k: int = K, dim: int = DIM, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``, a row per sound vector."""
    spark = vectors.sparkSession
    rows = quantised(vectors, dim, scale)
    classes = written(rows.groupBy("q").agg(F.count("*").alias("copies")), "quantised")
    centres = starts(rows, k, seed)
    out = "vec_id {}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centres):
        return spark.createDataFrame([], out.format(vectors.schema["vec_id"].dataType.simpleString()))
    centres = lloyd(classes, centres, rounds)
    found = written(classes.mapInArrow(_assign(centres), "q array<int>, copies long, cluster int, distance long"), "assigned")
    discard(classes)
    per = found.groupBy("cluster").agg(F.sum(F.col("copies").cast("decimal(19,0)") * F.col("distance")).alias("cost")).collect()  # k rows at most
    whole = sum(int(r["cost"]) for r in per)
    fits = lambda v: v if v < 2**63 else None
    told = [(r["cluster"], fits(int(r["cost"])), fits(whole), hashlib.sha256(",".join(map(str, centres[r["cluster"]].tolist())).encode()).hexdigest()) for r in per]
    told = F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    # plain shuffles on both sides, so that the rows of a vector that many share can be dealt out
    return rows.join(found.select("q", "cluster", "distance").hint("merge"), "q").join(told, "cluster").select(*[x.split()[0] for x in out.split(", ")])


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql(rounds: int = ROUNDS) -> str:
    assign = """
d{i} AS (
  SELECT q.row, q.q, c.k, list_sum(list_transform(range(1, 65), lambda j: (q.q[j] - c.c[j]) * (q.q[j] - c.c[j])))::BIGINT AS d
  FROM q, c{i} c),
a{i} AS (
  SELECT row, q, k, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, k) = 1)"""
    move = """
s{i} AS (
  SELECT a.k, j, sum(a.q[j])::BIGINT AS s, count(*) AS n FROM a{i} a, (SELECT unnest(range(1, 65)) AS j) GROUP BY a.k, j),
c{n} AS (
  SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM s{i} GROUP BY k
  UNION ALL SELECT k, c FROM c{i} WHERE k NOT IN (SELECT k FROM s{i}))"""
    steps = [assign.format(i=0)]
    for i in range(rounds):
        steps += [move.format(i=i, n=i + 1), assign.format(i=i + 1)]
    return f"""
WITH q AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, q) - 1 AS k, q AS c
  FROM q QUALIFY k < 16),{",".join(steps)},
t AS (
  SELECT k, sum(d)::BIGINT AS t FROM a{rounds} GROUP BY k)
SELECT q.vec_id, a.k::INT AS cluster, a.d AS distance, t.t AS cluster_inertia, (SELECT sum(t) FROM t)::BIGINT AS inertia,
       sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM q JOIN a{rounds} a USING (row) JOIN t ON t.k = a.k JOIN c{rounds} c ON c.k = a.k
"""


OP11_SQL = _sql()
