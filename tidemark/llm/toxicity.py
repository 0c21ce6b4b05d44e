"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the unlabelled text is drawn from
all documents, labelled or not, and no label of it is read.  With class prior p
the risk of a linear classifier is  p R(P, +) + max(0, R(U, -) - p R(P, -)),
logistic loss, minimised in numpy; where the second part turns negative the step
goes against it.  Features are the distinct lower-cased words of a text and their
prefixes of 4 to 6 letters, kept if they are clearly more frequent among positives.

Bounds, all parameters: the sample holds MAX_POSITIVE positives and
MAX_UNLABELLED unlabelled documents at most, chosen by a hash of doc_id among
those whose fold, crc32(doc_id as text) mod 3, is not held out; copies of a text
and near copies count once in it.  Spark counts its features and picks
MAX_FEATURES of them whose (document, feature) entries are MAX_ENTRIES at most;
only these entries, as integers, go to the driver.  The prior comes from all
labels of those folds.  Scoring is a map over all documents and reads the text only.

Defined results: null and empty texts score as a text without features; without
positives in the folds every score is the prior's, and so it is without
documents; a document with conflicting labels is toxic; null labels are none;
null doc_ids count as empty ones for the fold and are never learnt from;
repeated rows stay repeated.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, table, written

HELD_OUT = 1
FOLDS = 3
THRESHOLD = 0.7
MAX_POSITIVE = 3000
MAX_UNLABELLED = 9000
PREFIXES = (4, 5, 6)
MAX_FEATURES = 50_000
MAX_ENTRIES = 2_000_000
#: Longer words go by a digest, so that a feature's name is short.
LONG_WORD = 48

_WORD = re.compile(r"[^\W\d_]+")


def features_of_word(word: str) -> list[str]:
    name = word if len(word) <= LONG_WORD else f"#{xxhash.xxh64_hexdigest(word.encode())}"
    return [name, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


def _sketch(text: str) -> int:
    w = text.split()
    if not w:
        return 0
    return min(xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2)))


def sample(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> tuple[DataFrame, float]:
    """``side, sketch, feats`` of the sample, 1 for positives and 0 for unlabelled text, and the class prior."""
    free = (fold() != HELD_OUT) & F.col("doc_id").isNotNull()
    known = labels.where(free).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null")
    n, k = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    order = F.xxhash64(F.lit(17), "doc_id")
    pos = known.where("toxic = 1").orderBy(order, "doc_id").limit(max_positive).select("doc_id", F.lit(1).alias("side"))
    unl = docs.where(free).select("doc_id").orderBy(order, "doc_id").limit(max_unlabelled).distinct().select("doc_id", F.lit(0).alias("side"))
    chosen = pos.union(unl)  # at most max_positive + max_unlabelled ids

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                text = [x.as_py() or "" for x in part.column(1)]
                feats = [sorted({f for w in words_of(t) for f in features_of_word(w)}) for t in text]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([_sketch(t) for t in text], pa.uint64()).view(pa.int64()), pa.array(feats, pa.list_(pa.string()))], names=["side", "sketch", "feats"]
                )

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("side", "text").mapInArrow(run, "side int, sketch long, feats array<string>")
    once = written(rows.groupBy("side", "sketch").agg(F.min("feats").alias("feats")), "sample")
    most = {1: max_positive, 0: max_unlabelled}
    over = [r["side"] for r in once.groupBy("side").agg(F.count("*").alias("n")).collect() if r["n"] > most[r["side"]]]
    if over:  # rows that share a doc_id are more than the ids that were chosen
        kept = [once.where(F.col("side") == side).select("side", "sketch").orderBy("sketch").limit(rows) for side, rows in most.items()]
        whole, once = once, written(once.join(F.broadcast(kept[0].union(kept[1])), ["side", "sketch"], "left_semi"), "sample")
        discard(whole)
    return once, (k / n if n else 0.0)


def choose_features(
    rows: DataFrame, n_pos: int, n_unl: int, min_docs: int = 4, lift: float = 2.0, z: float = 4.0, most: int = MAX_FEATURES, entries: int = MAX_ENTRIES
) -> DataFrame:
    """``f, id``: features that positives have clearly oftener than unlabelled text, the clearest first."""
    side = F.col("side") == 1
    c = rows.select("side", F.explode("feats").alias("f")).groupBy("f").agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    p, q = F.col("a") / n_pos, (F.col("b") + 0.5) / (n_unl + 1)
    score = (p - q) / F.sqrt(q * (1 - F.least(q, F.lit(0.999))) / n_pos + 1e-12)
    c = c.where((F.col("a") >= min(min_docs, max(1, n_pos // 10))) & (p >= lift * q)).withColumn("score", score).where(F.col("score") >= z)
    top = c.orderBy(F.col("score").desc(), "f").limit(most)
    by = Window.orderBy(F.col("score").desc(), "f")  # over MAX_FEATURES rows
    top = top.withColumn("all", F.sum(F.col("a") + F.col("b")).over(by)).withColumn("id", F.row_number().over(by) - 1)
    return top.where(F.col("all") <= entries).select("f", "id")


def entries_of(rows: DataFrame, chosen: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """(row numbers, feature ids) of positives and of unlabelled documents that have any chosen feature."""
    e = rows.select("side", "sketch", F.explode("feats").alias("f")).join(F.broadcast(chosen), "f")
    t = e.groupBy("side", "sketch").agg(F.sort_array(F.collect_list("id")).alias("ids")).orderBy("sketch").toArrow()
    out = []
    for side in (1, 0):
        ids = t.filter(pa.compute.equal(t["side"], side))["ids"].combine_chunks()
        size = np.diff(ids.offsets.to_numpy()) if len(ids) else np.zeros(0, np.int64)
        out.append((np.repeat(np.arange(len(ids)), size), ids.flatten().to_numpy().astype(np.int64)))
    return tuple(out)


def risk(w: np.ndarray, b: float, pos, unl, n_pos: int, n_unl: int, prior: float) -> tuple[float, float, np.ndarray]:
    """(positive part, unlabelled part, gradient that a step follows) of the non-negative PU risk.

    ``pos`` and ``unl`` are (row numbers, feature ids); rows without an entry have the bias alone.
    The gradient is that of the sum, and where the unlabelled part is negative that of its opposite.
    """
    (pi, pj), (ui, uj) = pos, unl
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    zp, zu = b + np.bincount(pi, w[pj], n_pos), b + np.bincount(ui, w[uj], n_unl)
    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    gu, gp = sig(zu) / n_unl, -prior * sig(zp) / n_pos
    if negative >= 0:
        gp = gp - prior * sig(-zp) / n_pos
    else:
        gu, gp = -gu, -gp
    g = np.empty(len(w) + 1)
    g[:-1] = np.bincount(pj, gp[pi], len(w)) + np.bincount(uj, gu[ui], len(w))
    g[-1] = gp.sum() + gu.sum()
    return float(positive), float(negative), g


def fit_nnpu(pos, unl, n_pos: int, n_unl: int, size: int, prior: float, steps: int = 800, rate: float = 0.08, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """(weights, bias) of the non-negative PU risk, by Adam on whole batches."""
    x = np.zeros(size + 1)
    x[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        g = risk(x[:-1], x[-1], pos, unl, n_pos, n_unl, prior)[2]
        g[:-1] += l2 * x[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x[:-1], float(x[-1])


def train(docs: DataFrame, labels: DataFrame, **bounds) -> dict:
    """``{"weights": {feature: weight}, "bias": b}``; at most MAX_FEATURES features."""
    rows, prior = sample(docs, labels, **bounds)
    prior = min(max(prior, 1e-4), 0.5)
    n = {r["side"]: r["n"] for r in rows.groupBy("side").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        discard(rows)
        return {"weights": {}, "bias": float(np.log(prior / (1 - prior)))}
    chosen = written(choose_features(rows, n[1], n[0]), "features")
    names = [r["f"] for r in chosen.orderBy("id").collect()]
    pos, unl = entries_of(rows, chosen)
    discard(rows, chosen)
    w, b = fit_nnpu(pos, unl, n[1], n[0], len(names), prior)
    return {"weights": {f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, "bias": b}


def scorer(model: dict, memo_words: int = 300_000):
    """Score of one text; the features of a word are remembered up to a bound."""
    weights, bias, memo = model["weights"], model["bias"], {}

    def score(text: str | None) -> float:
        found: set[str] = set()
        for w in words_of(text):
            f = memo.get(w)
            if f is None:
                if len(memo) >= memo_words:
                    memo.clear()
                f = memo[w] = tuple(x for x in features_of_word(w) if x in weights)
            if f:
                found.update(f)
        z = bias + sum(sorted(weights[f] for f in found))
        return float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))

    return score


def score_documents(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``score``; only the text is read for it."""
    schema = docs.select(*keep).schema

    def run(batches):
        score = scorer(model)
        for b in batches:
            s = pa.array([score(x.as_py()) for x in b.column(len(keep))], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], s], names=[*keep, "score"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, f"{ddl}, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select(
        "doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
