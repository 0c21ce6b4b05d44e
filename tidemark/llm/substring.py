"""Exact substring dedup by level-wise doubling.

A window of ``length`` words is repeated only if the windows of half its length
inside it are.  So hashes double from single words upwards (1, 2, 4, ... words,
each from two of the level before), and candidates are narrowed level by level:

1. Base level, windows of about half the length: of those inside a full window
   the one with the least hash (its rightmost place on ties) stands for it.
   Equal windows have equal representatives at equal offsets, so only these
   representatives are counted, and only those seen twice are extended.
2. The full windows that share a representative at one place are a run.  The
   hash of all words of a run decides it at once: if it stands in another place
   as well, every window of the run is repeated.
3. What no run decides is extended to single full windows, which are compared
   with those of all runs that share the representative (one of each kind).

Level 2 and 3 compare (representative, hash), 128 bits.  All comparison is by
equality joins and counts with partial aggregation, so a passage that a third
of all documents hold costs each task one row.

Windows are judged on the input.  Defined results: null and empty texts have no
words and keep the empty string; texts of fewer words than the length keep all;
repeated rows repeat each other's windows; null doc_ids are documents too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, release, table, written

LENGTH = 35
#: Words hashed at a time; a longer text is still one array of 8 bytes a word.
SLAB_WORDS = 200_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_31, _29, _27 = np.uint64(31), np.uint64(29), np.uint64(27)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = a * _A
    z ^= z >> _29
    z += b
    z *= _B
    z ^= z >> _31
    z *= _C
    z ^= z >> _27
    return z


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each window of ``length``, doubled up from those of one word."""
    n, cur = 1, h
    while 2 * n <= length:
        cur = _mix(cur[:-n], cur[n:])
        n *= 2
    if n < length:
        cur = _mix(cur[: len(cur) - (length - n)], cur[length - n :])
    return cur


def rightmost_least(g: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of its least, the last of equals."""
    at, val, n = np.arange(len(g)), g, 1

    def join(val, at, step):
        right = val[step:] <= val[:-step]
        return np.where(right, val[step:], val[:-step]), np.where(right, at[step:], at[:-step])

    while 2 * n <= width:
        val, at = join(val, at, n)
        n *= 2
    if n < width:
        val, at = join(val, at, width - n)
    return at


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def runs(h: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of full windows by representative, over documents set end to end.

    ``h``: word hashes; ``doc``: the document of each word, ascending.
    Returns document, first window, number of windows, representative hash, run hash,
    place of the representative.
    """
    base = (length + 1) // 2
    if len(h) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    g = window_hashes(h, base)
    q = rightmost_least(g, length - base + 1)  # one per full window
    whole = doc[length - 1 :] == doc[: len(q)]  # windows that cross documents don't count
    p = np.flatnonzero(whole)
    q = q[p]
    new = np.r_[True, (q[1:] != q[:-1]) | (p[1:] != p[:-1] + 1)] if len(p) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    n = np.diff(np.r_[at, len(p)])
    first, gram = p[at], g[q[at]]
    # a run has no more windows than words in one, so its first and last window cover all its words
    full = window_hashes(h, length)
    rep = q[at]
    sig = _mix(_mix(full[first], full[first + n - 1]), n.astype(np.uint64) * _C + (rep - first).astype(np.uint64))
    return doc[first], first, n, gram, sig, rep


def _slabs(texts, limit: int):
    """Documents set end to end, up to ``limit`` words at a time: (index, words) lists."""
    held, total = [], 0
    for i, text in enumerate(texts):
        w = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
        held.append((i, w))
        total += len(w)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held


_RUNS = "gram long, sig long, first long, n int, lead int"


def find_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, tag, gram, sig, first, n, lead`` of each run; tag tells documents of equal doc_id apart."""

    def run(batches):
        for b in batches:
            for held in _slabs(b.column(2), SLAB_WORDS):
                held = [(i, w) for i, w in held if len(w) >= length]
                if not held:
                    continue
                sizes = np.array([len(w) for _, w in held])
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                h = word_hashes([x for _, w in held for x in w])
                d, first, n, gram, sig, rep = runs(h, np.repeat(np.arange(len(held)), sizes), length)
                rows = pa.array(np.array([i for i, _ in held])[d])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), pa.array(gram.view(np.int64)), pa.array(sig.view(np.int64)), pa.array(first - starts[d]), pa.array(n.astype(np.int32)), pa.array((rep - first).astype(np.int32))],
                    names=["doc_id", "tag", "gram", "sig", "first", "n", "lead"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed(docs).mapInArrow(run, f"doc_id {kind}, tag long, {_RUNS}")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")


def _single_windows(length: int):
    def run(batches):
        for b in batches:
            out = [[], [], [], [], [], []]
            for i in range(b.num_rows):
                w = (b.column(2)[i].as_py() or "").encode("utf-8", "surrogatepass").split()
                full = window_hashes(word_hashes(w), length).view(np.int64)
                for r in b.column(3)[i].as_py():
                    k = np.arange(r["first"], r["first"] + r["n"])
                    for o, v in zip(out, ([i] * len(k), [r["gram"]] * len(k), k - r["first"] - r["lead"], full[k], k, [r["open"]] * len(k)), strict=True):
                        o.append(v)
                if len(out[0]) > 4000 or i == b.num_rows - 1:
                    if out[0]:
                        c = [np.concatenate(o) for o in out]
                        rows = pa.array(c[0].astype(np.int64))
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(rows), b.column(1).take(rows), *(pa.array(x.astype(np.int64)) for x in c[1:5]), pa.array(c[5].astype(bool))],
                            names=["doc_id", "tag", "gram", "off", "full", "first", "open"],
                        )
                    out = [[], [], [], [], [], []]

    return run


def _merge(spans: list[tuple[int, int]], top: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        b = min(b, top)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif a < b:
            out.append((a, b))
    return out


def cut_words(text: str | None, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """(words, words removed, kept words joined by one space)."""
    w = (text or "").encode("utf-8", "surrogatepass").split()
    gone = _merge(spans, len(w))
    kept, at = [], 0
    for a, b in gone:
        kept += w[at:a]
        at = b
    kept += w[at:]
    return len(w), len(w) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, tag, start, stop``: word spans covered by repeated windows (they may overlap)."""
    spark = docs.sparkSession
    all_runs = written(find_runs(docs, length), "runs")
    # sides of joins are written first: then both are plain shuffles, and the skew join deals out the rows of a hot key
    twice = written(all_runs.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram"), "twice")
    alive = written(all_runs.join(twice, "gram", "left_semi"), "alive")
    discard(all_runs, twice)
    release(spark)
    kinds = written(
        alive.groupBy("gram", "sig").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "tag", "first", "n", "lead")).alias("at")), "kinds"
    )
    closed = alive.join(kinds.where("c > 1").select("gram", "sig"), ["gram", "sig"], "left_semi").select(
        "doc_id", "tag", F.col("first").alias("start"), (F.col("first") + F.col("n") + length - 1).alias("stop")
    )
    # runs that stand alone, and one of each other kind that shares their representative
    unsettled = written(kinds.where("c = 1").select("gram").distinct(), "unsettled")
    wanted = (
        kinds.join(unsettled, "gram", "left_semi")
        .select("at.doc_id", "at.tag", F.struct("gram", "at.first", "at.n", "at.lead", (F.col("c") == 1).alias("open")).alias("run"))
        .groupBy("doc_id", "tag")
        .agg(F.collect_list("run").alias("runs"))
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = _with(keyed(docs), wanted, "inner").select("doc_id", "tag", "text", "runs")
    single = written(texts.mapInArrow(_single_windows(length), f"doc_id {kind}, tag long, gram long, off long, full long, first long, open boolean"), "windows")
    again = written(single.groupBy("gram", "off", "full").agg(F.count("*").alias("c")).where("c > 1").drop("c"), "again")
    opened = (
        single.where("open")
        .join(again, ["gram", "off", "full"], "left_semi")
        .select("doc_id", "tag", F.col("first").alias("start"), (F.col("first") + length).alias("stop"))
    )
    return closed.union(opened)


def _with(docs: DataFrame, per_doc: DataFrame, how: str) -> DataFrame:
    """Documents with what was found about them; the small side is hashed, texts are not sorted."""
    r = per_doc.withColumnsRenamed({"doc_id": "r_doc", "tag": "r_tag"}).hint("shuffle_hash")
    return docs.join(r, docs["doc_id"].eqNullSafe(r["r_doc"]) & (docs["tag"] == r["r_tag"]), how).drop("r_doc", "r_tag")


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: tuple[str, ...] = ("doc_id",), rewrite: bool = False) -> DataFrame:
    """The columns ``keep``, ``n_words, n_removed, kept_sha256, kept``, one row per row of ``docs``.

    ``kept`` has one space between words; with ``rewrite`` a text of which nothing
    is removed stays as it is (null stays null).
    """
    spans = repeated_spans(docs, length).groupBy("doc_id", "tag").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    spans = written(spans, "spans")
    release(docs.sparkSession)
    schema, k = docs.select(*keep).schema, len(keep)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [x.as_py() for x in part.column(k)]
                rows = [cut_words(t, [(s["start"], s["stop"]) for s in p.as_py() or ()]) for t, p in zip(texts, part.column(k + 1), strict=True)]
                sha = [hashlib.sha256(x[2].encode("utf-8", "surrogatepass")).hexdigest() for x in rows]
                kept = [t if rewrite and not x[1] else x[2] for t, x in zip(texts, rows, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:k], pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                    names=[*keep, "n_words", "n_removed", "kept_sha256", "kept"],
                )

    columns = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text", *[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)])
    found = _with(columns, spans, "left").select(*[f"__{i}" for i in range(k)], "text", "spans")
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema)
    return found.mapInArrow(run, f"{ddl}n_words long, n_removed long, kept_sha256 string, kept string")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
