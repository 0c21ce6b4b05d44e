"""Near copies: documents whose word shingles have a Jaccard similarity of 0.8 or more.

1. Texts of one shingle set are one class, named by a digest of the set.
2. SimHash fingerprints are linked by the method of ``simhash``; classes whose
   fingerprints are in one component are drawn together into coarse groups.
3. As most pairs at 0.8 differ in more bits, least values under ``bands * rows``
   permutations are cut into bands; classes that share a band are drawn together
   too.  A pair of similarity s shares none with probability
   (1 - s**rows)**bands: 6e-5 at 0.8, less above.
4. Within a coarse group all pairs are decided by their shingle sets themselves:
   a search from class to class links what is similar and splits the group.

A coarse group of more than ``limit`` shingles is dealt out in blocks, and each
pair of blocks is searched on its own, so that no task holds a whole group and
no pair is left out.

Defined results are those of simhash: null and empty texts are one class, null
doc_ids get a component but never name one unless it has no other id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import connected_components, release, written

SEED = 42
WORDS = 5
SIMILAR = 0.8
ROWS = 6
BANDS = 32
#: Shingles of a coarse group, or of a block of one, that are searched at once.
LIMIT = 1 << 20


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 hashes of a text's word shingles; shorter texts have one, empty ones none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)] if w else [], np.uint64)
    each = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in each), np.uint64))


def set_digest(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), SEED)


def band_keys(h: np.ndarray, rows: int = ROWS, bands: int = BANDS, block: int = 1 << 11) -> list[int]:
    """A key for each band of least values; none for an empty set."""
    if not len(h):
        return []
    made = np.random.default_rng(SEED).integers(0, 1 << 32, (2, rows * bands), np.uint32)
    a, b = (made[0] | np.uint32(1))[:, None], made[1][:, None]
    x = (h >> np.uint64(32)).astype(np.uint32)
    least = np.min([(x[k : k + block] * a + b).min(1) for k in range(0, len(x), block)], axis=0)
    return [xxhash.xxh64_intdigest(least[i * rows : (i + 1) * rows].tobytes(), i) for i in range(bands)]


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def digests(docs: DataFrame, words: int = WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``fp``, the digest of the shingle set as a signed long."""
    schema, k = docs.select(*keep).schema, len(keep)

    def run(batches):
        for b in batches:
            fp = _longs([set_digest(shingles(x.as_py(), words)) for x in b.column(k)])
            yield pa.RecordBatch.from_arrays([*b.columns[:k], fp], names=[*keep, "fp"])

    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema)
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, f"{ddl}fp long")


def _signed(words: int, rows: int, bands: int):
    def run(batches):
        for b in batches:
            sets = [shingles(x.as_py(), words) for x in b.column(2)]
            keys = [band_keys(h, rows, bands) for h in sets]
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), _longs([x for k in keys for x in k]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), _longs([set_digest(h) for h in sets]), pa.array([len(h) for h in sets], pa.int64()), flat, _longs([simhash.fingerprint(x.as_py()) for x in b.column(2)])],
                names=["doc_id", "tag", "fp", "n", "keys", "sim"],
            )

    return run


def _sets(words: int):
    def run(batches):
        for b in batches:
            sets = [shingles(x.as_py(), words) for x in b.column(2)]
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat], names=["c", "fp", "h"])

    return run


def spanning(fps: np.ndarray, sets: list[np.ndarray], similar: float = SIMILAR) -> list[tuple[int, int]]:
    """(class, least class) of each class that links of ``similar`` or more lead to from a smaller one."""
    fps, first = np.unique(fps, return_index=True)
    sets = [sets[i] for i in first]
    size = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    own = [codes[e - n : e] for e, n in zip(ends, size, strict=True)]
    mark = np.zeros(codes.max() + 1, bool)
    todo, held, out = np.arange(len(fps)), codes, []
    starts = ends - size
    while len(todo) > 1:
        root, front, gone = todo[0], [todo[0]], np.arange(len(todo)) == 0
        while front and not gone.all():
            i = front.pop()
            mark[own[i]] = True
            common = np.add.reduceat(mark[held], starts, dtype=np.int64)
            mark[own[i]] = False
            # common / union >= similar, without a division
            near = ~gone & (common >= similar * (size[i] + size[todo] - common) - 1e-9)
            front += todo[near].tolist()
            out += [(int(fps[x]), int(fps[root])) for x in todo[near]]
            gone |= near
            if 2 * gone.sum() > len(gone):  # what is left is searched alone
                todo = todo[~gone]
                gone = np.zeros(len(todo), bool)
                if len(todo):
                    held = np.concatenate([own[x] for x in todo])
                    starts = np.cumsum(size[todo]) - size[todo]
        if gone.any():
            todo = todo[~gone]
            if len(todo):
                held = np.concatenate([own[x] for x in todo])
                starts = np.cumsum(size[todo]) - size[todo]
    return out


def _search(similar: float):
    def run(batches):
        for b in batches:
            found = []
            for group in b.column(0):
                v = group.values
                h = v.field("h")
                flat, at = h.values.to_numpy().view(np.uint64), h.offsets.to_numpy()
                found += spanning(v.field("fp").to_numpy(), [flat[x:y] for x, y in zip(at, at[1:], strict=False)], similar)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return run


def fingerprint_keys(signed: DataFrame) -> DataFrame:
    """``fp, key``: a key for each component of SimHash fingerprints that a class's texts are in; none for empty sets."""
    own = signed.where("n > 0").select("fp", "sim").distinct()
    edges = simhash.links(written(own.select(F.col("sim").alias("fp")).distinct(), "fingerprints"))
    drawn = own.join(connected_components(edges), F.col("sim") == F.col("node"), "left")
    return drawn.select("fp", F.xxhash64(F.lit("simhash"), F.coalesce("component", "sim")).alias("key"))


def components(docs: DataFrame, words: int = WORDS, similar: float = SIMILAR, rows: int = ROWS, bands: int = BANDS, limit: int = LIMIT) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    signed = written(keyed.mapInArrow(_signed(words, rows, bands), f"doc_id {kind}, tag long, fp long, n long, keys array<long>, sim long"), "bands")
    index = signed.select("fp", F.explode("keys").alias("key")).union(fingerprint_keys(signed)).distinct()
    heads = index.groupBy("key").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head")
    coarse = connected_components(index.join(heads, "key").where("fp <> head").select(F.col("fp").alias("a"), F.col("head").alias("b")))
    classes = written(
        signed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "tag")).alias("one"), F.first("n").alias("n"))
        .join(coarse.select(F.col("node").alias("fp"), F.col("component").alias("c")), "fp", "left"), "classes",
    )
    release(docs.sparkSession)
    # one text of each class goes to its group
    wanted = classes.where("c is not null").select("c", "fp", F.col("one.doc_id").alias("w_doc"), F.col("one.tag").alias("w_tag")).hint("shuffle_hash")
    texts = keyed.join(wanted, keyed["doc_id"].eqNullSafe(wanted["w_doc"]) & (keyed["tag"] == wanted["w_tag"])).select("c", "fp", "text")
    blocks = classes.where("c is not null").groupBy("c").agg(F.ceil(F.sum("n") / limit).cast("int").alias("k")).where("k > 1")
    sets = texts.mapInArrow(_sets(words), "c long, fp long, h array<long>")
    whole = blocks.isEmpty()
    if whole:
        dealt = sets.withColumn("at", F.lit(0)).withColumn("to", F.lit(0))
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
        dealt = sets.join(blocks, "c", "left").withColumn("own", F.coalesce(own, F.lit(0)))
        others = F.when(F.col("k").isNull(), F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("k") - 1), F.array("own")))
        dealt = dealt.withColumn("other", F.explode(others)).withColumn("at", F.least("own", "other")).withColumn("to", F.greatest("own", "other"))
    groups = dealt.groupBy("c", "at", "to").agg(F.collect_list(F.struct("fp", "h")).alias("members")).where(F.size("members") > 1)
    edges = written(groups.select("members").mapInArrow(_search(similar), "a long, b long"), "links")
    found = edges if whole else connected_components(edges).toDF("a", "b")
    named = classes.join(found.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("c"))
    names = named.groupBy("c").agg(F.min("least").alias("component_id"))
    return signed.select("doc_id", "fp").join(named.join(names, "c").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")
