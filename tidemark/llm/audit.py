"""Filter interactions: what each filter of a chain removes in every order.

A pass over the text column reads Arrow's buffers as they are: a table gives each
byte its classes, prefix sums of the classes at the offsets of documents give
words, capitals, symbols and code points, and prefix sums of weighted bytes give
a hash of every word.  A document's hashes are sorted; neighbours of equal hash are
compared byte by byte, so distinct words are exact.  Conditions on these counts
are bits of a mask, and all orders of the filters follow from counts of masks.

Copies are told by 256-bit digests of whole texts: a text's smallest doc_id is an
aggregate, and rows find it by (digest, doc_id), so a text that a third of the rows
share is dealt out like any other.

Defined results: null texts are empty ones, null languages the part of the empty
string; a null doc_id is neither smaller nor larger than another and never fails
as a copy; rows that repeat the smallest doc_id don't either; labels of one id
that repeat count if any says so; labels without a document and null labels count
for nothing; an empty table gives no parts and an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written

#: Bytes of text taken at a time; longer documents are taken in stretches of whole words.
PIECE = 1 << 21
SYMBOLS = b"#$%&*|"

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_CAPITAL = np.zeros(256, np.uint64)
_CAPITAL[65:91] = 1
_SYMBOL = np.zeros(256, np.uint64)
_SYMBOL[list(SYMBOLS)] = 1
#: Bytes that begin a code point.
_POINT = np.ones(256, np.uint64)
_POINT[128:192] = 0
#: Two counters to a sum: the low half and the high half.
_COUNTS = (_CAPITAL | _SYMBOL << np.uint64(32), _POINT)
_RANDOM = np.random.default_rng(13).integers(1, 2**63, 256, dtype=np.uint64)
#: An odd number, so that its powers have inverses.
_BASE = 0x9E3779B97F4A7C15


class _Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of documents that lie one behind another at ``offsets``."""
    word = ~_BLANK[data]
    before, after = np.r_[False, word[:-1]], np.r_[word[1:], False]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """A hash of each word's bytes, from prefix sums of weighted bytes."""
    up, down = powers.of(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[data] * up[:-1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def equal_neighbours(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the words of one ``length`` at ``a`` and at ``b`` are the same bytes."""
    out = np.ones(len(a), bool)
    todo = np.arange(len(a))
    for k in range(16):
        if not len(todo):
            return out
        same = data[a[todo] + k] == data[b[todo] + k]
        out[todo[~same]] = False
        todo = todo[same & (length[todo] > k + 1)]
    for i in todo.tolist():  # long words
        out[i] = data[a[i] : a[i] + length[i]].tobytes() == data[b[i] : b[i] + length[i]].tobytes()
    return out


def distinct_words(data: np.ndarray, doc: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct words of each of ``n`` documents; ``doc`` says whose a word is, in ascending order."""
    if not len(starts):
        return np.zeros(n, np.int64)
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    keys = doc.astype(np.uint64) << np.uint64(64) - bits | hashes >> bits
    order = np.argsort(keys)
    k, s, size = keys[order], starts[order], (ends - starts)[order]
    repeat = np.flatnonzero(k[1:] == k[:-1]) + 1
    alike = size[repeat] == size[repeat - 1]
    alike[alike] = equal_neighbours(data, s[repeat[alike]], s[repeat[alike] - 1], size[repeat[alike]])
    out = np.bincount(doc, minlength=n) - np.bincount(doc[order[repeat]], minlength=n)
    for d in np.unique(doc[order[repeat[~alike]]]).tolist():  # unlike words of one hash: count the words themselves
        own = doc == d
        out[d] = len({data[x:y].tobytes() for x, y in zip(starts[own].tolist(), ends[own].tolist(), strict=True)})
    return out


def scan(data: np.ndarray, offsets: np.ndarray, powers: _Powers) -> dict[str, np.ndarray]:
    """words, distinct, capitals, symbols, points of the documents between ``offsets``."""
    n = len(offsets) - 1
    sums = [np.zeros(len(data) + 1, np.uint64) for _ in _COUNTS]
    for out, weight in zip(sums, _COUNTS, strict=True):
        np.cumsum(weight[data], out=out[1:])
    pair, points = (s[offsets[1:]] - s[offsets[:-1]] for s in sums)
    starts, ends = word_places(data, offsets)
    doc = np.searchsorted(offsets, starts, "right") - 1
    return {
        "words": np.bincount(doc, minlength=n).astype(np.int64),
        "distinct": distinct_words(data, doc, starts, ends, word_hashes(data, starts, ends, powers), n),
        "capitals": (pair & np.uint64(0xFFFFFFFF)).astype(np.int64), "symbols": (pair >> np.uint64(32)).astype(np.int64), "points": points.astype(np.int64),
    }


def scan_long(data: np.ndarray, powers: _Powers, piece: int = PIECE) -> dict[str, int]:
    """The same of one document of any length, in stretches cut at white space."""
    total = dict.fromkeys(("words", "capitals", "symbols", "points"), 0)
    seen: set[bytes] = set()
    at = 0
    while at < len(data):
        end = min(at + piece, len(data))
        if end < len(data):
            blank = np.flatnonzero(_BLANK[data[at:end]])
            if len(blank):
                end = at + int(blank[-1]) + 1
            else:  # a word longer than a stretch
                while end < len(data) and not _BLANK[data[end]]:
                    end += 1
        part = data[at:end]
        starts, ends = word_places(part, np.array([0, len(part)]))
        seen.update(part[x:y].tobytes() for x, y in zip(starts.tolist(), ends.tolist(), strict=True))
        total["words"] += len(starts)
        total["capitals"] += int(_CAPITAL[part].sum())
        total["symbols"] += int(_SYMBOL[part].sum())
        total["points"] += int(_POINT[part].sum())
        at = end
    return total | {"distinct": len(seen)}


COUNTS = ("words", "distinct", "capitals", "symbols", "points")


def scan_texts(texts: pa.Array, powers: _Powers, piece: int = PIECE) -> tuple[dict[str, np.ndarray], list[bytes]]:
    """Counts and digests of a column of texts, read from its buffers; nulls are empty."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, where, raw = texts.buffers()
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    out = {c: np.zeros(len(texts), np.int64) for c in COUNTS}
    k = 0
    while k < len(texts):
        j = max(k + 1, int(np.searchsorted(offsets, offsets[k] + piece, "right")) - 1)
        part = data[offsets[k] : offsets[j]]
        if len(part) > piece:
            found = {c: [v] for c, v in scan_long(part, powers, piece).items()}
        else:
            found = scan(part, offsets[k : j + 1] - offsets[k], powers)
        for c in COUNTS:
            out[c][k:j] = found[c]
        k = j
    view = memoryview(data)
    return out, [hashlib.sha256(view[x:y]).digest() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest`` and COUNTS; a map without a shuffle."""

    def run(batches):
        powers = _Powers()
        for b in batches:
            for k in range(0, b.num_rows, 500):
                p = b.slice(k, 500)
                found, digests = scan_texts(p.column(2), powers)
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(digests, pa.binary()), *[pa.array(found[c]) for c in COUNTS]], names=["doc_id", "part", "digest", *COUNTS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, part string, digest binary, " + ", ".join(f"{c} long" for c in COUNTS))


def with_copies(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copy``: whether a smaller doc_id has the same digest."""
    least = rows.where("doc_id is not null").groupBy(F.col("digest").alias("__digest")).agg(F.min("doc_id").alias("__least")).withColumn("__first", F.lit(True))
    out = rows.join(least, (rows["digest"] == least["__digest"]) & (rows["doc_id"] == least["__least"]), "left")
    return out.select(*rows.columns, (F.col("__first").isNull() & F.col("doc_id").isNotNull()).alias("copy"))


#: By letter, when a document fails; over COUNTS and copy.
FILTERS: dict[str, Column | str] = {
    "A": "words < 200",
    "B": "100 * distinct < 50 * words",
    "C": "100 * capitals > 3 * points",
    "D": "symbols > 0",
    "E": "copy",
}


def masks(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """``part, mask, n, good, toxic``: counts of documents by the filters they fail, a bit each in their order."""
    rows = written(features(docs), "features")
    marked = labels.groupBy(F.col("doc_id").alias("__id")).agg(
        *[F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "__good"), ("toxic", "__toxic"))]
    )
    flagged = with_copies(rows)
    mask = sum((F.when(F.expr(x), 1 << k).otherwise(0) for k, x in enumerate(filters.values())), F.lit(0)).cast("int")
    out = flagged.select("doc_id", "part", mask.alias("mask")).join(marked, F.col("doc_id") == F.col("__id"), "left")
    counted = out.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("__good").alias("good"), F.count_if("__toxic").alias("toxic"))
    counted = written(counted, "masks")
    discard(rows)
    return counted


def steps(letters: str) -> list[tuple]:
    """(filter_order, step, mask, kept, removed, redundant, unique, shapley) for every order, step and mask, as 0 or 1 but the last.

    ``shapley`` is in how many of all orders the step's filter is the first that a document of this mask fails.
    """
    orders = list(permutations(range(len(letters))))
    out = []
    for order in orders:
        name, before = "".join(letters[i] for i in order), 0
        for k, f in enumerate(order):
            bit = 1 << f
            for mask in range(1 << len(letters)):
                fails, gone = bool(mask & bit), bool(mask & before)
                share = len(orders) // mask.bit_count() if fails else 0
                out.append((name, k + 1, mask, int(not gone and not fails), int(fails and not gone), int(fails and gone), int(mask == bit), share))
            before |= bit
    return out


def interactions(counted: DataFrame, letters: str) -> DataFrame:
    """All orders and steps of every part, from counts of masks.

    The table of steps is broadcast: its size depends on the number of filters alone.
    """
    kind = "filter_order string, step int, mask int, k int, r int, d int, u int, s int"
    table = F.broadcast(counted.sparkSession.createDataFrame(steps(letters), kind))
    sums = {"kept": ("k", "n"), "removed": ("r", "n"), "redundant": ("d", "n"), "unique_fails": ("u", "n"), "good_lost": ("r", "good"), "toxic_lost": ("r", "toxic"), "shapley": ("s", "n")}
    return counted.join(table, "mask").groupBy("part", "filter_order", "step").agg(*[F.sum(F.col(a) * F.col(b)).cast("long").alias(n) for n, (a, b) in sums.items()])


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "".join(FILTERS))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, l.good, l.toxic,
         [len(words) < 200,
          100 * len(list_distinct(words)) < 50 * len(words),
          100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
          regexp_matches(text, '[#$%&*|]'),
          coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (
  SELECT row_number() OVER () AS o, [a.i, b.i, c.i, e.i, g.i] AS p
  FROM x a, x b, x c, x e, x g
  WHERE len(list_distinct([a.i, b.i, c.i, e.i, g.i])) = 5),
m AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
s AS (
  SELECT part, o.p, st.i AS step, o.p[st.i] AS letter, n, good, toxic, m.fails[o.p[st.i]] AS bad,
         len(list_filter(range(1, st.i), lambda j: m.fails[o.p[j]])) > 0 AS gone,
         len(list_filter(m.fails, lambda z: z)) AS failed
  FROM m, o, x st),
r AS (
  SELECT part, p, step, letter,
         sum(n) FILTER (NOT gone AND NOT bad) AS kept, sum(n) FILTER (bad AND NOT gone) AS removed, sum(n) FILTER (bad AND gone) AS redundant,
         sum(n) FILTER (bad AND failed = 1) AS unique_fails, sum(good) FILTER (bad AND NOT gone) AS good_lost, sum(toxic) FILTER (bad AND NOT gone) AS toxic_lost
  FROM s GROUP BY part, p, step, letter)
SELECT part, array_to_string(list_transform(p, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, step::INT AS step,
       coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM r
"""
