"""Interleaved documents: ordered text and media references, resolved by digest.

A page is parsed into a sequence of structs ``(position, kind, text, ref,
caption)``; media references name the SHA-256 of a payload.  Payloads stand in a
store, each as an 8-bit grey image (PGM, binary) 24 samples wide, which is
lossless for any bytes that are padded to whole 24 x 24 tiles.  Features are
computed from what the store gives back and joined to the references by digest,
so positions and captions stay with their media.

Defined results: null text or html is empty; an empty text is stored as one
tile of padding; a reference without a payload keeps null features; equal
payloads have equal values; repeated rows stay repeated; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written

SIDE = 24
TILE = SIDE * SIDE
REF = "media:sha256:"

SEGMENT = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
_SEGMENT_ARROW = pa.list_(
    pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
)


#: What markup takes as white space.
BLANK = re.compile("[\t\n\f\r ]+")


class _Sequence(HTMLParser):
    BLOCKS = frozenset("p div article section h1 h2 h3 h4 h5 h6 li ul ol table tr td blockquote pre figure br hr main header footer nav aside".split())
    SILENT = frozenset(("script", "style", "noscript", "template"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.words, self.silent, self.figure, self.caption = [], [], 0, None, None

    def flush(self):
        text = " ".join(x for x in BLANK.split("".join(self.words)) if x)
        self.words = []
        if text:
            self.out.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT:
            self.silent += 1
        elif tag == "figure":
            self.flush()
            self.figure = len(self.out)
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in ("img", "video", "audio", "source", "embed"):
            at = dict(attrs)
            if at.get("src"):
                self.flush()
                self.out.append(["media", None, at["src"], at.get("alt") or None])
        elif tag in self.BLOCKS:
            self.flush()

    def handle_startendtag(self, tag, attrs):
        if tag not in self.SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join(x for x in BLANK.split("".join(self.caption)) if x), None
            media = [x for x in self.out[self.figure or 0 :] if x[0] == "media"] if self.figure is not None else []
            if media:
                media[-1][3] = text
            elif text:
                self.out.append(["text", text, None, None])
        elif tag == "figure":
            self.flush()
            self.figure = None
        elif tag in self.BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def parse_html(html: str | None) -> list[dict]:
    """Ordered text and media segments of a page; positions count from 0."""
    p = _Sequence()
    p.feed(html or "")
    p.close()
    p.flush()
    return [{"position": i, "kind": k, "text": t, "ref": r, "caption": c} for i, (k, t, r, c) in enumerate(p.out)]


def sequences(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and ``segments``, one row per page."""
    schema = pages.select(*keep).schema

    def run(batches):
        for b in batches:
            n = len(keep)
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                seg = pa.array([parse_html(x.as_py()) for x in part.column(n)], type=_SEGMENT_ARROW)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], seg], names=[*keep, "segments"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return pages.select(*keep, F.col(html).alias("__html")).mapInArrow(run, f"{ddl}, segments {SEGMENT}" if ddl else f"segments {SEGMENT}")


def payload(text: str = "text"):
    """UTF-8 of a text, padded with bytes 255 to a positive multiple of 576."""
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    n = F.octet_length(raw)
    pad = F.greatest(F.lit(1), F.ceil(n / TILE)) * TILE - n
    return F.concat(raw, F.unhex(F.repeat(F.lit("FF"), pad.cast("int"))))


def stored(payload_col):
    """A payload as a binary PGM, 24 samples wide."""
    head = F.concat(F.lit(f"P5\n{SIDE} "), (F.octet_length(payload_col) / SIDE).cast("long").cast("string"), F.lit("\n255\n"))
    return F.concat(F.encode(head, "utf-8"), payload_col)


_PGM = re.compile(rb"P5\s+(\d+)\s+(\d+)\s+255\s")


def read_samples(media: bytes) -> bytes:
    m = _PGM.match(media)
    if not m:
        raise ValueError("not an 8-bit PGM")
    data = media[m.end() : m.end() + int(m[1]) * int(m[2])]
    if len(data) != int(m[1]) * int(m[2]):
        raise ValueError("truncated PGM")
    return data


def features(media: bytes) -> dict:
    data = read_samples(media)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    at = np.flatnonzero(seen)
    return {
        "digest": hashlib.sha256(data).hexdigest(),
        "payload_bytes": len(data),
        "tail_crc32": zlib.crc32(data[-32:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"{SIDE}x{len(data) // SIDE} min={at[0]} max={at[-1]} levels={len(at)} sum={int(seen @ np.arange(256))}",
    }


_FEATURES = "digest string, payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_FEATURES_ARROW = pa.schema(
    [("digest", pa.string()), ("payload_bytes", pa.int64()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def _features(batches):
    for b in batches:
        yield pa.RecordBatch.from_pylist([features(x.as_py()) for x in b.column(0)], schema=_FEATURES_ARROW)


def store_features(store: DataFrame) -> DataFrame:
    """A row of features per distinct payload, from the stored bytes."""
    rows = store.select("media").mapInArrow(_features, _FEATURES)
    names = [x for x in rows.columns if x != "digest"]
    return rows.groupBy("digest").agg(*[F.first(x).alias(x) for x in names])


def resolve(seqs: DataFrame, feats: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Media references with the features of their payload, found by digest."""
    refs = (
        seqs.select(*keep, F.explode("segments").alias("s"))
        .where("s.kind = 'media'")
        .select(*keep, "s.position", "s.caption", F.when(F.col("s.ref").startswith(REF), F.substring("s.ref", len(REF) + 1, 64)).alias("digest"))
    )
    return refs.join(feats, "digest", "left")


def page_of(text: str, digest) -> F.Column:
    """A page that holds a document: a heading, the figure of its payload, the text, and a figure without a payload."""
    safe = F.coalesce(F.col(text), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    ref = lambda d: F.concat(F.lit(f'<img src="{REF}'), d, F.lit('">'))
    return F.concat(
        F.lit("<h1>document</h1><figure>"), ref(digest), F.lit("<figcaption>payload</figcaption></figure><pre>"), safe, F.lit("</pre><figure>"),
        ref(F.lit("0" * 64)), F.lit("<figcaption>absent</figcaption></figure>"),
    )


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    data = payload()
    store = written(docs.select(stored(data).alias("media")), "media")
    # both sides of the join are plain shuffles, so that the skew join deals out a payload of many documents
    feats = written(store_features(store), "features")
    discard(store)
    keep = ("doc_id", "n_bytes")
    pages = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), page_of("text", F.sha2(data, 256)).alias("html"))
    words = F.array_join(F.transform(F.filter("segments", lambda s: s["kind"] == "text"), lambda s: s["text"]), "\n")
    seqs = sequences(pages, keep=keep).select(*keep, "segments", F.size("segments").alias("n_segments"), F.md5(words).alias("text_md5"))
    found = resolve(seqs, feats, (*keep, "n_segments", "text_md5")).where("caption = 'payload'")
    return found.select(
        *keep, "payload_bytes", F.col("digest").alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_segments", "text_md5"
    )


OP2_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
           list_prepend(i::BIGINT, range(8)),
           lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
p AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, encode(coalesce(text, '')) AS raw,
         trim(regexp_replace(coalesce(text, ''), '[\t\n\f\r ]+', ' ', 'g'), ' ') AS words FROM documents),
q AS (
  SELECT doc_id, n_bytes, words, greatest(1, ceil(n_bytes / 576.0)::BIGINT) * 576 AS payload_bytes,
         unhex(hex(raw) || repeat('FF', (greatest(1, ceil(n_bytes / 576.0)::BIGINT) * 576 - n_bytes)::INT)) AS data
  FROM p),
b AS (
  SELECT doc_id, n_bytes, words, payload_bytes, data, hex(data) AS h,
         unhex(hex(encode('P5' || chr(10) || '24 ' || (payload_bytes // 24) || chr(10) || '255' || chr(10))) || hex(data)) AS media
  FROM q),
u AS (
  SELECT doc_id, ('0x' || unnest(regexp_extract_all(h, '..')))::INT AS v FROM b),
f AS (
  SELECT doc_id, min(v) AS lo, max(v) AS hi, count(DISTINCT v) AS levels, sum(v) AS s FROM u GROUP BY doc_id)
SELECT b.doc_id, n_bytes::BIGINT AS n_bytes, payload_bytes, sha256(data) AS payload_sha256,
       xor(4294967295, list_reduce(
         list_prepend(4294967295::BIGINT, list_transform(range(32), lambda i: ('0x' || substr(h, (2 * (payload_bytes - 32 + i) + 1)::BIGINT, 2))::BIGINT)),
         lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255) + 1]))) AS tail_crc32,
       octet_length(media)::BIGINT AS media_bytes, sha256(media) AS media_sha256,
       '24x' || (payload_bytes // 24) || ' min=' || lo || ' max=' || hi || ' levels=' || levels || ' sum=' || s AS feature,
       1::INT AS position, 'payload' AS caption, CASE WHEN words = '' THEN 3 ELSE 4 END::INT AS n_segments,
       md5('document' || CASE WHEN words = '' THEN '' ELSE chr(10) || words END) AS text_md5
FROM b JOIN f ON b.doc_id = f.doc_id, crc
"""
