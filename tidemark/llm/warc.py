"""WARC archives: writing with identical-payload revisits, reading by boundary chains.

Writing stays in the JVM: headers are string expressions and Spark's text
writer, with CRLFCRLF as line separator, puts the records into gzip files of
bounded size.  Reading trusts no magic by itself: tasks emit every place that
looks like a record, with the places its Content-Length leads to, and pointer
jumping from the start of each file keeps those that can be reached.  A magic
inside a payload stands on no chain from the start and is rejected.

Gzip files (names that end in .gz) stream through a task: Spark's text reader cuts
them at CRLFCRLF, payloads are digested as they pass by, and rows leave in
stretches, so an archive may be of any size.  Other files are taken whole, up to
2 GB each.  Only the record that a chain from the start has come to is digested;
other candidates, such as heads quoted in a payload, are two numbers each.

Defined results: null html is an empty payload; of repeated page ids with the
largest id each is a response; null page ids count as smaller than any, and
where all ids of a payload are null each is a response.  An empty table gives
an empty result.  Every file below a folder is read but those Spark hides (a dot or
a low line in front), plain or gzip, of one member or many; one that does not start
with a record gives none.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, scratch_path, table, written

MAGIC = b"WARC/1.1\r\n"
NEXT = "\r\n\r\n"
MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 8 << 20
STRIDE = 32
#: Rows of a file that are held before those that are known leave.
STRETCH = 4096


def _line(name: str, value) -> list:
    return [F.lit(f"{name}: "), value, F.lit("\r\n")]


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Revisits only: page_id, digest and the page that each refers to."""
    html = F.coalesce(F.col("html"), F.lit(""))
    keys = pages.select("page_id", F.sha1(F.encode(html, "utf-8")).alias("digest"), F.octet_length(html).alias("bytes")).where(F.col("bytes") >= min_bytes)
    first = keys.groupBy("digest", "bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = written(first, "originals")  # so that the rows of a digest that many pages share can be dealt out by the skew join
    return keys.join(first, ["digest", "bytes"]).where("page_id < refers_to or (page_id is null and refers_to is not null)")


def records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, files: int | None = None) -> DataFrame:
    """The text of each page's record up to its end mark, as ``page_id, value``; dealt to ``files`` partitions."""
    # one key of page and digest: pages are dealt by it once, for the join and for the files
    key = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "digest").alias("key")
    revisits = plan_records(pages, min_bytes).select(key.alias("r_key"), "refers_to").distinct()
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20]", "") if "url" in pages.columns else F.lit("")
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", url.alias("url"), html.alias("html"), F.sha1(F.encode(html, "utf-8")).alias("digest"), F.octet_length(html).alias("bytes"))
    p = p.withColumn("key", key)
    if files:
        p = p.repartition(files, "key")
    p = p.join(revisits, p["key"] == revisits["r_key"], "left")
    again = F.col("refers_to").isNotNull()
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(NEXT))
    body = F.when(again, F.lit("")).otherwise(F.col("html"))
    length = (F.octet_length(http) + F.octet_length(body)).cast("string")
    refers = F.when(
        again,
        F.concat(
            *_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">\r\n"),
        ),
    ).otherwise(F.lit(""))
    record = F.concat(
        F.lit(MAGIC.decode()),
        *_line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        F.lit("WARC-Record-ID: <urn:page:"), page, F.lit(">\r\n"),
        *_line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        *_line("WARC-Target-URI", F.col("url")),
        *_line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        refers,
        *_line("Content-Type", F.lit("application/http;msgtype=response")),
        *_line("Content-Length", length),
        F.lit("\r\n"), http, body,
    )
    return p.select("page_id", record.alias("value"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, min_bytes: int = MIN_REVISIT_BYTES) -> str:
    """Write gzip archives of about ``archive_bytes`` each (before gzip)."""
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    files = max(1, -(-total // archive_bytes))
    records(pages, min_bytes, int(files)).select("value").write.option("lineSep", NEXT).option("compression", "gzip").text(path)
    return path


def _inflate(data: bytes) -> bytes:
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:  # one member or many
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        data = d.unused_data
    return b"".join(out)


_LENGTH = re.compile(rb"\r\ncontent-length:\s*(\d+)\s*(?=\r\n)", re.I)
_FIELD = {
    k: re.compile(rb"\r\n" + k + rb":\s*([^\r\n]*)", re.I)
    for k in (b"WARC-Type", b"WARC-Record-ID", b"WARC-Refers-To", b"WARC-Payload-Digest")
}


class _Live:
    """The record that a chain from the file's start has come to: what has passed by of its payload."""

    def __init__(self, at: int, head: bytes, block: int, size: int):
        self.at, self.head, self.block, self.stop = at, head, block, block + size
        self.start, self.http, self.bytes, self.sha = None, b"", 0, hashlib.sha1()

    def see(self, data: bytes, at: int, whole: bool) -> None:
        """Bytes of the file from ``at`` on; ``whole``: they are all up to a blank line."""
        if whole and at == self.block:
            end = at + len(data) + len(NEXT)
            found = end <= self.stop  # else the block has no head of its own
            self.http, self.start = (data, end) if found else (b"", self.block)
        if self.start is not None and (part := data[max(self.start - at, 0) : max(self.stop - at, 0)]):
            self.sha.update(part)
            self.bytes += len(part)

    def row(self) -> dict:
        """Fields of the record; the digest of a payload that is there is computed anew."""
        f = {k: (m[1].decode("utf-8", "replace") if (m := r.search(self.head)) else None) for k, r in _FIELD.items()}
        page, ref = (re.fullmatch(r"<urn:page:(-?\d+)>", f[k] or "") for k in (b"WARC-Record-ID", b"WARC-Refers-To"))
        length = _LENGTH.search(b"\r\n" + self.http + b"\r\n")
        full = f[b"WARC-Type"] != "revisit"
        return {
            "page_id": int(page[1]) if page else None,
            "payload_bytes": self.bytes if full else int(length[1]) if length else None,
            "payload_digest": self.sha.hexdigest() if full else (f[b"WARC-Payload-Digest"] or "").rpartition(":")[2],
            "record_type": f[b"WARC-Type"],
            "refers_to": int(ref[1]) if ref else None,
        }


class _File:
    """The candidates of one file, whose bytes come in pieces between blank lines.

    A candidate is a place and where its record ends, and is looked at once more
    when the end passes by; the payload is digested of the one record at a time
    that a chain from the start leads to.  Rows leave in stretches, each as soon as
    its next places are known or can't come any more.
    """

    def __init__(self, name: str, stride: int, stretch: int = STRETCH):
        self.name, self.stride, self.stretch = name, stride, stretch
        self.at, self.tail, self.due = 0, b"", 0
        self.live: _Live | None = None
        self.ends: list[tuple[int, int]] = []
        self.open: set[int] = set()
        self.rows: dict[int, tuple[dict, int]] = {}

    def piece(self, data: bytes):
        """Take the bytes up to the next blank line, and yield rows that are known now."""
        blank, end = NEXT.encode(), self.at + len(data)
        block = end + len(blank)
        if self.live:
            self.live.see(data, self.at, True)
            self.live.see(blank, end, False)
        seen, base = self.tail + data + blank, self.at - len(self.tail)
        place, head, length = data.find(MAGIC), data + b"\r\n", None
        while place >= 0:
            if length is None or length.start() < place:
                length = _LENGTH.search(head, place)
                if length is None:
                    break
            at, size = self.at + place, int(length[1])
            self.close(at - len(blank), seen, base)  # a blank line may end in this piece
            heapq.heappush(self.ends, (block + size, at))
            self.open.add(at)
            if at == self.due:
                self.live = _Live(at, head[place:], block, size)
            place = data.find(MAGIC, place + 1)
        self.close(end, seen, base)
        self.tail, self.at = seen[-len(blank) + 1 :], block
        if len(self.rows) >= 2 * self.stretch:
            yield from self.known(False)

    def close(self, last: int, seen: bytes, base: int) -> None:
        """Settle candidates that end at ``last`` or before; ``seen`` are the file's bytes from ``base`` on."""
        while self.ends and self.ends[0][0] <= last:
            stop, at = heapq.heappop(self.ends)
            self.open.discard(at)
            chained = self.live is not None and self.live.at == at
            if seen[stop - base : stop - base + len(NEXT)] == NEXT.encode():
                self.rows[at] = (self.live.row() if chained else {}, stop + len(NEXT))
                if chained:
                    self.due = stop + len(NEXT)
            elif chained:
                self.due = -1
            if chained:
                self.live = None

    def known(self, ended: bool):
        """Rows whose next ``stride`` places are known, each with these and where they lead; all at the end of a file."""
        out, kept = [], {}
        for at, (fields, stop) in self.rows.items():
            path, jump = [at], stop
            while jump in self.rows and len(path) < self.stride:
                path.append(jump)
                jump = self.rows[jump][1]
            here = jump in self.rows
            if ended or here or (jump < self.at and jump not in self.open):
                out.append({"file": self.name, "at": at, "path": path, "jump": jump if here else None} | fields)
            else:
                kept[at] = (fields, stop)
        # a place that a kept row leads through is kept with it, as what it leads to is not known either
        self.rows = kept
        for k in range(0, len(out), 2000):
            yield pa.RecordBatch.from_pylist(out[k : k + 2000], schema=_RAW_ARROW)


_RAW = "file string, at long, path array<long>, jump long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_RAW_ARROW = pa.schema(
    [("file", pa.string()), ("at", pa.int64()), ("path", pa.list_(pa.int64())), ("jump", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def _scan_pieces(stride: int):
    def run(batches):
        file = None
        for b in batches:
            for i in range(b.num_rows):
                name = b.column(0)[i].as_py()
                if file is None or file.name != name:
                    if file:
                        yield from file.known(True)
                    file = _File(name, stride)
                yield from file.piece(b.column(1)[i].as_py())
        if file:
            yield from file.known(True)

    return run


def _scan_whole(stride: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                file = _File(b.column(0)[i].as_py(), stride)
                for piece in _inflate(b.column(1)[i].as_py()).split(NEXT.encode()):
                    yield from file.piece(piece)
                yield from file.known(True)

    return run


def read_archives(spark: SparkSession, path: str, stride: int = STRIDE) -> DataFrame:
    """The records of all archives below ``path`` that can be reached from a file's start.

    Each candidate carries its next ``stride`` places and where these lead;
    jumps are then doubled until no place is new.
    """
    deep = spark.read.option("recursiveFileLookup", "true")
    # a gzip file is never split, so its pieces come to one task in their order
    pieces = deep.option("pathGlobFilter", "*.gz").option("lineSep", NEXT).text(path).select("_metadata.file_path", F.col("value").cast("binary").alias("value"))
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{*[^z],*[^g]z,*[^.]gz,z,gz}").load(path).select("path", "content")
    found = written(pieces.mapInArrow(_scan_pieces(stride), _RAW).union(whole.mapInArrow(_scan_whole(stride), _RAW)), "candidates")
    jump = found.where("jump is not null").select("file", F.col("at").alias("from"), F.col("jump").alias("to"))
    reach, count = written(found.where("at = 0").select("file", "at"), "reach"), -1
    doubled = None
    while True:
        step = reach.join(jump.hint("merge"), (reach["file"] == jump["file"]) & (reach["at"] == jump["from"])).select(reach["file"], F.col("to").alias("at"))
        last, reach = reach, written(reach.union(step).distinct(), "reach")
        discard(last)
        if (new := reach.count()) == count:
            break
        count = new
        hop = jump.select(F.col("file").alias("f2"), F.col("from").alias("from2"), F.col("to").alias("to2"))
        last = doubled
        jump = doubled = written(jump.join(hop.hint("merge"), (jump["file"] == hop["f2"]) & (jump["to"] == hop["from2"])).select("file", "from", F.col("to2").alias("to")), "jump")
        if last is not None:
            discard(last)
    true = found.join(reach.hint("merge"), ["file", "at"]).select("file", F.explode("path").alias("at"))
    return found.join(true.hint("merge"), ["file", "at"], "left_semi").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", F.col("at").alias("offset"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return read_archives(spark, path).drop("file", "offset")


#: The same relation without archives.
OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html,
         octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
m AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS largest FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN largest END AS refers_to
FROM m
"""
