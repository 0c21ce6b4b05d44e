"""Cue files: SRT, ASS/SSA, VTT, VobSub index and PGS, told apart by content.

Readers take whole file contents (``binaryFile``) and give one row per file with
``status`` OK or ERROR, never an empty list for a failure, and the cues with the
character spans that a rewriter needs to change only what it must.

A file is gone through line by line, and its cues are columns, not objects: a task
holds one file's bytes and text and about 60 bytes a cue beside what it says.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import decode

SPANS = ("start_at", "start_to", "end_at", "end_to", "block_at", "block_to")
NAMES = ("idx", "start", "end", "text", *SPANS)
CUES = "array<struct<idx:int,start:double,end:double,text:string,start_at:int,start_to:int,end_at:int,end_to:int,block_at:int,block_to:int>>"
FILES = f"path string, status string, reason string, format string, encoding string, bom binary, text string, warnings array<string>, cues {CUES}"

_CLOCK = r"(?:(\d+):)?(\d{1,3}):(\d{1,2})[,.](\d{1,3})"
_SRT_LINE = re.compile(rf"({_CLOCK})[ \t]*-->[ \t]*({_CLOCK})")
_VTT_CLOCK = r"(?:(\d{2,}):)?(\d{2}):(\d{2})\.(\d{3})"
_VTT_LINE = re.compile(rf"({_VTT_CLOCK})[ \t]*-->[ \t]*({_VTT_CLOCK})[^\n]*")
_ASS_CLOCK = re.compile(r"\s*(\d{1,2}):(\d{2}):(\d{2})[.,](\d{1,3})\s*")
_IDX_LINE = re.compile(r"^timestamp:\s*((\d+):(\d{2}):(\d{2}):(\d{1,3}))\s*,\s*filepos:", re.M | re.I)
_NUMBER = re.compile(r"\s*\d+\s*")


class Unreadable(ValueError):
    pass


def seconds(h, m, s, frac) -> float:
    return int(h or 0) * 3600 + int(m) * 60 + int(s) + int((frac + "000")[:3]) / 1000.0


def cue(idx, start, end, text="", start_span=(None, None), end_span=(None, None), block=(None, None)) -> tuple:
    return (idx, start, end, text, *start_span, *end_span, *block)


class Cues(Sequence):
    """Cues of one file as columns, read as a dict a cue."""

    def __init__(self):
        self.idx, self.start, self.end = array("i"), array("d"), array("d")
        self.said, self.ends = bytearray(), array("q", [0])
        self.spans = tuple(array("i") for _ in SPANS)

    def add(self, c: tuple) -> None:
        self.idx.append(c[0])
        self.start.append(c[1])
        self.end.append(c[2])
        self.said += c[3].encode()
        self.ends.append(len(self.said))
        for column, x in zip(self.spans, c[4:], strict=True):
            column.append(-1 if x is None else x)

    def extend(self, other: Cues) -> None:
        shift = len(self.said)
        self.said += other.said
        self.ends.extend(shift + x for x in other.ends[1:])
        for own, more in zip((self.idx, self.start, self.end, *self.spans), (other.idx, other.start, other.end, *other.spans), strict=True):
            own.extend(more)

    def __len__(self) -> int:
        return len(self.idx)

    def __getitem__(self, i: int) -> dict:
        i = range(len(self))[i]
        spans = (None if x[i] < 0 else x[i] for x in self.spans)
        said = self.said[self.ends[i] : self.ends[i + 1]].decode()
        return dict(zip(NAMES, (self.idx[i], self.start[i], self.end[i], said, *spans), strict=True))

    def __eq__(self, other) -> bool:
        return isinstance(other, Sequence) and len(self) == len(other) and all(map(dict.__eq__, self, other))

    def arrow(self) -> pa.Array:
        """Structs of all cues."""
        flat = lambda x, kind: np.frombuffer(x, kind) if len(x) else np.empty(0, kind)
        spans = [(v := flat(x, np.int32), v < 0) for x in self.spans]
        ends = np.frombuffer(self.ends, np.int64).astype(np.int32)
        said = pa.StringArray.from_buffers(len(self), pa.py_buffer(ends), pa.py_buffer(self.said))
        plain = [pa.array(flat(self.idx, np.int32)), pa.array(flat(self.start, float)), pa.array(flat(self.end, float))]
        return pa.StructArray.from_arrays([*plain, said, *[pa.array(v, mask=gone) for v, gone in spans]], names=list(NAMES))


class Stanza(NamedTuple):
    """A timing line and the lines behind it, up to the next one, each with its place."""

    times: re.Match
    at: int
    above: list[tuple[int, str]]
    below: list[tuple[int, str]]


def lines_of(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    while (to := text.find("\n", at)) >= 0:
        yield at, text[at:to]
        at = to + 1
    yield at, text[at:]


def stanzas(text: str, timing: re.Pattern) -> Iterator[Stanza]:
    """A stanza as soon as the next one begins; its lines above are those behind the timing line before, or the file's first ones."""
    last, held = None, []
    for at, x in lines_of(text):
        if m := timing.search(text, at, at + len(x)):
            if last:
                yield last
            last = Stanza(m, at, held, [])
            held = last.below
        else:
            held.append((at, x))
    if last:
        yield last


def _blank(line: str) -> bool:
    return line in ("", "\r")


def read_srt(text: str, warnings: list[str]) -> Iterator[tuple]:
    def begin(s: Stanza, first: bool) -> int | None:
        """At a number right above that nothing or a blank line precedes, else at the timing line."""
        numbered = s.above and _NUMBER.fullmatch(s.above[-1][1])
        if numbered and (_blank(s.above[-2][1]) if len(s.above) > 1 else first):
            return s.above[-1][0]
        return s.at if s.at or not s.times.start() else None

    def made(i: int, s: Stanza, a: int | None, b: int | None) -> tuple:
        last = len(s.below)
        while last and not s.below[last - 1][1].strip():
            last -= 1
        if last and _NUMBER.fullmatch(s.below[last - 1][1]):  # the number of the next one
            last -= 1
        start, end = seconds(*s.times.group(2, 3, 4, 5)), seconds(*s.times.group(7, 8, 9, 10))
        if end < start:
            warnings.append(f"cue {i} ends before it starts")
        whole = (a, b) if a is not None and b is not None and b >= a else (None, None)
        return cue(i, start, end, "\n".join(x for _, x in s.below[:last]).strip("\n"), s.times.span(1), s.times.span(6), whole)

    n, held = 0, None  # a stanza and where it begins
    for s in stanzas(text, _SRT_LINE):
        here = begin(s, held is None)
        if held:
            n += 1
            yield made(n, *held, here)
        held = s, here
    if held:
        yield made(n + 1, *held, len(text))
    elif sum(bool(_NUMBER.fullmatch(x)) for x in text.split("\n", 200)[:200]) >= 2:
        raise Unreadable("index lines but no timing line")


def read_vtt(text: str, warnings: list[str]) -> Iterator[tuple]:
    if not text.lstrip("\ufeff").lstrip().startswith("WEBVTT"):
        raise Unreadable("no WEBVTT signature")
    for i, s in enumerate(stanzas(text, _VTT_LINE)):
        start, end = seconds(*s.times.group(2, 3, 4, 5)), seconds(*s.times.group(7, 8, 9, 10))
        if end < start:
            warnings.append(f"cue {i + 1} ends before it starts")
        # a cue's own extent: a name right above belongs to it, and the first blank line ends it; what stands behind that is no part
        named = s.above[-1:] if s.above and _names_a_cue(s.above[-1][1]) else []
        close = next((at + len(x) + 1 for at, x in s.below if _blank(x) and at + len(x) < len(text)), None)
        whole = (None, None) if close is None else ((named[0][0] if named else s.at), close)
        yield cue(i + 1, start, end, "\n".join(x for _, x in s.below).strip("\n"), s.times.span(1), s.times.span(6), whole)


#: Words that open a block of another kind.
VTT_BLOCKS = ("NOTE", "STYLE", "REGION", "WEBVTT")


def _names_a_cue(line: str) -> bool:
    words = line.split()
    return bool(words) and "-->" not in line and words[0].upper() not in VTT_BLOCKS


def _ass_seconds(s: str) -> float:
    m = _ASS_CLOCK.fullmatch(s)
    if not m:
        raise Unreadable(f"no ASS timestamp: {s!r}")
    return seconds(*m.groups())


def read_ass(text: str, warnings: list[str]) -> Iterator[tuple]:
    section, columns, events, n = None, None, False, 0
    for begin, raw in lines_of(text):
        at = begin + len(raw) + 1
        line = raw.rstrip("\r")
        if m := re.fullmatch(r"\s*\[([^\]]+)\]\s*", line):
            section = m[1].strip().lower()
            events |= section == "events"
        elif section == "events" and (m := re.match(r"\s*(format|dialogue|comment)\s*:\s*", line, re.I)):
            if m[1].lower() == "format":
                columns = [x.strip().lower() for x in line[m.end() :].split(",")]
                if not {"start", "end"} <= {*columns}:
                    warnings.append("the Format line names no Start or End")
                    columns = None
                continue
            if columns is None:
                raise Unreadable("an event before any Format line")
            fields = line[m.end() :].split(",", len(columns) - 1)
            s, e = columns.index("start"), columns.index("end")
            if len(fields) <= max(s, e):
                warnings.append(f"an event of {len(fields)} fields, {len(columns)} declared")
                continue
            place = [begin + m.end()]
            for f in fields:
                place.append(place[-1] + len(f) + 1)
            try:
                times = _ass_seconds(fields[s]), _ass_seconds(fields[e])
            except Unreadable as bad:
                warnings.append(str(bad))
                continue
            spans = [(place[k], place[k + 1] - 1) for k in (s, e)]
            n += 1
            yield cue(n, *times, fields[-1] if len(fields) == len(columns) else "", *spans, (begin, min(at, len(text))))
    if not events:
        raise Unreadable("no [Events] section")


def read_vobsub(text: str, warnings: list[str], last: float = 2.0) -> Iterator[tuple]:
    i, held = 0, None
    for m in _IDX_LINE.finditer(text):
        start = seconds(*m.group(2, 3, 4, 5))
        if held:
            yield cue(i, held[0], start, "", held[1])
        i, held = i + 1, (start, m.span(1))
    if held:
        warnings.append("end times are derived")
        yield cue(i, held[0], held[0] + last, "", held[1])
    elif "# VobSub index file" not in text and not re.search(r"^id:\s", text, re.M):
        raise Unreadable("no timestamp lines and no index header")


def read_pgs(data: bytes, warnings: list[str]) -> Iterator[tuple]:
    """Captions between composition segments that show objects and those that clear or replace them."""
    at, shown, n, seen, bad = 0, None, 0, 0, 0
    while at + 13 <= len(data):
        if data[at : at + 2] != b"PG":
            bad += 1
            at = data.find(b"PG", at + 1)
            if at < 0:
                break
            continue
        pts, kind, size = struct.unpack(">xxIxxxxBH", data[at : at + 13])
        body = data[at + 13 : at + 13 + size]
        if len(body) < size:
            break
        seen += 1
        if kind == 0x16 and size >= 11:
            now = pts / 90000.0
            if shown is not None and now > shown:
                n += 1
                yield cue(n, shown, now)
            shown = now if body[10] else None
        at += 13 + size
    if not seen:
        raise Unreadable("PG magic but no whole segment")
    warnings += ["ends with a caption shown"] * (shown is not None) + [f"{bad} segments with bad magic"] * bool(bad)


def collected(read, what) -> tuple[Cues, list[str]]:
    out, warnings = Cues(), []
    for c in read(what, warnings):
        out.add(c)
    return out, warnings


READERS = {"srt": read_srt, "ass": read_ass, "vtt": read_vtt, "vobsub": read_vobsub}
HINTS = {".srt": "srt", ".ass": "ass", ".ssa": "ass", ".vtt": "vtt", ".idx": "vobsub"}


def sniff(text: str) -> dict[str, float]:
    """How much a text looks like each format, 0 to 1."""
    signed = text.lstrip("﻿").lstrip().startswith("WEBVTT")
    out = dict.fromkeys(READERS, 0.0)
    head = text[:8192]
    if (m := _SRT_LINE.search(head)) and not head.lstrip().startswith("WEBVTT"):
        numbered = any(_NUMBER.fullmatch(x) for x in head[: m.start()].split("\n")[-3:])
        out["srt"] = min(1.0, 0.6 + 0.3 * ("," in m[1]) + 0.1 * numbered)
    for part, size, weight in ((r"Script Info", 4096, 0.4), (r"V4\+? Styles", 4096, 0.3), (r"Events", 65536, 0.3)):
        out["ass"] += weight * bool(re.search(rf"^\s*\[{part}\]", text[:size], re.M | re.I))
    out["vtt"] = float(signed)
    out["vobsub"] = min(1.0, 0.6 * ("# VobSub index file" in head) + 0.2 * bool(re.search(r"^id:\s*\w+", head, re.M)) + 0.4 * bool(_IDX_LINE.search(head)))
    return out


def read_bytes(data: bytes, name: str = "") -> dict:
    """One file: the extension's format first, then the others by how they look; the first with cues wins."""
    row = dict(path=name, status="OK", reason="", format=None, encoding=None, bom=b"", text="", warnings=[], cues=Cues())
    if data[:2] == b"PG":
        try:
            row["cues"], row["warnings"] = collected(read_pgs, data)
            return row | {"format": "pgs"}
        except Unreadable as bad:
            return row | {"status": "ERROR", "reason": str(bad)}
    text, row["encoding"], row["bom"] = decode(data)
    row["text"] = text
    if not text.strip():
        return row | {"reason": "file is empty"}
    scores = sniff(text)
    order = sorted((k for k in scores if scores[k] > 0), key=lambda k: (-scores[k], k))
    hint = HINTS.get(name[name.rfind(".") :].lower() if "." in name else "")
    order = [hint, *(k for k in order if k != hint)] if hint else order
    empty, tried = None, []
    for kind in order:
        try:
            cues, warnings = collected(READERS[kind], text)
        except (Unreadable, ValueError) as bad:
            tried.append(f"{kind}: {bad}")
            continue
        if cues:
            return row | {"format": kind, "cues": cues, "warnings": warnings}
        tried.append(f"{kind}: no cues")
        empty = empty or kind
    if empty:
        return row | {"format": empty, "reason": f"read as {empty}; contains no cues"}
    return row | {"status": "ERROR", "reason": "no reader knows this file: " + ("; ".join(tried) or "nothing matched")}


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    """Files of ``read_bytes`` as Spark takes them."""
    ends = np.cumsum([0, *(len(r["cues"]) for r in rows)], dtype=np.int32)
    whole = rows[0]["cues"] if len(rows) == 1 else Cues()
    for r in rows if len(rows) > 1 else ():
        whole.extend(r["cues"])
    listed = pa.ListArray.from_arrays(pa.array(ends), whole.arrow())
    of = lambda k, kind: pa.array([r[k] for r in rows], kind)
    names = ("path", "status", "reason", "format", "encoding", "bom", "text", "warnings", "cues")
    kinds = (*[pa.string()] * 5, pa.binary(), pa.string(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([*map(of, names, kinds), listed], names)


#: Fixed value: bytes of files that make a batch.
BATCH = 4 << 20


def read_cue_files(files: DataFrame) -> DataFrame:
    """Rows of (path, content) to one row per file."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                data = content.as_py()
                size += len(data)
                held.append(read_bytes(data, path.as_py()))
                del data
                if size >= BATCH:
                    made = batch_of(held)
                    held, size = [], 0
                    yield made
                    del made
        if held:
            yield batch_of(held)

    return files.select("path", "content").mapInArrow(run, FILES)


def scan_cue_files(spark: SparkSession, path: str, pattern: str = "*.{srt,ass,ssa,vtt,idx,sup}") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return read_cue_files(files)


def cues_of(files: DataFrame) -> DataFrame:
    """One row per cue of the files that could be read."""
    return files.where("status = 'OK'").select("path", "format", F.explode("cues").alias("c")).select("path", "format", "c.*")
