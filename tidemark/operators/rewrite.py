"""Writing cue files back: only timestamps and dropped blocks change.

Cues come one by one and edits are columns, so that a task holds a file's text, the
new one and about 40 bytes an edit.
"""

from __future__ import annotations

import io
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.encoding import encode_back
from ..sources.formats import SPANS

WRITABLE = ("srt", "ass", "vtt")
_NUMBER = re.compile(r"[^\S\n]*(\d+)[^\S\n]*(?=\n)")
_PLAIN = {"srt": "00:00:00,000", "ass": "0:00:00.00", "vtt": "00:00:00.000"}


def _shape(like: str) -> tuple[list[int], str] | None:
    """(digits of hours, if any, minutes, seconds and fraction, sign before the fraction) of a timestamp; None if it is none."""
    body = like.strip()
    sign = "," if "," in body else "."
    *clock, last = body.split(":")
    parts = [*clock, *last.split(sign)]
    sizes = [len(x) for x in parts]
    whole = len(clock) in (1, 2) and len(parts) == len(clock) + 2 and all(x.isdecimal() for x in parts)
    return (sizes, sign) if whole and sizes[-3] <= 3 and sizes[-2] <= 2 else None


def format_like(t: float, kind: str, like: str | None = None) -> str:
    """A moment in the shape of another timestamp of the file."""
    like = like if like and _shape(like) else _PLAIN[kind]
    sizes, sign = _shape(like)
    ticks = round(max(0.0, t) * 10 ** sizes[-1])
    whole, rest = divmod(ticks, 10 ** sizes[-1])
    parts = [f"{whole // 60 % 60:0{sizes[-3]}d}", f"{whole % 60:0{sizes[-2]}d}{sign}{rest:0{sizes[-1]}d}"]
    if len(sizes) == 4 or whole >= 3600:
        parts.insert(0, f"{whole // 3600:0{sizes[0] if len(sizes) == 4 else 2}d}")
    body = like.strip()
    at = like.index(body)
    return f"{like[:at]}{':'.join(parts)}{like[at + len(body) :]}"


def apply_edits(text: str, edits: Iterable[tuple[int, int, str]]) -> str:
    """Replace spans; all outside them stays as it is, spans must not overlap."""
    lo, hi, ends, said = array("q"), array("q"), array("q", [0]), io.StringIO()
    for a, b, new in edits:
        lo.append(a)
        hi.append(b)
        ends.append(ends[-1] + said.write(new))
    news, at, out = said.getvalue(), 0, io.StringIO()
    order = np.lexsort((np.array(hi), np.array(lo)))
    a, b = np.array(lo)[order], np.array(hi)[order]
    if ((a[1:] == a[:-1]) & (b[1:] == b[:-1])).any():  # of equal places the text decides
        order = sorted(order, key=lambda i: (lo[i], hi[i], news[ends[i] : ends[i + 1]]))
    order = array("q", order)
    for i in order:
        a, b = lo[i], hi[i]
        if a < at or b < a or b > len(text):
            raise ValueError(f"span ({a}, {b}) overlaps another or leaves the text")
        out.write(text[at:a])
        out.write(news[ends[i] : ends[i + 1]])
        at = b
    out.write(text[at:])
    return out.getvalue()


def render(text: str, kind: str, cues: Iterable[dict], segments: list[dict]) -> str:
    """Cues moved by piecewise offsets, with those that lose their place removed and SRT renumbered.

    A cue goes if its start lies in a removed span or its end moves to zero or
    before; the others keep their length.
    """
    if kind not in WRITABLE:
        raise ValueError(f"{kind} can be read but not written")
    turns = [(a["split"] - a["offset"], a["offset"], b["offset"]) for a, b in zip(segments, segments[1:], strict=False)]
    gone = [(t, t + o - n) for t, o, n in turns if n < o]
    number = 0

    def edits() -> Iterator[tuple[int, int, str]]:
        nonlocal number
        for c in cues:
            offset = segments[0]["offset"]
            for t, _, n in turns:
                if c["start"] >= t:
                    offset = n
            start, end = c["start"] + offset, c["end"] + offset
            if any(a <= c["start"] < b for a, b in gone) or end <= 0:
                if c["block_at"] is None:
                    raise ValueError("a cue to remove has no known extent")
                yield c["block_at"], c["block_to"], ""
                continue
            number += 1
            for a, b, t in ((c["start_at"], c["start_to"], start), (c["end_at"], c["end_to"], end)):
                yield a, b, format_like(t, kind, text[a:b])
            if kind == "srt" and c["block_at"] is not None and (m := _NUMBER.match(text, c["block_at"])) and m[1] != str(number):
                yield *m.span(1), str(number)
        if not number:
            raise ValueError("no cue survives")

    return apply_edits(text, edits())


def _cues(listed: pa.Array, step: int = 4096) -> Iterator[dict]:
    """Times and places of a file's cues, a stretch of them at a time."""
    names = ("start", "end", *SPANS)
    columns = [listed.field(k) for k in names]
    for at in range(0, len(listed), step):
        for x in zip(*[c.slice(at, step).to_pylist() for c in columns], strict=True):
            yield dict(zip(names, x, strict=True))


def render_files(files: DataFrame) -> DataFrame:
    """Rows of read files with ``segments`` to (path, status, reason, content)."""

    def one(path, kind, encoding, bom, text, cues, segments) -> list:
        try:
            new = render(text.as_py(), kind.as_py(), _cues(cues.values), segments.as_py())
            return [path.as_py(), "OK", "", encode_back(new, encoding.as_py(), bom.as_py() or b"")]
        except (ValueError, LookupError) as bad:
            return [path.as_py(), "ERROR", str(bad), None]

    def run(batches):
        names, kinds = ("path", "status", "reason", "content"), (*[pa.string()] * 3, pa.binary())
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(one(*row), kinds, strict=True)], names)

    return files.select("path", "format", "encoding", "bom", "text", "cues", "segments").mapInArrow(run, "path string, status string, reason string, content binary")
