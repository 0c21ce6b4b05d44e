"""Timestamps of subtitle formats, as column expressions.

A timestamp is read as what is left of it without its digits, which tells the
format, and as its numbers, whose widths are checked.  A text that is no timestamp
of the format gives null.  ``like`` is an original timestamp whose shape (digits,
separator, blanks around) the new one takes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs between the numbers, and least and greatest digits of hours, minutes, seconds, fraction.
SIGNS = {"srt": ("::,", "::.", ":,", ":."), "ass": ("::.", "::,"), "vtt": ("::.", ":."), "vobsub": (":::",)}
WIDTHS = {
    "srt": ((1, 18), (1, 3), (1, 2), (1, 3)),
    "ass": ((1, 2), (2, 2), (2, 2), (1, 3)),
    "vtt": ((2, 18), (2, 2), (2, 2), (3, 3)),
    "vobsub": ((1, 18), (2, 2), (2, 2), (1, 3)),
}
#: Widths that the original of a new timestamp may have, and what stands for one that is none.
LIKE_WIDTHS = ((1, 18), (1, 3), (1, 2), (1, 18))
DEFAULT = {"srt": "00:00:00,000", "ass": "0:00:00.00", "vtt": "00:00:00.000"}

BLANKS = " \t\n\x0b\f\r"


def _numbers(c: Column) -> tuple[Column, Column, list[Column]]:
    """(text without blanks around, its signs, its four numbers as text); hours are null if there are none."""
    t = F.trim(c, F.lit(BLANKS))
    parts = F.split(t, "[:,.]")
    of = lambda k: F.get(parts, F.size(parts) - k)
    return t, F.translate(t, "0123456789", ""), [F.when(F.size(parts) > 3, of(4)), of(3), of(2), of(1)]


def _wide(numbers: list[Column], widths) -> Column:
    ok = F.lit(True)
    for n, (least, most) in zip(numbers, widths, strict=True):
        ok = ok & F.coalesce(F.length(n).between(least, most), n.isNull())
    return ok


def _let(value: Column, then) -> Column:
    """``then`` of a value that is reckoned once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def parse_timestamp(c: Column, kind: str) -> Column:
    def read(x: Column) -> Column:
        _, signs, numbers = _numbers(x)
        h, m, s = (F.coalesce(n.try_cast("long"), F.lit(0)) for n in numbers[:3])
        milli = F.rpad(numbers[3], 3, "0").try_cast("long")
        return F.when(signs.isin(*SIGNS[kind]) & _wide(numbers, WIDTHS[kind]), (h * 3600 + m * 60 + s).cast("double") + milli / 1000.0)

    return _let(c, read)


def _padded(n: Column, width: Column) -> Column:
    s = n.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, F.lit("0")))


def _shaped(positive: Column, given: Column) -> Column:
    _, signs, (hh, mm, ss, frac) = _numbers(given)
    lead = F.substr(given, F.lit(1), F.length(given) - F.length(F.ltrim(given, F.lit(BLANKS))))
    trail = F.substr(given, F.length(F.rtrim(given, F.lit(BLANKS))) + 1)
    scale = F.pow(F.lit(10.0), F.length(frac)).cast("long")

    def write(total: Column) -> Column:
        whole = F.floor(total / scale).cast("long")
        h = F.floor(whole / 3600)
        hour = F.when(hh.isNull() & (h == 0), "").otherwise(F.concat(_padded(h, F.coalesce(F.length(hh), F.lit(2))), F.lit(":")))
        minute, second, part = _padded(F.floor(whole / 60) % 60, F.length(mm)), _padded(whole % 60, F.length(ss)), _padded(total % scale, F.length(frac))
        return F.concat(lead, hour, minute, F.lit(":"), second, F.right(signs, F.lit(1)), part, trail)

    return _let(F.bround(positive * scale, 0).cast("long"), write)


def format_timestamp(seconds: Column, kind: str, like: Column | None = None) -> Column:
    """A moment in the shape of ``like``; below zero it is zero, ties round to even."""
    positive = F.greatest(seconds, F.lit(0.0))
    if kind == "vobsub":
        ms = F.bround(positive * 1000, 0).cast("long")
        s = F.floor(ms / 1000)
        return F.format_string("%02d:%02d:%02d:%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, ms % 1000)
    plain = F.lit(DEFAULT[kind])
    if like is None:
        return _shaped(positive, plain)

    def own(x: Column) -> Column:
        _, signs, numbers = _numbers(x)
        return F.when(signs.isin(*SIGNS["srt"]) & _wide(numbers, LIKE_WIDTHS), x).otherwise(plain)

    return _let(_let(like, own), lambda given: _shaped(positive, given))


def clock(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour."""
    s = F.bround(seconds, 0).cast("long")
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))
