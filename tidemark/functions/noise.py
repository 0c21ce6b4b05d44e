"""Words of file names that tell how a release was made, not what it is.

A name is looked at as runs of word characters.  What starts at a run is spelt with
the two or three runs behind it, as it stands or without blanks, and looked up among
plain words; whether a short word is a tag is told by the characters on either side
of its run.  All is decided on the name as it came, in one pass.
"""

from __future__ import annotations

import re

#: Heights of pictures, and letters behind them.
HEIGHTS = ("2160", "1440", "1080", "1088", "720", "576", "540", "480", "360")
SCANS = ("p", "i")
#: Words for sizes, sound, codecs, depths, sources and rates, as they are spelt.
SIZES = ("4k", "uhd", "fhd", "hd", "sd")
AUDIO = ("ddp", "dd", "dd+", "eac3", "ac3", "aac", "dts", "dtshd", "truehd", "atmos", "flac", "opus", "mp3", "pcm")
CODECS = ("x264", "x265", "h264", "h265", "x.264", "x.265", "h.264", "h.265", "hevc", "avc", "av1", "vp9", "xvid", "divx", "nvenc")
DEPTHS = ("hi10", "hi10p", "ma10", "ma10p")
SOURCES = (
    "bd", "bdrip", "bdmv", "bdbox", "bluray", "blu-ray", "web", "webdl", "web-dl", "webrip", "web-rip", "hdtv", "tvrip", "dvd", "dvdrip", "dvdiso", "r2", "r2j", "r2dvd", "remux", "vhs",
    "laserdisc", "ld",
)
RATES = ("yadif", "qsv", "kfmvfr", "vfr", "cfr")
#: Words of numbers, with blanks between or without.
BITS, CHANNELS, FRAMES, QUALITY = ("10bit", "10bits", "8bit", "8bits"), ("ch", "channel", "channels"), "fps", "crf"
#: Words that may have a number behind them.
NUMBERED = ("yadif", "qsv")
#: Marks that are noise wherever they stand.
MARKS = ("字幕", "外挂", "内嵌", "简体", "繁體", "简日", "繁日")
#: Words that are noise only as a tag, and platforms that are between blanks too.
TAGS = (
    "repack", "proper", "internal", "extended", "uncut", "limited", "complete", "final", "remux", "nf", "amzn", "dsnp", "hmax", "atvp", "max", "cr", "funi", "hulu", "netflix",
    "amazon", "disney", "ja", "jp", "jpn", "en", "eng", "zh", "chs", "cht", "kor", "ko", "cc", "sdh", "forced", "字",
)
PLATFORMS = ("nf", "amzn", "dsnp", "hmax", "atvp")

_PLAIN = {*SIZES, *AUDIO, *CODECS, *DEPTHS, *SOURCES, *RATES, *(h + s for h in HEIGHTS for s in SCANS)}
_MARK = re.compile("|".join(MARKS))
#: Runs that a phrase may have: a word of two parts and a layout of two digits.
LONGEST = 4


def _digits(s: str, least: int, most: int) -> bool:
    return least <= len(s) <= most and s.isdecimal()


def _layout(s: str) -> bool:
    """Two digits with a point between, as of channels."""
    return len(s) == 3 and s[1] == "." and (s[0] + s[2]).isdecimal()


def _as_spelt(word: str) -> bool:
    stem = word.rstrip("0123456789")
    return word in _PLAIN or stem in NUMBERED or (stem in ("mpeg", "mpeg-") and len(word) == len(stem) + 1)


def _with_number(spelt: str) -> bool:
    """Pictures (width x height), frames a second, quality, bits, channels, and sound with its layout, in one part or with blanks before or behind the word."""
    wide, _, high = spelt.replace("×", "x").partition("x")
    if _digits(wide.rstrip(), 3, 4) and _digits(high.lstrip(), 3, 4):
        return True
    parts = spelt.split()
    word = "".join(parts)
    if len(parts) > 2:
        return False
    first, last = parts[0], parts[-1]
    if word.endswith(FRAMES):
        whole, point, part = word.removesuffix(FRAMES).partition(".")
        return _digits(whole, 2, 3) and (not point or part.isdecimal()) and (len(parts) == 1 or last == FRAMES)
    if word.startswith(QUALITY):
        return word.removeprefix(QUALITY).isdecimal() and (len(parts) == 1 or first == QUALITY)
    if _layout(word[:3]) and word[3:] in CHANNELS:
        return len(parts) == 1 or last in CHANNELS
    if _layout(word[-3:]) and word[:-3] in AUDIO:
        return len(parts) == 1 or first in AUDIO
    return word in BITS and (len(parts) == 1 or first.isdecimal())


def _phrase(name: str, runs: list[tuple[int, int]], i: int) -> int:
    """How many runs from the i-th on are noise together; 0 if none."""
    for n in range(min(LONGEST, len(runs) - i), 0, -1):
        word = name[runs[i][0] : runs[i + n - 1][1]].lower()
        if _as_spelt(word) or _with_number(word):
            return n
    return 0


def _tag(name: str, a: int, b: int) -> tuple[int, int] | None:
    """The stretch to drop where the run [a, b) is a tag: between brackets, behind a dot, or a platform on its own."""
    word, left, right = name[a:b].lower(), name[a - 1 : a], name[b : b + 1]
    if len(word) == 8 and left == "[" and right == "]" and not set(word) - set("0123456789abcdef"):
        return a - 1, b + 1
    if word in TAGS:
        inner = len(name[:a].rstrip()), len(name) - len(name[b:].lstrip())
        if name[inner[0] - 1 : inner[0]] in ("[", "(") and name[inner[1] : inner[1] + 1] in ("]", ")"):
            return inner
        if left == "." and right in (".", "[", "]"):
            return (a - 1, b) if not right else (a, b)
        if left == "." and not right:
            return a - 1, b
    if word in PLATFORMS and (left == "[" or left.isspace()) and (right == "]" or right.isspace()):
        return a, b
    return None


def strip(name: str) -> str:
    """A name with a blank for each stretch of noise."""
    runs = [m.span() for m in re.finditer(r"\w+", name)]
    gone, i = [m.span() for m in _MARK.finditer(name)], 0
    while i < len(runs):
        a, b = runs[i]
        n = _phrase(name, runs, i)
        if tag := _tag(name, a, b):
            gone.append(tag)
        elif n:
            gone.append((a, runs[i + n - 1][1]))
            i += n - 1
        elif i + 1 < len(runs) and b - a > 1 and name[b - 2].isascii() and name[b - 2].isalpha() and _layout(name[b - 1 : runs[i + 1][1]]):
            gone.append((b - 1, runs[i + 1][1]))  # a layout right behind a word
            i += 1
        i += 1
    out, at = [], 0
    for a, b in sorted(gone):
        if a >= at:
            out += [name[at:a], " "]
        at = max(at, b)
    return re.sub(r"\s{2,}", " ", "".join([*out, name[at:]])).strip()
