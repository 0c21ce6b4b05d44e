"""Character encodings of cue files, guessed without hints."""

from __future__ import annotations

import re
import unicodedata

#: Byte-order marks and codecs, in the order they are tried.
BOMS = ((b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"))
CODECS = "utf-8 cp932 shift_jis euc-jp iso-2022-jp gb18030 big5 euc-kr cp1251 koi8-r cp1252 iso-8859-2 cp874 cp1256".split()
GOOD = ((0x20, 0x7E), (0x400, 0x4FF), (0x600, 0x6FF), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFF01, 0xFF60))


def _weight(c: str) -> int:
    """1 for a likely character, less than 0 for an unlikely one."""
    o = ord(c)
    if c in "\n\r\t" or any(a <= o <= b for a, b in GOOD):
        return 1
    if o < 32:
        return -2
    if o == 0xFFFD:
        return -5
    kind = unicodedata.category(c)
    if kind in ("Cn", "Co", "Cs"):
        return -3
    return 1 if kind[0] in "LNPZSM" else -1


def plausibility(text: str) -> float:
    """Share of weight on likely characters; runs of half-width kana count against."""
    known = {c: _weight(c) for c in set(text)}
    good = sum(1 for c in text if known[c] > 0)
    bad = sum(-known[c] for c in text if known[c] < 0) + sum(map(len, re.findall("[ｦ-ﾟ]{3,}", text)))
    return good / (good + bad) if good + bad else 0.0


def _by_nulls(data: bytes) -> str | None:
    """UTF-32 or UTF-16 without a mark, from where the zero bytes stand."""
    head = data[:4096]
    quads = [head[i : i + 4] for i in range(0, len(head) - len(head) % 4, 4)]
    if len(quads) >= 2:
        low, high = sum(q[2:] == b"\0\0" for q in quads), sum(q[:2] == b"\0\0" for q in quads)
        if max(low, high) >= 0.9 * len(quads) and low != high:
            return "utf-32-le" if low > high else "utf-32-be"
    if len(head) >= 4 and head.count(0) * 4 >= len(head):
        even, odd = head[: len(head) - len(head) % 2 : 2].count(0), head[1::2].count(0)
        if odd > 2 * even:
            return "utf-16-le"
        if even > 2 * odd:
            return "utf-16-be"
    return None


def _try(data: bytes, codec: str) -> str | None:
    try:
        return data.decode(codec)
    except (UnicodeDecodeError, LookupError):
        return None


def decode(data: bytes, least: float = 0.80) -> tuple[str, str, bytes]:
    """(text, codec, byte-order mark)."""
    if not data:
        return "", "utf-8", b""
    for bom, codec in BOMS:
        if data.startswith(bom):
            signed = codec == "utf-8-sig"
            text = _try(data if signed else data[len(bom) :], codec)
            if text is not None:
                return text, codec, b"" if signed else bom
            break
    for codec in (_by_nulls(data), "utf-8"):
        if codec and (text := _try(data, codec)) is not None:
            return text, codec, b""
    best = None  # one reading is held at a time, beside the best
    for codec in CODECS:
        if (text := _try(data, codec)) is not None:
            share = plausibility(text)
            best = best if best and best[0] >= share else (share, codec, text)
    if best and best[0] >= least:
        return best[2], best[1], b""
    return data.decode("latin-1"), "latin-1", b""


def encode_back(text: str, codec: str, bom: bytes = b"") -> bytes:
    return bom + text.encode(codec)
