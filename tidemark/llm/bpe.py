"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of the bytes before a word says so, so equal
passages give equal chunks wherever they stand.  A chunk's tokens are remembered
and reused by all documents of a task; only new chunks are encoded.  Chunks are
then joined: where the pre-tokenizer is bound to break between two chunks their
tokens agree as they are, and elsewhere (cuts forced in text without such
places) all between the nearest sure breaks is encoded again, so that what
stands on either side agrees exactly.

Plain text is encoded by the merge ranks of the vocabulary file; text with
characters outside the blocks listed in PLAIN goes to the tokenizers library
itself, which knows its own character classes best.

A vocabulary file whose pre-tokens or merges are of another kind (known_shape)
goes to the library too, whole texts at a time.

Defined results: null and empty texts have no tokens; repeated rows stay
repeated; very long texts are cut into chunks like any other; ids fit 32 bits.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Average and greatest distance of cuts, in bytes of candidates seen.
MASK = 63
MAX_CHUNK = 8192
CACHE_CHUNKS = 40_000

#: ASCII but for odd separators, and Latin letters of two further blocks.
PLAIN = re.compile(r"[\t\n\r\x20-\x7E\xA1-\xAC\xAE-ɏ‘-”…€]*")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def known_shape(spec: dict) -> bool:
    """Whether a vocabulary file cuts and merges as the fast path and the cuts of chunks take it.

    That is: byte-level pre-tokens by the usual pattern without a space before
    the text, no normalizer, nothing that drops or joins ids, and merges whose
    order is that of the ids they make.
    """
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    merge = (m if isinstance(m, str) else " ".join(m) for m in model.get("merges", ()))
    made = [model["vocab"].get("".join(m.split(" ")), -1) for m in merge]
    usual = model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    return bool(level and not spec.get("normalizer") and usual and all(a < b for a, b in zip(made, made[1:], strict=False)) and min(made, default=0) >= 0)


class Codec:
    """Encoder and decoder of one byte-level vocabulary file (JSON of the tokenizers library)."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.plain = known_shape(spec)
        back = byte_alphabet()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        raw = {i: bytes(back[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
        size = max([*raw, *special.values()]) + 1
        self.pieces = [raw.get(i, b"") for i in range(size)]
        for t, i in special.items():
            self.pieces[i] = t.encode()
        self.numbers = [str(i) for i in range(size)]
        self.special = list(special)
        merges = {v: k for k, v in raw.items()}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def encode_piece(self, text: str) -> list[int]:
        if self.plain and PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def decode(self, ids) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def safe_places(data: np.ndarray) -> np.ndarray:
    """Places where pre-tokens always break: ASCII white space after what surely is none.

    Of the characters of several bytes, all that share the first bytes of a white
    space are passed over.
    """
    if len(data) < 2:
        return np.zeros(0, np.int64)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    one = (data > 32) & (data < 127)
    back = [np.r_[np.zeros(k, np.uint8), data[: len(data) - k]] for k in (1, 2)]
    two = (data >= 0x80) & (data < 0xC0) & (back[0] >= 0xC3) & (back[0] < 0xE0)
    three = (data >= 0x80) & (data < 0xC0) & (back[1] >= 0xE3) & (back[1] < 0xF0) & ~((back[1] == 0xE3) & (back[0] == 0x80))
    return np.flatnonzero(blank[1:] & (one | two | three)[:-1]) + 1


def cut_places(raw: bytes, mask: int = MASK, most: int = MAX_CHUNK) -> list[int]:
    """Content-defined cuts of UTF-8 bytes, all at the start of a character."""
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    if n < 2:
        return []
    at = safe_places(data)
    if len(at):
        h = np.zeros(len(at), np.uint32)
        for k in range(1, 9):  # the eight bytes before the place
            h = h * np.uint32(0x01000193) ^ data[np.maximum(at - k, 0)]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        cuts = at[(h >> np.uint32(9)) & np.uint32(mask) == 0].tolist()
    else:
        cuts = []
    out, last = [], 0
    for c in [*cuts, n]:
        while c - last > most:  # forced: the last safe place in reach, else any character
            k = np.searchsorted(at, last + most, "right") - 1
            f = int(at[k]) if k >= 0 and at[k] > last else last + most
            while f > last + 1 and data[f] & 0xC0 == 0x80:
                f -= 1
            out.append(f)
            last = f
        if c < n and c > last:
            out.append(c)
            last = c
    return out


def _agrees(left: bytes, right: bytes) -> bool:
    """Whether the pre-tokenizer is bound to break between the two."""
    edge = np.frombuffer(left[-3:] + right[:1], np.uint8)
    at = safe_places(edge)
    return len(at) > 0 and int(at[-1]) == len(edge) - 1


class Encoder:
    def __init__(self, codec: Codec, mask: int = MASK, most: int = MAX_CHUNK, cache: int = CACHE_CHUNKS):
        self.codec, self.mask, self.most, self.cache = codec, mask, most, cache
        self.young: dict[bytes, np.ndarray] = {}
        self.old: dict[bytes, np.ndarray] = {}
        self.encoded = self.reused = self.repaired = 0

    def chunk(self, raw: bytes) -> np.ndarray:
        """Tokens of a chunk, remembered over two generations of bounded size."""
        ids = self.young.get(raw)
        if ids is None:
            ids = self.old.get(raw)
            if ids is None:
                self.encoded += 1
                ids = np.array(self.codec.encode_piece(raw.decode("utf-8")), np.int32)
            else:
                self.reused += 1
            if len(self.young) >= self.cache:
                self.old, self.young = self.young, {}
            self.young[raw] = ids
        else:
            self.reused += 1
        return ids

    def join(self, pieces: list[bytes], ids: list[np.ndarray]) -> np.ndarray:
        """Tokens of pieces whose seams aren't sure, repaired by encoding anew.

        Encoded again is all from the last sure break of the first piece to the
        first one of the last piece; before and after, the tokens stand as they
        are.  Each byte is encoded twice at most, however many seams there are.
        """
        if len(pieces) == 1:
            return ids[0]
        self.repaired += len(pieces) - 1
        first, last = (safe_places(np.frombuffer(p, np.uint8)) for p in (pieces[0], pieces[-1]))
        x = int(first[-1]) if len(first) else 0
        y = int(last[0]) if len(last) else len(pieces[-1])
        i, j = self.tokens_before(ids[0], x), self.tokens_before(ids[-1], y)
        middle = b"".join([pieces[0][x:], *pieces[1:-1], pieces[-1][:y]])
        return np.concatenate([ids[0][:i], np.array(self.codec.encode_piece(middle.decode("utf-8")), np.int32), ids[-1][j:]])

    def tokens_before(self, ids: np.ndarray, place: int) -> int:
        ends = np.cumsum([0, *(len(self.codec.pieces[i]) for i in ids.tolist())])
        k = int(np.searchsorted(ends, place))
        assert ends[k] == place, "no token ends at a sure break"
        return k

    def encode(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode("utf-8", "replace")
        if not raw:
            return np.zeros(0, np.int32)
        if not self.codec.plain or any(x in text for x in self.codec.special):  # a special string may span a cut
            return np.array(self.codec.encode_piece(text), np.int32)
        cuts = [0, *cut_places(raw, self.mask, self.most), len(raw)]
        out, pieces, ids = [], [], []
        for x, y in zip(cuts, cuts[1:], strict=False):
            piece = raw[x:y]
            if pieces and _agrees(pieces[-1], piece):
                out.append(self.join(pieces, ids))
                pieces, ids = [], []
            pieces.append(piece)
            ids.append(self.chunk(piece))
        out.append(self.join(pieces, ids))
        return np.concatenate(out)


_OUT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False, **limits) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids``; a map without a shuffle."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        codec = Codec(path)
        encoder = Encoder(codec, **limits)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                n, sha, back, ids = [], [], [], []
                for x in part.column(1):
                    found = encoder.encode(x.as_py()).tolist()
                    n.append(len(found))
                    sha.append(hashlib.sha256(",".join(map(codec.numbers.__getitem__, found)).encode()).hexdigest())
                    back.append(hashlib.sha256(codec.decode(found).encode("utf-8")).hexdigest())
                    if with_ids:
                        ids.append(found)
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_OUT}" + (", ids array<int>" if with_ids else ""))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
