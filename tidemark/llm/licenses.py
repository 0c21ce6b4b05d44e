"""Licence scan with a generalised suffix automaton.

The automaton holds the words of all licence templates.  A text is streamed
through it and yields matching statistics: at each word, how many words up to it
stand together in some template, and by the suffix links of the state the same
for every other place of every template that agrees with fewer words.  Matches
of at least ``min_match`` words are chained per template, in order, with at most
``max_gap`` words passed over on either side between two of them, so that most
words are covered; a template whose chain covers enough of its words gives its
label.  Words that no template has reset the automaton.

The base phrases are templates too: a phrase ends at a word where the match is at
least as long as the phrase and the state descends from the phrase's own.

Defined results: null and empty texts have no words, no labels and score 0; of
chains that cover as many words the one that ends first, then starts last,
stands; repeated rows stay repeated; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Phrase words and label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public licence notices, by label.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2",),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "mit": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
}

MIN_MATCH = 3
MAX_GAP = 3
MIN_COVER = 0.8

#: Bytes that are no part of a word become spaces: ASCII but 0-9 and a-z.
_SPLIT = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPLIT).split()


class Automaton:
    """Generalised suffix automaton over word ids; every state knows its end places (template, word) but those of longer states below it."""

    def __init__(self, texts: list[list[int]]):
        self.next, self.link, self.length, self.ends = [{}], [-1], [0], [set()]
        for t, ids in enumerate(texts):
            last = 0
            for i, c in enumerate(ids):
                last = self._extend(last, c)
                self.ends[last].add((t, i))
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for v in order:  # a suffix ends wherever the longer string does
            if self.link[v] > 0:
                self.ends[self.link[v]] |= self.ends[v]

    def _new(self, length, nxt, link):
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p, q, c):
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last, c):
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        cur, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return cur

    def step(self, v: int, n: int, c: int) -> tuple[int, int]:
        """From state v with n matched words over word c."""
        while v and c not in self.next[v]:
            v = self.link[v]
            n = self.length[v]
        return (self.next[v][c], n + 1) if c in self.next[v] else (0, 0)

    def places(self, v: int, least: int) -> list[tuple[int, int, int]]:
        """(template, word, words that agree at most) of all places that end like state v, for at least ``least`` words."""
        out, seen, most = [], set(), self.length[v]
        while v > 0 and most >= least:
            out += [(t, i, most) for t, i in self.ends[v] - seen]
            seen, v = self.ends[v], self.link[v]
            most = self.length[v]
        return sorted(out)

    def walk(self, ids: list[int]) -> int:
        v = 0
        for c in ids:
            v = self.next[v][c]
        return v


class Scanner:
    """Templates by label, base phrases by label; ``scan`` gives one text's result."""

    def __init__(self, templates=None, base=None, min_match=MIN_MATCH, max_gap=MAX_GAP, min_cover=MIN_COVER):
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        templates, base = TEMPLATES if templates is None else templates, BASE if base is None else base
        texts = [(label, words_of(t)) for label, ts in templates.items() for t in ts]
        phrases = [(label, words_of(p)) for p, label in base.items()]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in texts + phrases for w in ws))}
        self.labels = [x for x, _ in texts]
        coded = [[self.ids[w] for w in ws] for _, ws in texts + phrases]
        self.sizes = [len(x) for x in coded]
        self.auto = Automaton(coded)
        self.pairs = np.zeros((len(self.ids), len(self.ids)), bool)
        for x in coded:
            self.pairs[x[:-1], x[1:]] = True
        own: dict[int, list] = {}
        for label, ws in phrases:
            if ws:
                own.setdefault(self.auto.walk([self.ids[w] for w in ws]), []).append((label, len(ws)))
        self.single = min_match < 2 or any(len(ws) == 1 for _, ws in phrases)
        # phrases that end where a state does: its own, or those of its suffixes
        self.ending: list[list] = []
        for v in range(len(self.auto.length)):
            found, u = [], v
            while u > 0:
                found += own.get(u, ())
                u = self.auto.link[u]
            self.ending.append(found)
        self.known: dict[int, list[tuple[int, int, int]]] = {}

    def statistics(self, codes: np.ndarray):
        """(place, state, matched words) wherever two words or more match; one, if a phrase or match may be so short."""
        if self.single:
            v = n = 0
            for i in np.flatnonzero(codes >= 0).tolist():
                if i and codes[i - 1] < 0:
                    v = n = 0
                v, n = self.auto.step(v, n, int(codes[i]))
                yield i, v, n
            return
        if len(codes) < 2:
            return
        a, b = codes[:-1], codes[1:]
        follow = (a >= 0) & (b >= 0)
        at = np.flatnonzero(follow)
        at = at[self.pairs[a[at], b[at]]]
        v = n = 0
        before = -2
        for i in at.tolist():
            if i != before + 1:
                v, n = self.auto.step(0, 0, int(codes[i]))
            v, n = self.auto.step(v, n, int(codes[i + 1]))
            before = i
            yield i + 1, v, n

    def matches(self, stats) -> dict[int, list[tuple[int, int, int]]]:
        """Per template the maximal matches of ``min_match`` words or more: (first word, words, first word in the template)."""
        open_: dict[tuple[int, int], list[int]] = {}  # by template and distance to it: last word, words
        done: dict[int, list[tuple[int, int, int]]] = {}

        def close(key, last, words):
            done.setdefault(key[0], []).append((last - words + 1, words, last - words + 1 - key[1]))

        for place, v, n in stats:
            if n < self.min_match:
                continue
            spots = self.known.get(v)
            if spots is None:
                spots = self.known[v] = self.auto.places(v, self.min_match)
            for t, i, most in spots:
                key, words = (t, place - i), min(n, most)
                held = open_.get(key)
                if held and held[0] != place - 1:
                    close(key, *held)
                open_[key] = [place, words]
            if len(open_) > 4096:
                for key in [k for k, h in open_.items() if h[0] < place]:
                    close(key, *open_.pop(key))
        for key, held in open_.items():
            close(key, *held)
        return done

    def chain(self, matches: dict[int, list[tuple[int, int, int]]]) -> list[tuple[int, float, int, int]]:
        """(template, share of its words, first word, end) of the chain of matches that covers most words.

        A match may be entered after its first word; so a chain is a path over
        words of matches, each as far on in the text as in the template or up to
        ``max_gap`` words further on either side.
        """
        out = []
        steps = range(1, self.max_gap + 2)
        for t, spans in matches.items():
            spans = sorted(spans)
            rows: dict[int, dict[int, tuple[int, int]]] = {}  # by word in the text, then in the template: words covered, first word
            active: list[tuple[int, int, int]] = []
            k, i, best = 0, 0, (0, 0, 0)
            while active or k < len(spans):
                if not active:
                    i = spans[k][0]
                while k < len(spans) and spans[k][0] == i:
                    active.append(spans[k])
                    k += 1
                near = [rows[i - x] for x in steps if i - x in rows]
                row = rows[i] = {}
                for first, _, there in active:
                    j = there + i - first
                    before = max((r[j - y] for r in near for y in steps if j - y in r), default=(0, i))
                    row[j] = (before[0] + 1, before[1])
                    best = max(best, (row[j][0], -i, row[j][1]))
                active = [s for s in active if s[0] + s[1] > i + 1]
                i += 1
                rows = {x: r for x, r in rows.items() if x >= i - self.max_gap - 1}
            covered, last, start = best
            out.append((t, covered / self.sizes[t], start, 1 - last))
        return out

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        get = self.ids.get
        codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        base, stats = [], []
        for place, v, n in self.statistics(codes):
            base += [(place - size + 1, label) for label, size in self.ending[v] if size <= n]
            stats.append((place, v, n))
        found = self.matches(stats)
        chained = self.chain({t: m for t, m in found.items() if t < len(self.labels)})
        spans = sorted((s, e, self.labels[t], round(c, 6)) for t, c, s, e in chained if c >= self.min_cover)
        plain = sorted({x for _, x in base})
        return {
            "n_words": len(words),
            "n_base": len(base),
            "first_word": min((p for p, _ in base), default=None),
            "last_word": max((p for p, _ in base), default=None),
            "base_labels": ",".join(plain),
            "labels": ",".join(sorted({*plain, *(x for _, _, x, _ in spans)})),
            "score": 1.0 if base else float(max((c for _, c, _, _ in chained), default=0.0)),
            "spans": [f"{x}:{s}-{e}" for s, e, x, _ in spans],
        }


_OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<string>"
_ARROW = pa.schema(
    [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.string()))]
)


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """One row per document; a map without a shuffle, the automaton goes with the task."""
    scanner = scanner or Scanner()

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                found = pa.RecordBatch.from_pylist([scanner.scan(x.as_py()) for x in part.column(1)], schema=_ARROW)
                yield pa.RecordBatch.from_arrays([part.column(0), *found.columns], names=["doc_id", *_ARROW.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_OUT}")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
