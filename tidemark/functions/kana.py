"""Kana to romaji, and phonetic matching of titles across scripts."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.pairing import accept_best, gram_top_k
from .text import bigrams, is_kana, phonetic_fold, sequence_ratio

#: Rows of the syllabary, vowels a i u e o; a dot where there is none.
ROWS = {
    "": "あいうえお", "k": "かきくけこ", "s": "さしすせそ", "t": "たちつてと", "n": "なにぬねの", "h": "はひふへほ", "m": "まみむめも", "y": "や.ゆ.よ", "r": "らりるれろ",
    "w": "わゐ.ゑを", "g": "がぎぐげご", "z": "ざじずぜぞ", "d": "だぢづでど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ",
}
#: Syllables that aren't spelt by their row.
IRREGULAR = {"し": "shi", "ち": "chi", "つ": "tsu", "ふ": "fu", "じ": "ji", "ぢ": "ji", "づ": "zu", "ん": "n", "ゔ": "vu", "ゕ": "ka", "ゖ": "ke"}
SMALL = {"ゃ": "ya", "ゅ": "yu", "ょ": "yo", "ぁ": "a", "ぃ": "i", "ぅ": "u", "ぇ": "e", "ぉ": "o", "ゎ": "wa"}
#: Stems that swallow the y of a small kana.
SWALLOW = ("sh", "ch", "j")


def syllables() -> dict[str, str]:
    """Spelling of every kana, and of every kana with a small one after it.

    A small kana takes the place of the vowel before it; a lone u turns to w.
    Doubled syllables stand under their own kana: they keep the y that others lose.
    """
    one = {k: row + v for row, kana in ROWS.items() for k, v in zip(kana, "aiueo", strict=True) if k != "."} | IRREGULAR
    two = {}
    for k, spelt in one.items():
        stem = "w" if spelt == "u" else spelt[:-1]
        first = "t" if spelt.startswith("ch") else spelt[0]
        two["っ" + k] = first + spelt
        for small, v in SMALL.items():
            two[k + small] = stem + (v.lstrip("y") if stem in SWALLOW else v)
            two["っ" + k + small] = first + spelt[:-1] + v
    return one | two


SYLLABLES = syllables()
#: A syllable, longest first; a long mark; a blank; a Latin letter or digit.
_SPELT = re.compile(rf"({'|'.join(sorted(SYLLABLES, key=len, reverse=True))})|(ー)|([\s・･])|([0-9A-Za-z])")


def to_romaji(text: str | None) -> str:
    plain = unicodedata.normalize("NFKC", text or "").translate({k: k - 96 for k in range(0x30A1, 0x30F7)})
    out = ""
    for kana, long, blank, latin in _SPELT.findall(plain):
        out += SYLLABLES.get(kana, "") + latin.lower() + (" " if blank else "")
        if long and out.endswith(("a", "i", "u", "e", "o")):
            out += out[-1]
    return " ".join(out.split())


def romaji(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(to_romaji)

    return run(c)


def skeleton(c: Column) -> Column:
    """Phonetic fold of a title, through romaji where it has kana."""
    return phonetic_fold(F.when(is_kana(c), romaji(c)).otherwise(c))


def best_titles(queries: DataFrame, titles: DataFrame, prefilter: int = 300, accept: float = 0.85, margin: float = 0.10) -> DataFrame:
    """``query, title, score`` of queries (id, text) with one clearly best title.

    Bigram Jaccard keeps ``prefilter`` titles, the sequence matcher scores them.
    """
    q, t = (d.select("id", skeleton(F.col("text")).alias("skel")) for d in (queries, titles))
    grams = lambda d: d.select("id", bigrams(F.replace("skel", F.lit(" "), F.lit(""))).alias("grams"))
    near = gram_top_k(grams(q), grams(t), prefilter)
    both = near.join(q.select(F.col("id").alias("query"), F.col("skel").alias("a")), "query").join(t.select(F.col("id").alias("title"), F.col("skel").alias("b")), "title")
    return accept_best(both.select("query", "title", sequence_ratio(F.col("a"), F.col("b")).alias("score")), accept, margin)
