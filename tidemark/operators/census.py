"""Round trips: files against what was made of them, byte for byte.

    seen = outcomes(compare(files, "before", "after"))       # a row a file
    table = against(rates(seen, ["ext"]), baseline, ["ext"]) # shares, and what changed since

Bytes are met in the JVM, in blocks of 65,536, then of 256 in the first block that
differs, then one by one.

Defined results: two nulls are the same, one null and no bytes too; equal files
have no place; a file that begins another differs at the end of the shorter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = (65_536, 256, 1)
SHOWN = 8


def _parted(a: Column, b: Column, start: Column, end: Column, block: int) -> Column:
    """Where the first block begins that differs between two places, ``end`` if none does."""
    size = lambda i: F.least(F.lit(block), end - start - i * block).cast("int")
    part = lambda c, i: F.substring(c, (start + i * block + 1).cast("int"), size(i))
    steps = F.ceil((end - start) / block).cast("int")
    blocks = F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.coalesce(start + F.get(F.filter(blocks, lambda i: part(a, i) != part(b, i)), F.lit(0)) * block, end)


def first_difference(files: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``files`` with the number of bytes that two columns have in common at their beginnings, null where they are equal."""
    out = files.withColumn("__lo", F.lit(0)).withColumn("__hi", F.least(F.octet_length(a), F.octet_length(b)))
    for block in BLOCKS:
        out = out.withColumn("__lo", _parted(F.col(a), F.col(b), F.col("__lo"), F.col("__hi"), block)).withColumn("__hi", F.least(F.col("__hi"), F.col("__lo") + block))
    return out.withColumn(name, F.when(F.col(a) != F.col(b), F.col("__lo"))).drop("__lo", "__hi")


def compare(files: DataFrame, before: str, after: str) -> DataFrame:
    """``files`` without the two columns, with ``before_bytes, after_bytes, kind, at, was, is_now``."""
    none = F.lit(b"")
    x = files.withColumn("__a", F.coalesce(before, none)).withColumn("__b", F.coalesce(after, none)).drop(before, after)
    x = first_difference(x, "__a", "__b", "at").withColumns({"before_bytes": F.octet_length("__a"), "after_bytes": F.octet_length("__b")})
    short = F.least("before_bytes", "after_bytes")
    kind = F.when(F.col("at").isNull(), "same").when(F.col("at") == short, "beginning").when(F.col("before_bytes") == F.col("after_bytes"), "changed").otherwise("changed and resized")
    there = lambda c: F.when(F.col("at").isNotNull(), F.substring(c, (F.col("at") + 1).cast("int"), F.lit(SHOWN)))
    return x.withColumns({"kind": kind, "was": there(F.col("__a")), "is_now": there(F.col("__b"))}).drop("__a", "__b")


def outcomes(compared: DataFrame) -> DataFrame:
    """``outcome`` of compared files by their ``status``: error, empty and read only say so, read files are identical or a mismatch."""
    told = F.col("status").isin("error", "empty", "read only")
    return compared.withColumn("outcome", F.when(told, F.col("status")).when(F.col("kind") == "same", "identical").otherwise("mismatch"))


def rates(seen: DataFrame, keys: list[str]) -> DataFrame:
    """``files, identical, mismatches, empties, errors, rate`` of groups; the rate is of all files that aren't read only."""
    n = lambda what: F.count_if(F.col("outcome") == what)
    g = seen.where("outcome <> 'read only'").groupBy(*keys)
    return g.agg(F.count("*").alias("files"), n("identical").alias("identical"), n("mismatch").alias("mismatches"), n("empty").alias("empties"), n("error").alias("errors"), F.round(n("identical") / F.count("*"), 6).alias("rate"))


def against(now: DataFrame, baseline: DataFrame, keys: list[str], tolerance: float = 0.001) -> DataFrame:
    """``now`` with the ``baseline`` rate of its group and ``verdict``: new, worse, better or level."""
    far = F.when(F.col("baseline").isNull(), "new").when(F.col("rate") < F.col("baseline") - tolerance, "worse").when(F.col("rate") > F.col("baseline") + tolerance, "better").otherwise("level")
    known = baseline.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("rate").alias("baseline"))
    same = [now[k].eqNullSafe(known[f"__{k}"]) for k in keys]
    return now.join(known, same, "left").drop(*[f"__{k}" for k in keys]).withColumn("verdict", far)
