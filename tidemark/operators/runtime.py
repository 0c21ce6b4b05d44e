"""Running time: where a cue stream ends, and whether it can belong to a video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(c: Column) -> Column:
    """A positive finite number, else null."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (x > 0) & (x < float("inf")), x)


def content_end(cues: DataFrame, keys: list[str], start: str = "start", orphan_gap: float = 300.0) -> DataFrame:
    """Per group the last start once trailing starts behind a gap are walked over.

    The walk goes back while the gap before a start is too large, so the end is
    the last start whose gap isn't: a window with ``lag`` and two aggregates.
    """
    x = F.col(start).cast("double")
    ok = cues.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(*keys, x.alias("t"))
    gap = F.col("t") - F.lag("t").over(Window.partitionBy(*keys).orderBy("t"))
    end = ok.withColumn("gap", gap).groupBy(*keys).agg(
        F.max(F.when(F.col("gap") <= orphan_gap, F.col("t"))).alias("held"), F.min("t").alias("first")
    )
    e = F.coalesce("held", "first")
    return end.select(*keys, F.when(e > 0, e).alias("content_end"))


def runtime_verdict(video: Column, subtitle: Column, cues: Column | None = None, long_ratio: float = 1.25, long_absolute: float = 120.0, min_cues: int = 5) -> Column:
    """impossible, plausible or unknown."""
    v, s = usable(video), usable(subtitle)
    few = F.coalesce(cues < min_cues, F.lit(False)) if cues is not None else F.lit(False)
    return (
        F.when(v.isNull() | s.isNull() | few, "unknown")
        .when((s > v * long_ratio) & (s - v > long_absolute), "impossible")
        .otherwise("plausible")
    )


def runtime_score(video: Column, subtitle: Column, long_scale: float = 0.0325, short_scale: float = 0.065) -> Column:
    """1 for equal running times, falling with the difference; null if one is unknown."""
    v, s = usable(video), usable(subtitle)
    d = (s - v) / v
    return 1 / (1 + F.abs(d) / F.when(d > 0, long_scale).otherwise(short_scale))


def proximity(a: Column, b: Column) -> Column:
    """How near two files lie, by their directories."""
    da, db = (F.regexp_extract(x, "^(.*)/[^/]*$", 1) for x in (a, b))
    pa_, pb = (F.regexp_extract(x, "^(.*)/[^/]*$", 1) for x in (da, db))
    root_a, root_b = (F.regexp_extract(x, "^(/?[^/]+)", 1) for x in (da, db))
    inside = F.startswith(da, F.concat(db, F.lit("/"))) | F.startswith(db, F.concat(da, F.lit("/")))
    return (
        F.when(da == db, 1.0)
        .when(inside, 0.7)
        .when((pa_ == pb) & (pa_ != ""), 0.5)
        .when((root_a == root_b) & (root_a != ""), 0.2)
        .otherwise(0.0)
    )
