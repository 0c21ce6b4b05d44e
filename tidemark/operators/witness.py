"""Whether what is heard in a video is what its cue file says there.

``heard``: video, start, text of transcript windows; ``cues``: video, at (moved
to the video's axis), text.  Both texts are normalised beforehand or here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import containment, nfkc


def normalise(c: Column, unicode_forms: bool = True) -> Column:
    """Letters and digits in lower case, without tags."""
    s = F.regexp_replace(c, r"\{[^}]*\}|\\[Nnh]|<[^>]*>", "")
    return F.lower(F.regexp_replace(nfkc(s) if unicode_forms else s, r"[^\p{L}\p{N}]+", ""))


def sample_windows(duration: Column, n: int = 10, width: float = 30.0) -> Column:
    """Starts of windows spread over a running time, with the first and the last."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.greatest(F.lit(0.0), duration * (i + 0.5) / n - width / 2))
    many = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), spread, F.array(duration - width))))
    none = F.array().cast("array<double>")
    return F.when(duration.isNull() | (duration <= 0), none).when(duration <= width, F.array(F.lit(0.0))).otherwise(many)


def outside(cues: DataFrame, most: int = 2) -> DataFrame:
    """Videos with more than ``most`` lines (start, end, duration) wholly before or after them."""
    early, late = F.count_if(F.col("end") <= 0).alias("early"), F.count_if(F.col("start") >= F.col("duration")).alias("late")
    return cues.groupBy("video").agg(early, late).where(F.col("early") + F.col("late") > most)


def written(heard: DataFrame, cues: DataFrame, shift: Column | float = 0.0, width: float = 30.0, margin: float = 3.0) -> DataFrame:
    """``video, start, said, text``: the lines of each window in order, joined."""
    o = F.lit(shift) if isinstance(shift, (int, float)) else shift
    cell = width + 2 * margin
    h = heard.select("video", "start", "said", (F.col("start") - margin + o).alias("lo"), (F.col("start") + width + margin + o).alias("hi"), *([] if isinstance(shift, (int, float)) else [o.alias("shift")]))
    h = h.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell).cast("long"), F.floor(F.col("hi") / cell).cast("long"))))
    c = cues.select("video", "at", "text", F.floor(F.col("at") / cell).cast("long").alias("cell"))
    hit = h.join(c, ["video", "cell"]).where("at >= lo and at <= hi")
    keys = [x for x in h.columns if x not in ("lo", "hi", "cell")]
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "")
    return hit.groupBy(*keys).agg(lines.alias("text"))


def score_windows(heard: DataFrame, cues: DataFrame, quiet: int = 8, empty: int = 4) -> DataFrame:
    """``video, start, said, here``: share of what is said that stands there; null if nothing can be compared."""
    w = written(heard, cues).select("video", "start", "text")
    both = heard.join(w, ["video", "start"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    fine = (F.length("said") >= quiet) & (F.length("text") >= empty)
    return both.select("video", "start", "said", F.when(fine, containment(F.col("said"), F.col("text"))).alias("here"))


def elsewhere(scored: DataFrame, cues: DataFrame, reach: float = 120.0, step: float = 0.5, margin: float = 3.0, empty: int = 4, width: float = 30.0) -> DataFrame:
    """Per scored window the best share at another place, and the middle of the shifts that reach it.

    A line stands in a window over one stretch of shifts, so between the ends of
    these stretches the text stays the same: a window meets its lines once and is
    compared once a text, not once a shift.
    """
    n = round(reach / step)
    near = max(k for k in range(n + 1) if k * step <= margin)  # shifts that are no other place
    lo, hi = F.col("start") - margin, F.col("start") + width + margin
    cell = width + 2 * margin + 2 * reach
    h = scored.where("here is not null").select("video", "start", "said", lo.alias("lo"), hi.alias("hi"))
    first, last = (F.floor((c + d) / cell).cast("long") for c, d in ((F.col("lo"), -n * step), (F.col("hi"), n * step)))
    h = h.withColumn("cell", F.explode(F.sequence(first, last)))
    c = cues.select("video", "at", "text", F.floor(F.col("at") / cell).cast("long").alias("cell"))
    hit = h.join(c, ["video", "cell"]).where((F.col("at") >= F.col("lo") - n * step) & (F.col("at") <= F.col("hi") + n * step))
    # first and last shift of a line: the guess or one beside it, by the test itself
    a, b = F.ceil((F.col("at") - F.col("hi")) / step).cast("int"), F.floor((F.col("at") - F.col("lo")) / step).cast("int")
    a = F.when(F.col("at") <= F.col("hi") + (a - 1) * step, a - 1).when(F.col("at") <= F.col("hi") + a * step, a).otherwise(a + 1)
    b = F.when(F.col("at") >= F.col("lo") + (b + 1) * step, b + 1).when(F.col("at") >= F.col("lo") + b * step, b).otherwise(b - 1)
    lines = F.sort_array(F.collect_list(F.struct("at", "text", a.alias("a"), b.alias("b"))))
    w = hit.groupBy("video", "start", "said").agg(lines.alias("lines"))
    ends = F.flatten(F.transform("lines", lambda x: F.array(F.greatest(x["a"], F.lit(-n)), F.least(x["b"], F.lit(n)) + 1)))
    ends = F.array_sort(F.array_distinct(F.concat(ends, F.array(*map(F.lit, (-n, -near, near + 1, n + 1))))))
    w = w.withColumn("ends", ends).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("ends") - 2)))
    w = w.select("video", "start", "said", "lines", F.get("ends", F.col("i")).alias("k"), (F.get("ends", F.col("i") + 1) - 1).alias("to")).where((F.col("k") > near) | (F.col("to") < -near))
    w = w.withColumn("here", F.filter("lines", lambda x: (x["a"] <= F.col("k")) & (x["b"] >= F.col("k")))).where(F.size("here") > 0)
    w = w.select("video", "start", "said", "k", "to", F.array_join(F.transform("here", lambda x: x["text"]), "").alias("text")).where(F.length("text") >= empty)
    s = w.select("video", "start", containment(F.col("said"), F.col("text")).alias("share"), (F.col("k") * step).alias("d0"), (F.col("to") * step).alias("d1"))
    g = s.groupBy("video", "start").agg(F.max("share").alias("there"), F.collect_list(F.struct("share", "d0", "d1")).alias("each"))
    ties = F.filter("each", lambda x: x["share"] >= F.col("there") - 1e-9)
    middle = -(F.array_min(F.transform(ties, lambda x: x["d0"])) + F.array_max(F.transform(ties, lambda x: x["d1"]))) / 2
    return g.select("video", "start", "there", middle.alias("shift"))


def check(heard: DataFrame, cues: DataFrame, match: float = 0.23, min_share: float = 0.75, min_scored: int = 4, gain: float = 0.15, least: float = 0.5) -> DataFrame:
    """``video, scored, hits, passed, reason``."""
    s = score_windows(heard, cues)
    e = s.join(elsewhere(s, cues), ["video", "start"], "left")
    better = (F.col("there") >= least) & (F.col("there") - F.col("here") >= gain)
    g = e.groupBy("video").agg(F.count("here").alias("scored"), F.count_if(F.col("here") >= match).alias("hits"), F.count_if(better).alias("better"))
    reason = F.when(F.col("better") > 0, "fits better elsewhere").when(F.col("scored") < min_scored, "too few windows").when(F.col("hits") < min_share * F.col("scored"), "says something else").otherwise("")
    return g.select("video", "scored", "hits", (reason == "").alias("passed"), reason.alias("reason"))
