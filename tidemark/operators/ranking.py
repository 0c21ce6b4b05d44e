"""Choosing one winner per slot, and settling what slots claim from each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column, bad: float = 0.0) -> Column:
    x = c.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), bad).otherwise(x)


def rank_candidates(edges: DataFrame) -> DataFrame:
    """Edges per video in order: identity, score, proximity, path.

    Speculative edges count only where the identity is certain.
    """
    order = F.when(F.col("identity") == "same", 0).when(F.col("identity") == "unsure", 1).otherwise(2)
    w = Window.partitionBy("video").orderBy(order, F.col("score").desc(), F.col("proximity").desc(), "subtitle")
    return edges.where("not speculative or identity = 'same'").withColumn("rank", F.row_number().over(w))


def rank_slot(candidates: DataFrame) -> DataFrame:
    """Candidates of a (video, lang) slot in order of seven keys."""
    w = Window.partitionBy("video", "lang").orderBy(
        F.col("confident").desc(), F.col("hearing_impaired").asc(), finite(F.col("cues")).desc(), F.col("name_matches").desc(),
        finite(F.col("content_end")).desc(), finite(F.col("segments"), 1e6).asc(), "path",
    )
    return candidates.withColumn("rank", F.row_number().over(w))


def plan_slots(candidates: DataFrame, keep_all: bool = False, unknown: str = "und") -> DataFrame:
    """``action`` of each candidate: write, supersede or keep.

    A slot without a confident candidate writes nothing; the best confident one is
    written (all of them with ``keep_all``); the rest is superseded but for
    speculative ones and slots of unknown language.
    """
    ranked = rank_slot(candidates).withColumn("any", F.max(F.col("confident").cast("int")).over(Window.partitionBy("video", "lang")))
    win = F.col("confident") if keep_all else F.col("confident") & (F.col("rank") == 1)
    lose = (F.col("any") == 1) & ~F.col("speculative") & (F.col("lang") != unknown) & F.lit(not keep_all)
    return ranked.withColumn("action", F.when(win, "write").when(lose, "supersede").otherwise("keep")).drop("any")


def choose_reference(tracks: DataFrame, min_cues: int = 5) -> DataFrame:
    """Per video the track with most cues; then default, not forced, lowest index."""
    w = Window.partitionBy("video").orderBy(F.col("n_cues").desc(), F.col("is_default").desc(), F.col("forced").asc(), "index")
    return tracks.where(F.col("n_cues") >= min_cues).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def separated(scored: DataFrame) -> DataFrame:
    """Per subtitle its best candidate, and whether it differs from the next in (proximity, gap)."""
    w = Window.partitionBy("subtitle").orderBy(F.col("proximity").desc(), F.col("gap").asc_nulls_last(), "video")
    key = F.struct("proximity", "gap")
    ranked = scored.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead(key).over(w))
    same = F.col("next").isNotNull() & F.col("proximity").eqNullSafe(F.col("next.proximity")) & F.col("gap").eqNullSafe(F.col("next.gap"))
    return ranked.where("r = 1").select("subtitle", "video", "proximity", "gap", (~same).alias("separated"))


def target_collisions(slots: DataFrame, target: str = "target") -> DataFrame:
    """Slots with ``collides``: another slot wants the same target, so neither is written."""
    n = slots.select(target, "video", "lang").distinct().groupBy(target).agg(F.count("*").alias("n"))
    return slots.join(n, target, "left").withColumn("collides", F.coalesce(F.col("n") > 1, F.lit(False))).drop("n")


def ownership(plan: DataFrame) -> DataFrame:
    """A file that any slot writes from is superseded by none."""
    owned = plan.where("action = 'write'").select("path").distinct().withColumn("owned", F.lit(True))
    p = plan.join(owned, "path", "left")
    return p.withColumn("action", F.when((F.col("action") == "supersede") & F.col("owned"), "keep").otherwise(F.col("action"))).drop("owned")


def settle_ownership(plan: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """``plan`` (video, lang, path, action, target) after two rules on files that several videos need.

    A write in place, over a source that another video's slot also answers with,
    is refused; a file that any slot still writes from, or that answers a video
    this run skipped as settled (``answers``: path, video), is superseded by none.
    """
    claims = plan.where("action = 'write'").select("path", "video")
    if answers is not None:
        claims = claims.union(answers.select("path", "video"))
    shared = claims.distinct().groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit(True).alias("shared"))
    p = plan.join(shared, "path", "left")
    over = (F.col("action") == "write") & (F.col("target") == F.col("path")) & F.coalesce("shared", F.lit(False))
    p = p.withColumn("action", F.when(over, "refuse").otherwise(F.col("action"))).drop("shared")
    owned = p.where("action = 'write'").select("path")
    if answers is not None:
        owned = owned.union(answers.select("path"))
    p = p.join(owned.distinct().withColumn("owned", F.lit(True)), "path", "left")
    return p.withColumn("action", F.when((F.col("action") == "supersede") & F.col("owned"), "keep").otherwise(F.col("action"))).drop("owned")


def distinguishing_tags(candidates: DataFrame, most: int = 24) -> DataFrame:
    """``candidates`` (video, lang, path, stem, video_stem, seq) with ``tag``, which tells those of a slot apart.

    What a stem has besides the video's; none for the first that is the video's
    own; the head of a digest of the path where nothing is left or another has it.
    """
    stem, own = F.lower("stem"), F.lower("video_stem")
    plain = (own != "") & (stem == own)
    at = F.instr(stem, own)
    left = F.when((own != "") & (at > 0), F.concat(F.substr(stem, F.lit(1), at - 1), F.substr(stem, at + F.length(own)))).otherwise(F.col("stem"))
    left = F.substring(F.regexp_replace(left, r"[^\p{L}\p{N}_-]", ""), 1, most)
    digest = F.substring(F.sha1(F.col("path").cast("binary")), 1, 8)
    c = candidates.withColumn("__left", F.when(plain, "").otherwise(F.when(left == "", digest).otherwise(left)))
    first = F.row_number().over(Window.partitionBy("video", "lang", F.lower("__left")).orderBy("seq", "path")) == 1
    return c.withColumn("tag", F.when(~first, digest).when(F.col("__left") != "", F.col("__left"))).drop("__left")


def mirror_root(folders: DataFrame) -> DataFrame:
    """``root``: the deepest folder above all of ``folders`` (folder), in one row; null without any.

    Partial minima and maxima suffice: what the first and the last folder in order share, all share.
    """
    ends = folders.agg(F.min("folder").alias("a"), F.max("folder").alias("b"))
    a, b = F.split("a", "/"), F.split("b", "/")
    same = F.transform(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda i: F.slice(a, F.lit(1), i) == F.slice(b, F.lit(1), i))
    return ends.select(F.when(F.col("a").isNotNull(), F.array_join(F.slice(a, F.lit(1), F.size(F.filter(same, lambda x: x))), "/")).alias("root"))


def output_folder(folder: Column, root: Column, out: str) -> Column:
    """The folder below ``out`` that stands for one below ``root``; ``out`` itself for the root and for any other."""
    below = F.startswith(folder, F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))
    return F.concat(F.lit(out.rstrip("/")), F.when(below, F.substr(folder, F.length(F.rtrim(root, F.lit("/"))) + 1)).otherwise(""))


def resolve_claims(pairs: DataFrame) -> DataFrame:
    """Asserted pairs: exact repeats collapse to the first; a subtitle of several videos is refused everywhere."""
    first = pairs.groupBy("video", "subtitle").agg(F.min("seq").alias("seq"))
    videos = first.groupBy("subtitle").agg(F.count("*").alias("videos"))
    return first.join(videos, "subtitle").select("seq", "video", "subtitle", (F.col("videos") > 1).alias("refused"))


def first_seen(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Distinct keys with the place where each was seen first."""
    return rows.groupBy(key).agg(F.min(seq).alias(seq))


def tree_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files of two listings (path, digest): kept, changed, moved, gone or new."""
    a = before.select("path", F.col("digest").alias("old"))
    b = after.select("path", F.col("digest").alias("new"))
    there = after.select(F.col("digest").alias("d")).distinct()
    both = a.join(b, "path", "full").join(there, F.col("old") == F.col("d"), "left")
    return both.select(
        "path",
        F.when(F.col("old").isNull(), "new")
        .when(F.col("old") == F.col("new"), "kept")
        .when(F.col("new").isNotNull(), "changed")
        .when(F.col("d").isNotNull(), "moved")
        .otherwise("gone")
        .alias("state"),
    )
