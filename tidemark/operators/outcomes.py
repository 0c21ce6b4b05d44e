"""Rows for what a run did and for what it did not do.

A slot (video, lang) has a row for each file written and, where none is, one row
that names the best candidate and why it was refused: a write that was held back
before candidates by rank.  A video has a row where no candidate is of the language
asked for, with what other languages had.

Defined results: a null language is ``und``; an outcome that is missing is ERROR;
nothing is ``written`` in a dry run; slots and videos of null names stay apart from
all others; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a result tells, in its order.
FIELDS = (
    "video", "subtitle", "outcome", "reason", "segments", "undetermined", "offset", "match_rate", "match_percent", "excess_over_chance", "raw_excess", "verdict_word", "holds_throughout",
    "runtime_check", "cluster_coherence", "dropped_in_gap", "dropped_before_zero", "reference_kind", "reference", "output_path", "superseded", "would_supersede", "lang", "lang_tag",
    "forced", "write_failed", "episode", "notes",
)
DEFAULTS = {
    "reason": "string", "segments": "array<struct<split:double,offset:double>>", "undetermined": "array<struct<lo:double,hi:double>>", "score": "double", "excess": "double", "word": "string",
    "failing": "int", "runtime_check": "string", "coherence": "double", "dropped_in_gap": "long", "dropped_before_zero": "long", "reference_kind": "string", "reference": "string",
    "lang_tag": "string", "episode": "double",
}


def language(asked: str, tags: dict[str, str]) -> str:
    """The code of a language as names of files spell it; one that no name has is an error, never ``und``."""
    token = asked.strip().lower()
    code = "und" if token == "und" else tags.get(token) or tags.get(token.partition("-")[0] if len(token.partition("-")[0]) == 2 else token)
    if code is None:
        raise ValueError(f"{asked!r} is no language as file names have it, such as ja, jpn or ja-JP; und asks for names without one")
    return code


def unpaired_in(videos: DataFrame, offered: DataFrame, lang: str | None = None) -> DataFrame:
    """``video, reason`` of videos without a candidate, of one language if asked.

    ``offered``: video, subtitle, lang.  Names without a language count as none.
    """
    code = F.coalesce("lang", F.lit("und"))
    told = F.when(F.col("code") == "und", "untagged").otherwise(F.col("code"))
    per = offered.withColumn("code", code).groupBy(F.col("video").alias("__v")).agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(told)), ", ").alias("others"), F.bool_or(F.col("code") == (lang or "und")).alias("has"),
        F.bool_or(F.col("code") == "und").alias("bare"),
    )
    v = videos.select("video").distinct()
    j = v.join(per, v["video"].eqNullSafe(per["__v"]), "left")
    none = F.col("n").isNull()
    left = j.where(none if lang is None else none | ~F.col("has"))
    bare = F.when(F.col("bare"), "; a name without a language is of none").otherwise("")
    other = F.concat(F.lit(f"no {lang} file among the "), F.col("n").cast("string"), F.lit(" offered ("), "others", F.lit(")"), bare)
    return left.select("video", F.when(none, "nothing was offered").otherwise(other).alias("reason"))


def _rank() -> Column:
    """Order of refusals: a write held back, then what is nearest to being written, then the rank of a slot."""
    class_ = F.when(F.col("action") == "withheld", 0).otherwise(1)
    return F.struct(class_, F.coalesce("rank", F.lit(2**31 - 1)), F.coalesce("subtitle", F.lit("")))


def refusals(decided: DataFrame) -> DataFrame:
    """One row a slot without a write: the best-ranked candidate, a write that was held back before all.

    ``decided``: video, lang, subtitle, action, outcome, rank, reason and any more,
    which stay.  ``withheld`` tells that the candidate was to be written.
    """
    own = [F.coalesce("video", F.lit("\0")).alias("__v"), F.coalesce("lang", F.lit("und")).alias("__l")]
    rows = decided.select("*", *own)
    written = rows.where("action = 'write'").select("__v", "__l").distinct()
    cols = [c for c in decided.columns if c != "lang"]
    best = rows.join(written, ["__v", "__l"], "left_anti").groupBy("__v", "__l").agg(F.min_by(F.struct(*cols), _rank()).alias("x"), F.count("*").alias("candidates"))
    out = best.select("x.*", F.col("__l").alias("lang"), "candidates")
    held = F.coalesce(F.col("action") == "withheld", F.lit(False))
    name = F.regexp_extract("subtitle", "([^/]*)$", 1)
    why = F.when(held, F.concat(F.lit("not written: "), name, F.lit(" also answers another video, which still has to read it"))).otherwise(F.coalesce("reason", F.concat(F.lit("no candidate of "), F.col("candidates").cast("string"), F.lit(" is good enough"))))
    return out.withColumn("withheld", held).withColumn("outcome", F.coalesce("outcome", F.lit("ERROR"))).withColumn("reason", why).select(*decided.columns, "withheld", "candidates")


def result_rows(decided: DataFrame, outcomes: DataFrame | None = None, dry_run: bool = True, force: bool = False) -> DataFrame:
    """All FIELDS of every written file and of every slot without one.

    ``decided`` has video, lang, subtitle, action, outcome, rank and what of the
    measured columns is known; ``outcomes`` are those of ``applying.final`` (slot,
    kind, source, target, status, reason).  A row that should have been written and
    was not says so, in its reason and in ``write_failed``.
    """
    have = decided
    for c, kind in DEFAULTS.items():
        if c not in have.columns:
            have = have.withColumn(c, F.lit(None).cast(kind))
    rest = refusals(have)
    rows = have.where("action = 'write'").withColumn("withheld", F.lit(False)).withColumn("candidates", F.lit(None).cast("long")).unionByName(rest)
    rows = rows.withColumn("lang", F.coalesce("lang", F.lit("und"))).withColumn("outcome", F.coalesce("outcome", F.lit("ERROR")))
    slot = F.concat_ws("\n", F.coalesce("video", F.lit("")), "lang")
    rows = rows.withColumn("__slot", slot)
    kinds = "array<string>"
    if outcomes is None:
        rows = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in ("status", "fault", "written")], F.array().cast(kinds).alias("moved"), F.array().cast(kinds).alias("would"))
    else:
        w = outcomes.where("kind = 'write'").select(F.col("slot").alias("__slot"), F.col("source").alias("subtitle"), "status", F.col("reason").alias("fault"), F.col("target").alias("written"))
        files = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("source"))))
        t = outcomes.where("kind = 'trash'").groupBy(F.col("slot").alias("__slot")).agg(files("done").alias("moved"), files("would").alias("would"))
        rows = rows.join(w, ["__slot", "subtitle"], "left").join(t, "__slot", "left")
        # what a slot moved is told once, by its first row
        first = rows.where("action = 'write'").groupBy("__slot").agg(F.min("subtitle").alias("__first"))
        rows = rows.join(first, "__slot", "left")
        once = F.coalesce(F.col("subtitle") == F.col("__first"), F.lit(False))
        rows = rows.withColumns({c: F.when(once, F.coalesce(c, F.array().cast(kinds))).otherwise(F.array().cast(kinds)) for c in ("moved", "would")})
    tried, done = F.col("action") == "write", F.coalesce(F.col("status") == "done", F.lit(False))
    failed = (F.lit(not dry_run) & tried & ~done) | (F.lit(not dry_run) & F.col("withheld"))
    said = F.when(tried & failed, F.concat(F.lit("not written: "), F.coalesce("fault", F.lit("no reason was recorded")), F.coalesce(F.concat(F.lit("; "), "reason"), F.lit(""))))
    said = said.when(tried & ~done, F.concat_ws(" ", F.lit("dry run, nothing was written"), "reason")).otherwise(F.coalesce("reason", F.lit("")))
    good = F.col("outcome") == "CONFIDENT"
    offset = F.when(F.size("segments") == 1, F.get("segments", F.lit(0))["offset"])
    empty = lambda c: F.coalesce(c, F.array().cast(DEFAULTS[c]))
    score, excess = F.coalesce("score", F.lit(0.0)), F.coalesce("excess", F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    values = {
        "video": F.col("video"), "subtitle": F.col("subtitle"), "outcome": F.col("outcome"), "reason": said, "segments": empty("segments"), "undetermined": empty("undetermined"), "offset": offset,
        "match_rate": score, "match_percent": F.bround(score * 100, 0).cast("int"), "excess_over_chance": F.greatest(excess, F.lit(0.0)), "raw_excess": excess,
        "verdict_word": F.when(good, F.col("word")), "holds_throughout": F.coalesce("failing", F.lit(0)) == 0, "runtime_check": F.coalesce("runtime_check", F.lit("absent")),
        "cluster_coherence": F.col("coherence"), "dropped_in_gap": zero("dropped_in_gap"), "dropped_before_zero": zero("dropped_before_zero"),
        "reference_kind": F.coalesce("reference_kind", F.lit("text")), "reference": F.coalesce("reference", F.lit("")), "output_path": F.when(tried & done, F.col("written")),
        "superseded": F.col("moved"), "would_supersede": F.col("would"), "lang": F.col("lang"), "lang_tag": F.coalesce("lang_tag", F.lit("")),
        "forced": F.lit(force) & tried & (F.col("outcome") == "REFUSED"), "write_failed": failed, "episode": F.col("episode"),
        "notes": F.filter(F.array(F.when(F.col("candidates") > 1, F.concat(F.lit("best of "), F.col("candidates").cast("string"), F.lit(" candidates")))), lambda x: x.isNotNull()),
    }
    return rows.select(*[values[f].alias(f) for f in FIELDS])
