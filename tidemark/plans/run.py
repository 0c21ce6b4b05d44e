"""The whole run: from two folders of files to one row per pair.

    items = scan(spark, "/videos", "/subs")
    results = sync(items, references, files)

``references``: video path, starts array<double>, duration, and lines
array<struct<start,end>> where known.  ``files``: read cue files
(sources.formats).  Two steps look at all pairs at once, and are the only
shuffles that can't be merged: clusters before verdicts, ownership after plans.

Candidates are pairs of equal episode; of a series whose numberings differ by a
shift also those the shift brings together, and where its numberings never meet
a bounded pool of the season, both marked speculative; and films by key, year and
folder.  A series is an equal title key, or one that an alias table bridges.
Titles that are surely different are left out before anything is measured.
Kana ranking (functions.kana.best_titles) is no part of a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import names, text
from ..operators import agreement, align, applying, opinions, pairing, ranking, runtime, verdict, witness

GROUP = ["cluster_title", "cluster_season", "cluster_group", "cluster_dir"]


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Paths below a root; the contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("bytes")).distinct()


def require_folder(spark: SparkSession, root: str) -> None:
    """An absent root is never an empty result, in any file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not root.strip() or not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise FileNotFoundError(f"{root!r} is no folder; an absent root is never an empty result")


def scan(spark: SparkSession, videos: str, subtitles: str | None = None) -> DataFrame:
    """``path, name, kind, p (parsed name), key, side`` of what isn't junk or creditless."""
    roots = [videos] + ([subtitles] if subtitles and subtitles != videos else [])
    for r in roots:
        require_folder(spark, r)
    files = listing(spark, roots[0])
    for r in roots[1:]:
        files = files.unionByName(listing(spark, r)).distinct()
    name = F.regexp_extract("path", "([^/]+)$", 1)
    items = files.withColumn("name", name).withColumn("kind", names.classify(F.col("name")))
    return items.where(F.col("kind").isNotNull() & ~names.is_junk(F.col("name")) & ~names.is_creditless(F.col("name")))


def parsed(items: DataFrame, tags: dict[str, str], others: DataFrame | None = None) -> DataFrame:
    """Items with title key, tokens, season, episode, group, language and flags.

    The episode is what the name, its folder's scheme and ``others`` (path, parser,
    episode, season) come to; ``candidates`` are all that were proposed.
    """
    cue = F.col("kind") == "subtitle"
    side = names.sidecar(F.col("name"), tags)
    base = items.withColumn("side", side).withColumn("stem", F.when(cue, F.col("side.stem")).otherwise(F.regexp_replace("name", r"\.[^.]*$", "")))
    known = base.select("stem").distinct().withColumn("p", names.parse_names(F.col("stem")))
    p = base.join(known, "stem").select(
        "path", "name", "kind", "stem", F.col("side.lang").alias("lang"), F.col("side.flags").alias("flags"), F.col("side.ext").alias("ext"), F.col("p.title").alias("title"),
        F.col("p.season").alias("season"), F.col("p.episode").alias("episode"), F.lower("p.group").alias("group"), F.col("p.kind").alias("name_kind"),
    )
    p = p.withColumn("key", text.title_key(F.col("title"))).withColumn("tokens", text.title_tokens(F.col("title"))).withColumn("signature", text.signature_of(F.col("title"))).withColumn("script", text.script_of(F.col("title")))
    seen = opinions.settle(p.withColumn("kind", F.col("name_kind")), others)
    p = p.drop("episode", "season").join(seen.withColumnRenamed("state", "vote"), "path")
    # films are what has no number at all
    two = frozenset(k for k in tags if len(k) == 2)
    films = p.where((F.size("candidates") == 0) & F.col("season").isNull()).select("name").distinct().withColumn("f", names.read_films(F.col("name"), tags=two)).where(F.col("f.refusal").isNull())
    films = films.select("name", F.lit(True).alias("film"), text.title_key(F.col("f.title")).alias("film_key"), F.col("f.year").alias("year"), F.col("f.edition").alias("edition"))
    return p.join(films, "name", "left").withColumn("film", F.coalesce("film", F.lit(False)))


def series_pairs(items: DataFrame, alias: DataFrame | None = None) -> DataFrame:
    """``key, s_key``: title keys of videos and of cue files that are one series, by equality or by a shared entity."""
    keys = lambda kind, name: items.where((F.col("kind") == kind) & (F.col("key") != "")).select(F.col("key").alias(name)).distinct()
    v, s = keys("video", "key"), keys("subtitle", "s_key")
    same = v.join(s, v["key"] == s["s_key"])
    if alias is None:
        return same
    of = lambda d, name: d.join(alias.select(F.col("key").alias(name), "entity"), name)
    return same.union(of(v, "key").join(of(s, "s_key"), "entity").select("key", "s_key")).distinct()


def numbered(items: DataFrame, series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(videos with ``shift``, cue files once per series of a video), of those that have an episode."""
    ep = items.where(F.col("episode").isNotNull() & (F.col("key") != ""))
    v = ep.where("kind = 'video'").select("path", "key", "season", "episode")
    s = ep.where("kind = 'subtitle'").select("path", F.col("key").alias("s_key"), "season", "episode").join(series, "s_key").drop("s_key")
    known = F.col("season").isNotNull()
    shift = agreement.numbering_shift(v.where(known), s.where(known), ["key", "season"]).where(F.col("shift").isNotNull()).select("key", "season", "shift")
    return v.join(shift, ["key", "season"], "left"), s


def film_edges(items: DataFrame, references: DataFrame | None) -> DataFrame:
    """``video, subtitle`` of films: one video per cue file, none where the two best can't be told apart."""
    films = items.where("film").select("path", "kind", F.col("film_key").alias("key"), "year", F.nullif("edition", F.lit("")).alias("edition")).where("key <> ''")
    none = F.lit(None).cast("double")
    v = films.where("kind = 'video'")
    v = v.withColumn("seconds", none) if references is None else v.join(references.select(F.col("video").alias("path"), F.col("duration").alias("seconds")), "path", "left")
    found = pairing.pair_films(v, films.where("kind = 'subtitle'").withColumn("seconds", none))
    return ranking.separated(found).where("separated").select("video", "subtitle")


def likely_titles(items: DataFrame, alias: DataFrame | None = None, different_below: float = 0.40) -> DataFrame:
    """``key, s_key``: title keys of videos and cue files that their letters, words or an alias table don't surely tell apart.

    Only titles that share enough bigrams, or all their words, can be as similar as
    that; they meet by a join on rare bigrams and by an equality of words.
    """
    of = lambda kind: items.where((F.col("kind") == kind) & (F.col("key") != "")).groupBy("key").agg(F.max("tokens").alias("tokens"))
    v, s = of("video"), of("subtitle")
    grams = lambda d: d.select(F.col("key").alias("id"), text.bigrams(F.col("key")).alias("grams"))
    near = pairing.similar(grams(v), grams(s), different_below).select(F.col("a").alias("key"), F.col("b").alias("s_key"))
    words = lambda kind, name: items.where((F.col("kind") == kind) & (F.col("key") != "") & (F.size("tokens") > 1)).select(F.col("key").alias(name), F.array_sort("tokens").alias("words")).distinct()
    same = words("video", "key").join(words("subtitle", "s_key"), "words").select("key", "s_key")
    return near.union(same).union(series_pairs(items, alias)).distinct()


def likely(items: DataFrame, alias: DataFrame | None = None) -> DataFrame:
    """``video, subtitle, speculative`` of equal episode, but for titles of one script that are surely different.

    Titles of other scripts and empty ones can't be told apart by their letters: they
    meet by episode alone, each kind in a join of its own.
    """
    # a name whose readings differ meets by each of them; timing decides
    proposed = items.withColumn("episode", F.explode("candidates")) if "candidates" in items.columns else items
    v, s = (proposed.where(F.col("kind") == kind) for kind in ("video", "subtitle"))
    # only titles of files with an episode that the other side has too are compared: films and lone numbers meet nothing here
    met_by = lambda d, other: d.join(other.select("episode").distinct(), "episode", "left_semi")
    titles = likely_titles(met_by(v, s).unionByName(met_by(s, v)), alias)
    by_title = v.join(scratch.stored(titles, "titles"), "key")
    met = pairing.block(by_title.select("path", "s_key", "season", "episode"), s.withColumnRenamed("key", "s_key").select("path", "s_key", "season", "episode"), ["s_key"])
    han, empty = F.col("script").isin("cjk", "mixed"), F.col("key") == ""
    for a, b in ((han, ~han), (~han, han), (empty, F.lit(True)), (F.lit(True), empty)):
        met = met.union(pairing.block(v.where(a), s.where(b)))
    return met.groupBy("video", "subtitle").agg(F.bool_and("speculative").alias("speculative"))


def edges(items: DataFrame, references: DataFrame | None = None, alias: DataFrame | None = None) -> DataFrame:
    """``video, subtitle, identity, score, speculative, proximity``: candidates that aren't surely of different series.

    Pairs grow with titles that are alike, not with the files of an episode (``likely``).
    ``items`` is read many times and should be stored or cached.
    """
    pairs = scratch.stored(likely(items, alias), "likely")  # several joins below read it
    v, s = numbered(items, series_pairs(items, alias))
    shifted = pairing.block(v, s, ["key"]).where("speculative")
    met = pairs.select("video", "subtitle").union(shifted.select("video", "subtitle"))
    rest = v.where(F.col("shift").isNull())
    pool = pairing.absolute_fallback(rest, s, met, ["key"])
    guesses = shifted.union(pool).distinct()
    whole = pairs.union(guesses)
    if "film" in items.columns:
        whole = whole.union(film_edges(items, references).select("video", "subtitle", F.lit(False)))
    # all edges of a video whose numbering is shifted are speculative
    moved = v.where(F.col("shift").isNotNull()).select(F.col("path").alias("video"), F.lit(True).alias("moved"))
    whole = whole.groupBy("video", "subtitle").agg(F.bool_and("speculative").alias("speculative")).join(moved, "video", "left")
    whole = whole.withColumn("speculative", F.col("speculative") | F.coalesce("moved", F.lit(False))).drop("moved")
    left = items.select(F.col("path").alias("video"), *[F.col(c).alias(f"v_{c}") for c in ("key", "tokens", "signature", "script")])
    right = items.select(F.col("path").alias("subtitle"), *[F.col(c).alias(f"s_{c}") for c in ("key", "tokens", "signature", "script")])
    e = whole.join(left, "video").join(right, "subtitle")
    bridged = F.lit(False)
    if alias is not None:
        known = pairing.bridge(e.select(F.col("v_key").alias("a"), F.col("s_key").alias("b")).distinct(), alias).where(F.col("entity").isNotNull())
        e = e.join(known.select(F.col("a").alias("v_key"), F.col("b").alias("s_key"), F.lit(True).alias("bridged")), ["v_key", "s_key"], "left")
        bridged = F.coalesce("bridged", F.lit(False))
    e = e.withColumn("score", text.title_similarity(F.col("v_key"), F.col("s_key"), F.col("v_tokens"), F.col("s_tokens")))
    same = text.series_identity(F.col("score"), F.col("v_key"), F.col("s_key"), F.col("v_signature"), F.col("s_signature"), F.col("v_script"), F.col("s_script"), bridged)
    same = F.when((F.col("v_key") == "") | (F.col("s_key") == ""), "unsure").otherwise(same)  # nothing to compare: timing decides
    e = e.withColumn("identity", same).where("identity <> 'different' and (not speculative or identity = 'same')")
    return e.select("video", "subtitle", "identity", "score", "speculative", runtime.proximity(F.col("video"), F.col("subtitle")).alias("proximity"))


def measure(pairs: DataFrame, references: DataFrame, files: DataFrame) -> DataFrame:
    """Fits of pairs whose running time allows it, with what a verdict needs; breaks are placed by the references' lines."""
    read = files.where("status = 'OK'").select(F.col("path").alias("subtitle"), F.transform("cues", lambda c: c["start"]).alias("at"), F.transform("cues", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))).alias("sub_lines"))
    moments = read.select("subtitle", F.posexplode("at").alias("i", "t"))
    starts = align.unique_starts(moments, ["subtitle"]).withColumnRenamed("starts", "sub")
    end = runtime.content_end(moments, ["subtitle"], "t")
    lines = F.col("lines") if "lines" in references.columns else F.lit(None).cast("array<struct<start:double,end:double>>")
    m = pairs.join(references.select(F.col("video"), F.col("starts").alias("ref"), "duration", lines.alias("ref_lines")), "video").join(starts, "subtitle").join(end, "subtitle", "left")
    m = m.join(read.select("subtitle", "sub_lines", F.size("at").alias("cues")), "subtitle")
    m = m.where(runtime.runtime_verdict(F.col("duration"), F.col("content_end"), F.col("cues")) != "impossible").withColumn("pair_id", F.concat_ws("\n", "video", "subtitle"))
    fit = align.fit_pairs(m.select("pair_id", "ref", "sub", "duration"))
    f = align.place_all(m.drop("ref", "sub").join(fit, "pair_id")).drop("ref_lines", "sub_lines")
    whole = F.transform("segments", lambda s: F.struct(s["split"].alias("split"), F.when(F.size("segments") == 1, align.snap(s["offset"])).otherwise(s["offset"]).alias("offset")))
    fails = F.size(F.filter("buckets", lambda b: b["fails"])).alias("failing")
    return f.withColumn("segments", whole).select("*", fails, F.size(F.filter("buckets", lambda b: b["applied"].isNotNull())).alias("usable"))


def judge_all(fits: DataFrame, items: DataFrame) -> DataFrame:
    """Verdicts, pairs of one title, season, group and folder vouching for each other."""
    of = items.select(F.col("path").alias("subtitle"), F.col("key").alias(GROUP[0]), F.col("season").alias(GROUP[1]), F.col("group").alias(GROUP[2]), F.regexp_extract("path", "^(.*)/", 1).alias(GROUP[3]))
    f = fits.join(of, "subtitle")
    ok = verdict.measurable(F.col("score"), F.col("chance"), F.col("n_ref"), F.col("n_sub")) & (F.col(GROUP[0]) != "")
    c = agreement.coherence(f.where(ok).withColumn("offset_ms", F.col("single_offset") * 1000), GROUP)
    c = c.select(*[F.col(g).alias(f"c_{g}") for g in GROUP], "centre", "coheres", "coherence")
    j = f.join(c, [f[g].eqNullSafe(c[f"c_{g}"]) for g in GROUP], "left")
    j = j.withColumn("agrees", verdict_agrees()).withColumn("coheres", F.coalesce("coheres", F.lit(False)))
    return verdict.judge(j)


def verdict_agrees():
    return agreement.agrees(F.col("single_offset"), F.col("centre"))


def heard_there(judged: DataFrame, files: DataFrame, heard: DataFrame) -> DataFrame:
    """Confident pairs whose lines don't say what is heard in the video (video, start, said) are refused."""
    ok = judged.where("outcome = 'CONFIDENT'").select("pair_id", "video", "subtitle", "segments")
    lines = files.select(F.col("path").alias("subtitle"), F.explode("cues").alias("c")).select("subtitle", F.col("c.start").alias("t"), witness.normalise(F.col("c.text")).alias("text"))
    placed = ok.join(lines, "subtitle").where(~align.is_removed(F.col("t"), F.col("segments"))).select(F.col("pair_id").alias("video"), align.map_time(F.col("t"), F.col("segments")).alias("at"), "text")
    said = ok.join(heard.select("video", "start", "said"), "video").select(F.col("pair_id").alias("video"), "start", "said")
    bad = witness.check(said, placed).where("not passed").select(F.col("video").alias("pair_id"), F.col("reason").alias("witness_reason"))
    j = judged.join(bad, "pair_id", "left")
    fails = F.col("witness_reason").isNotNull()
    return j.withColumn("outcome", F.when(fails, "REFUSED").otherwise(F.col("outcome"))).withColumn("word", F.when(~fails, F.col("word")))


def sync(
    items: DataFrame, references: DataFrame, files: DataFrame, tags: dict[str, str] | None = None, keep_all: bool = False, alias: DataFrame | None = None, heard: DataFrame | None = None,
    settled=None, answers: DataFrame | None = None, scratch: str | None = None,
) -> DataFrame:
    """One row per measured pair: segments, verdict, action and the name to write.

    ``alias``: (key, entity); ``heard``: transcript windows; ``settled``: videos
    (video) that operators.state found to have nothing to do, or a function that
    finds them among the candidates, and ``answers`` the files (path, video) that
    answer them.  Names, fits and verdicts are read
    several times: they are written below ``scratch``, a shared folder, or else
    checkpointed or cached.
    """
    spark = items.sparkSession
    keep = lambda df, name: stored(df, f"{scratch.rstrip('/')}/{name}" if scratch else None)
    tags = tags or names.languages(spark)
    p = keep(parsed(items, tags), "names")
    e = keep(edges(p, references, alias), "candidates")
    if settled is not None:
        settled = settled(e) if callable(settled) else settled
        e = e.join(settled.select("video").distinct(), "video", "left_anti")
    # fits are used by clusters and by verdicts
    fits = keep(measure(e.withColumnRenamed("score", "title_score"), references, files), "fits")
    judged = keep(judge_all(fits, p), "verdicts")
    if heard is not None:
        judged = heard_there(judged, files, heard)
    return decide(judged, p, keep_all, answers)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Rows that several plans read, with their own plan cut off: written to ``path``, checkpointed if a folder is set, else cached."""
    if path:
        df.write.mode("errorifexists").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def decide(judged: DataFrame, items: DataFrame, keep_all: bool = False, answers: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Judged pairs to one winner per slot, targets, and what slots claim from each other."""
    vid = items.where("kind = 'video'").select(F.col("path").alias("video"), F.col("stem").alias("video_stem"))
    sub = items.where("kind = 'subtitle'").select(F.col("path").alias("subtitle"), "lang", "flags", "ext", "stem")
    good = verdict.decide(F.col("outcome"), force).startswith("write")
    c = judged.join(vid, "video").join(sub, "subtitle").select(
        "*", F.col("subtitle").alias("path"), good.alias("confident"), F.arrays_overlap("flags", F.array(F.lit("sdh"), F.lit("cc"), F.lit("hi"))).alias("hearing_impaired"),
        (F.lower("stem") == F.lower("video_stem")).alias("name_matches"), F.size("segments").alias("n_segments"),
    )
    ranked = c.withColumn("all_segments", F.col("segments")).withColumn("segments", F.col("n_segments"))
    planned = ranking.plan_slots(ranked, keep_all)
    tag = F.lit(None).cast("string")
    if keep_all:
        planned = ranking.distinguishing_tags(planned.withColumn("seq", F.col("rank")))
        tag = F.col("tag")
    target = F.concat(F.regexp_extract("video", "^(.*/)", 1), names.safe_name(F.col("video_stem"), F.col("lang"), F.col("flags"), F.col("ext"), tag)["name"])
    planned = planned.withColumn("target", target).withColumn("action", F.when((F.col("action") == "write") & F.col("target").isNull(), "refuse").otherwise(F.col("action")))
    write = planned.where("action = 'write'")
    clash = ranking.target_collisions(write).select("video", "lang", "path", "collides")
    out = planned.join(clash, ["video", "lang", "path"], "left").withColumn("action", F.when(F.coalesce("collides", F.lit(False)), "refuse").otherwise(F.col("action")))
    out = ranking.settle_ownership(out, answers)
    return out.select(
        "video", "subtitle", "lang", "identity", "outcome", "word", "band", "runtime_check", "excess", "score", F.col("all_segments").alias("segments"), "coherence", "rank", "speculative", "action",
        F.when(F.col("action") == "write", F.col("target")).alias("target"),
    )


def sync_pairs(entries: DataFrame, references: DataFrame, files: DataFrame, tags: dict[str, str] | None = None, force: bool = False) -> DataFrame:
    """Asserted pairs (seq, video, subtitle, fault) measured and decided: a row per entry.

    A faulty entry and a subtitle asserted for several videos are refused unopened;
    ``force`` writes what a verdict refuses, never what can't be measured.
    """
    spark = entries.sparkSession
    faulty = entries.where(F.col("fault").isNotNull()).select("seq", "video", "subtitle", F.col("fault").alias("reason"))
    claims = ranking.resolve_claims(entries.where(F.col("fault").isNull()).select("seq", "video", "subtitle"))
    taken = claims.where("refused").select("seq", "video", "subtitle", F.lit("asserted for several videos").alias("reason"))
    sound = claims.where("not refused").select("seq", "video", "subtitle")
    both = sound.select(F.explode(F.array(F.struct(F.col("video").alias("path"), F.lit("video").alias("kind")), F.struct(F.col("subtitle").alias("path"), F.lit("subtitle").alias("kind")))).alias("x"))
    items = parsed(both.select("x.path", "x.kind").distinct().withColumn("name", F.regexp_extract("path", "([^/]+)$", 1)), tags or names.languages(spark))
    items = stored(items)
    pairs = sound.select("video", "subtitle", F.lit("same").alias("identity"), F.lit(1.0).alias("title_score"), F.lit(False).alias("speculative"), runtime.proximity(F.col("video"), F.col("subtitle")).alias("proximity"))
    done = decide(stored(judge_all(stored(measure(pairs, references, files)), items)), items, force=force)
    rows = sound.join(done, ["video", "subtitle"], "left")
    rows = rows.withColumn("reason", F.when(F.col("outcome").isNull(), "not measured")).withColumn("outcome", F.coalesce("outcome", F.lit("ERROR"))).withColumn("forced", (F.col("action") == "write") & (F.col("outcome") == "REFUSED"))
    return rows.unionByName(faulty.union(taken).withColumn("outcome", F.lit("ERROR")), allowMissingColumns=True)


def align_to_files(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Cue files (subtitle) aligned to other cue files (reference): outcome, word, segments, unchecked lines.

    It makes the one agree with the other, and can't tell whether that agrees with
    a video.  The same file twice is an error, unopened.
    """
    ok = pairs.where("subtitle <> reference").select(F.col("reference").alias("video"), "subtitle").distinct()
    read = files.where("status = 'OK'").select(F.col("path").alias("video"), F.explode("cues").alias("c")).select("video", F.col("c.start").alias("t"), F.col("c.end").alias("end"))
    starts = align.unique_starts(read, ["video"])
    spans = read.groupBy("video").agg(F.array_sort(F.collect_list(F.struct(F.col("t").alias("start"), "end"))).alias("lines"))
    refs = starts.join(spans, "video").withColumn("duration", F.lit(None).cast("double"))
    fits = measure(ok, refs, files).withColumn("coheres", F.lit(False)).withColumn("agrees", F.lit(False))
    judged = stored(verdict.judge(fits))
    moved = judged.select("pair_id", "subtitle", "segments").join(read.select(F.col("video").alias("subtitle"), "t"), "subtitle").where(~align.is_removed(F.col("t"), F.col("segments")))
    placed = moved.select("pair_id", align.map_time(F.col("t"), F.col("segments")).alias("t"))
    base = judged.select("pair_id", "video").join(read.select("video", "t"), "video").select("pair_id", "t")
    out = align.checked(judged, align.unchecked_runs(base, placed, ["pair_id"]), ["pair_id"])
    out = out.select("subtitle", F.col("video").alias("reference"), "outcome", "word", "segments", "score", "excess", "unchecked")
    lost = pairs.select("subtitle", "reference").distinct().join(out.select("subtitle", "reference"), ["subtitle", "reference"], "left_anti")
    return out.unionByName(lost.withColumn("outcome", F.lit("ERROR")), allowMissingColumns=True)


def summary(results: DataFrame) -> DataFrame:
    """Counts of a report: clean, cut, refused and failed pairs."""
    one = F.size("segments") == 1
    return results.agg(
        F.count_if((F.col("outcome") == "CONFIDENT") & one).alias("clean"), F.count_if((F.col("outcome") == "CONFIDENT") & ~one).alias("cut"),
        F.count_if(F.col("outcome") == "REFUSED").alias("refused"), F.count_if(F.col("outcome") == "ERROR").alias("failed"), F.count("*").alias("all"),
    )


def write_ndjson(results: DataFrame, path: str) -> None:
    results.write.mode("errorifexists").json(path)


def apply(results: DataFrame, rendered: DataFrame, trash: str, dry_run: bool = True, force: bool = False, name: str = "") -> DataFrame:
    """Outcomes of writing winners and moving superseded files to the trash (``operators.applying``), stored."""
    todo = scratch.stored(applying.intents(results, trash, force, name), "intents")
    contents = rendered.where("status = 'OK'").select("path", "content")
    return scratch.stored(applying.apply(todo, contents, trash, dry_run), "outcomes")
