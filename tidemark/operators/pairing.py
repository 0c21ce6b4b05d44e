"""Which cue file may belong to which video: blocking joins and their fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dealt(season: Column, deals: int) -> Column:
    return F.pmod(F.xxhash64(season.cast("string")), F.lit(deals)).cast("int")


def block(videos: DataFrame, subtitles: DataFrame, keys: list[str] | None = None, parts: int | None = None, deals: int = 8) -> DataFrame:
    """Edges of equal episode whose stated seasons don't differ.

    The join is an equality on episode (and ``keys``); leniency towards unknown
    seasons is a residual, so that it stays a hash or merge join.  A shift column
    on the videos adds edges at episode + shift, and makes all of that video's
    edges speculative.  Paths are unique on either side, and so are edges: a cue
    file has one episode.

    Where edges are many more than files, ``parts`` is the number of tasks that make
    them: the videos of an episode and a season are one task's, in a row, so that
    their edges, written as columns, are a name once and a list of few names.  A
    season's hash is one of ``deals``; a cue file goes to its own and to that of
    videos without a season, to all if it has none itself.
    """
    keys = keys or []
    v = videos.where(F.col("episode").isNotNull()).select(*keys, F.col("path").alias("video"), F.col("season").alias("v_season"), F.col("episode").alias("at"), *([F.col("shift")] if "shift" in videos.columns else [F.lit(None).cast("long").alias("shift")]))
    moved = v.where(F.coalesce("shift", F.lit(0)) != 0).withColumn("at", F.col("at") + F.col("shift"))
    s = subtitles.where(F.col("episode").isNotNull()).select(*keys, F.col("path").alias("subtitle"), F.col("season").alias("s_season"), F.col("episode").alias("at"))
    v, own = v.union(moved), [*keys, "at"]
    if parts:
        own = [*own, "deal"]
        meets = F.array_distinct(F.array(dealt(F.col("s_season"), deals), dealt(F.lit(None), deals)))
        every = F.sequence(F.lit(0), F.lit(deals - 1))
        s = s.withColumn("deal", F.explode(F.when(F.col("s_season").isNull(), every).otherwise(meets))).repartition(parts, *own)
        v = v.withColumn("deal", dealt(F.col("v_season"), deals)).repartition(parts, *own).hint("merge")
    both = v.join(s, own)
    both = both.where(F.col("v_season").isNull() | F.col("s_season").isNull() | (F.col("v_season") == F.col("s_season")))
    return both.select("video", "subtitle", (F.coalesce("shift", F.lit(0)) != 0).alias("speculative"))


def block_counts(videos: DataFrame, subtitles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``video, n`` of every video that has edges by ``block``: their number, from counts of cue files by episode and season.

    Where only the number of edges, or whether there is one, is asked, no edge is made;
    the work grows with the files and not with the pairs.
    """
    keys = keys or []
    own = [*keys, "at"]
    shift = F.col("shift") if "shift" in videos.columns else F.lit(None).cast("long")
    v = videos.where(F.col("episode").isNotNull()).select(*keys, F.col("path").alias("video"), "season", F.col("episode").alias("at"), shift.alias("shift"))
    v = v.union(v.where(F.coalesce("shift", F.lit(0)) != 0).withColumn("at", F.col("at") + F.col("shift"))).drop("shift")
    s = subtitles.where(F.col("episode").isNotNull()).groupBy(*keys, F.col("episode").alias("at"), "season").agg(F.count("*").alias("n"))
    whole = s.groupBy(*own).agg(F.sum("n").alias("every"), F.sum(F.when(F.col("season").isNull(), F.col("n"))).alias("unknown"))
    same = s.where(F.col("season").isNotNull()).withColumnRenamed("n", "same")
    x = v.join(whole, own).join(same, [*own, "season"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    n = F.when(F.col("season").isNull(), F.col("every")).otherwise(zero("unknown") + zero("same"))
    return x.groupBy("video").agg(F.sum(n).alias("n")).where("n > 0")


def fan_out(videos: DataFrame, edges: DataFrame) -> DataFrame:
    """``video, candidates``: of every video its number of edges; ``edges`` are rows of ``block`` or counts of ``block_counts``."""
    n = edges if "n" in edges.columns else edges.groupBy("video").agg(F.count("*").alias("n"))
    return videos.select(F.col("path").alias("video")).join(n, "video", "left").select("video", F.coalesce("n", F.lit(0)).alias("candidates"))


def absolute_fallback(videos: DataFrame, subtitles: DataFrame, edges: DataFrame, keys: list[str], cap: int = 64) -> DataFrame:
    """Speculative edges for videos without any, where a season's numberings share no number.

    The pool is the season's cue files in path order, ``cap`` of them at most (a
    limit of the operator itself).
    """
    group = [*keys, "season"]
    alone = videos.where(F.col("season").isNotNull()).join(edges.select(F.col("video").alias("path")).distinct(), "path", "left_anti")
    known = subtitles.where(F.col("season").isNotNull())
    shared = videos.select(*group, "episode").distinct().join(known.select(*group, "episode").distinct(), [*group, "episode"]).select(*group).distinct()
    pool = known.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy("path"))).where(F.col("r") <= cap)
    pool = pool.join(shared, group, "left_anti").select(*group, F.col("path").alias("subtitle"))
    return alone.select(*group, F.col("path").alias("video")).join(pool, group).select("video", "subtitle", F.lit(True).alias("speculative"))


def unpaired(videos: DataFrame, edges: DataFrame) -> DataFrame:
    left = videos.join(edges.select(F.col("video").alias("path")).distinct(), "path", "left_anti")
    reason = F.when(F.col("episode").isNull() & F.col("season").isNull(), "film").when(F.col("episode").isNull(), "no key").otherwise("no such episode")
    return left.select(F.col("path").alias("video"), reason.alias("reason"))


def bridge(pairs: DataFrame, alias: DataFrame, max_entities: int = 64) -> DataFrame:
    """Pairs (a, b of title keys) with ``entity``, the smallest that both names share, or null.

    Keys of more than ``max_entities`` entities say nothing.
    """
    n = alias.distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") <= max_entities)
    known = alias.distinct().join(n.select("key"), "key", "left_semi")
    left = pairs.select("a", "b").distinct().join(known.select(F.col("key").alias("a"), "entity"), "a")
    both = left.join(known.select(F.col("key").alias("b"), "entity"), ["b", "entity"]).groupBy("a", "b").agg(F.min("entity").alias("entity"))
    return pairs.join(both, ["a", "b"], "left")


def gram_top_k(queries: DataFrame, titles: DataFrame, k: int = 300) -> DataFrame:
    """``query, title, jaccard, rank``: the k titles of greatest bigram Jaccard per query.

    Both have id and grams (distinct).  Equal gram sets are one class, named by its
    smallest id: classes are compared, by exploded grams, an equality join and a
    count, and of a class only the k smallest ids can be among the first k of any
    query, as only the k best classes can.  The rank keeps k, which is the
    operator's own limit.
    """
    sets = lambda d: d.select("id", F.array_sort("grams").alias("g"))
    place = F.row_number().over(Window.partitionBy("g").orderBy("id"))
    members = sets(titles).withColumn("place", place).where(F.col("place") <= k)
    asked = sets(queries)
    ends = [d.groupBy("g").agg(F.min("id").alias("c")) for d in (asked, members)]
    q, t = (d.select(F.col("c").alias(c), F.size("g").alias(f"n_{c}"), F.explode("g").alias("x")) for d, c in zip(ends, "qt", strict=True))
    n = q.join(t, "x").groupBy("q", "t").agg(F.count("*").alias("n"), F.first("n_q").alias("nq"), F.first("n_t").alias("nt"))
    s = n.select("q", "t", (F.col("n") / (F.col("nq") + F.col("nt") - F.col("n"))).alias("jaccard"))
    near = s.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.col("jaccard").desc(), "t"))).where(F.col("r") <= k)
    of_query = asked.join(ends[0].withColumnRenamed("c", "q"), "g").select(F.col("id").alias("query"), "q")
    of_title = members.join(ends[1].withColumnRenamed("c", "t"), "g").select(F.col("id").alias("title"), "t")
    both = near.join(of_title, "t").join(of_query, "q")
    w = Window.partitionBy("query").orderBy(F.col("jaccard").desc(), "title")
    return both.select("query", "title", "jaccard", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def similar(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``a, b, jaccard``: all pairs of ids whose sets (id, grams; distinct) have a Jaccard similarity of ``least`` or more, above zero.

    Grams are ordered from rare to frequent.  Two sets that are as similar share one
    of the first ``n - least * n + 1`` grams of either, so only these are joined, with
    the sizes and what can still follow as residuals; a frequent gram is in no prefix
    but that of sets made of frequent ones.  What meets is verified on the whole sets.
    Empty sets are similar to nothing; ids that repeat are one.
    """
    sets = lambda d: d.where(F.size("grams") > 0).dropDuplicates(["id"]).select("id", "grams")
    l, r = sets(left), sets(right)
    seen = r.select(F.explode("grams").alias("x")).groupBy("x").agg(F.count("*").alias("df"))

    def prefix(d: DataFrame, name: str) -> DataFrame:
        each = d.select("id", F.explode("grams").alias("x")).join(seen, "x", "left")
        ordered = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "x"))).alias("g")).withColumn("n", F.size("g"))
        first = (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int")
        rows = ordered.select("id", "n", F.posexplode(F.slice("g", F.lit(1), F.least(F.greatest(first, F.lit(1)), F.col("n")))).alias("i", "e"))
        return rows.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("i").alias(f"i_{name}"), F.col("e.x").alias("x"))

    both = prefix(l, "a").join(prefix(r, "b"), "x")
    short, long = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    # what stands before the shared gram on either side, this gram, and what is left
    shared = F.least("i_a", "i_b") + F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b"))
    need = (F.col("n_a") + F.col("n_b")) * (least / (1 + least)) - 1e-9
    met = both.where((short >= long * least - 1e-9) & (shared >= need)).select("a", "b").distinct()
    whole = met.join(l.select(F.col("id").alias("a"), F.col("grams").alias("g_a")), "a").join(r.select(F.col("id").alias("b"), F.col("grams").alias("g_b")), "b")
    n = F.size(F.array_intersect("g_a", "g_b"))
    scored = whole.select("a", "b", (n / (F.size("g_a") + F.size("g_b") - n)).alias("jaccard"))
    return scored.where((F.col("jaccard") >= least) & (F.col("jaccard") > 0))


def accept_best(scored: DataFrame, accept: float = 0.85, margin: float = 0.10) -> DataFrame:
    """Per query the best title if it is good and clear of the next."""
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("title").desc())
    r = scored.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).where("r = 1")
    good = (F.col("score") >= accept) & (F.col("score") - F.coalesce("next", F.lit(0.0)) >= margin)
    return r.where(good).select("query", "title", "score")


def pair_films(videos: DataFrame, subtitles: DataFrame) -> DataFrame:
    """``subtitle, video, rung``: equal (key, year); equal key where one side states no year; the folder's only video.

    Both have path, key, year, edition, seconds.  Stated editions that differ and
    impossible running times veto a candidate; the best rung that has any stands.
    """
    from .runtime import proximity, runtime_verdict

    v = videos.select(F.col("path").alias("video"), F.col("key").alias("v_key"), F.col("year").alias("v_year"), F.col("edition").alias("v_ed"), F.col("seconds").alias("v_s"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("v_dir"))
    s = subtitles.select(F.col("path").alias("subtitle"), "key", "year", "edition", "seconds", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"))
    same = s.join(v, s["key"] == v["v_key"])
    exact = same.where(F.col("year").eqNullSafe(F.col("v_year"))).withColumn("rung", F.lit(1))
    loose = same.where(F.col("year").isNull() != F.col("v_year").isNull()).withColumn("rung", F.lit(2))
    only = v.withColumn("n", F.count("*").over(Window.partitionBy("v_dir"))).where("n = 1").drop("n")
    here = s.join(only, s["dir"] == only["v_dir"]).withColumn("rung", F.lit(3))
    has = v.select(F.col("v_dir").alias("dir")).distinct()
    parent = F.regexp_extract("dir", "^(.*)/[^/]*$", 1)
    above = s.join(has, "dir", "left_anti").select("subtitle", "key", "year", "edition", "seconds", "dir").withColumn("up", parent)
    above = above.join(only, above["up"] == only["v_dir"]).drop("up").withColumn("rung", F.lit(3))
    found = exact.unionByName(loose).unionByName(here).unionByName(above)
    veto = (F.col("edition").isNotNull() & F.col("v_ed").isNotNull() & (F.col("edition") != F.col("v_ed"))) | (runtime_verdict(F.col("v_s"), F.col("seconds")) == "impossible")
    found = found.where(~F.coalesce(veto, F.lit(False)))
    best = found.withColumn("first", F.min("rung").over(Window.partitionBy("subtitle"))).where("rung = first")
    gap = F.abs(F.col("v_s") - F.col("seconds"))
    return best.select("subtitle", "video", "rung", proximity(F.col("video"), F.col("subtitle")).alias("proximity"), gap.alias("gap"))


def claim(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """The side whose root is the longest prefix of a path; ``roots``: root, side.

    Folders, not their files, meet roots by equality with the folders above them, so
    roots may be many; a path then takes its folder's side.
    """
    parts = lambda c: F.split(c, "/")
    first = lambda c, n: F.array_join(F.slice(parts(c), F.lit(1), n), "/")
    # repeated paths are one: dealt first, so that no task gathers all of its input
    own = paths.select("path").repartition("path").distinct().select("path", first("path", F.greatest(F.size(parts("path")) - 1, F.lit(1))).alias("folder"))
    above = F.transform(F.sequence(F.lit(1), F.size(parts("folder"))), lambda i: first("folder", i))
    hit = own.select("folder").distinct().select("folder", F.explode(above).alias("root")).join(roots, "root")
    sides = hit.groupBy("folder").agg(F.max_by("side", F.length("root")).alias("side"))
    return own.join(sides, "folder").select("path", "side")
