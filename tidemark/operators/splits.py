"""Fit of piecewise offsets as frames: candidates, hits, cuts, ties, refinement.

All pairs go through the same plans.  Densities of differences are runs of equal
height, peaks are found in rounds of arg-max and suppression over windows, hits
come from a semi-join on cells, and become one array of prefix sums per candidate.
The search for cuts keeps a frontier: each round cuts every segment that is new by
those sums, tests what each cut is worth, lets each pair take its best one, and
ends when no pair takes any.  What a round leaves is written to the shared folder.

``ref`` and ``sub`` are long tables (keys, t).  Null moments are left out; repeated
ones count as often as they stand.  A pair without moments on one side, or without
any difference within the window, has no candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import discard, stored
from .align import Settings, difference_counts, differences_near


def binned(diffs: DataFrame, keys: list[str], s: Settings = Settings()) -> DataFrame:
    """``keys, bin, n``: how many differences each bin has."""
    b = F.floor((F.col("d") + s.window) / s.bin).cast("long")
    return diffs.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def density_runs(counts: DataFrame, keys: list[str], s: Settings = Settings()) -> DataFrame:
    """``keys, lo, hi, dense``: the bins of an offset histogram (keys, bin, n), smoothed by a box, as runs of one height above zero."""
    bins = int(2 * s.window / s.bin) + 1
    half = (int(round(2 * s.tol / s.bin)) | 1) // 2
    d = counts.select(*keys, F.col("bin").cast("int").alias("b"), "n").where((F.col("b") >= 0) & (F.col("b") < bins))
    ends = F.array(F.struct(F.greatest(F.col("b") - half, F.lit(0)).alias("at"), F.col("n").alias("by")), F.struct((F.col("b") + half + 1).alias("at"), (-F.col("n")).alias("by")))
    steps = d.select(*keys, F.inline(ends)).where(F.col("at") < bins).groupBy(*keys, "at").agg(F.sum("by").alias("by")).where("by <> 0")
    w = Window.partitionBy(*keys).orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = steps.select(*keys, F.col("at").alias("lo"), (F.lead("at", 1, bins).over(w) - 1).alias("hi"), F.sum("by").over(so_far).alias("dense"))
    return runs.where("dense > 0")


def plateaus(runs: DataFrame, keys: list[str], most: int, s: Settings = Settings()) -> DataFrame:
    """``keys, rank, first, last, dense``: the ``most`` highest runs, each clear of those before it.

    Every round takes each group's highest run, the leftmost of equal ones, and cuts
    all others back to what lies outside its surroundings.
    """
    clear = max(1, int(s.separation / s.bin))
    own = Window.partitionBy(*keys)
    cur = runs.select(*keys, "lo", "hi", "dense", F.lit(None).cast("int").alias("rank"))
    for k in range(most):
        live = F.col("rank").isNull()
        top = F.max(F.when(live, F.struct("dense", (-F.col("lo")).alias("left"), F.col("hi").alias("last")))).over(own)
        cur = cur.withColumn("top", top)
        first, last = -F.col("top.left"), F.col("top.last")
        taken = live & (F.col("lo") == first)
        rest = F.array(F.struct("lo", F.least("hi", first - clear - 1).alias("hi")), F.struct(F.greatest("lo", last + clear + 1).alias("lo"), F.col("hi")))
        parts = F.when(live & ~taken, rest).otherwise(F.array(F.struct("lo", "hi")))
        cur = cur.select(*keys, "dense", F.when(taken, k).otherwise(F.col("rank")).alias("rank"), F.inline(parts)).where("lo <= hi")
    return cur.where("rank is not null").select(*keys, "rank", F.col("lo").alias("first"), F.col("hi").alias("last"), "dense")


def _middle(xs: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(xs)
    return (F.get(xs, F.floor((n - 1) / 2).cast("int")) + F.get(xs, F.floor(n / 2).cast("int"))) / 2


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value reckoned once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _weighted_middle(xs: Column) -> Column:
    """Median of a sorted array of (d, n), in which d stands n times; null if it is empty."""
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0).cast("long").alias("so_far"), none.alias("low"), none.alias("high"))

    def middle(total: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            n = acc["so_far"] + x["n"]
            at = lambda name, k: F.coalesce(acc[name], F.when(n > k, x["d"])).alias(name)
            return F.struct(n.alias("so_far"), at("low", F.floor((total - 1) / 2)), at("high", F.floor(total / 2)))

        return F.aggregate(xs, start, add, lambda acc: (acc["low"] + acc["high"]) / 2)

    return _bound(F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + x["n"]), middle)


def _centred(runs: DataFrame, keys: list[str], most: int, s: Settings) -> DataFrame:
    """``keys, rank, dense, centre, narrow`` of the densest plateaus; narrow ones are to move to a median."""
    top = plateaus(runs, keys, most, s)
    centre = F.floor((F.col("first") + F.col("last")) / 2) * s.bin - s.window
    return top.select(*keys, "rank", "dense", centre.alias("centre"), ((F.col("last") - F.col("first")) * s.bin < s.tol).alias("narrow"))


def _reach(s: Settings) -> float:
    """How far from a centre its medians can lead."""
    return s.tol * s.refine_passes + s.bin


def _moved(top: DataFrame, near: DataFrame, keys: list[str], s: Settings) -> DataFrame:
    """``keys, rank, offset, dense``: narrow centres moved to the median of what is ``near`` (keys, rank, ds: sorted (d, n)), as often as set."""
    step = lambda o, _: _bound(F.filter("ds", lambda x: F.abs(x["d"] - o) <= s.tol), lambda n: F.coalesce(_weighted_middle(n), o))
    passes = F.sequence(F.lit(1), F.lit(s.refine_passes)) if s.refine_passes else F.array().cast("array<int>")
    none = F.array().cast("array<struct<d:double,n:bigint>>")
    found = top.join(near, [*keys, "rank"], "left").withColumn("ds", F.coalesce("ds", none))
    return found.select(*keys, "rank", F.aggregate(passes, F.col("centre"), step).alias("offset"), "dense")


def peaks(diffs: DataFrame, keys: list[str], most: int, s: Settings = Settings()) -> DataFrame:
    """``keys, rank, offset, dense``: centres of the densest plateaus of differences.

    Where a plateau is narrower than the tolerance its centre moves to the median of
    the differences around it, as often as set.
    """
    top, reach = _centred(density_runs(binned(diffs, keys, s), keys, s), keys, most, s), _reach(s)
    cell = lambda c: F.floor(c / (2 * reach)).cast("long")
    asked = top.where("narrow").select(*keys, "rank", "centre", F.explode(F.sequence(cell(F.col("centre") - reach), cell(F.col("centre") + reach))).alias("cell"))
    d = diffs.groupBy(*keys, "d").agg(F.count("*").alias("n")).withColumn("cell", cell(F.col("d")))
    found = asked.join(d, [*keys, "cell"]).where(F.abs(F.col("d") - F.col("centre")) <= reach)
    near = found.groupBy(*keys, "rank").agg(F.array_sort(F.collect_list(F.struct("d", "n"))).alias("ds"))
    return _moved(top, near, keys, s)


def stream_peaks(ref: DataFrame, sub: DataFrame, keys: list[str], s: Settings = Settings(), local: bool = True) -> DataFrame:
    """``keys, bucket, rank, offset, dense``: peaks of the whole running time (bucket -1) and, if asked, of each stretch that has enough differences.

    Differences are counted where they are made, by bin and then, near narrow
    plateaus, by value; no table holds a row for each of them.
    """
    counts = stored(difference_counts(ref, sub, keys, s.window, s.bin, s.bucket), "differences")
    whole = counts.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    of = [*keys, "bucket"]
    top = _centred(density_runs(whole, keys, s), keys, s.global_peaks, s).select(*keys, F.lit(-1).alias("bucket"), "rank", "dense", "centre", "narrow")
    if local:
        each = counts.where("cell >= 0").withColumn("bucket", F.col("cell").cast("int"))
        full = each.groupBy(*of).agg(F.sum("n").alias("total")).where(F.col("total") >= s.min_cues).select(*of)
        top = top.union(_centred(density_runs(each.join(full, of, "left_semi"), of, s), of, s.bucket_peaks, s).select(*of, "rank", "dense", "centre", "narrow"))
    top = stored(top, "plateaus")
    near = differences_near(ref, sub, top.where("narrow").select(*of, "rank", "centre"), keys, _reach(s), s.window, s.bucket)
    near = near.groupBy(*of, "rank").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("ds"))
    return _moved(top, near, of, s)


def offset_candidates(ref: DataFrame, sub: DataFrame, keys: list[str], s: Settings = Settings()) -> DataFrame:
    """``keys, cand, offset``: peaks over the whole running time, then those of each stretch of it that are clear of all before."""
    rows = F.array_sort(F.collect_list(F.struct("bucket", "rank", "offset")))
    clear = lambda found, p: (p["bucket"] < 0) | F.forall(found, lambda c: F.abs(p["offset"] - c) > s.separation)
    kept = F.aggregate(rows, F.array().cast("array<double>"), lambda found, p: F.when(clear(found, p), F.concat(found, F.array(p["offset"]))).otherwise(found))
    both = stream_peaks(ref, sub, keys, s).groupBy(*keys).agg(kept.alias("found"))
    return both.select(*keys, F.posexplode("found").alias("cand", "offset"))


def hit_prefixes(ref: DataFrame, sub: DataFrame, cands: DataFrame, keys: list[str], tol: float = 0.35) -> DataFrame:
    """``keys, cand, offset, n, prefix``: how many of a pair's first k moments, moved by a candidate, have another within ``tol``, for k from 0 to n."""
    r = ref.where("t is not null").select(*keys, "t", (F.row_number().over(Window.partitionBy(*keys).orderBy("t")) - 1).alias("i"))
    cell = lambda c: F.floor(c / (2 * tol)).cast("long")
    moved = r.join(cands, keys).select(*keys, "cand", "i", (F.col("t") - F.col("offset")).alias("x"))
    moved = moved.withColumn("cell", cell(F.col("x")))
    a = sub.where("t is not null").select(*keys, F.col("t").alias("a"), F.explode(F.array(*[cell(F.col("t")) + k for k in (-1, 0, 1)])).alias("cell"))
    same = [moved[k] == a[k] for k in (*keys, "cell")]
    hit = moved.join(a, [*same, F.abs(moved["x"] - a["a"]) <= tol], "left_semi")
    places = hit.groupBy(*keys, "cand").agg(F.array_sort(F.collect_list("i")).alias("at"))
    size = r.groupBy(*keys).agg(F.count("*").cast("int").alias("n"))
    out = cands.join(size, keys).join(places, [*keys, "cand"], "left")
    # the j-th hit is where the sum turns from j to j + 1
    turns = F.concat(F.array(F.lit(-1)), F.coalesce("at", F.array().cast("array<int>")), F.array("n"))
    sums = F.flatten(F.transform(F.sequence(F.lit(0), F.size("turns") - 2), lambda j: F.array_repeat(j, F.get("turns", j + 1) - F.get("turns", j))))
    return out.withColumn("turns", turns).select(*keys, "cand", "offset", "n", sums.alias("prefix"))


def best_cuts(prefixes: DataFrame, segments: DataFrame, keys: list[str], min_cues: int = 12) -> DataFrame:
    """``keys, a, b, k, p, q``: of each segment [a, b) of moments the cut, and the candidates before and behind it, with most hits.

    The first of equal cuts and the first of equal candidates stand; a segment too
    short, or one that no two different candidates cut, has no row.
    """
    open_ = segments.where(F.col("b") - F.col("a") >= 2 * min_cues)
    x = prefixes.select(*keys, "cand", "prefix").join(open_, keys)
    k = F.explode(F.sequence(F.col("a") + min_cues, F.col("b") - min_cues)).alias("k")
    at = lambda c: F.get("prefix", F.col(c))
    x = x.select(*keys, "a", "b", "cand", "prefix", k).select(*keys, "a", "b", "k", "cand", (at("k") - at("a")).alias("head"), (at("b") - at("k")).alias("tail"))
    first = lambda c: F.max(F.struct(F.col(c).alias("hits"), (-F.col("cand")).alias("cand")))
    per = x.groupBy(*keys, "a", "b", "k").agg(first("head").alias("h"), first("tail").alias("t")).where("h.cand <> t.cand")
    most = F.max(F.struct((F.col("h.hits") + F.col("t.hits")).alias("hits"), (-F.col("k")).alias("k"), F.col("h.cand").alias("p"), F.col("t.cand").alias("q")))
    return per.groupBy(*keys, "a", "b").agg(most.alias("m")).select(*keys, "a", "b", (-F.col("m.k")).alias("k"), (-F.col("m.p")).alias("p"), (-F.col("m.q")).alias("q"))


def _hits(cand: Column, a: Column, b: Column) -> Column:
    """Hits of a candidate among the moments [a, b), from ``sums``."""
    return _bound(F.get("sums", cand), lambda p: F.get(p, b) - F.get(p, a))


def worth(cuts: Column, labels: Column, s: Settings = Settings()) -> Column:
    """The rate of a division whose every part and every cut earns its place, else null.

    Reads ``sums`` (an array of prefix sums per candidate), ``offsets``, ``chance`` and ``n``.
    """
    size = lambda i: F.get(cuts, i + 1) - F.get(cuts, i)
    rate = lambda label, i: _hits(F.get(labels, label), F.get(cuts, i), F.get(cuts, i + 1)) / size(i)
    parts = F.sequence(F.lit(0), F.size(labels) - 1)
    rates = F.transform(parts, lambda i: rate(i, i))
    inner = F.slice(parts, 1, F.size(labels) - 1)
    offset = lambda i: F.get("offsets", F.get(labels, i))
    jump = lambda i: F.abs(offset(i + 1) - offset(i)).between(s.min_break, s.max_break)
    mine = lambda i: F.when(size(i) <= size(i + 1), i).otherwise(i + 1)
    margin = lambda i: rate(mine(i), mine(i)) - rate(2 * i + 1 - mine(i), mine(i)) >= s.min_margin
    total = F.aggregate(parts, F.lit(0.0), lambda t, i: t + F.get(rates, i) * size(i)) / F.col("n")
    good = F.forall(rates, lambda r: r >= F.col("chance") * s.min_excess) & F.forall(inner, lambda i: jump(i) & margin(i))
    return F.when(good, total)


def gathered(prefixes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, offsets, sums``: a pair's candidates in their order, one row each pair."""
    rows = F.array_sort(F.collect_list(F.struct("cand", "offset", "prefix")))
    g = prefixes.groupBy(*keys, "n").agg(rows.alias("rows"))
    return g.select(*keys, "n", F.transform("rows", lambda r: r["offset"]).alias("offsets"), F.transform("rows", lambda r: r["prefix"]).alias("sums"))


def split_frontier(prefixes: DataFrame, chances: DataFrame, keys: list[str], s: Settings = Settings(), max_segments: int | None = None) -> DataFrame:
    """``keys, n, offsets, sums, chance, cuts, labels, score, single``: the division of every pair that greedy cuts lead to.

    ``chances``: keys, chance.  Part i holds the moments from cuts[i] to cuts[i + 1]
    under candidate labels[i]; ``single`` is the best candidate of an uncut pair.
    """
    pairs = stored(gathered(prefixes, keys).join(chances.select(*keys, "chance"), keys), "pairs")
    total = F.transform("sums", lambda p: F.element_at(p, -1))
    best = (F.array_position(total, F.array_max(total)) - 1).cast("int")
    state = pairs.select(
        *keys, F.array(F.lit(0), F.col("n")).alias("cuts"), F.array(best).alias("labels"), (F.array_max(total) / F.col("n")).alias("score"), best.alias("single"),
        F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("fresh"),
    )
    state, cache = stored(state, "state"), None
    while True:
        moving = state.where(F.size("fresh") > 0)
        if max_segments is not None:
            moving = moving.where(F.size("labels") < max_segments)
        found = best_cuts(prefixes, moving.select(*keys, F.inline("fresh")), keys, s.min_cues)
        found = stored(found if cache is None else cache.union(found), "cuts")
        i = F.array_position("cuts", F.col("a")).cast("int")
        tries = moving.join(found, keys).where(F.get("cuts", i) == F.col("b")).withColumn("i", i)
        join = lambda c, cut, *new: F.concat(F.slice(c, F.lit(1), cut), F.array(*new), F.slice(c, F.col("i") + 1, F.size(c)))
        tries = tries.select(
            *keys, "a", "b", "k", "i", "score", join("cuts", F.col("i"), F.col("k")).alias("cuts"), join("labels", F.col("i") - 1, F.col("p"), F.col("q")).alias("labels")
        )
        w = worth(F.col("cuts"), F.col("labels"), s)
        tries = tries.join(pairs, keys).withColumn("w", w).where(F.col("w") - F.col("score") >= s.min_gain)
        fresh = F.array(F.struct("a", F.col("k").alias("b")), F.struct(F.col("k").alias("a"), "b"))
        take = tries.groupBy(*keys).agg(F.max_by(F.struct("cuts", "labels", F.col("w").alias("score"), fresh.alias("fresh")), F.struct("w", -F.col("i"))).alias("new"))
        none = F.array().cast("array<struct<a:int,b:int>>")
        after = state.join(take, keys, "left").select(
            *keys, *[F.coalesce(f"new.{c}", c).alias(c) for c in ("cuts", "labels", "score")], "single", F.coalesce("new.fresh", none).alias("fresh")
        )
        last = [state] if cache is None else [state, cache]
        state, cache = stored(after, "state"), found
        discard(*last)
        if state.where(F.size("fresh") > 0).isEmpty():
            break
    discard(cache)
    return pairs.join(state.drop("fresh"), keys)


def tie_range(a: Column, b: Column, p: Column, q: Column, s: Settings = Settings()) -> Column:
    """(first, last) place of a cut of [a, b) between two candidates that is as good as the best up to the slack; reads ``sums``."""
    least = s.min_cues
    places = F.sequence(a + least, b - least)
    score = lambda k: _hits(p, a, k) + _hits(q, k, b)
    scored = F.transform(places, lambda k: F.struct(score(k).alias("hits"), k.alias("k")))

    def good(rows: Column) -> Column:
        most = F.array_max(F.transform(rows, lambda r: r["hits"]))
        return F.filter(rows, lambda r: r["hits"] >= most - s.tie_slack - 1e-9)

    ends = _bound(scored, lambda rows: _bound(good(rows), lambda g: F.struct(F.get(g, F.lit(0))["k"].alias("first"), F.element_at(g, -1)["k"].alias("last"))))
    middle = (a + F.floor((b - a) / 2)).cast("int")
    return F.when(b - a >= 2 * least, ends).otherwise(F.struct(middle.alias("first"), middle.alias("last")))


def refined(parts: DataFrame, ref: DataFrame, sub: DataFrame, keys: list[str], s: Settings = Settings()) -> DataFrame:
    """``keys, part, fine``: the middle of the best of the offsets around a part's own, tried in steps.

    ``parts``: keys, part, lo, hi (its moments, ends included), offset.  A part no
    offset hits keeps its own.
    """
    steps = int(round(s.refine_window / s.refine_step))
    reach = s.refine_window + s.tol + s.refine_step
    cell = lambda c: F.floor(c / (2 * reach)).cast("long")
    r = ref.join(parts, keys).where(F.col("t").between(F.col("lo"), F.col("hi"))).select(*keys, "part", "offset", F.col("t").alias("r"), F.monotonically_increasing_id().alias("who"))
    r = r.withColumn("cell", F.explode(F.sequence(cell(F.col("r") - F.col("offset") - reach), cell(F.col("r") - F.col("offset") + reach))))
    a = sub.where("t is not null").select(*keys, F.col("t").alias("a"), cell(F.col("t")).alias("cell"))
    near = r.join(a, [*keys, "cell"]).where(F.abs(F.col("r") - F.col("offset") - F.col("a")) <= reach)
    near = near.groupBy(*keys, "part", "offset", "r", "who").agg(F.collect_list("a").alias("near"))
    at = lambda k: F.col("offset") + k * s.refine_step
    ks = F.filter(F.sequence(F.lit(-steps), F.lit(steps)), lambda k: F.exists("near", lambda x: F.abs(F.col("r") - at(k) - x) <= s.tol))
    per = near.select(*keys, "part", "offset", F.explode(ks).alias("k")).groupBy(*keys, "part", "offset", "k").agg(F.count("*").alias("hits"))
    top = per.groupBy(*keys, "part", "offset").agg(F.max(F.struct("hits", (-F.col("k")).alias("k"))).alias("f"), F.max(F.struct("hits", "k")).alias("l"))
    return top.select(*keys, "part", ((at(-F.col("f.k")) + at(F.col("l.k"))) / 2).alias("fine"))


def walk(s: Settings = Settings()) -> Column:
    """Per stretch of the running time the rate of the offset in force and of the best one near it.

    Reads ``moments`` (sorted), ``sums``, ``offsets``, ``cuts``, ``labels``, ``chance``.
    """
    of = lambda t: F.floor(t / s.bucket).cast("int")
    buckets = F.when(F.size("moments") > 0, F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), of(F.element_at("moments", -1)))), lambda b: F.lit(True)))
    least = F.lit(s.min_bucket_cues)
    parts = F.sequence(F.lit(0), F.size("labels") - 1)

    def row(b: Column) -> Column:
        return _bound(F.filter(F.sequence(F.lit(0), F.size("moments") - 1), lambda i: of(F.get("moments", i)) == b), lambda own: told(b, own))

    def told(b: Column, own: Column) -> Column:
        x, n = F.get(own, F.lit(0)), F.size(own)
        y = x + n
        inside = lambda i: F.greatest(F.lit(0), F.least(y, F.get("cuts", i + 1)) - F.greatest(x, F.get("cuts", i)))
        hits = F.aggregate(parts, F.lit(0), lambda t, i: t + F.when(inside(i) > 0, _hits(F.get("labels", i), F.greatest(x, F.get("cuts", i)), F.least(y, F.get("cuts", i + 1)))).otherwise(0))
        held = F.array_sort(F.flatten(F.transform(parts, lambda i: F.array_repeat(F.get("offsets", F.get("labels", i)), inside(i)))))
        centre = _middle(held)
        near = lambda c: F.filter(F.sequence(F.lit(0), F.size("offsets") - 1), lambda k: F.abs(F.get("offsets", k) - c) <= s.local_window)
        scored = lambda c: F.transform(near(c), lambda k: F.struct(_hits(k, x, y).alias("hits"), (-k).alias("k")))
        spread = F.sqrt(F.greatest(F.col("chance") * (1 - F.col("chance")), F.lit(0.0)) / n)
        floor = F.when(F.col("chance") > 0, F.least(F.lit(1.0), F.col("chance") + s.noise_z * spread)).otherwise(1.0)
        best = _bound(centre, lambda c: _bound(F.array_max(scored(c)), lambda m: F.struct(c.alias("centre"), F.get("offsets", -m["k"]).alias("wanted"), (m["hits"] / n).alias("rate"))))
        enough = n >= least
        applied = hits / n
        return _bound(
            F.when(enough, best),
            lambda m: F.struct(
                (b * s.bucket).cast("double").alias("t0"), n.alias("n"), F.when(enough, applied).alias("applied"), m["wanted"].alias("wanted"), m["rate"].alias("rate"),
                F.coalesce(enough & (m["rate"] - applied > s.rate_slack) & (F.abs(m["wanted"] - m["centre"]) > s.max_drift) & (m["rate"] > floor), F.lit(False)).alias("fails"),
                m["centre"].alias("centre"),
            ),
        )

    kind = "array<struct<t0:double,n:int,applied:double,wanted:double,rate:double,fails:boolean,centre:double>>"
    return F.coalesce(F.transform(buckets, row), F.array()).cast(kind)


def chance_rates(ref: DataFrame, sub: DataFrame, durations: DataFrame, keys: list[str], tol: float = 0.35) -> DataFrame:
    """``keys, chance, n_ref, n_sub, moments``: how often a moment is met by chance, over the longer of the duration and the subtitle's own span."""
    r = ref.where("t is not null").groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("moments"))
    a = sub.where("t is not null").groupBy(*keys).agg(F.count("*").cast("int").alias("n_sub"), (F.max("t") - F.min("t")).alias("own"))
    x = durations.select(*keys, F.col("duration").cast("double").alias("duration")).join(r, keys, "left").join(a, keys, "left")
    span = F.greatest(F.coalesce("own", F.lit(0.0)), F.when(F.col("duration") != 0, F.col("duration")))
    n = F.coalesce("n_sub", F.lit(0))
    chance = F.when(span > 0, F.least(F.lit(1.0), 2 * tol * n / span)).otherwise(1.0)
    moments = F.coalesce("moments", F.array().cast("array<double>"))
    return x.select(*keys, chance.alias("chance"), F.size(moments).alias("n_ref"), n.alias("n_sub"), moments.alias("moments"))


def fit(ref: DataFrame, sub: DataFrame, durations: DataFrame, keys: list[str], s: Settings = Settings(), max_segments: int | None = None) -> DataFrame:
    """The fit of every pair of ``durations`` (keys, duration; null if unknown), with the columns of ``align.FIT``.

    A pair without candidates has one segment at 0 and score 0.
    """
    base = stored(chance_rates(ref, sub, durations, keys, s.tol), "base")
    cands = stored(offset_candidates(ref, sub, keys, s), "candidates")
    prefixes = stored(hit_prefixes(ref, sub, cands, keys, s.tol), "prefixes")
    cut = stored(split_frontier(prefixes, base, keys, s, max_segments).join(base.select(*keys, "moments"), keys), "division")
    i = F.col("part")
    parts = cut.select(*keys, "cuts", "labels", "offsets", "moments", F.explode(F.sequence(F.lit(0), F.size("labels") - 1)).alias("part"))
    parts = parts.select(*keys, "part", F.get("moments", F.get("cuts", i)).alias("lo"), F.get("moments", F.get("cuts", i + 1) - 1).alias("hi"), F.get("offsets", F.get("labels", i)).alias("offset"))
    fine = parts.select(*keys, "part", "offset").join(refined(parts, ref, sub, keys, s), [*keys, "part"], "left")
    fine = fine.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", F.coalesce("fine", "offset").alias("fine")))).alias("fine"))
    inner = F.when(F.size("labels") > 1, F.sequence(F.lit(0), F.size("labels") - 2)).otherwise(F.array().cast("array<int>"))
    place = lambda k: tie_range(F.get("cuts", k), F.get("cuts", k + 2), F.get("labels", k), F.get("labels", k + 1), s)
    t = lambda k: F.get("moments", k)
    gaps = F.transform(inner, lambda k: _bound(place(k), lambda z: F.struct(t(z["first"]).alias("lo"), t(z["last"]).alias("hi"))))
    out = cut.join(fine, keys).withColumn("gaps", gaps)
    split = lambda k: F.get("gaps", k)["lo"]
    segments = F.transform("fine", lambda f, k: F.struct(split(k).alias("split"), f["fine"].alias("offset")))
    out = out.select(*keys, segments.alias("segments"), "score", F.get("offsets", F.col("single")).alias("single_offset"), (F.element_at(F.get("sums", F.col("single")), -1) / F.col("n")).alias("single_rate"), walk(s).alias("buckets"), "gaps", "offsets")
    none = F.array(F.struct(F.lit(None).cast("double").alias("split"), F.lit(0.0).alias("offset")))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    kinds = dict(out.dtypes)
    return base.join(out, keys, "left").select(
        *keys, F.coalesce("segments", none).alias("segments"), zero("score"), "chance", zero("single_offset"), zero("single_rate"),
        empty("buckets", kinds["buckets"]).alias("buckets"), empty("gaps", kinds["gaps"]).alias("gaps"), empty("offsets", "array<double>").alias("candidates"), "n_ref", "n_sub",
    )
