"""Alignment, running time, agreement and verdict queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import agreement, align, runtime, splits, verdict
from . import inputs
from .inputs import LINES, MOMENTS, SPLICED, SUBTITLES, VIDEOS, table

QUERIES: dict = {}
SQL: dict = {}
K = ["pair_id"]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"""WITH {MOMENTS},
g AS (SELECT pair_id, side, list_sort(list_distinct(list(round_even(t, 3)))) AS xs FROM moments GROUP BY pair_id, side),
k AS (SELECT pair_id, side, list_reduce(list_transform(xs, lambda x: [x]), lambda kept, x: CASE WHEN x[1] - kept[-1] > 15e-2 THEN list_concat(kept, x) ELSE kept END) AS s FROM g)
SELECT pair_id, side, len(s) AS n, s[1] AS first, s[-1] AS last FROM k""")
def unique_starts(spark, d):
    s = align.unique_starts(inputs.moments(spark, d), ["pair_id", "side"])
    return s.select("pair_id", "side", F.size("starts").cast("long").alias("n"), F.element_at("starts", 1).alias("first"), F.element_at("starts", -1).alias("last"))


@query(f"""WITH {MOMENTS},
p AS (SELECT r.pair_id, r.t - a.t AS d FROM moments r JOIN moments a ON r.pair_id = a.pair_id AND r.side = 0 AND a.side = 1 AND abs(r.t - a.t) <= 120e0)
SELECT pair_id, count(*) AS n, min(d) AS lo, max(d) AS hi FROM p GROUP BY pair_id""")
def band_join_differences(spark, d):
    x = align.differences(*inputs.sides(spark, d), K)
    return x.groupBy("pair_id").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))


@query(f"""WITH {MOMENTS},
p AS (SELECT r.pair_id, floor((r.t - a.t + 120e0) / 1e-2)::BIGINT AS bin FROM moments r JOIN moments a ON r.pair_id = a.pair_id AND r.side = 0 AND a.side = 1 AND abs(r.t - a.t) <= 120e0),
h AS (SELECT pair_id, bin, count(*) AS n FROM p GROUP BY 1, 2)
SELECT pair_id, bin, n, sum(n) OVER (PARTITION BY pair_id ORDER BY bin RANGE BETWEEN 35 PRECEDING AND 35 FOLLOWING)::BIGINT AS smooth FROM h""")
def offset_histogram(spark, d):
    return align.offset_histogram(*inputs.sides(spark, d), K)


HITS = """
hit AS (SELECT r.pair_id, r.t, r.side, EXISTS (SELECT 1 FROM moments a WHERE a.pair_id = r.pair_id AND a.side = 1 AND abs((r.t - 5e-1) - a.t) <= 35e-2) AS hit
        FROM moments r WHERE r.side = 0)"""


@query(f"WITH {MOMENTS}, {HITS} SELECT pair_id, avg(hit::INT::DOUBLE) AS rate, count(*) AS n FROM hit GROUP BY pair_id")
def nearest_hit_rate(spark, d):
    return align.match_rate(align.nearest_hits(*inputs.sides(spark, d), K, 0.5), K)


@query(f"""WITH {MOMENTS}, {HITS}
SELECT pair_id, floor(t / 120) * 120 AS t0, count(*) AS n, CASE WHEN count(*) >= 8 THEN avg(hit::INT::DOUBLE) END AS rate FROM hit GROUP BY 1, 2""")
def runtime_walk(spark, d):
    return align.bucket_walk(align.nearest_hits(*inputs.sides(spark, d), K, 0.5), K).withColumn("t0", F.col("t0").cast("double"))


@query(f"""WITH {MOMENTS},
s AS (SELECT pair_id, count(*) FILTER (side = 0) AS n_ref, count(*) FILTER (side = 1) AS n_sub, max(t) - min(t) AS span FROM moments GROUP BY 1),
c AS (SELECT *, CASE WHEN span <= 0 THEN 1e0 ELSE least(1e0, 7e-1 * n_sub / span) END AS chance FROM s),
f AS (SELECT *, CASE WHEN least(n_ref, n_sub) <= 0 OR chance <= 0 THEN 1e0 ELSE least(1e0, chance + 4e0 * sqrt(greatest(chance * (1e0 - chance), 0e0) / least(n_ref, n_sub))) END AS floor FROM c)
SELECT pair_id, chance, floor, CASE WHEN 5e-1 >= floor THEN 'above' ELSE 'below' END AS side FROM f""")
def chance_and_noise_floor(spark, d):
    m = inputs.moments(spark, d).groupBy("pair_id").agg(
        F.count_if(F.col("side") == 0).alias("n_ref"), F.count_if(F.col("side") == 1).alias("n_sub"), (F.max("t") - F.min("t")).alias("span")
    )
    m = m.withColumn("chance", verdict.chance_rate(F.col("n_sub"), F.col("span")))
    m = m.withColumn("floor", verdict.noise_floor(F.col("chance"), F.least("n_ref", "n_sub")))
    return m.select("pair_id", "chance", "floor", F.when(F.lit(0.5) >= F.col("floor"), "above").otherwise("below").alias("side"))


@query(f"""WITH {MOMENTS},
r AS (SELECT pair_id, t, row_number() OVER (PARTITION BY pair_id ORDER BY t) - 1 AS i FROM (SELECT DISTINCT pair_id, t FROM moments WHERE side = 0)),
h AS (SELECT pair_id, i, cand, EXISTS (SELECT 1 FROM moments a WHERE a.pair_id = r.pair_id AND a.side = 1 AND abs((r.t - cand * 7e0) - a.t) <= 5e0)::INT AS hit FROM r, (SELECT unnest([0, 1, 2]) AS cand)),
p AS (SELECT pair_id, i + 1 AS k, cand, sum(hit) OVER (PARTITION BY pair_id, cand ORDER BY i) AS head, sum(hit) OVER (PARTITION BY pair_id, cand) AS whole, count(*) OVER (PARTITION BY pair_id, cand) AS n FROM h),
q AS (SELECT pair_id, k, cand, head, whole - head AS tail FROM p WHERE k >= 12 AND k <= n - 12),
b AS (SELECT pair_id, k, max(head) AS head, max(tail) AS tail, arg_max(cand, head * 10 - cand) AS first, arg_max(cand, tail * 10 - cand) AS second FROM q GROUP BY 1, 2),
o AS (SELECT *, head + tail AS total, row_number() OVER (PARTITION BY pair_id ORDER BY head + tail DESC, k) AS rk FROM b WHERE first <> second)
SELECT pair_id, k, total::BIGINT AS total, first, second FROM o WHERE rk = 1""")
def best_single_cut(spark, d):
    r, a = inputs.sides(spark, d)
    cands = F.explode(F.array(*[F.lit(c) for c in range(3)])).alias("cand")
    both = [*K, "cand"]
    hit = align.nearest_hits(r.distinct().select("*", cands), a.select("*", cands), both, F.col("cand") * 7.0, 5.0)
    hit = hit.withColumn("i", F.row_number().over(Window.partitionBy(*both).orderBy("t")) - 1)
    return align.best_cut(hit, K).withColumn("k", F.col("k").cast("long"))


SEGMENTS = "array(struct(double(1800) as split, 1.5D as offset), struct(double(3600) as split, -8.25D as offset), struct(cast(null as double) as split, 4.0D as offset))"


@query(f"""WITH {MOMENTS}
SELECT pair_id, side, t, t + CASE WHEN t >= 3600e0 + 825e-2 THEN 4e0 WHEN t >= 1800e0 - 15e-1 THEN -825e-2 ELSE 15e-1 END AS mapped,
       t >= 17985e-1 AND t < 17985e-1 + 975e-2 AS removed,
       CASE WHEN t < 1800 THEN 15e-1 WHEN t < 3600 THEN -825e-2 ELSE 4e0 END AS offset_there
FROM moments""")
def piecewise_mapping(spark, d):
    a = inputs.moments(spark, d).withColumn("g", F.expr(SEGMENTS))
    return a.select(
        "pair_id", "side", "t", align.map_time(F.col("t"), F.col("g")).alias("mapped"), align.is_removed(F.col("t"), F.col("g")).alias("removed"),
        align.offset_at(F.col("t"), F.col("g")).alias("offset_there"),
    )


@query(f"""WITH {LINES}
SELECT r.pair_id, r.start AS r0, r."end" AS r1, s.start AS p0, s."end" AS p1,
       (least(r."end", s."end") - greatest(r.start, s.start)) / (greatest(r."end", s."end") - least(r.start, s.start)) AS share
FROM lines r JOIN lines s ON r.pair_id = s.pair_id AND r.side = 0 AND s.side = 1 AND r.start < s."end" AND s.start < r."end" """)
def interval_overlap_join(spark, d):
    x = inputs.lines(spark, d)
    return align.overlap_join(x.where("side = 0"), x.where("side = 1"), K)


@query(f"""WITH {MOMENTS},
h AS (SELECT s.pair_id, s.t, EXISTS (SELECT 1 FROM moments r WHERE r.pair_id = s.pair_id AND r.side = 0 AND abs(r.t - s.t) <= 10e0) AS hit FROM moments s WHERE s.side = 1),
w AS (SELECT *, CASE WHEN NOT hit AND coalesce(lag(hit) OVER (PARTITION BY pair_id ORDER BY t), true) THEN 1 ELSE 0 END AS new FROM h),
i AS (SELECT *, sum(new) OVER (PARTITION BY pair_id ORDER BY t) AS run FROM w)
SELECT pair_id, min(t) AS lo, max(t) AS hi, count(*) AS lines FROM i WHERE NOT hit GROUP BY pair_id, run""")
def unchecked_runs(spark, d):
    r, a = inputs.sides(spark, d)
    return align.unchecked_runs(r, a, K, 10.0)


@query(f"""WITH {MOMENTS},
g AS (SELECT pair_id, side, t, t - lag(t) OVER (PARTITION BY pair_id, side ORDER BY t) AS gap FROM moments),
e AS (SELECT pair_id, side, coalesce(max(t) FILTER (gap <= 20e0), min(t)) AS e FROM g GROUP BY 1, 2)
SELECT pair_id, side, CASE WHEN e > 0 THEN e END AS content_end FROM e""")
def content_end(spark, d):
    return runtime.content_end(inputs.moments(spark, d), ["pair_id", "side"], "t", 20.0)


@query(f"""WITH {VIDEOS}, {SUBTITLES}
SELECT v.id AS video, s.id AS subtitle,
  CASE WHEN v.seconds IS NULL OR s.last IS NULL OR s.cues < 5 THEN 'unknown' WHEN s.last > v.seconds * 125e-2 AND s.last - v.seconds > 120e0 THEN 'impossible' ELSE 'plausible' END AS verdict,
  1e0 / (1e0 + abs((s.last - v.seconds) / v.seconds) / CASE WHEN (s.last - v.seconds) / v.seconds > 0 THEN 325e-4 ELSE 65e-3 END) AS score
FROM videos v JOIN subtitles s ON v.id = s.id""")
def runtime_gate(spark, d):
    v, s = inputs.videos(spark, d), inputs.subtitles(spark, d)
    j = v.select(F.col("id").alias("video"), "seconds").join(s.select(F.col("id").alias("subtitle"), "last", "cues"), F.col("video") == F.col("subtitle"))
    return j.select("video", "subtitle", runtime.runtime_verdict(F.col("seconds"), F.col("last"), F.col("cues")).alias("verdict"), runtime.runtime_score(F.col("seconds"), F.col("last")).alias("score"))


OFFSETS = """
o AS (SELECT l_suppkey % 50 AS g, ((l_partkey * 37) % 4000)::DOUBLE AS offset_ms FROM lineitem)"""


@query(f"""WITH {OFFSETS},
n AS (SELECT g, offset_ms AS o, count(*) OVER w AS n, min(offset_ms) OVER w AS below FROM o WINDOW w AS (PARTITION BY g ORDER BY offset_ms RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING)),
b AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, o) AS rk, count(*) OVER (PARTITION BY g) AS size FROM n),
t AS (SELECT g, n, below, size FROM b WHERE rk = 1),
r AS (SELECT g, offset_ms, row_number() OVER (PARTITION BY g ORDER BY offset_ms) AS i FROM o),
f AS (SELECT t.g, t.n, t.size, min(r.i) AS lo FROM t JOIN r ON t.g = r.g AND r.offset_ms >= t.below GROUP BY 1, 2, 3)
SELECT f.g, f.size, f.n::DOUBLE / f.size AS coherence, r.offset_ms AS centre, f.size >= 3 AND f.n::DOUBLE / f.size >= 6e-1 AS coheres
FROM f JOIN r ON f.g = r.g AND r.i = f.lo + f.n // 2""")
def cluster_coherence(spark, d):
    o = table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("g"), ((F.col("l_partkey") * 37) % 4000).cast("double").alias("offset_ms"))
    return agreement.coherence(o, ["g"])


FITS = """
f AS (SELECT o_orderkey AS id, (o_orderkey % 100) / 100e0 AS score, (o_orderkey % 7 + 1) / 20e0 AS chance, o_orderkey % 60 AS n_ref, o_orderkey % 45 AS n_sub,
             CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS failing, o_orderkey % 4 AS usable, o_orderkey % 5 = 0 AS coheres, o_orderkey % 2 = 0 AS agrees FROM orders)"""


def fits(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("id"), ((k % 100) / 100.0).alias("score"), ((k % 7 + 1) / 20.0).alias("chance"), (k % 60).alias("n_ref"), (k % 45).alias("n_sub"),
        F.when(k % 9 == 0, 1).otherwise(0).alias("failing"), (k % 4).alias("usable"), (k % 5 == 0).alias("coheres"), (k % 2 == 0).alias("agrees"),
    )


@query(f"""WITH {FITS},
n AS (SELECT *, least(n_ref, n_sub) AS n FROM f),
c AS (SELECT *, CASE WHEN n <= 0 THEN 1e0 ELSE least(1e0, chance + 4e0 * sqrt(greatest(chance * (1e0 - chance), 0e0) / n)) END AS floor FROM n),
e AS (SELECT *, n >= 5 AND score > floor AS measurable, CASE WHEN n >= 5 AND score > floor THEN score / chance ELSE 0e0 END AS excess FROM c),
b AS (SELECT *, CASE WHEN failing > 0 THEN 'failed' WHEN usable = 0 THEN 'absent' WHEN usable < 2 THEN 'weak' ELSE 'held' END AS runtime_check,
        CASE WHEN n < 5 THEN 'error' WHEN NOT measurable OR failing > 0 THEN 'refuse' WHEN excess >= 25e-1 THEN 'accept' WHEN excess < 15e-1 THEN 'refuse' WHEN agrees AND coheres THEN 'accept' ELSE 'escalate' END AS band FROM e),
w AS (SELECT *, CASE WHEN agrees AND coheres AND excess < 25e-1 THEN 'uncertain' WHEN excess >= 4 THEN 'locked' WHEN excess >= 3 THEN 'strong' WHEN excess >= 25e-1 THEN 'fair' ELSE 'uncertain' END AS w FROM b)
SELECT id, excess, runtime_check, band, CASE band WHEN 'error' THEN 'ERROR' WHEN 'accept' THEN 'CONFIDENT' ELSE 'REFUSED' END AS outcome,
       CASE WHEN band = 'accept' THEN CASE WHEN runtime_check = 'absent' AND w IN ('locked', 'strong') THEN 'fair' ELSE w END END AS word FROM w""")
def judge_fits(spark, d):
    return verdict.judge(fits(spark, d)).select("id", "excess", "runtime_check", "band", "outcome", "word")


FAILING = """
x AS (SELECT DISTINCT l_orderkey AS g, (l_linenumber + CASE WHEN (l_orderkey + l_linenumber) % 4 = 0 THEN 10 ELSE 0 END) * 120e0 AS t0 FROM lineitem),
f AS (SELECT g, t0, t0 / 40e0 - (g % 3) * (t0 * 7e0 % 11e0) AS jump FROM x)"""


def failing(spark, d):
    far = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 4 == 0, 10).otherwise(0)
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), ((F.col("l_linenumber") + far) * F.lit(120.0)).alias("t0")).distinct()
    return x.select("g", "t0", (F.col("t0") / 40.0 - (F.col("g") % 3) * (F.col("t0") * 7.0 % 11.0)).alias("jump"))


@query(f"""WITH {FAILING},
w AS (SELECT *, row_number() OVER v - 1 AS i, t0 - lag(t0) OVER v AS gap, jump - lag(jump) OVER v AS step FROM f WINDOW v AS (PARTITION BY g ORDER BY t0)),
a AS (SELECT g, min(t0) AS lo, max(t0) + 120e0 AS hi, count(*) AS n, arg_max(jump, t0) AS last, arg_min(jump, t0) AS first,
        coalesce(bool_and(abs(gap - 120e0) < 1e-6), true) AS joined, coalesce(bool_and(step > 0), true) OR coalesce(bool_and(step < 0), true) AS mono,
        bool_and(abs(jump) BETWEEN 1 AND 60) AS sized, list(jump ORDER BY t0) AS jumps FROM w GROUP BY g)
SELECT g, lo, hi, CASE WHEN n >= 3 AND mono AND abs(last - first) > 75e-2 THEN last ELSE jumps[n // 2 + 1] END AS jump,
       CASE WHEN n >= 3 AND mono AND abs(last - first) > 75e-2 THEN 'drift' WHEN joined AND sized THEN 'cut' ELSE 'local' END AS shape FROM a""")
def failure_diagnosis(spark, d):
    return verdict.diagnose(failing(spark, d), ["g"])


@query(f"""WITH {FAILING},
w AS (SELECT g, t0, coalesce((abs(t0 - lag(t0) OVER (PARTITION BY g ORDER BY t0) - 120e0) >= 1e-6)::INT, 1) AS new FROM f),
i AS (SELECT g, t0, sum(new) OVER (PARTITION BY g ORDER BY t0) AS island FROM w)
SELECT g, min(t0) AS lo, max(t0) + 120e0 AS hi FROM i GROUP BY g, island""")
def failing_stretches(spark, d):
    return verdict.stretches(failing(spark, d), ["g"])


def fit_and_judge(spark, d):
    """Fits of all pairs, with verdicts; cuts are found one after another, so there is no SQL."""
    r, a = inputs.sides(spark, d)
    rs = align.unique_starts(r, K).withColumnRenamed("starts", "ref")
    ss = align.unique_starts(a, K).withColumnRenamed("starts", "sub")
    f = align.fit_pairs(rs.join(ss, "pair_id").withColumn("duration", F.lit(7200.0)))
    fails = F.size(F.filter("buckets", lambda b: b["fails"])).alias("failing")
    usable = F.size(F.filter("buckets", lambda b: b["applied"].isNotNull())).alias("usable")
    flat = f.select("pair_id", "segments", "score", "chance", "n_ref", "n_sub", fails, usable, F.lit(False).alias("coheres"), F.lit(False).alias("agrees"))
    return verdict.judge(flat).select("pair_id", F.size("segments").alias("parts"), F.round("score", 6).alias("score"), F.round("excess", 6).alias("excess"), "band", "outcome", "word", "runtime_check")


QUERIES["fit_and_judge"] = fit_and_judge


def _density(name: str, source: str, keys: str) -> str:
    """SQL of a smoothed histogram of ``d`` in every bin that has any height."""
    return f"""
{name}_b AS (SELECT {keys}, floor((d + 120e0) / 1e-2)::BIGINT AS b, count(*) AS n FROM {source} GROUP BY ALL),
{name}_0 AS (SELECT {keys}, bin, sum(n) AS dense FROM (SELECT {keys}, n, unnest(range(b - 35, b + 36)) AS bin FROM {name}_b WHERE b BETWEEN 0 AND 24000) WHERE bin BETWEEN 0 AND 24000 GROUP BY ALL)"""


def _rounds(name: str, keys: list[str], most: int) -> str:
    """SQL of the rounds: the first bin of greatest height, the end of its plateau, all around it set aside."""
    k, out = ", ".join(keys), []
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys)
    for i in range(most):
        out.append(f"""
{name}_t{i} AS (SELECT {k}, max(dense) AS top, arg_min(bin, (-dense, bin)) AS first FROM {name}_{i} GROUP BY ALL),
{name}_e{i} AS (SELECT {k}, bin, bin - row_number() OVER (PARTITION BY {k} ORDER BY bin) AS island FROM (SELECT h.* FROM {name}_{i} h JOIN {name}_t{i} t ON {on("h", "t")} AND h.dense = t.top)),
{name}_p{i} AS (SELECT {", ".join("t." + c for c in keys)}, {i} AS rank, t.top::BIGINT AS dense, t.first, max(y.bin) AS last FROM {name}_t{i} t JOIN {name}_e{i} x ON {on("x", "t")} AND x.bin = t.first JOIN {name}_e{i} y ON {on("y", "x")} AND y.island = x.island GROUP BY ALL),
{name}_{i + 1} AS (SELECT h.* FROM {name}_{i} h LEFT JOIN {name}_p{i} p ON {on("h", "p")} AND h.bin BETWEEN p.first - 50 AND p.last + 50 WHERE p.rank IS NULL)""")
    every = " UNION ALL ".join(f"SELECT * FROM {name}_p{i}" for i in range(most))
    return ",".join(out) + f""",
{name}_p AS (SELECT *, ((first + last) // 2) * 1e-2 - 120e0 AS o0, (last - first) * 1e-2 < 35e-2 AS narrow FROM ({every}))"""


def _medians(name: str, source: str, keys: list[str]) -> str:
    """SQL of three passes of medians around narrow plateaus."""
    out, k = [], ", ".join("p." + c for c in keys)
    on = " AND ".join(f"d.{c} = p.{c}" for c in keys)
    for i in range(3):
        at = f"{name}_p" if i == 0 else f"{name}_m{i}"
        out.append(f"""
{name}_m{i + 1} AS (SELECT {k}, p.rank, p.dense, p.narrow, coalesce(median(d.d), p.o{i}) AS o{i + 1} FROM {at} p LEFT JOIN {source} d ON {on} AND p.narrow AND abs(d.d - p.o{i}) <= 35e-2 GROUP BY {k}, p.rank, p.dense, p.narrow, p.o{i})""")
    return ",".join(out)


DIFFS = """
d AS (SELECT r.pair_id, r.t AS r, r.t - a.t AS d, floor(r.t / 120e0)::INT AS bucket FROM moments r JOIN moments a ON r.pair_id = a.pair_id AND r.side = 0 AND a.side = 1 AND abs(r.t - a.t) <= 120e0)"""


@query(f"""WITH {MOMENTS}, {DIFFS}, {_density("w", "d", "pair_id")}, {_rounds("w", ["pair_id"], 6)}, {_medians("w", "d", ["pair_id"])}
SELECT pair_id, rank, dense, round(o3, 6) AS "offset" FROM w_m3""")
def offset_peaks(spark, d):
    """The densest offsets of every pair over the whole running time."""
    x = splits.stream_peaks(*inputs.sides(spark, d), K, local=False)
    return x.select("pair_id", "rank", "dense", F.round("offset", 6).alias("offset"))


@query(f"""WITH RECURSIVE {MOMENTS}, {DIFFS},
l AS (SELECT * FROM d WHERE (pair_id, bucket) IN (SELECT (pair_id, bucket) FROM d GROUP BY pair_id, bucket HAVING count(*) >= 12)),
{_density("w", "d", "pair_id")}, {_rounds("w", ["pair_id"], 6)}, {_medians("w", "d", ["pair_id"])},
{_density("b", "l", "pair_id, bucket")}, {_rounds("b", ["pair_id", "bucket"], 2)}, {_medians("b", "l", ["pair_id", "bucket"])},
o AS (SELECT pair_id, bucket, o3 AS o, row_number() OVER (PARTITION BY pair_id ORDER BY bucket, rank) AS i
      FROM (SELECT pair_id, -1 AS bucket, rank, o3 FROM w_m3 UNION ALL SELECT pair_id, bucket, rank, o3 FROM b_m3)),
f AS (SELECT pair_id, 0::BIGINT AS i, []::DOUBLE[] AS found FROM (SELECT DISTINCT pair_id FROM o)
      UNION ALL
      SELECT f.pair_id, o.i, CASE WHEN o.bucket < 0 OR len(list_filter(f.found, lambda c: abs(o.o - c) <= 5e-1)) = 0 THEN list_append(f.found, o.o) ELSE f.found END
      FROM f JOIN o ON o.pair_id = f.pair_id AND o.i = f.i + 1),
e AS (SELECT pair_id, arg_max(found, i) AS found FROM f GROUP BY pair_id)
SELECT pair_id, cand::INT AS cand, round(found[cand + 1], 6) AS "offset" FROM (SELECT pair_id, found, unnest(range(len(found))) AS cand FROM e)""")
def offset_candidates(spark, d):
    """What a fit tries: peaks of the whole running time and of each stretch of it."""
    x = splits.offset_candidates(*inputs.sides(spark, d), K)
    return x.select("pair_id", "cand", F.round("offset", 6).alias("offset"))


@query(f"""WITH {SPLICED},
c AS (SELECT pair_id, cand, cand * 4e0 AS o FROM (SELECT DISTINCT pair_id FROM ref), (SELECT unnest([0, 1, 2]) AS cand)),
r AS (SELECT pair_id, t, row_number() OVER (PARTITION BY pair_id ORDER BY t) AS i FROM ref),
h AS (SELECT r.pair_id, c.cand, r.i, EXISTS (SELECT 1 FROM sub a WHERE a.pair_id = r.pair_id AND abs((r.t - c.o) - a.t) <= 35e-2)::INT AS hit FROM r JOIN c ON r.pair_id = c.pair_id),
s AS (SELECT pair_id, cand, i, sum(hit) OVER (PARTITION BY pair_id, cand ORDER BY i) AS s FROM h)
SELECT pair_id, cand, max(i) AS n, '0,' || string_agg(s::BIGINT::VARCHAR, ',' ORDER BY i) AS sums FROM s GROUP BY ALL""")
def hit_prefixes(spark, d):
    """Prefix sums of the hits of every moment under three offsets."""
    r, a = inputs.spliced(spark, d)
    cands = r.select("pair_id").distinct().select("pair_id", F.inline(F.array(*[F.struct(F.lit(c).alias("cand"), F.lit(c * 4.0).alias("offset")) for c in range(3)])))
    p = splits.hit_prefixes(r, a, cands, K)
    return p.select("pair_id", "cand", F.col("n").cast("long").alias("n"), F.array_join("prefix", ",").alias("sums"))


@query(f"""WITH {SPLICED},
r AS (SELECT pair_id, t, row_number() OVER (PARTITION BY pair_id ORDER BY t) AS i, count(*) OVER (PARTITION BY pair_id) AS n FROM ref),
c AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS cand),
h AS (SELECT r.pair_id, cand, i, n, EXISTS (SELECT 1 FROM sub a WHERE a.pair_id = r.pair_id AND abs((r.t - (r.pair_id % 5 * 15e-1 + cand * 425e-2)) - a.t) <= 35e-2)::INT AS hit FROM r, c),
s AS (SELECT pair_id, cand, i AS k, n, sum(hit) OVER (PARTITION BY pair_id, cand ORDER BY i) AS head, sum(hit) OVER (PARTITION BY pair_id, cand) AS whole FROM h),
q AS (SELECT * FROM s WHERE k BETWEEN 12 AND n - 12),
b AS (SELECT pair_id, k, max(head) AS head, max(whole - head) AS tail, arg_max(cand, head * 10 - cand) AS p, arg_max(cand, (whole - head) * 10 - cand) AS q FROM q GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY head + tail DESC, k) AS rk FROM b WHERE p <> q)
SELECT pair_id, k, p, q, (head + tail)::BIGINT AS hits FROM o WHERE rk = 1""")
def frontier_cuts(spark, d):
    """The first cut of every pair between six offsets: one step of the frontier."""
    r, a = inputs.spliced(spark, d)
    base = F.col("pair_id") % 5 * 1.5
    cands = r.select("pair_id").distinct().select("pair_id", F.inline(F.array(*[F.struct(F.lit(c).alias("cand"), (base + c * 4.25).alias("offset")) for c in range(6)])))
    p = splits.hit_prefixes(r, a, cands, K)
    whole = p.select("pair_id", F.lit(0).alias("a"), F.col("n").alias("b")).distinct()
    cut = splits.best_cuts(p, whole, K)
    at = lambda c: F.max(F.when(F.col("cand") == F.col(c), F.get("prefix", F.col("k"))))
    end = F.max(F.when(F.col("cand") == F.col("q"), F.get("prefix", F.col("b"))))
    hits = cut.join(p.select("pair_id", "cand", "prefix"), "pair_id").groupBy("pair_id", "k", "p", "q").agg((at("p") + end - at("q")).cast("long").alias("hits"))
    return hits.select("pair_id", F.col("k").cast("long").alias("k"), "p", "q", "hits")


def split_fits(spark, d):
    """Whole fits of spliced streams as frames; greedy cuts are no SQL, tests hold them to a plain search."""
    r, a = inputs.spliced(spark, d)
    x = splits.fit(r, a, r.select("pair_id").distinct().withColumn("duration", F.lit(7200.0)), K)
    offsets = F.array_join(F.transform("segments", lambda s: F.round(s["offset"], 2).cast("string")), " ")
    return x.select("pair_id", F.size("segments").alias("parts"), F.round("score", 6).alias("score"), F.round("chance", 6).alias("chance"), offsets.alias("offsets"), F.round(F.get("gaps", F.lit(0))["lo"], 3).alias("cut"))


QUERIES["split_fits"] = split_fits
