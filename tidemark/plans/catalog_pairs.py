"""Pairing, ranking, conflict and bookkeeping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement, pairing, ranking, runtime
from . import inputs
from .inputs import SUBTITLES, VIDEOS, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


EDGES = """
edges AS (
  SELECT DISTINCT v.path AS video, s.path AS subtitle FROM videos v JOIN subtitles s
  ON v.title = s.title AND v.episode = s.episode AND (v.season IS NULL OR s.season IS NULL OR v.season = s.season))"""


def edge_counts(spark, d):
    return pairing.block_counts(inputs.videos(spark, d), inputs.subtitles(spark, d), ["title"])


#: Videos of one task where all their edges are a result: their names fit the dictionary of a Parquet column.
TOGETHER = 8192


def every_edge(videos, subtitles):
    """All edges, which grow with the square of the tables: more of them are more tasks, not longer ones."""
    return pairing.block(videos, subtitles, ["title"], parts=1 + videos.count() // TOGETHER)


def edges(spark, d):
    return every_edge(inputs.videos(spark, d), inputs.subtitles(spark, d))


@query(f"WITH {VIDEOS}, {SUBTITLES}, {EDGES} SELECT video, subtitle, false AS speculative FROM edges")
def candidate_join(spark, d):
    return edges(spark, d)


@query(f"""WITH {VIDEOS}, {SUBTITLES},
v AS (SELECT *, CASE WHEN id % 5 = 0 THEN 2 END AS shift FROM videos),
a AS (SELECT path, title, season, episode AS at, shift FROM v UNION ALL SELECT path, title, season, episode + shift, shift FROM v WHERE shift IS NOT NULL)
SELECT DISTINCT a.path AS video, s.path AS subtitle, a.shift IS NOT NULL AS speculative FROM a JOIN subtitles s
ON a.title = s.title AND a.at = s.episode AND (a.season IS NULL OR s.season IS NULL OR a.season = s.season)""")
def shifted_candidate_join(spark, d):
    v = inputs.videos(spark, d).withColumn("shift", F.when(F.col("id") % 5 == 0, 2))
    return every_edge(v, inputs.subtitles(spark, d))


@query(f"""WITH {VIDEOS}, {SUBTITLES}, {EDGES}
SELECT v.path AS video, count(e.subtitle) AS candidates FROM videos v LEFT JOIN edges e ON v.path = e.video GROUP BY v.path""")
def fan_out(spark, d):
    return pairing.fan_out(inputs.videos(spark, d), edge_counts(spark, d))


@query(f"""WITH {VIDEOS}, {SUBTITLES}, {EDGES}
SELECT path AS video, 'no such episode' AS reason FROM videos WHERE path NOT IN (SELECT video FROM edges)""")
def unpaired_videos(spark, d):
    return pairing.unpaired(inputs.videos(spark, d), edge_counts(spark, d))


#: Numberings that meet in shows of even number and don't in the others.
SPLIT = """
low AS (SELECT * REPLACE (episode % 8 AS episode) FROM videos),
high AS (SELECT * REPLACE (6 + episode % 25 + 30 * (substr(title, 6)::INT % 2) AS episode) FROM subtitles)"""


@query(f"""WITH {VIDEOS}, {SUBTITLES}, {SPLIT},
e AS (SELECT DISTINCT v.path AS video FROM low v JOIN high s ON v.title = s.title AND v.episode = s.episode AND (v.season IS NULL OR s.season IS NULL OR v.season = s.season)),
shared AS (SELECT DISTINCT v.title, v.season FROM low v JOIN high s ON v.title = s.title AND v.season = s.season AND v.episode = s.episode),
pool AS (SELECT title, season, path, row_number() OVER (PARTITION BY title, season ORDER BY path) AS r FROM high WHERE season IS NOT NULL)
SELECT v.path AS video, p.path AS subtitle, true AS speculative FROM low v JOIN pool p ON v.title = p.title AND v.season = p.season
WHERE p.r <= 64 AND v.path NOT IN (SELECT video FROM e) AND NOT EXISTS (SELECT 1 FROM shared x WHERE x.title = v.title AND x.season = v.season)""")
def absolute_fallback(spark, d):
    v = inputs.videos(spark, d).withColumn("episode", F.col("episode") % 8)
    s = inputs.subtitles(spark, d).withColumn("episode", 6 + F.col("episode") % 25 + 30 * (F.expr("substr(title, 6)").cast("int") % 2))
    return pairing.absolute_fallback(v, s, pairing.block_counts(v, s, ["title"]), ["title"])


@query(f"""WITH {VIDEOS}, {SUBTITLES},
v AS (SELECT DISTINCT title, season, episode % 9 AS episode FROM videos WHERE season IS NOT NULL),
s AS (SELECT DISTINCT title, season, episode % 9 + season * 7 AS episode FROM subtitles WHERE season IS NOT NULL),
c AS (SELECT v.title, v.season, s.episode - v.episode AS k, count(*) AS n FROM v JOIN s ON v.title = s.title AND v.season = s.season GROUP BY 1, 2, 3),
m AS (SELECT title, season, max(n) AS cover FROM c GROUP BY 1, 2),
t AS (SELECT m.title, m.season, m.cover, count(*) AS ties, min(k) AS k FROM m JOIN c ON c.title = m.title AND c.season = m.season AND c.n = m.cover GROUP BY 1, 2, 3)
SELECT title, season, CASE WHEN ties = 1 AND k <> 0 AND cover >= 2 THEN k END AS shift, cover FROM t""")
def numbering_shift(spark, d):
    v = inputs.videos(spark, d).withColumn("episode", F.col("episode") % 9)
    s = inputs.subtitles(spark, d).withColumn("episode", F.col("episode") % 9 + F.col("season") * 7)
    v, s = v.where("season is not null"), s.where("season is not null")  # numberings are those of seasons
    return agreement.numbering_shift(v, s, ["title", "season"])


@query("""WITH a AS (SELECT DISTINCT l_partkey % 300 AS key, l_suppkey % 40 AS entity FROM lineitem),
k AS (SELECT * FROM a WHERE key IN (SELECT key FROM a GROUP BY key HAVING count(*) <= 64)),
p AS (SELECT DISTINCT o_orderkey % 300 AS a, o_custkey % 300 AS b FROM orders),
f AS (SELECT p.a, p.b, min(x.entity) AS entity FROM p JOIN k x ON x.key = p.a JOIN k y ON y.key = p.b AND y.entity = x.entity GROUP BY 1, 2)
SELECT p.a, p.b, f.entity FROM p LEFT JOIN f ON f.a = p.a AND f.b = p.b""")
def alias_bridge(spark, d):
    alias = table(spark, d, "lineitem").select((F.col("l_partkey") % 300).alias("key"), (F.col("l_suppkey") % 40).alias("entity"))
    pairs = table(spark, d, "orders").select((F.col("o_orderkey") % 300).alias("a"), (F.col("o_custkey") % 300).alias("b")).distinct()
    return pairing.bridge(pairs, alias)


GRAMS = """
t AS (SELECT p_partkey AS id, p_name || ' ' || p_brand AS name FROM part),
g AS (SELECT id, list_distinct(list_transform(range(1, length(name)), lambda i: substr(name, i, 2))) AS grams FROM t),
e AS (SELECT id, len(grams) AS n, unnest(grams) AS x FROM g)"""


@query(f"""WITH {GRAMS},
j AS (SELECT q.id AS query, t.id AS title, count(*) AS c, any_value(q.n) AS nq, any_value(t.n) AS nt FROM e q JOIN e t ON q.x = t.x WHERE q.id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT query, title, c::DOUBLE / (nq + nt - c) AS jaccard FROM j)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY jaccard DESC, title)::INT AS rank FROM r) WHERE rank <= 5""")
def gram_top_k(spark, d):
    from ..functions.text import bigrams

    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), bigrams(F.concat_ws(" ", "p_name", "p_brand")).alias("grams"))
    return pairing.gram_top_k(t.where("id % 50 = 0"), t, 5)


@query("""WITH a AS (SELECT DISTINCT p_name || ' ' || p_size AS id FROM part), b AS (SELECT DISTINCT p_name || ' ' || p_brand AS id FROM part),
f AS (SELECT id, list_distinct(list_transform(range(1, length(id)), lambda i: substr(id, i, 2))) AS grams FROM a), g AS (SELECT id, list_distinct(list_transform(range(1, length(id)), lambda i: substr(id, i, 2))) AS grams FROM b),
x AS (SELECT id, len(grams) AS n, unnest(grams) AS x FROM f), y AS (SELECT id, len(grams) AS n, unnest(grams) AS x FROM g),
j AS (SELECT x.id AS a, y.id AS b, count(*)::DOUBLE / (any_value(x.n) + any_value(y.n) - count(*)) AS jaccard FROM x JOIN y ON x.x = y.x GROUP BY 1, 2)
SELECT * FROM j WHERE jaccard >= 5e-1""")
def similar_titles(spark, d):
    """All pairs of two lists of titles of all parts whose bigrams are alike to 0.5."""
    from ..functions.text import bigrams

    p = table(spark, d, "part")
    of = lambda *c: p.select(F.concat_ws(" ", *c).alias("id")).distinct().withColumn("grams", bigrams(F.col("id")))
    return pairing.similar(of("p_name", F.col("p_size").cast("string")), of("p_name", "p_brand"), 0.5)


@query("""WITH s AS (SELECT l_orderkey AS query, l_partkey AS title, max(l_discount * 10e0) AS score FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS next FROM s WINDOW w AS (PARTITION BY query ORDER BY score DESC, title DESC))
SELECT query, title, score FROM r WHERE r = 1 AND score >= 85e-2 AND score - coalesce(next, 0e0) >= 1e-1""")
def accept_clear_best(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("title")).agg(F.max(F.col("l_discount") * 10.0).alias("score"))
    return pairing.accept_best(s)


#: Folders and keys that grow with the tables.
FILMS = """
fv AS (SELECT '/films/' || (o_orderkey * 7 // 10) || '/f' || o_orderkey || '.mkv' AS path, 'k' || (o_orderkey // 3) AS key,
         CASE WHEN o_orderkey % 3 <> 0 THEN 1990 + o_orderkey % 7 END AS year, CASE WHEN o_orderkey % 5 = 0 THEN 'extended' WHEN o_orderkey % 7 = 0 THEN 'theatrical' END AS edition,
         5000e0 + o_orderkey % 900 AS seconds FROM orders),
fs AS (SELECT '/films/' || (p_partkey * 5) || CASE WHEN p_partkey % 4 = 0 THEN '/subs' ELSE '' END || '/s' || p_partkey || '.srt' AS path, 'k' || (p_partkey * 2) AS key,
         CASE WHEN p_partkey % 4 <> 0 THEN 1990 + p_partkey % 7 END AS year, CASE WHEN p_partkey % 6 = 0 THEN 'extended' END AS edition,
         4800e0 + p_partkey * 11 % 2500 AS seconds FROM part)"""


@query(f"""WITH {FILMS},
v AS (SELECT path AS video, key AS vk, year AS vy, edition AS ve, seconds AS vs, regexp_extract(path, '^(.*)/[^/]*$', 1) AS vd FROM fv),
s AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM fs),
o AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY vd) AS n FROM v) WHERE n = 1),
c AS (SELECT s.*, v.*, 1 AS rung FROM s JOIN v ON s.key = v.vk AND s.year IS NOT DISTINCT FROM v.vy
 UNION ALL SELECT s.*, v.*, 2 FROM s JOIN v ON s.key = v.vk AND (s.year IS NULL) <> (v.vy IS NULL)
 UNION ALL SELECT s.*, o.* EXCLUDE (n), 3 FROM s JOIN o ON s.dir = o.vd
 UNION ALL SELECT s.*, o.* EXCLUDE (n), 3 FROM s JOIN o ON regexp_extract(s.dir, '^(.*)/[^/]*$', 1) = o.vd WHERE s.dir NOT IN (SELECT vd FROM v)),
k AS (SELECT * FROM c WHERE NOT coalesce(edition <> ve, false) AND NOT (seconds > vs * 125e-2 AND seconds - vs > 120e0)),
b AS (SELECT *, min(rung) OVER (PARTITION BY path) AS top FROM k)
SELECT path AS subtitle, video, rung,
  CASE WHEN dir = vd THEN 1e0 WHEN starts_with(dir, vd || '/') OR starts_with(vd, dir || '/') THEN 7e-1
       WHEN regexp_extract(dir, '^(.*)/[^/]*$', 1) = regexp_extract(vd, '^(.*)/[^/]*$', 1) THEN 5e-1 ELSE 2e-1 END AS proximity,
  abs(vs - seconds) AS gap FROM b WHERE rung = top""")
def film_pairing(spark, d):
    k, p, text = F.col("o_orderkey"), F.col("p_partkey"), lambda c: c.cast("long").cast("string")
    v = table(spark, d, "orders").select(
        F.concat(F.lit("/films/"), text(F.floor(k * 7 / 10)), F.lit("/f"), text(k), F.lit(".mkv")).alias("path"), F.concat(F.lit("k"), text(F.floor(k / 3))).alias("key"),
        F.when(k % 3 != 0, 1990 + k % 7).alias("year"), F.when(k % 5 == 0, "extended").when(k % 7 == 0, "theatrical").alias("edition"), (5000.0 + k % 900).alias("seconds"),
    )
    s = table(spark, d, "part").select(
        F.concat(F.lit("/films/"), text(p * 5), F.when(p % 4 == 0, "/subs").otherwise(""), F.lit("/s"), text(p), F.lit(".srt")).alias("path"),
        F.concat(F.lit("k"), text(p * 2)).alias("key"), F.when(p % 4 != 0, 1990 + p % 7).alias("year"), F.when(p % 6 == 0, "extended").alias("edition"),
        (4800.0 + p * 11 % 2500).alias("seconds"),
    )
    return pairing.pair_films(v, s)


@query(f"""WITH {VIDEOS},
r(root, side) AS (VALUES ('/lib', 'video'), ('/lib/show 1', 'subtitle'), ('/lib/show 2/s1', 'subtitle'))
SELECT path, arg_max(side, length(root)) AS side FROM videos JOIN r ON starts_with(path, root || '/') GROUP BY path""")
def root_ownership(spark, d):
    roots = spark.createDataFrame([("/lib", "video"), ("/lib/show 1", "subtitle"), ("/lib/show 2/s1", "subtitle")], "root string, side string")
    return pairing.claim(inputs.videos(spark, d).select("path"), roots)


@query(f"""WITH {VIDEOS}, {SUBTITLES}
SELECT v.path AS a, s.path AS b,
  CASE WHEN regexp_extract(v.path, '^(.*)/[^/]*$', 1) = regexp_extract(s.path, '^(.*)/[^/]*$', 1) THEN 1e0
       WHEN regexp_extract(regexp_extract(v.path, '^(.*)/[^/]*$', 1), '^(.*)/[^/]*$', 1) = regexp_extract(regexp_extract(s.path, '^(.*)/[^/]*$', 1), '^(.*)/[^/]*$', 1) THEN 5e-1 ELSE 2e-1 END AS proximity
FROM videos v JOIN subtitles s ON v.id = s.id""")
def path_proximity(spark, d):
    v, s = inputs.videos(spark, d).select("id", F.col("path").alias("a")), inputs.subtitles(spark, d).select("id", F.col("path").alias("b"))
    return v.join(s, "id").select("a", "b", runtime.proximity(F.col("a"), F.col("b")).alias("proximity"))


CANDS = """
c AS (SELECT l_orderkey AS video, (['en', 'de', 'und'])[l_suppkey % 3 + 1] AS lang, 'p' || l_partkey || '-' || l_linenumber || '-' || l_suppkey AS path,
        l_returnflag <> 'A' AS confident, l_suppkey % 2 = 0 AS hearing_impaired, l_quantity AS cues, l_linestatus = 'O' AS name_matches,
        CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS content_end, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_linenumber END AS segments,
        l_partkey % 7 = 0 AS speculative FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY video, lang ORDER BY confident DESC, hearing_impaired, coalesce(cues, 0) DESC, name_matches DESC, coalesce(content_end, 0) DESC, coalesce(segments, 1000000), path)::INT AS rank,
        bool_or(confident) OVER (PARTITION BY video, lang) AS has FROM c),
plan AS (SELECT *, CASE WHEN confident AND rank = 1 THEN 'write' WHEN has AND NOT speculative AND lang <> 'und' THEN 'supersede' ELSE 'keep' END AS action FROM r)"""


def slot_candidates(spark, d):
    x = table(spark, d, "lineitem")
    return x.select(
        F.col("l_orderkey").alias("video"), F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit("und")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("lang"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("path"),
        (F.col("l_returnflag") != "A").alias("confident"), (F.col("l_suppkey") % 2 == 0).alias("hearing_impaired"), F.col("l_quantity").alias("cues"),
        (F.col("l_linestatus") == "O").alias("name_matches"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_extendedprice")).alias("content_end"),
        F.when(F.col("l_returnflag") != "A", F.col("l_linenumber")).alias("segments"), (F.col("l_partkey") % 7 == 0).alias("speculative"),
    )


@query(f"WITH {CANDS} SELECT video, lang, path, rank FROM r")
def slot_ranking(spark, d):
    return ranking.rank_slot(slot_candidates(spark, d)).select("video", "lang", "path", "rank")


@query(f"WITH {CANDS} SELECT video, lang, path, action FROM plan")
def slot_plan(spark, d):
    return ranking.plan_slots(slot_candidates(spark, d)).select("video", "lang", "path", "action")


@query(f"""WITH {CANDS}, w AS (SELECT DISTINCT path FROM plan WHERE action = 'write')
SELECT video, lang, path, CASE WHEN action = 'supersede' AND path IN (SELECT path FROM w) THEN 'keep' ELSE action END AS action FROM plan""")
def cross_slot_ownership(spark, d):
    return ranking.ownership(ranking.plan_slots(slot_candidates(spark, d))).select("video", "lang", "path", "action")


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS video, l_returnflag AS lang, 'out' || (l_partkey % 3000) AS target FROM lineitem),
n AS (SELECT target, count(*) AS n FROM s GROUP BY target)
SELECT s.target, video, lang, n > 1 AS collides FROM s JOIN n ON s.target = n.target""")
def target_collisions(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("video"), F.col("l_returnflag").alias("lang"), F.concat(F.lit("out"), (F.col("l_partkey") % 3000).cast("string")).alias("target")).distinct()
    return ranking.target_collisions(s)


@query("""WITH e AS (SELECT l_orderkey AS video, l_partkey || '-' || l_linenumber || '-' || l_suppkey AS subtitle, (['same', 'unsure', 'different'])[l_suppkey % 3 + 1] AS identity, l_discount AS score, l_tax AS proximity, l_partkey % 4 = 0 AS speculative FROM lineitem)
SELECT video, subtitle, row_number() OVER (PARTITION BY video ORDER BY CASE identity WHEN 'same' THEN 0 WHEN 'unsure' THEN 1 ELSE 2 END, score DESC, proximity DESC, subtitle)::INT AS rank
FROM e WHERE NOT speculative OR identity = 'same'""")
def candidate_ranking(spark, d):
    x = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("video"), F.concat_ws("-", "l_partkey", "l_linenumber", "l_suppkey").alias("subtitle"),
        F.element_at(F.array(F.lit("same"), F.lit("unsure"), F.lit("different")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("identity"),
        F.col("l_discount").alias("score"), F.col("l_tax").alias("proximity"), (F.col("l_partkey") % 4 == 0).alias("speculative"),
    )
    return ranking.rank_candidates(x).select("video", "subtitle", "rank")


@query("""WITH t AS (SELECT l_orderkey AS video, l_linenumber AS "index", l_partkey AS tag, l_quantity AS n_cues, l_returnflag = 'N' AS is_default, l_linestatus = 'F' AS forced FROM lineitem)
SELECT video, min("index") AS "index" FROM (SELECT *, rank() OVER (PARTITION BY video ORDER BY n_cues DESC, is_default DESC, forced, "index") AS r FROM t WHERE n_cues >= 5) WHERE r = 1 GROUP BY video""")
def reference_choice(spark, d):
    t = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("video"), F.col("l_linenumber").alias("index"), F.col("l_quantity").alias("n_cues"), (F.col("l_returnflag") == "N").alias("is_default"), (F.col("l_linestatus") == "F").alias("forced")
    )
    return ranking.choose_reference(t).select("video", "index")


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS subtitle, l_partkey AS video, max(l_discount) AS proximity, min(l_quantity) AS gap FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS r, lead(proximity) OVER w AS np, lead(gap) OVER w AS ng FROM s WINDOW w AS (PARTITION BY subtitle ORDER BY proximity DESC, gap, video))
SELECT subtitle, video, proximity, gap, NOT (np IS NOT NULL AND proximity = np AND gap = ng) AS separated FROM r WHERE r = 1""")
def separation_test(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("subtitle"), F.col("l_partkey").alias("video")).agg(F.max("l_discount").alias("proximity"), F.min("l_quantity").alias("gap"))
    return ranking.separated(s)


@query("""WITH p AS (SELECT l_orderkey % 500 AS video, l_partkey AS subtitle, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY 1, 2)
SELECT seq, video, subtitle, count(*) OVER (PARTITION BY subtitle) > 1 AS refused FROM p""")
def claim_collisions(spark, d):
    p = table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("video"), F.col("l_partkey").alias("subtitle"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return ranking.resolve_claims(p)


#: Odd lines of an order are one side, even ones the other.
@query("""WITH e AS (SELECT l_orderkey % 800 AS g, l_suppkey % 10 AS item, count(*) AS e FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1, 2),
p AS (SELECT l_orderkey % 800 AS g, l_suppkey % 10 AS item, count(*) AS p FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1, 2),
b AS (SELECT coalesce(e.g, p.g) AS g, coalesce(e, 0) AS e, coalesce(p, 0) AS p FROM e FULL JOIN p ON e.g = p.g AND e.item = p.item)
SELECT g, sum(greatest(p - e, 0))::BIGINT AS added, sum(greatest(e - p, 0))::BIGINT AS gone, sum(abs(p - e)) = 0 AS settled FROM b GROUP BY g""")
def settled_multisets(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_orderkey") % 800).alias("g"), (F.col("l_suppkey") % 10).alias("item"), "l_linenumber")
    return agreement.settled(x.where("l_linenumber % 2 = 1").drop("l_linenumber"), x.where("l_linenumber % 2 = 0").drop("l_linenumber"), ["g"], "item")


@query("""WITH s AS (SELECT l_orderkey % 800 AS g, l_suppkey % 4 AS item, count(*) AS a FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1, 2),
b AS (SELECT l_orderkey % 800 AS g, l_suppkey % 4 AS item, count(*) AS b FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1, 2)
SELECT s.g, bool_and(coalesce(b, 0) >= a) AS within FROM s LEFT JOIN b ON s.g = b.g AND s.item = b.item GROUP BY s.g""")
def multiset_inclusion(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_orderkey") % 800).alias("g"), (F.col("l_suppkey") % 4).alias("item"), "l_linenumber")
    return agreement.multiset_within(x.where("l_linenumber % 2 = 0"), x.where("l_linenumber % 2 = 1"), ["g"], "item")


@query("""WITH a AS (SELECT c_custkey AS path, md5((c_custkey % 400)::VARCHAR) AS digest FROM customer WHERE c_custkey % 3 <> 0),
b AS (SELECT c_custkey AS path, md5((c_custkey % 390)::VARCHAR) AS digest FROM customer WHERE c_custkey % 5 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.digest IS NULL THEN 'new' WHEN a.digest = b.digest THEN 'kept' WHEN b.digest IS NOT NULL THEN 'changed'
  WHEN a.digest IN (SELECT digest FROM b) THEN 'moved' ELSE 'gone' END AS state FROM a FULL JOIN b ON a.path = b.path""")
def tree_diff(spark, d):
    c = table(spark, d, "customer")
    file = lambda k, n: c.where(F.col("c_custkey") % k != 0).select(F.col("c_custkey").alias("path"), F.md5((F.col("c_custkey") % n).cast("string")).alias("digest"))
    return ranking.tree_diff(file(3, 400), file(5, 390))


@query("SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY l_partkey")
def first_seen_order(spark, d):
    x = table(spark, d, "lineitem").withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return ranking.first_seen(x, "l_partkey", "seq")


@query("""WITH s(name, lo, hi) AS (VALUES ('dev', 0, 60), ('validation', 60, 85), ('sealed', 85, 100)),
k AS (SELECT c_custkey, ('0x' || substr(sha256(c_name), 1, 16))::UBIGINT % 100 AS m FROM customer)
SELECT c_custkey, name AS slice FROM k JOIN s ON m >= lo AND m < hi""")
def hash_split(spark, d):
    return table(spark, d, "customer").select("c_custkey", agreement.hash_split(F.col("c_name"), {"dev": 60, "validation": 25, "sealed": 15}).alias("slice"))


@query("""WITH r AS (SELECT substr(l_shipdate::DATE::VARCHAR, 1, 7) AS g, l_quantity AS v FROM lineitem),
i AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM r)
SELECT g, max(v) FILTER (i = round_even(5e-1 * (n - 1), 0)::INT) AS p50, max(v) FILTER (i = round_even(95e-2 * (n - 1), 0)::INT) AS p95 FROM i GROUP BY g""")
def nearest_rank_percentiles(spark, d):
    r = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("g"), F.col("l_quantity").alias("v"))
    return agreement.nearest_rank(r, ["g"], "v", (50, 95))


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), g AS (SELECT sum(n) AS rows, max(n) AS mode FROM c GROUP BY c_nationkey HAVING sum(n) >= 2)
SELECT count(*) AS groups, sum(rows)::BIGINT AS rows, sum(rows - mode)::BIGINT AS off_modal FROM g""")
def modal_spread(spark, d):
    return agreement.modal_spread(table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment")


@query("""WITH t AS (SELECT doc_id % 60 AS series, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS token, doc_id FROM documents),
x AS (SELECT series, token, (doc_id % 17 = 0) AS in_title FROM t),
d AS (SELECT token, count(DISTINCT series) AS shows, count(DISTINCT CASE WHEN in_title THEN series END) AS titled FROM x GROUP BY token)
SELECT token, shows, titled FROM d WHERE shows >= 25 AND titled::DOUBLE / shows < 2e-1 AND token NOT IN ('der', 'the')""")
def vocabulary_learning(spark, d):
    t = table(spark, d, "documents").select((F.col("doc_id") % 60).alias("show"), (F.col("doc_id") % 17 == 0).alias("in_title"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("token"))
    return agreement.learn_vocabulary(t, spark.createDataFrame([("der",), ("the",)], "token string"), 25, 0.2)
