"""Names, titles, timestamps and decorations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, text, times
from ..operators import agreement
from .inputs import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: Titles of the part table, and their keys, as SQL.
TITLES = """
t AS (SELECT p_partkey AS id, p_name || ' and the ' || p_type AS title FROM part),
a AS (SELECT id, title, regexp_replace(regexp_replace(lower(title), '\\band\\b', '&', 'g'), '\\bthe\\b', '', 'g') AS s FROM t),
b AS (SELECT id, title, replace(replace(replace(replace(replace(replace(s, 'shi', 'si'), 'chi', 'ti'), 'tsu', 'tu'), 'fu', 'hu'), 'sha', 'sya'), 'shu', 'syu') AS s FROM a),
c AS (SELECT id, title, replace(replace(replace(replace(replace(replace(s, 'sho', 'syo'), 'she', 'sye'), 'cha', 'tya'), 'chu', 'tyu'), 'cho', 'tyo'), 'che', 'tye') AS s FROM b),
d AS (SELECT id, title, replace(replace(replace(replace(replace(replace(s, 'ja', 'zya'), 'ju', 'zyu'), 'jo', 'zyo'), 'je', 'zye'), 'ji', 'zi'), 'dzu', 'zu') AS s FROM c),
e AS (SELECT id, title, regexp_replace(regexp_replace(regexp_replace(s, 'ou([^aeiou]|$)', 'o\\1', 'g'), 'oh([^aeiou]|$)', 'o\\1', 'g'), 'oo([^aeiou]|$)', 'o\\1', 'g') AS s FROM d),
k AS (SELECT id, title, regexp_replace(replace(replace(replace(s, 'uu', 'u'), 'aa', 'a'), 'ee', 'e'), '[^0-9a-z]+', '', 'g') AS key FROM e)"""


def titles(spark, d):
    t = F.concat(F.col("p_name"), F.lit(" and the "), F.col("p_type"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), t.alias("title"))


@query(f"WITH {TITLES} SELECT id, key FROM k")
def title_keys(spark, d):
    t = titles(spark, d)
    keys = t.select("title").distinct().withColumn("key", text.title_key(F.col("title")))
    return t.join(keys, "title").select("id", "key")


SIMILAR = """
g AS (SELECT id, key, list_distinct(list_transform(range(1, length(key)), lambda i: substr(key, i, 2))) AS g FROM k),
p AS (SELECT x.id AS a, y.id AS b, x.key AS ka, y.key AS kb, x.g AS ga, y.g AS gb FROM g x JOIN g y ON y.id = x.id + 1),
s AS (SELECT a, b, CASE WHEN ka = kb THEN 1e0 ELSE len(list_intersect(ga, gb))::DOUBLE / len(list_distinct(list_concat(ga, gb))) END AS jaccard FROM p)"""


@query(f"WITH {TITLES}, {SIMILAR} SELECT a, b, jaccard, CASE WHEN jaccard >= 8e-1 THEN 'same' WHEN jaccard < 4e-1 THEN 'different' ELSE 'unsure' END AS identity FROM s")
def title_similarity(spark, d):
    k = title_keys(spark, d)
    x, y = k.select(F.col("id").alias("a"), F.col("key").alias("ka")), k.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("key").alias("kb"))
    none = F.array().cast("array<string>")
    p = x.join(y, "a").withColumn("jaccard", text.title_similarity(F.col("ka"), F.col("kb"), none, none))
    latin, no = F.lit("latin"), F.lit("")
    identity = text.series_identity(F.col("jaccard"), F.col("ka"), F.col("kb"), no, no, latin, latin, F.lit(False))
    return p.select("a", "b", "jaccard", identity.alias("identity"))


@query("""WITH t AS (SELECT doc_id, regexp_matches(text, '[A-Za-z]') AS latin, regexp_matches(text, '[\u3040-\u309F\u30A0-\u30FF\uFF66-\uFF9F\u4E00-\u9FFF\u3400-\u4DBF]') AS cjk FROM documents)
SELECT doc_id, CASE WHEN cjk AND latin THEN 'mixed' WHEN cjk THEN 'cjk' WHEN latin THEN 'latin' ELSE 'other' END AS script FROM t""")
def script_class(spark, d):
    return table(spark, d, "documents").select("doc_id", text.script_of(F.col("text")).alias("script"))


@query("""WITH s AS (SELECT doc_id, text AS s FROM documents)
SELECT doc_id, regexp_replace(regexp_extract(rtrim(s, ' ' || chr(10) || chr(13) || chr(9)), '([^0-9A-Za-z]+)$', 1), '[^''°☆△★!?.+~]', '', 'g') AS signature FROM s""")
def title_signature(spark, d):
    return table(spark, d, "documents").select("doc_id", text.signature_of(F.col("text")).alias("signature"))


TIMES = """
m AS (SELECT l_orderkey * 10 + l_linenumber AS id, (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey) % 36000000 AS ms FROM lineitem),
h AS (SELECT id, ms, ms // 3600000 AS h, ms // 60000 % 60 AS m, ms // 1000 % 60 AS s, ms % 1000 AS f FROM m)"""


def stamps(spark, d):
    x = table(spark, d, "lineitem")
    return x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey")) % 36000000).alias("ms"))


@query(f"""WITH {TIMES}
SELECT id, printf('%02d:%02d:%02d,%03d', h, m, s, f) AS srt, printf('%02d:%02d:%02d.%03d', h, m, s, f) AS vtt, printf('%02d:%02d:%02d:%03d', h, m, s, f) AS vobsub, ms / 1000e0 AS back FROM h""")
def timestamp_formats(spark, d):
    t = F.col("ms") / 1000.0
    x = stamps(spark, d).withColumn("srt", times.format_timestamp(t, "srt"))
    return x.select("id", "srt", times.format_timestamp(t, "vtt").alias("vtt"), times.format_timestamp(t, "vobsub").alias("vobsub"), times.parse_timestamp(F.col("srt"), "srt").alias("back"))


@query(f"""WITH {TIMES}
SELECT id, CASE WHEN (ms + 1500) // 3600000 > 0 THEN printf('%02d:', (ms + 1500) // 3600000) ELSE '' END || printf('%02d:%02d.%03d', (ms + 1500) // 60000 % 60, (ms + 1500) // 1000 % 60, (ms + 1500) % 1000) AS moved FROM h""")
def timestamp_shape_kept(spark, d):
    like = F.lit("00:01.000")
    return stamps(spark, d).select("id", times.format_timestamp((F.col("ms") + 1500) / 1000.0, "srt", like).alias("moved"))


#: Names of a few shapes; the oracle knows what was put in.
NAMES = """
n AS (SELECT o_orderkey AS id, (o_orderkey % 4 + 1)::INT AS season, (o_orderkey % 97 + 1)::DOUBLE AS episode, o_orderkey % 6 AS form FROM orders)"""


def made_names(spark, d):
    k = F.col("o_orderkey")
    s, e, form = (k % 4 + 1).cast("string"), (k % 97 + 1), k % 6
    two = F.lpad(e.cast("string"), 2, "0")
    show = F.concat(F.lit("Blue Harbor "), F.element_at(F.array(*map(F.lit, ("Tales", "Nights", "Road"))), (k % 3 + 1).cast("int")))
    name = (
        F.when(form == 0, F.concat(show, F.lit(" S0"), s, F.lit("E"), two, F.lit(" 1080p WEB-DL x264.mkv")))
        .when(form == 1, F.concat(F.lit("[Grp] "), show, F.lit(" - "), two, F.lit(" [720p][ABCDEF12].mkv")))
        .when(form == 2, F.concat(show, F.lit(" "), s, F.lit("x"), two, F.lit(".srt")))
        .when(form == 3, F.concat(show, F.lit(" Season "), s, F.lit(" Episode "), e.cast("string"), F.lit(".ass")))
        .when(form == 4, F.concat(show, F.lit(" (2009) 1080p BluRay.mkv")))
        .otherwise(F.concat(show, F.lit(" 01~12 [BD].mkv")))
    )
    return table(spark, d, "orders").select(k.alias("id"), name.alias("name"), form.alias("form"))


@query(f"""WITH {NAMES}
SELECT id, CASE form WHEN 4 THEN 'film' WHEN 5 THEN 'batch' ELSE 'episode' END AS kind, CASE WHEN form IN (0, 2, 3) THEN season END AS season, CASE WHEN form < 4 THEN episode END AS episode,
       CASE WHEN form = 4 THEN 2009 END::INT AS year, CASE WHEN form <> 5 THEN 'Blue Harbor ' || (['Tales', 'Nights', 'Road'])[id % 3 + 1] END AS title FROM n""")
def name_ladder(spark, d):
    n = made_names(spark, d)
    p = n.select("name").distinct().withColumn("p", names.parse_names(F.col("name")))
    return n.join(p, "name").select("id", "p.kind", "p.season", "p.episode", "p.year", F.when(F.col("p.kind") != "batch", F.col("p.title")).alias("title"))


@query("""WITH f AS (SELECT s_suppkey AS id, s_suppkey % 6 AS k FROM supplier)
SELECT id, CASE k WHEN 0 THEN 'v' || id WHEN 1 THEN 'v' || id WHEN 2 THEN 'v' || id WHEN 3 THEN 'v' || id || '.notes' WHEN 4 THEN 'v' || id ELSE 'en' END AS stem,
       CASE k WHEN 0 THEN 'en' WHEN 1 THEN 'ja' WHEN 2 THEN 'pt' WHEN 4 THEN 'de' ELSE 'und' END AS lang,
       CASE k WHEN 1 THEN 'cc' WHEN 2 THEN 'forced,sdh' WHEN 4 THEN 'hi' ELSE '' END AS flags, 'srt' AS ext FROM f""")
def sidecar_names(spark, d):
    k, v = F.col("s_suppkey") % 6, F.concat(F.lit("v"), F.col("s_suppkey").cast("string"))
    tail = F.when(k == 0, ".en.srt").when(k == 1, ".ja[cc].srt").when(k == 2, ".pt-BR.sdh.forced.srt").when(k == 3, ".notes.srt").when(k == 4, ".ger.HI.srt")
    name = F.when(k == 5, F.lit("en.srt")).otherwise(F.concat(v, tail))
    x = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), names.sidecar(name, names.languages(spark)).alias("s"))
    return x.select("id", "s.stem", "s.lang", F.array_join("s.flags", ",").alias("flags"), "s.ext")


@query("""WITH s AS (SELECT c_nationkey AS dir, 'Show ' || (c_nationkey % 5) || ' - ' || (c_custkey % 40) || ' [' || 720 || 'p].mkv' AS name, c_custkey % 40 AS e FROM customer),
g AS (SELECT dir, count(*) AS files, count(DISTINCT e) AS dist, min(e) AS lo, max(e) AS hi FROM s GROUP BY dir)
SELECT dir, files, 1 AS slot, 5e-1 * (dist::DOUBLE / files) + 5e-1 * dist::DOUBLE / (hi - lo + 1) AS confidence FROM g WHERE files >= 3 AND dist::DOUBLE / files >= 5e-1""")
def scheme_inference(spark, d):
    k = F.col("c_custkey") % 40
    n = table(spark, d, "customer").select(
        F.col("c_nationkey").alias("dir"), F.concat(F.lit("Show "), (F.col("c_nationkey") % 5).cast("string"), F.lit(" - "), k.cast("string"), F.lit(" [720p].mkv")).alias("name")
    )
    shaped = n.select("dir", names.shape(F.col("name")).alias("x")).select("dir", "x.shape", "x.numbers")
    return agreement.infer_slots(shaped, ["dir"], names.RESOLUTIONS).select("dir", "files", "slot", "confidence")


@query("""WITH f AS (SELECT p_partkey AS id, p_partkey % 5 AS k FROM part)
SELECT id, k IN (0, 1) AS creditless, CASE k WHEN 2 THEN 'director''s cut' WHEN 3 THEN 'extended edition' ELSE '' END AS edition,
       CASE k WHEN 4 THEN NULL WHEN 1 THEN 'subtitle' ELSE 'video' END AS kind, k = 2 AS junk FROM f""")
def film_name_parts(spark, d):
    k, n = F.col("p_partkey") % 5, F.concat(F.lit("Harbor "), F.col("p_partkey").cast("string"))
    tail = F.when(k == 0, " NCOP1.mkv").when(k == 1, " creditless.srt").when(k == 2, ".Director's.Cut.sample.mkv").when(k == 3, " (Extended Edition).mkv").otherwise(".txt")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(n, tail).alias("name")).select(
        "id", names.is_creditless(F.col("name")).alias("creditless"), names.edition(F.col("name")).alias("edition"), names.classify(F.col("name")).alias("kind"), names.is_junk(F.col("name")).alias("junk")
    )


@query("""WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS id, unnest([l_partkey % 3, l_suppkey % 3, l_linenumber % 3])::DOUBLE AS episode FROM lineitem),
n AS (SELECT id, episode, count(*) AS n FROM v GROUP BY 1, 2),
g AS (SELECT id, sum(n) AS all_n, count(*) AS kinds, arg_max(episode, n * 10 - episode) AS top, max(n) AS tn FROM n GROUP BY id),
s AS (SELECT *, CASE WHEN all_n = 1 THEN 'sole' WHEN kinds = 1 THEN 'agree' WHEN tn >= 2 AND tn > all_n - tn THEN 'majority' ELSE 'disagree' END AS state FROM g)
SELECT id, state, CASE WHEN state <> 'disagree' THEN top END AS episode FROM s""")
def parser_vote(spark, d):
    x = table(spark, d, "lineitem")
    v = x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.explode(F.array(F.col("l_partkey") % 3, F.col("l_suppkey") % 3, (F.col("l_linenumber") % 3).cast("long"))).alias("e"))
    return names.vote(v.select("id", F.col("e").cast("double").alias("episode")), ["id"])


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' v2x' END AS title, p_partkey % 2 = 0 AS polluted FROM part""")
def decoration_strip(spark, d):
    k = F.col("p_partkey")
    n = F.concat(F.col("p_name"), F.when(k % 2 == 0, " [WEBX]").otherwise(" v2x"))
    return table(spark, d, "part").select(k.alias("id"), names.strip_decoration(n, ["webx", "hdq"]).alias("title"), names.is_polluted(n, ["webx", "hdq"]).alias("polluted"))
