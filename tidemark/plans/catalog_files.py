"""Cue files, rewriting, encodings, text functions, state, names to write and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kana, names, text, times
from ..operators import agreement, align, ranking, report, rewrite, state, verdict, witness
from ..sources import encoding, formats
from ..streaming import windows
from . import inputs
from .catalog_names import made_names
from .inputs import LINES, MOMENTS, SUBTITLES, VIDEOS, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


KINDS = ("srt", "ass", "vtt", "idx")


def cue_files(spark, d):
    """path, content: each stream of a pair as a file, its format by the pair."""
    x = inputs.lines(spark, d).select("pair_id", "side", "start", "end").distinct()
    by = F.array_sort(F.collect_list(F.struct("start", "end")))
    g = x.groupBy("pair_id", "side").agg(by.alias("cues"), F.array_sort(F.collect_set("start")).alias("starts"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("pair_id") % 4 + 1).cast("int"))
    t = lambda k, c: times.format_timestamp(c, k)
    srt = F.transform("cues", lambda c, i: F.concat((i + 1).cast("string"), F.lit("\n"), t("srt", c["start"]), F.lit(" --> "), t("srt", c["end"]), F.lit("\nline "), i.cast("string"), F.lit("\n\n")))
    ass = F.transform("cues", lambda c: F.concat(F.lit("Dialogue: 0,"), t("ass", c["start"]), F.lit(","), t("ass", c["end"]), F.lit(",some, text\n")))
    vtt = F.transform("cues", lambda c: F.concat(t("vtt", c["start"]), F.lit(" --> "), t("vtt", c["end"]), F.lit(" line:0\nsay\n\n")))
    idx = F.transform("starts", lambda s: F.concat(F.lit("timestamp: "), t("vobsub", s), F.lit(", filepos: 000000000\n")))
    body = (
        F.when(kind == "srt", F.array_join(srt, "")).when(kind == "ass", F.concat(F.lit("[Script Info]\n\n[V4+ Styles]\n\n[Events]\nFormat: Layer, Start, End, Text\n"), F.array_join(ass, "")))
        .when(kind == "vtt", F.concat(F.lit("WEBVTT\n\n"), F.array_join(vtt, ""))).otherwise(F.concat(F.lit("# VobSub index file, v7\nid: en\n"), F.array_join(idx, "")))
    )
    path = F.concat(F.lit("/c/"), F.col("pair_id").cast("string"), F.lit("-"), F.col("side").cast("string"), F.lit("."), kind)
    return g.select(path.alias("path"), body.alias("body"))


FILES = f"""WITH {LINES},
u AS (SELECT DISTINCT pair_id, side, start, "end" FROM lines),
k AS (SELECT *, (['srt', 'ass', 'vtt', 'idx'])[pair_id % 4 + 1] AS kind FROM u),
i AS (SELECT DISTINCT pair_id, side, start, kind FROM k WHERE kind = 'idx'),
c AS (SELECT pair_id, side, kind, CASE kind WHEN 'ass' THEN round_even(start * 100, 0) / 100 ELSE start END AS start, CASE kind WHEN 'ass' THEN round_even("end" * 100, 0) / 100 ELSE "end" END AS "end" FROM k WHERE kind <> 'idx'
  UNION ALL SELECT pair_id, side, kind, start, coalesce(lead(start) OVER (PARTITION BY pair_id, side ORDER BY start), start + 2) FROM i),
f AS (SELECT '/c/' || pair_id || '-' || side || '.' || kind AS path, CASE kind WHEN 'idx' THEN 'vobsub' ELSE kind END AS format, start, "end" FROM c)"""


@query(FILES + """ SELECT path, format, round(start, 3) AS start, round("end", 3) AS "end" FROM f""")
def read_cues(spark, d):
    read = formats.read_cue_files(cue_files(spark, d).select("path", F.encode("body", "utf-8").alias("content")))
    return formats.cues_of(read).select("path", "format", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query(FILES + """ SELECT path, format, round(start + 15e-1, 3) AS start, round("end" + 15e-1, 3) AS "end" FROM f WHERE format <> 'vobsub'""")
def retimed_cues(spark, d):
    """Files moved by 1.5 s, written in their own shape and read again; an index can't be written."""
    read = formats.read_cue_files(cue_files(spark, d).select("path", F.encode("body", "utf-8").alias("content")))
    moved = rewrite.render_files(read.withColumn("segments", F.expr("array(struct(cast(null as double) as split, 1.5D as offset))"))).where("status = 'OK'")
    return formats.cues_of(formats.read_cue_files(moved)).select("path", "format", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query(FILES + """,
n AS (SELECT path, count(*) AS n, count(*) FILTER (start >= 1200 AND start < 1210) AS gone FROM f WHERE format = 'srt' GROUP BY path)
SELECT path, n - gone AS cues, n - gone AS last_number FROM n""")
def removed_cues(spark, d):
    """SRT files with ten seconds cut out: lines without a place go, the others are numbered anew."""
    read = formats.read_cue_files(cue_files(spark, d).select("path", F.encode("body", "utf-8").alias("content"))).where("format = 'srt'")
    cut = "array(struct(1204.0D as split, 4.0D as offset), struct(cast(null as double) as split, -6.0D as offset))"
    out = rewrite.render_files(read.withColumn("segments", F.expr(cut)))
    again = formats.read_cue_files(out.where("status = 'OK'"))
    number = F.regexp_extract_all("text", F.lit(r"(?m)^(\d+)$"), F.lit(1))
    return again.select("path", F.size("cues").cast("long").alias("cues"), F.element_at(number, -1).cast("long").alias("last_number"))


@query("""WITH e(codec) AS (VALUES ('utf-8'), ('utf-16'), ('cp932')),
t AS (SELECT s_suppkey AS id, '1' || chr(10) || '00:00:01,000 --> 00:00:02,000' || chr(10) || repeat('これは字幕の' || s_suppkey || 'です。', 12) || chr(10) AS text FROM supplier)
SELECT id, codec AS stored, md5(text) AS text_md5, true AS same_bytes FROM t, e""")
def encodings_round_trip(spark, d):
    """Text stored in three encodings, found out and decoded, and encoded back to the same bytes."""
    said = F.concat(F.lit("1\n00:00:01,000 --> 00:00:02,000\n"), F.repeat(F.concat(F.lit("これは字幕の"), F.col("s_suppkey").cast("string"), F.lit("です。")), F.lit(12)), F.lit("\n"))
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), said.alias("text"), F.explode(F.array(F.lit("utf-8"), F.lit("utf-16"), F.lit("cp932"))).alias("stored"))

    def run(batches):
        import hashlib

        import pandas as pd

        for pdf in batches:
            rows = []
            for i, body, codec in zip(pdf["id"], pdf["text"], pdf["stored"], strict=True):
                data = body.encode(codec)
                got, used, bom = encoding.decode(data)
                rows.append((i, codec, hashlib.md5(got.encode()).hexdigest(), encoding.encode_back(got, used, bom) == data))
            yield pd.DataFrame(rows, columns=["id", "stored", "text_md5", "same_bytes"])

    return t.mapInPandas(run, "id long, stored string, text_md5 string, same_bytes boolean")


@query(f"""WITH {MOMENTS}, s AS (SELECT *, (['0:00', '00:00:00,0', 'x'])[(floor(t) % 3)::INT + 1] AS odd FROM moments)
SELECT pair_id, side, t, t AS ass, t AS vtt, t AS vobsub, odd <> '00:00:00,0' AS no_srt,
       CASE WHEN round_even(t, 0) >= 3600 THEN printf('%d:%02d:%02d', round_even(t, 0)::BIGINT // 3600, round_even(t, 0)::BIGINT // 60 % 60, round_even(t, 0)::BIGINT % 60)
            ELSE printf('%d:%02d', round_even(t, 0)::BIGINT // 60, round_even(t, 0)::BIGINT % 60) END AS clock FROM s""")
def timestamps_read(spark, d):
    odd = F.element_at(F.array(F.lit("0:00"), F.lit("00:00:00,0"), F.lit("x")), (F.floor("t") % 3 + 1).cast("int"))
    read = lambda k, like: times.parse_timestamp(times.format_timestamp(F.col("t"), "srt", F.lit(like)), k)
    return inputs.moments(spark, d).select(
        "pair_id", "side", "t", read("ass", "0:00:00.000").alias("ass"), read("vtt", "00:00.000").alias("vtt"), times.parse_timestamp(times.format_timestamp(F.col("t"), "vobsub"), "vobsub").alias("vobsub"),
        times.parse_timestamp(odd, "srt").isNull().alias("no_srt"), times.clock(F.col("t")).alias("clock"),
    )


#: Digits as words in kana, and how they are spelt.
KANA = ("レイ", "イチ", "ニ", "サン", "シ", "ゴー", "ロク", "シッチ", "ハチャ", "キュウ")
SPELT = ("rei", "ichi", "ni", "san", "shi", "goo", "roku", "shitchi", "hacha", "kyuu")


@query(f"""WITH c AS (SELECT p_partkey AS id, list_transform(string_split(p_partkey::VARCHAR, ''), lambda x: x::INT + 1) AS n FROM part)
SELECT id, array_to_string(list_transform(n, lambda i: ({list(SPELT)})[i]), ' ') AS romaji, id % 7 = 0 AS han, true AS kana FROM c""")
def kana_romaji(spark, d):
    k = F.col("p_partkey").cast("string")
    word = lambda c: F.element_at(F.array(*map(F.lit, KANA)), (c.cast("int") + 1))
    said = F.array_join(F.transform(F.regexp_extract_all(k, F.lit(r"(\d)"), F.lit(1)), word), "・")
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(said, F.when(F.col("p_partkey") % 7 == 0, "　漢").otherwise("")).alias("t"))
    return t.select("id", kana.romaji(F.col("t")).alias("romaji"), (~text.is_kana_only(F.col("t"))).alias("han"), text.is_kana(F.col("t")).alias("kana"))


@query("""WITH t AS (SELECT p_partkey AS id, p_name AS name, lower(p_name) AS s FROM part),
a AS (SELECT *, replace(regexp_replace(regexp_replace(s, '[^a-z ]+', ' ', 'g'), 'ch', 'C', 'g'), 'zz', 'z') AS x FROM t)
SELECT id, array_to_string(list_sort(list_distinct(list_transform(range(1, length(s)), lambda i: substr(s, i, 2)))), ',') AS grams,
       len(list_intersect(list_distinct(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))), list_distinct(list_transform(range(1, length(s || 'x')), lambda i: substr(s || 'x', i, 2)))))::DOUBLE
         / len(list_distinct(list_transform(range(1, length(s)), lambda i: substr(s, i, 2)))) AS contained, replace(name, ' ', '') <> '' AS inside, 'latin' AS script FROM a""")
def text_grams(spark, d):
    n = F.lower("p_name")
    key = F.regexp_replace(n, " ", "")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.array_join(F.array_sort(text.bigrams(n)), ",").alias("grams"), text.containment(n, F.concat(n, F.lit("x"))).alias("contained"),
        text.contains_other(F.concat(key, F.lit("s")), key).alias("inside"), text.majority_script(F.col("p_name")).alias("script"),
    )


#: Characters that stand for digits: variants of kanji and what they fold to, katakana and hiragana.
VARIANTS, FOLDED, KATAKANA, HIRAGANA = "劍戀戰廣國學實櫻氣歸", "剣恋戦広国学実桜気帰", "カキクケコサシスセソ", "かきくけこさしすせそ"


@query(f"""WITH p AS (SELECT p_partkey AS id, p_partkey::VARCHAR AS k, p_size % 2 = 0 AS even, substr(p_name, 1, p_size % 9) AS w, p_name, p_brand FROM part),
n AS (SELECT *, length(k) AS han, CASE WHEN even THEN length(k) ELSE 0 END AS kana, length(regexp_replace(w, '[^A-Za-z]', '', 'g')) AS latin, chr(39) || chr(34) AS quotes,
  translate(k, '0123456789', '{FOLDED}') AS a, CASE WHEN even THEN translate(k, '0123456789', '{KATAKANA}') ELSE '' END AS b FROM p)
SELECT id, a || b || quotes || w AS folded, CASE WHEN (han + kana) * 2 < han + kana + latin THEN 'latin' WHEN kana * 10 >= kana + han THEN 'kana' ELSE 'han' END AS majority,
  CASE WHEN latin > 0 THEN 'mixed' ELSE 'cjk' END AS script, true AS crosses, a || translate(b, '{KATAKANA}', '{HIRAGANA}') || quotes || w AS hiragana,
  trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^0-9a-z]+', ' ', 'g')) AS split_key FROM n""")
def script_folds(spark, d):
    """Titles of every part in kanji variants, katakana, quotes and the first letters of its name."""
    k = F.col("p_partkey").cast("string")
    kana = F.when(F.col("p_size") % 2 == 0, F.translate(k, "0123456789", KATAKANA)).otherwise("")
    raw = F.concat(F.translate(k, "0123456789", VARIANTS), kana, F.lit("’“"), F.substr("p_name", F.lit(1), F.col("p_size") % 9))
    folder = F.concat(F.lpad(k, 6, "0"), F.lit(" "), "p_name", F.lit(" [Tag]（x） "), "p_brand", F.lit("!"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), raw.alias("raw"), folder.alias("folder"))
    folded = text.fold_cjk_variants(text.fold_quotes(F.col("raw")))
    return p.select(
        "id", folded.alias("folded"), text.majority_script(F.col("raw")).alias("majority"), text.script_of(F.col("raw")).alias("script"),
        text.cross_script(text.script_of(F.col("raw")), F.lit("latin")).alias("crosses"), text.kata_to_hira(folded).alias("hiragana"), text.split_key(F.col("folder")).alias("split_key"),
    )


@query("""WITH t AS (SELECT s_suppkey AS id, s_suppkey % 5 AS k FROM supplier)
SELECT id, CASE k WHEN 0 THEN 'same' WHEN 1 THEN 'different' WHEN 2 THEN 'same' WHEN 3 THEN 'unsure' ELSE 'different' END AS identity,
       CASE k WHEN 0 THEN 1e0 WHEN 1 THEN 1e0 ELSE NULL END AS score FROM t""")
def series_rules(spark, d):
    """Every rule of identity: equal keys, equal keys with other signs behind, a bridge, two scripts, nothing in common."""
    rows = [
        ("Blue Harbor", "blue harbor", False), ("Blue Harbor!", "Blue Harbor", False), ("Umi no Machi", "Ocean Town Story", True), ("海の街", "Umi no Machi", False), ("Blue Harbor", "Zzyx Quux", False),
    ]
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("bridged")) for a, b, c in rows])
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.element_at(pairs, (F.col("s_suppkey") % 5 + 1).cast("int")).alias("p")).select("id", "p.*")
    k = [text.title_key(F.col(c)) for c in "ab"]
    w = [text.title_tokens(F.col(c)) for c in "ab"]
    t = t.select("id", "a", "b", "bridged", k[0].alias("ka"), k[1].alias("kb"), w[0].alias("wa"), w[1].alias("wb"))
    score = text.title_similarity(F.col("ka"), F.col("kb"), F.col("wa"), F.col("wb"))
    sign = [text.signature_of(F.col(c)) for c in "ab"]
    script = [text.script_of(F.col(c)) for c in "ab"]
    t = t.withColumn("score", score)
    return t.select("id", text.series_identity(F.col("score"), F.col("ka"), F.col("kb"), *sign, *script, F.col("bridged")).alias("identity"), F.when(F.col("id") % 5 < 2, F.col("score")).alias("score"))


@query("""WITH h AS (SELECT s_suppkey AS video, unnest(range(8)) AS i FROM supplier),
w AS (SELECT video, count(*) AS scored, count(*) FILTER (video % 3 <> 1) AS hits FROM h GROUP BY video)
SELECT video, CASE WHEN video % 5 = 4 THEN 2 ELSE scored END AS scored, CASE WHEN video % 5 = 4 THEN CASE WHEN video % 3 = 1 THEN 0 ELSE 2 END ELSE hits END AS hits,
       CASE WHEN video % 5 = 4 THEN 'too few windows' WHEN video % 3 = 1 THEN 'says something else' ELSE '' END AS reason FROM w""")
def text_witness(spark, d):
    """What is heard in eight windows (two, for some) against what is written there, of another text for every third video."""
    words = F.array(*map(F.lit, ("alphabetagamma", "deltaepsilonzeta", "etathetaiotakappa", "lambdamunuxi", "omicronpirhosigma", "tauupsilonphichi", "psiomegaqoppa", "sampistigmaheta")))
    v = table(spark, d, "supplier").select(F.col("s_suppkey").alias("video"), F.posexplode(words).alias("i", "said"))
    heard = v.where("video % 5 <> 4 or i < 2").select("video", (F.col("i") * 400.0).alias("start"), "said")
    cues = v.select("video", (F.col("i") * 400.0 + 5).alias("at"), F.when(F.col("video") % 3 == 1, "xxyyzzxxyyzz").otherwise(F.col("said")).alias("text"))
    return witness.check(heard, cues).select("video", "scored", "hits", "reason")


@query("""WITH p AS (SELECT o_custkey AS video, 'd' || (o_orderkey % 50) AS digest, count(*) AS p FROM orders GROUP BY 1, 2),
e AS (SELECT o_custkey AS video, 'd' || (o_orderkey % 50) AS digest, count(*) AS e FROM orders WHERE o_custkey % 3 <> 0 OR o_orderkey % 2 = 0 GROUP BY 1, 2),
b AS (SELECT coalesce(p.video, e.video) AS video, coalesce(p, 0) AS p, coalesce(e, 0) AS e FROM p FULL JOIN e ON p.video = e.video AND p.digest = e.digest),
g AS (SELECT video, sum(greatest(p - e, 0))::BIGINT AS added, sum(greatest(e - p, 0))::BIGINT AS gone FROM b GROUP BY video)
SELECT video, coalesce(added, 0) + 0 AS added, gone + 0 AS gone, added = 0 AND gone = 0 AND video IN (SELECT video FROM e) AS settled FROM g""")
def settled_videos(spark, d):
    """Videos whose files are those a former run recorded; a third of them has files that came later."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("video"), F.concat(F.lit("d"), (F.col("o_orderkey") % 50).cast("string")).alias("digest"), "o_orderkey")
    known = o.where("video % 3 <> 0 or o_orderkey % 2 = 0")
    considered = F.collect_list(F.struct("digest", F.lit("REFUSED").alias("outcome"), F.lit(True).alias("survived")))
    records = known.groupBy("video").agg(considered.alias("considered"), F.min("digest").alias("output_digest"))
    records = records.select("output_digest", F.concat(F.lit("v"), F.col("video").cast("string")).alias("video_digest"), F.lit("en").alias("lang"), F.create_map(F.lit("rename"), F.lit("1")).alias("shape"), "considered")
    present = o.select("video", F.concat(F.lit("v"), F.col("video").cast("string")).alias("video_digest"), "digest")
    return state.work_left(records, present, {"rename": "1"}).select("video", "added", "gone", "settled")


@query("""WITH t AS (SELECT s_suppkey AS id, s_suppkey % 6 AS k FROM supplier)
SELECT id, CASE k WHEN 0 THEN 'CON_.x' || id || '.en.forced.srt' WHEN 1 THEN 'v' || id || '.best-1.de.srt' WHEN 2 THEN repeat('漢', 82) || '.ja.srt' WHEN 3 THEN 'v' || id || '.srt' WHEN 4 THEN 'lpt1_.fr.sdh.cc.ass' ELSE 'nul' || id || '.en.vtt' END AS name,
       CASE k WHEN 0 THEN 'reserved' WHEN 2 THEN 'trimmed' WHEN 4 THEN 'reserved' ELSE '' END AS notes, k IN (0, 4) AS device,
       CASE k WHEN 0 THEN NULL WHEN 1 THEN 'another language' WHEN 2 THEN 'no language code' WHEN 3 THEN 'the language is not known' WHEN 4 THEN 'not plain letters' END AS code_fault,
       CASE k WHEN 0 THEN NULL WHEN 1 THEN 'empty' WHEN 2 THEN 'too long' WHEN 3 THEN 'blanks around it' WHEN 4 THEN 'forbidden signs' END AS suffix_fault,
       'v' || id || '_rt.ja[cc].srt' AS suffixed FROM t""")
def names_to_write(spark, d):
    """Names of the files to write: devices, tags, length in bytes, codes, suffixes."""
    k, i = F.col("s_suppkey") % 6, F.col("s_suppkey").cast("string")
    pick = lambda *x: F.element_at(F.array(*[y if isinstance(y, F.Column) else F.lit(y) for y in x]), (k + 1).cast("int"))
    lists = lambda *x: F.element_at(F.array(*[F.array(*map(F.lit, y)).cast("array<string>") for y in x]), (k + 1).cast("int"))
    stem = pick(F.concat(F.lit("CON.x"), i), F.concat(F.lit("v"), i), F.lit("漢" * 100), F.concat(F.lit("v"), i), F.lit("lpt1"), F.concat(F.lit("nul"), i))
    lang = pick("en", "de", "ja", "und", "fr", "en")
    tags = names.languages(spark)
    made = names.safe_name(stem, lang, lists(("FORCED",), (), (), (), ("cc", "sdh"), ()), pick("srt", "srt", ".srt", "srt", "ass", "vtt"), F.when(k == 1, "best/-1"))
    code = pick("eng", "jpn", "zz", "en", "f-r", "eng")
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), made["name"].alias("name"), F.array_join(made["notes"], ",").alias("notes"), names.is_reserved(stem).alias("device"), names.code_fault(code, lang, tags).alias("code_fault"),
        names.suffix_fault(pick("_rt", "", "x" * 33, " a", "a.b", "ok")).alias("suffix_fault"), names.suffixed_name(F.concat(F.lit("v"), i, F.lit(".ja[cc].srt")), F.lit("_rt"), tags).alias("suffixed"),
    )


@query("""WITH n AS (SELECT o_orderkey AS id, (o_orderkey % 2400)::DOUBLE AS v FROM orders)
SELECT id, v NOT IN (240, 360, 480, 540, 576, 640, 720, 848, 852, 854, 960, 1024, 1080, 1088, 1280, 1440, 1920, 2160, 2560, 3840, 4320, 8, 10, 16, 24, 26, 264, 265) AND v <= 2000 AND NOT (v BETWEEN 1900 AND 2100 AND id % 2 = 0 AND id % 3 <> 2) AS plausible,
       id % 3 <> 2 AS western FROM n""")
def plausible_numbers(spark, d):
    k = F.col("o_orderkey")
    v = (k % 2400).cast("double")
    name = F.concat(F.lit("Show"), F.when(k % 2 == 0, F.concat(F.lit("."), (k % 2400).cast("string"))).otherwise(F.lit(".one")), F.element_at(F.array(F.lit("-GRP.mkv"), F.lit(".x.mkv"), F.lit("字-GRP.mkv")), (k % 3 + 1).cast("int")))
    return table(spark, d, "orders").select(k.alias("id"), names.is_plausible(v, name).alias("plausible"), names.looks_western(name).alias("western"))


@query("""WITH c AS (SELECT c_custkey AS id, c_nationkey AS dir, c_custkey % 40 AS e, c_custkey % 10 = 0 AS other FROM customer),
g AS (SELECT dir, count(*) AS files, count(DISTINCT e)::DOUBLE / count(*) AS ratio, 5e-1 * count(DISTINCT e) / count(*) + 5e-1 * count(DISTINCT e) / (max(e) - min(e) + 1) AS score FROM c WHERE NOT other GROUP BY dir)
SELECT id, CASE WHEN NOT other AND files >= 3 AND ratio >= 5e-1 AND score >= 5e-1 THEN e END AS scheme_episode FROM c LEFT JOIN g ON c.dir = g.dir""")
def folder_schemes(spark, d):
    """Episodes by the scheme of a folder's names alone; full-width digits count like others, names of another shape get none."""
    k = F.col("c_custkey") % 40
    wide = F.translate(k.cast("string"), "0123456789", "０１２３４５６７８９")
    # a single name of its own shape in every tenth row
    name = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("only "), F.regexp_replace(F.sha1(F.col("c_custkey").cast("string").cast("binary")), r"\d", "x"), F.lit(".mkv"))).otherwise(
        F.concat(F.lit("Show （"), F.when(k % 2 == 0, wide).otherwise(k.cast("string")), F.lit("） [720p].mkv"))
    )
    n = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("dir"), name.alias("name"))
    shaped = n.select("id", "dir", names.shape(F.col("name")).alias("x")).select("id", "dir", "x.shape", "x.numbers")
    return agreement.scheme_episodes(shaped, agreement.infer_slots(shaped, ["dir"], names.RESOLUTIONS), ["dir"]).select("id", "scheme_episode")


@query("""WITH s AS (SELECT l_suppkey % 100 AS dir, l_linenumber::VARCHAR AS shape, count(*) AS files, max(l_discount) AS confidence FROM lineitem GROUP BY 1, 2)
SELECT dir, shape, files, confidence FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY files DESC, confidence DESC, shape) AS r FROM s) WHERE r = 1""")
def dominant_scheme(spark, d):
    s = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 100).alias("dir"), F.col("l_linenumber").cast("string").alias("shape")).agg(F.count("*").alias("files"), F.max("l_discount").alias("confidence"))
    return agreement.dominant_scheme(s, ["dir"])


@query("""WITH v AS (SELECT s_suppkey AS g, unnest(range(1, 11)) AS e FROM supplier), s AS (SELECT s_suppkey AS g, unnest(range(1 + (s_suppkey % 4) * 6, 11 + (s_suppkey % 4) * 6)) AS e FROM supplier)
SELECT DISTINCT s_suppkey AS g, ((s_suppkey % 4) * 6)::BIGINT AS shift, 10 AS overlap, 10 AS smaller FROM supplier WHERE s_suppkey % 4 > 0""")
def renumberings(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("g"))
    v = s.select("g", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("episode")).withColumn("episode", F.col("episode").cast("long"))
    return agreement.renumbering(v, v.withColumn("episode", F.col("episode") + F.col("g") % 4 * 6), ["g"])


#: Slots that share sources; a third of them write in place.
OWNERS = """
p AS (SELECT DISTINCT l_orderkey % 900 AS video, l_returnflag AS lang, 's' || (l_partkey % 700) AS path,
             CASE WHEN l_partkey % 3 = 0 THEN 's' || (l_partkey % 700) ELSE 't' || l_partkey || l_returnflag END AS target, CASE WHEN l_linenumber < 3 THEN 'write' ELSE 'supersede' END AS action FROM lineitem),
a AS (SELECT 's' || s_suppkey AS path, 100000 + s_suppkey AS video FROM supplier WHERE s_suppkey % 7 = 0)"""


@query(f"""WITH {OWNERS},
c AS (SELECT path, video FROM p WHERE action = 'write' UNION SELECT path, video FROM a),
n AS (SELECT path FROM c GROUP BY path HAVING count(*) > 1),
r AS (SELECT *, CASE WHEN action = 'write' AND target = path AND path IN (SELECT path FROM n) THEN 'refuse' ELSE action END AS act FROM p),
o AS (SELECT path FROM r WHERE act = 'write' UNION SELECT path FROM a)
SELECT video, lang, path, target, CASE WHEN act = 'supersede' AND path IN (SELECT path FROM o) THEN 'keep' ELSE act END AS action FROM r""")
def shared_source_guard(spark, d):
    x = table(spark, d, "lineitem")
    own = F.concat(F.lit("s"), (F.col("l_partkey") % 700).cast("string"))
    p = x.select(
        (F.col("l_orderkey") % 900).alias("video"), F.col("l_returnflag").alias("lang"), own.alias("path"),
        F.when(F.col("l_partkey") % 3 == 0, own).otherwise(F.concat(F.lit("t"), F.col("l_partkey").cast("string"), F.col("l_returnflag"))).alias("target"),
        F.when(F.col("l_linenumber") < 3, "write").otherwise("supersede").alias("action"),
    ).distinct()
    s = table(spark, d, "supplier").where("s_suppkey % 7 = 0")  # the videos a run skipped
    answers = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"), (F.col("s_suppkey") + 100000).alias("video"))
    return ranking.settle_ownership(p, answers).select("video", "lang", "path", "target", "action")


@query("""WITH c AS (SELECT l_orderkey AS video, l_returnflag AS lang, l_linenumber AS seq, 'p' || l_partkey || '-' || l_linenumber AS path,
  CASE WHEN l_partkey % 3 = 0 THEN 'V' || l_orderkey ELSE 'v' || l_orderkey || ' [grp' || (l_suppkey % 2) || ']' END AS stem FROM lineitem),
t AS (SELECT *, CASE WHEN lower(stem) = 'v' || video THEN '' ELSE regexp_replace(substr(lower(stem), length('v' || video) + 1), '[^0-9a-z_-]', '', 'g') END AS head FROM c)
SELECT video, lang, path, CASE WHEN row_number() OVER (PARTITION BY video, lang, head ORDER BY seq, path) > 1 THEN substr(sha1(path), 1, 8) WHEN head <> '' THEN head END AS tag FROM t""")
def distinguishing_tags(spark, d):
    x, v = table(spark, d, "lineitem"), F.col("l_orderkey").cast("string")
    stem = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("V"), v)).otherwise(F.concat(F.lit("v"), v, F.lit(" [grp"), (F.col("l_suppkey") % 2).cast("string"), F.lit("]")))
    c = x.select(
        F.col("l_orderkey").alias("video"), F.col("l_returnflag").alias("lang"), F.col("l_linenumber").alias("seq"), F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("path"),
        stem.alias("stem"), F.concat(F.lit("v"), v).alias("video_stem"),
    )
    return ranking.distinguishing_tags(c).select("video", "lang", "path", "tag")


@query(f"""WITH {VIDEOS} SELECT path, '/out' || substr(regexp_extract(path, '^(.*)/[^/]*$', 1), length('/lib') + 1) AS folder FROM videos""")
def mirrored_folders(spark, d):
    v = inputs.videos(spark, d).select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"))
    root = F.broadcast(ranking.mirror_root(v))  # one row
    return v.crossJoin(root).select("path", ranking.output_folder(F.col("folder"), F.col("root"), "/out").alias("folder"))


RESULTS = """
r AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'CONFIDENT' WHEN 1 THEN 'CONFIDENT' WHEN 2 THEN 'REFUSED' WHEN 3 THEN 'ERROR' ELSE NULL END AS outcome, o_orderkey % 3 + 1 AS segments,
        o_orderkey % 7 = 0 AS landed, o_orderkey % 11 = 0 AS write_failed, o_orderkey % 13 = 0 AS forced, o_orderkey % 4 AS superseded FROM orders)"""


@query(f"""WITH {RESULTS}
SELECT count(*) FILTER (outcome = 'CONFIDENT' AND segments = 1) AS clean, count(*) FILTER (outcome = 'CONFIDENT' AND segments > 1) AS cut, count(*) FILTER (outcome = 'REFUSED') AS refused, count(*) FILTER (outcome = 'ERROR') AS errored,
       count(*) FILTER (outcome IS NULL) AS unknown, count(*) FILTER (outcome = 'CONFIDENT') AS confident, count(*) FILTER (landed) AS landed, count(*) FILTER (write_failed) AS write_failed, count(*) FILTER (forced) AS forced,
       sum(superseded)::BIGINT AS superseded FROM r""")
def run_counts(spark, d):
    k = F.col("o_orderkey")
    out = F.when(k % 5 < 2, "CONFIDENT").when(k % 5 == 2, "REFUSED").when(k % 5 == 3, "ERROR")
    r = table(spark, d, "orders").select(out.alias("outcome"), (k % 3 + 1).alias("segments"), (k % 7 == 0).alias("landed"), (k % 11 == 0).alias("write_failed"), (k % 13 == 0).alias("forced"), (k % 4).alias("superseded"))
    return report.run_counts(r)


@query("""WITH f AS (SELECT o_orderkey AS id, (o_orderkey % 100) / 100e0 AS score, o_orderkey % 5 AS size FROM orders)
SELECT id, round_even(score * 100, 0)::INT || '% of the lines match, ' || printf('%.1f', score * 4) || ' times chance' ||
  CASE WHEN score * 4 < 15e-1 THEN ', below 1.5' ELSE ', between 1.5 and 2.5; ' || CASE WHEN size = 0 THEN 'nothing vouches for it' WHEN size < 3 THEN 'only ' || size || ' of its folder could vouch for it' ELSE 'its folder does not agree (40%)' END END AS band_reason,
  round_even(score * 100, 0)::INT || '% of the lines match, but ' || CASE WHEN size = 0 THEN 'the first 2:00' ELSE '2:00-4:00 and 1:00:00-1:02:00' END || ' wants to move by ' || CASE WHEN id % 2 = 0 THEN '+4.5' ELSE '-4.5' END || ' s: ' ||
  (['a break that the video lacks', 'a clock that runs at another rate', 'a stretch of another cut'])[id % 3 + 1] AS stretch_reason FROM f""")
def refusal_reasons(spark, d):
    k = F.col("o_orderkey")
    score, size = (k % 100) / 100.0, F.when(k % 5 > 0, k % 5)
    two = lambda a, b: F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi"))
    spans = F.when(k % 5 == 0, F.array(two(0.0, 120.0))).otherwise(F.array(two(120.0, 240.0), two(3600.0, 3720.0)))
    shape = F.element_at(F.array(F.lit("cut"), F.lit("drift"), F.lit("local")), (k % 3 + 1).cast("int"))
    band = F.when(score * 4 < 1.5, "refuse").otherwise("escalate")
    return table(spark, d, "orders").select(
        k.alias("id"), report.band_reason(score, score * 4, band, size, F.lit(0.4)).alias("band_reason"), report.stretch_reason(score, spans, F.when(k % 2 == 0, 4.5).otherwise(-4.5), shape).alias("stretch_reason")
    )


@query("""WITH t AS (SELECT o_orderkey AS id, o_orderkey % 6 AS form FROM orders)
SELECT id, CASE form WHEN 4 THEN 'episode-less' WHEN 5 THEN 'episode-less' ELSE 'resolved' END AS parsed, CASE WHEN id % 9 = 0 THEN 'empty' WHEN id % 4 = 0 AND form < 4 THEN 'contaminated' ELSE 'clean' END AS title FROM t""")
def name_gates(spark, d):
    """How names were parsed and whether a title still has the episode's marker, put there for every fourth."""
    n = made_names(spark, d)
    p = n.join(n.select("name").distinct().withColumn("p", names.parse_names(F.col("name"))), "name").select("id", "p.*")
    marked = F.when((F.col("id") % 4 == 0) & F.col("episode").isNotNull(), F.concat("title", F.lit(" E"), F.col("episode").cast("int").cast("string"))).otherwise(F.col("title"))
    key = F.when(F.col("id") % 9 == 0, "").otherwise("k")
    return p.select("id", report.parse_state(F.col("kind"), F.col("episode"), F.lit(0)).alias("parsed"), report.title_state(key, marked, F.col("episode"), F.col("episode_end")).alias("title"))


@query(f"""WITH {VIDEOS}, {SUBTITLES},
p AS (SELECT v.season AS vs, v.episode AS ve, s.season AS ss, s.episode AS se, CASE WHEN v.title = s.title THEN 'same' ELSE 'different' END AS identity FROM videos v JOIN subtitles s ON v.id = s.id),
x AS (SELECT 'episode' AS measure, CASE WHEN ve = se AND vs IS NOT DISTINCT FROM ss THEN 'agree' WHEN ve = se THEN 'season differs' ELSE 'disagree' END AS value FROM p UNION ALL SELECT 'identity', identity FROM p)
SELECT measure, value, count(*) AS n FROM x GROUP BY 1, 2""")
def pairing_recall(spark, d):
    v, s = inputs.videos(spark, d), inputs.subtitles(spark, d)
    j = v.select("id", F.col("title").alias("vt"), F.col("season").alias("v_season"), F.col("episode").alias("v_episode")).join(s.select("id", F.col("title").alias("st"), F.col("season").alias("s_season"), F.col("episode").alias("s_episode")), "id")
    return report.pairing_recall(j.withColumn("identity", F.when(F.col("vt") == F.col("st"), "same").otherwise("different")))


@query(f"""WITH {MOMENTS},
s AS (SELECT DISTINCT pair_id, (pair_id * 40)::DOUBLE AS lo, pair_id * 40e0 + pair_id * 8e0 AS hi FROM moments)
SELECT m.pair_id, side, t, t BETWEEN lo AND hi AS open FROM moments m JOIN s ON m.pair_id = s.pair_id""")
def undetermined_moments(spark, d):
    p = F.col("pair_id")
    gaps = F.array(F.struct((p * 40.0).alias("lo"), (p * 48.0).alias("hi")))
    return inputs.moments(spark, d).select("pair_id", "side", "t", align.undetermined(F.col("t"), gaps).alias("open"))


@query(f"""WITH {MOMENTS},
h AS (SELECT s.pair_id, s.t, EXISTS (SELECT 1 FROM moments r WHERE r.pair_id = s.pair_id AND r.side = 0 AND abs(r.t - s.t) <= 4e0) AS hit FROM moments s WHERE s.side = 1),
w AS (SELECT *, CASE WHEN NOT hit AND coalesce(lag(hit) OVER (PARTITION BY pair_id ORDER BY t), true) THEN 1 ELSE 0 END AS new FROM h),
i AS (SELECT *, sum(new) OVER (PARTITION BY pair_id ORDER BY t) AS run FROM w),
r AS (SELECT pair_id, max(t) - min(t) AS span, count(*) AS lines FROM i WHERE NOT hit GROUP BY pair_id, run),
g AS (SELECT pair_id, max(span) AS longest, sum(lines)::BIGINT AS unchecked FROM r GROUP BY pair_id),
f AS (SELECT DISTINCT pair_id, (['locked', 'strong', 'uncertain'])[pair_id % 3 + 1] AS word FROM moments)
SELECT f.pair_id, CASE WHEN longest >= 8e0 THEN 'REFUSED' ELSE 'CONFIDENT' END AS outcome, CASE WHEN longest >= 8e0 THEN NULL WHEN longest IS NOT NULL AND word IN ('locked', 'strong') THEN 'fair' ELSE word END AS word,
       coalesce(unchecked, 0) AS unchecked FROM f LEFT JOIN g ON f.pair_id = g.pair_id""")
def aligned_to_file(spark, d):
    """Verdicts of files aligned to another file, after the stretches that it leaves unchecked."""
    r, a = inputs.sides(spark, d)
    word = F.element_at(F.array(F.lit("locked"), F.lit("strong"), F.lit("uncertain")), (F.col("pair_id") % 3 + 1).cast("int"))
    f = inputs.moments(spark, d).select("pair_id").distinct().select("pair_id", F.lit("CONFIDENT").alias("outcome"), word.alias("word"))
    return align.checked(f, align.unchecked_runs(r, a, ["pair_id"], 4.0), ["pair_id"], 8.0).select("pair_id", "outcome", "word", "unchecked")


@query("""WITH x AS (SELECT o_orderkey AS id, (o_orderkey % 50) / 10e0 AS excess, (['CONFIDENT', 'REFUSED', 'ERROR'])[o_orderkey % 3 + 1] AS outcome FROM orders)
SELECT id, CASE WHEN excess >= 22e-1 THEN 'accept' WHEN excess < 2 THEN 'refuse' ELSE 'escalate' END AS band, CASE outcome WHEN 'CONFIDENT' THEN 'write' WHEN 'REFUSED' THEN 'write_forced' ELSE 'fault' END AS forced,
       CASE outcome WHEN 'CONFIDENT' THEN 'write' WHEN 'REFUSED' THEN 'refuse' ELSE 'fault' END AS plain FROM x""")
def decisions(spark, d):
    k = F.col("o_orderkey")
    outcome = F.element_at(F.array(F.lit("CONFIDENT"), F.lit("REFUSED"), F.lit("ERROR")), (k % 3 + 1).cast("int"))
    return table(spark, d, "orders").select(k.alias("id"), verdict.speech_band((k % 50) / 10.0).alias("band"), verdict.decide(outcome, True).alias("forced"), verdict.decide(outcome).alias("plain"))


@query("""WITH n AS (SELECT s_suppkey AS id, s_suppkey % 6 AS k FROM supplier)
SELECT id, CASE k WHEN 0 THEN 2009 WHEN 1 THEN 2011 WHEN 2 THEN 2015 END::INT AS year, CASE k WHEN 3 THEN 'extended cut' ELSE '' END AS edition, CASE k WHEN 4 THEN 'episode' WHEN 5 THEN 'creditless' END AS refusal,
       CASE k WHEN 0 THEN 'harbor' WHEN 1 THEN 'blueharbor' WHEN 2 THEN 'harbor2' WHEN 3 THEN 'harborcut' END AS key FROM n""")
def film_names(spark, d):
    forms = ("The.Harbor.2009.1080p.BluRay.x264-GRP.mkv", "[Grp] Blue Harbor (2011) [720p].mkv", "Harbor 2 (2015).en.srt", "Harbor.Extended.Cut.mkv", "Harbor S01E02.mkv", "Harbor NCOP1.mkv")
    n = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.element_at(F.array(*map(F.lit, forms)), (F.col("s_suppkey") % 6 + 1).cast("int")).alias("name"))
    f = n.select("name").distinct().withColumn("f", names.read_films(F.col("name"), tags=frozenset({"en", "ja"})))
    return n.join(f, "name").select("id", "f.year", "f.edition", "f.refusal", F.when(F.col("f.refusal").isNull(), text.title_key(F.col("f.title"))).alias("key"))


@query("""WITH e AS (SELECT event_type, time_bucket(INTERVAL 2 MINUTES, ts, TIMESTAMP '1970-01-01') AS t0 FROM events WHERE ts IS NOT NULL)
SELECT event_type, strftime(t0, '%Y-%m-%d %H:%M:%S') AS t0, count(*) AS n FROM e GROUP BY 1, 2""")
def stream_buckets(spark, d):
    """The streaming operator's buckets, over the table as it stands."""
    e = table(spark, d, "events").where("ts is not null").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return windows.bucket_counts(e, ["event_type"]).select("event_type", F.date_format("t0", "yyyy-MM-dd HH:mm:ss").alias("t0"), "n")


@query("""WITH r AS (SELECT c_custkey AS entity, c_custkey % 3 AS k FROM customer)
SELECT 'harbor' || (entity % 200) AS key, entity FROM r WHERE k = 0 UNION ALL SELECT '海' || (entity % 200) AS key, entity FROM r WHERE k = 0""")
def alias_table(spark, d):
    """Entities named in both scripts; those in one are left out, older records too."""
    c, i = F.col("c_custkey"), (F.col("c_custkey") % 200).cast("string")
    last = F.array(F.when(c % 3 != 1, F.concat(F.lit("Harbor "), i)), F.when(c % 3 != 2, F.concat(F.lit("海"), i)))
    rec = table(spark, d, "customer").select(c.alias("entity"), F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.array(F.lit("Old name"), F.lit("古")).alias("names")), F.struct(F.lit(2).alias("seq"), last.alias("names")))).alias("r"))
    rows = rec.select("entity", "r.seq", F.explode("r.names").alias("name")).where("name is not null")
    return agreement.entity_names(rows)


@query("""WITH s AS (SELECT s_suppkey AS id, s_suppkey // 20 AS g, s_suppkey % 20 // 2 + 1 AS e FROM supplier)
SELECT '/v/Harbor' || id || ' (2009).mkv' AS video, '/s/Harbor' || id || '.2009.en.srt' AS subtitle, false AS speculative FROM s WHERE id % 2 = 0
UNION ALL SELECT '/v/Tale' || g || ' S01E' || e || '.mkv', '/s/Tale' || g || ' S01E' || (e + 12) || '.srt', true FROM s WHERE id % 2 = 1""")
def run_candidates(spark, d):
    """Candidates of a whole run over films and over series whose cue files count on from another season."""
    from . import run

    k = F.col("s_suppkey")
    g, e = F.floor(k / 20).cast("string"), F.floor(k % 20 / 2) + 1
    film = k % 2 == 0
    video = F.when(film, F.concat(F.lit("/v/Harbor"), k.cast("string"), F.lit(" (2009).mkv"))).otherwise(F.concat(F.lit("/v/Tale"), g, F.lit(" S01E"), e.cast("string"), F.lit(".mkv")))
    cue = F.when(film, F.concat(F.lit("/s/Harbor"), k.cast("string"), F.lit(".2009.en.srt"))).otherwise(F.concat(F.lit("/s/Tale"), g, F.lit(" S01E"), (e + 12).cast("string"), F.lit(".srt")))
    s = table(spark, d, "supplier")
    items = s.select(video.alias("path"), F.lit("video").alias("kind")).union(s.select(cue.alias("path"), F.lit("subtitle").alias("kind")))
    items = items.withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    return run.edges(run.stored(run.parsed(items, {"en": "en", "ja": "ja"}))).select("video", "subtitle", "speculative")


@query(f"""WITH {MOMENTS}, o AS (SELECT pair_id, side, list_sort(list(round(t - 29e-2, 6))) AS starts FROM moments GROUP BY pair_id, side)
SELECT pair_id, side, len(starts) AS n, starts[1] AS first, starts[-1] AS last FROM o WHERE len(starts) >= 10""")
def speech_references(spark, d):
    s = align.speech_reference(inputs.moments(spark, d), ["pair_id", "side"], least=10)
    return s.select("pair_id", "side", F.size("starts").cast("long").alias("n"), F.round(F.element_at("starts", 1), 6).alias("first"), F.round(F.element_at("starts", -1), 6).alias("last"))


@query("""WITH w AS (SELECT o_orderkey AS k FROM orders), r AS (SELECT l_orderkey AS k, bool_or(l_linenumber % 2 = 0) AS fresh FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY 1)
SELECT count(*) FILTER (fresh) AS hits, count(*) FILTER (NOT fresh) AS stale, count(*) FILTER (fresh IS NULL) AS misses, count(*) FILTER (fresh)::DOUBLE / count(*) AS hit_rate FROM w LEFT JOIN r ON w.k = r.k""")
def record_hits(spark, d):
    """Lookups of all orders among the records of lines; a third of the orders has none, odd lines are of an older version."""
    w = table(spark, d, "orders").select(F.col("o_orderkey").alias("output_digest"))
    rec = table(spark, d, "lineitem").where("l_orderkey % 3 > 0")  # the rest was never recorded
    rec = rec.select(F.col("l_orderkey").alias("output_digest"), F.when(F.col("l_linenumber") % 2 == 0, state.VERSION).otherwise(1).alias("version"))
    return state.hit_statistics(w, rec)


@query("""SELECT o_orderkey AS seq FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')""")
def undecided_pairs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"))
    return state.undecided(o, table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("seq")))
