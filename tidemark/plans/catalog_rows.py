"""Rows of results and refusals, keys of names, tables read from files, encodings, keys of contents, windows, blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scratch
from ..functions import times
from ..operators import agreement, outcomes, state, witness
from ..sources import formats, tables
from . import inputs
from .inputs import LINES, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


DECIDED = """
c AS (SELECT 'v' || l_orderkey AS video, CASE l_suppkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS lang, 's' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS subtitle,
  CASE WHEN l_partkey % 7 = 0 THEN 'write' WHEN l_partkey % 11 = 0 THEN 'withheld' ELSE 'refuse' END AS action,
  CASE WHEN l_partkey % 7 = 0 OR l_partkey % 11 = 0 THEN 'CONFIDENT' WHEN l_partkey % 13 > 0 THEN 'REFUSED' END AS outcome,
  l_linenumber AS rank, CASE WHEN l_partkey % 2 = 0 THEN 'at chance' END AS reason, l_discount AS score, l_quantity AS excess FROM lineitem),
d AS (SELECT *, coalesce(lang, 'und') AS code, count(*) OVER (PARTITION BY video, coalesce(lang, 'und')) AS n, count(*) FILTER (action = 'write') OVER (PARTITION BY video, coalesce(lang, 'und')) AS w,
  row_number() OVER (PARTITION BY video, coalesce(lang, 'und') ORDER BY action <> 'withheld', rank, subtitle) AS r FROM c)"""


def decided(spark, d):
    p, s = F.col("l_partkey"), F.col("l_suppkey") % 3
    text = lambda c: F.col(c).cast("string")
    good = (p % 7 == 0) | (p % 11 == 0)
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("v"), text("l_orderkey")).alias("video"), F.when(s == 0, "en").when(s == 1, "de").alias("lang"),
        F.concat(F.lit("s"), F.concat_ws("-", *map(text, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))).alias("subtitle"),
        F.when(p % 7 == 0, "write").when(p % 11 == 0, "withheld").otherwise("refuse").alias("action"), F.when(good, "CONFIDENT").when(p % 13 > 0, "REFUSED").alias("outcome"),
        F.col("l_linenumber").alias("rank"), F.when(p % 2 == 0, "at chance").alias("reason"), F.col("l_discount").alias("score"), F.col("l_quantity").alias("excess"),
    )


@query(f"""WITH {DECIDED}
SELECT video, code AS lang, subtitle, coalesce(outcome, 'ERROR') AS outcome, action = 'withheld' AS withheld, n AS candidates,
  CASE WHEN action = 'withheld' THEN 'not written: ' || subtitle || ' also answers another video, which still has to read it' ELSE coalesce(reason, 'no candidate of ' || n || ' is good enough') END AS reason
FROM d WHERE w = 0 AND r = 1""")
def refusal_rows(spark, d):
    """One row for every slot of all lines that gets no file."""
    return outcomes.refusals(decided(spark, d)).select("video", "lang", "subtitle", "outcome", "withheld", "candidates", "reason")


@query(f"""WITH {DECIDED}
SELECT video, subtitle, code AS lang, coalesce(outcome, 'ERROR') AS outcome, score AS match_rate, excess AS raw_excess, CASE WHEN w > 0 THEN 1 ELSE 0 END AS tried,
  CASE WHEN w > 0 THEN concat_ws(' ', 'dry run, nothing was written', reason) WHEN action = 'withheld' THEN 'not written: ' || subtitle || ' also answers another video, which still has to read it'
       ELSE coalesce(reason, 'no candidate of ' || n || ' is good enough') END AS reason, CASE WHEN w = 0 AND n > 1 THEN 'best of ' || n || ' candidates' ELSE '' END AS notes, 28 AS fields
FROM d WHERE (w > 0 AND action = 'write') OR (w = 0 AND r = 1)""")
def result_rows(spark, d):
    """All fields of every result of a dry run over all lines, of which some are shown."""
    x = outcomes.result_rows(decided(spark, d))
    tried = F.startswith("reason", F.lit("dry run")).cast("int")
    return x.select("video", "subtitle", "lang", "outcome", "match_rate", "raw_excess", tried.alias("tried"), "reason", F.array_join("notes", " ").alias("notes"), F.lit(len(x.columns)).alias("fields"))


@query("""WITH o AS (SELECT 'v' || l_orderkey AS video, CASE l_suppkey % 4 WHEN 0 THEN 'ja' WHEN 1 THEN 'en' WHEN 2 THEN 'de' END AS lang FROM lineitem),
g AS (SELECT video, count(*) AS n, string_agg(DISTINCT coalesce(lang, 'untagged'), ', ' ORDER BY coalesce(lang, 'untagged')) AS others, bool_or(lang IS NULL) AS bare FROM o GROUP BY video HAVING NOT coalesce(bool_or(lang = 'ja'), false)),
v AS (SELECT 'v' || o_orderkey AS video FROM orders)
SELECT v.video, CASE WHEN n IS NULL THEN 'nothing was offered' ELSE 'no ja file among the ' || n || ' offered (' || others || ')' || CASE WHEN bare THEN '; a name without a language is of none' ELSE '' END END AS reason
FROM v LEFT JOIN g ON v.video = g.video WHERE n IS NOT NULL OR v.video NOT IN (SELECT video FROM o)""")
def unpaired_languages(spark, d):
    """Orders without a line of one language, and what others had."""
    k = F.col("l_suppkey") % 4
    o = table(spark, d, "lineitem").select(F.concat(F.lit("v"), F.col("l_orderkey").cast("string")).alias("video"), F.lit("s").alias("subtitle"), F.when(k == 0, "ja").when(k == 1, "en").when(k == 2, "de").alias("lang"))
    v = table(spark, d, "orders").select(F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("video"))
    return outcomes.unpaired_in(v, o, "ja")


#: Syllables that stand for digits in both scripts.
KANA, LATIN = "ナルトカキミサモリヤ", ("na", "ru", "to", "ka", "ki", "mi", "sa", "mo", "ri", "ya")


def _latin_sql(c: str) -> str:
    for i, x in enumerate(LATIN):
        c = f"replace({c}, '{i}', '{x}')"
    return c


@query(f"""WITH p AS (SELECT p_partkey AS k, translate(p_partkey::VARCHAR, '0123456789', '{KANA}') AS kana, {_latin_sql("p_partkey::VARCHAR")} AS latin, p_partkey % 3 AS how FROM part),
n AS (SELECT k, how, kana, latin, CASE how WHEN 0 THEN latin || ' -' || kana || '-' WHEN 1 THEN latin || 'sa -' || kana || '-' ELSE latin || ' -' || kana || '- 疾風伝' END AS label,
  CASE how WHEN 1 THEN latin || 'sa' ELSE latin END || kana || CASE how WHEN 2 THEN '疾風伝' ELSE '' END AS whole FROM p)
SELECT label, whole AS key FROM n UNION SELECT label, latin FROM n WHERE how = 0 UNION SELECT label, kana FROM n WHERE how = 0""")
def name_labels(spark, d):
    """Keys of a label of every part: of its halves too where it is one title in two scripts."""
    n = F.col("p_partkey").cast("string")
    latin = n
    for i, x in enumerate(LATIN):
        latin = F.replace(latin, F.lit(str(i)), F.lit(x))
    kana, how = F.translate(n, "0123456789", KANA), F.col("p_partkey") % 3
    end = F.concat(F.lit(" -"), kana, F.lit("-"))
    label = F.when(how == 0, F.concat(latin, end)).when(how == 1, F.concat(latin, F.lit("sa"), end)).otherwise(F.concat(latin, end, F.lit(" 疾風伝")))
    return agreement.name_keys(table(spark, d, "part").select(label.alias("label")), "label").distinct()


CHARSETS = {"UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be", "UTF-32": "utf-32-be", "UTF-8": "utf-8"}


@query("""WITH e(i, codec) AS (VALUES (0, 'utf-16-le'), (1, 'utf-16-be'), (2, 'utf-32-be'), (3, 'utf-8'))
SELECT doc_id AS id, codec AS encoding, md5('1' || chr(10) || '00:00:01,000 --> 00:00:02,000' || chr(10) || text || chr(10)) AS text_md5 FROM documents JOIN e ON e.i = doc_id % 4 WHERE text IS NOT NULL""")
def encodings_without_marks(spark, d):
    """Every text as a cue file in UTF-16, UTF-32 or UTF-8 without a byte-order mark, told apart by its bytes."""
    k = F.col("doc_id")
    said = F.concat(F.lit("1\n00:00:01,000 --> 00:00:02,000\n"), F.col("text"), F.lit("\n"))
    stored = F.coalesce(*[F.when(k % 4 == i, F.encode(said, c)) for i, c in enumerate(CHARSETS)])
    x = formats.read_cue_files(table(spark, d, "documents").where("text is not null and doc_id is not null").select(k.cast("string").alias("path"), stored.alias("content")))
    return x.select(F.col("path").cast("long").alias("id"), "encoding", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query("""WITH b AS (SELECT doc_id AS id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents)
SELECT id, sha256(t) AS whole, CASE WHEN n <= 65536 THEN sha256(encode(n::VARCHAR) || encode(t) || encode(t)) END AS ends FROM b""")
def content_keys(spark, d):
    """Both keys of every text's bytes; the cheap one shown where the ends are the whole."""
    t = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    x = table(spark, d, "documents").select(F.col("doc_id").alias("id"), t.alias("content"))
    return x.select("id", state.full_key(F.col("content")).alias("whole"), F.when(F.octet_length("content") <= 65536, state.content_key(F.col("content"))).alias("ends"))


def _one_file(lines, tag: str) -> str:
    """Lines (n, value) in their order in a folder of one file."""
    spark = lines.sparkSession
    path = scratch.stored(lines.select("n").limit(0), tag).scratch + "-file"
    lines.repartition(1).sortWithinPartitions("n").select("value").write.text(path)
    return path


@query("""SELECT 'key ' || s_suppkey % 40 AS key, s_suppkey::VARCHAR AS entity, 'Name ' || s_suppkey AS name FROM supplier""")
def alias_tables(spark, d):
    """An alias file of all suppliers, written and read: which entities a key has, and their names."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    keys = s.groupBy((k % 40).alias("g")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(k)), lambda x: x.cast("string")), " ").alias("ids"))
    head = keys.select(F.col("g").alias("n"), F.concat(F.lit("key "), F.col("g").cast("string"), F.lit("\t"), "ids").alias("value"))
    mark = s.agg(F.lit(1000).cast("long").alias("n"), F.lit("##").alias("value"))
    tail = s.select((k + 2000).alias("n"), F.concat(k.cast("string"), F.lit("\tName "), k.cast("string")).alias("value"))
    of, names = tables.read_alias(spark, _one_file(head.union(mark).union(tail), "alias"))
    return of.join(names, "entity").select("key", "entity", "name")


@query("""SELECT DISTINCT p_brand AS token FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 7)""")
def vocabularies(spark, d):
    """A vocabulary of all brands, written and read, without those that are protected."""
    p = table(spark, d, "part")
    whole = p.agg(F.lit(0).alias("n"), F.to_json(F.struct(F.collect_set("p_brand").alias("tokens"))).alias("value"))
    return tables.read_vocabulary(spark, _one_file(whole, "vocabulary"), p.where("p_size = 7").select(F.col("p_brand").alias("token")).distinct())


@query("""WITH o AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS seq FROM orders)
SELECT seq::INT AS seq, '/v/' || k AS video, CASE WHEN k % 9 <> 4 THEN '/s/' || k END AS subtitle, CASE WHEN k % 9 = 4 AND k % 2 = 0 THEN 'not a pair' WHEN k % 9 = 4 THEN 'video or subtitle missing' END AS fault FROM o""")
def pair_manifests(spark, d):
    """A manifest of all orders, lists and objects by turns, some without a subtitle, written and read."""
    k = F.col("o_orderkey")
    v, s = F.concat(F.lit("/v/"), k.cast("string")), F.when(k % 9 != 4, F.concat(F.lit("/s/"), k.cast("string")))
    entry = F.when(k % 2 == 0, F.to_json(F.filter(F.array(v, s), lambda x: x.isNotNull()))).otherwise(F.to_json(F.struct(v.alias("video"), s.alias("subtitle"))))
    o = table(spark, d, "orders")
    end = o.agg(F.max(k).alias("end"))
    rows = o.crossJoin(F.broadcast(end)).select(F.lit(1).alias("n"), k.alias("k"), F.concat(entry, F.when(k == F.col("end"), "").otherwise(",")).alias("value"))  # one row on the right
    signs = end.select(F.inline(F.array(*[F.struct(F.lit(n).alias("n"), F.col("end").alias("k"), F.lit(c).alias("value")) for n, c in ((0, "["), (2, "]"))])))
    path = scratch.stored(end.limit(0), "manifest").scratch + "-lines"
    rows.union(signs).orderBy("n", "k").select("value").write.text(path)
    return tables.read_manifest(spark, path)


@query("""WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 > 0 THEN o_totalprice / 100 - 5 END AS t FROM orders),
s AS (SELECT id, t, unnest(list_distinct(list_concat([0e0], list_concat(list_transform(range(10), lambda i: greatest(0e0, t * (i + 5e-1) / 10 - 30e0 / 2)), [t - 30e0])))) AS first FROM o WHERE t > 30
  UNION ALL SELECT id, t, 0e0 FROM o WHERE t > 0 AND t <= 30)
SELECT id, round(first, 6) AS first FROM s""")
def sampled_windows(spark, d):
    """Where transcript windows start, over running times of all orders."""
    k = F.col("o_orderkey")
    t = F.when(k % 17 > 0, F.col("o_totalprice") / 100 - 5)
    return table(spark, d, "orders").select(k.alias("id"), F.explode(witness.sample_windows(t)).alias("first")).withColumn("first", F.round("first", 6))


@query(f"""WITH {LINES}
SELECT pair_id AS video FROM lines GROUP BY pair_id HAVING count(*) FILTER ("end" - 60 <= 0) + count(*) FILTER (start - 60 >= 7000 + pair_id * 10) > 2""")
def lines_outside(spark, d):
    """Pairs with lines wholly before or after a running time."""
    x = inputs.lines(spark, d).select(F.col("pair_id").alias("video"), (F.col("start") - 60).alias("start"), (F.col("end") - 60).alias("end"), (F.col("pair_id") * 10 + 7000.0).alias("duration"))
    return witness.outside(x).select("video")


@query(f"""WITH {LINES},
u AS (SELECT DISTINCT pair_id, side, start, "end" FROM lines),
i AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY start, "end") AS i FROM u),
l AS (SELECT *, CASE WHEN i % 4 = 1 THEN length(i::VARCHAR) + 5 ELSE 0 END + 35 AS own, CASE WHEN i % 3 = 0 THEN 9 ELSE 0 END AS note FROM i),
p AS (SELECT *, 8 + coalesce(sum(own + note) OVER (PARTITION BY pair_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM l)
SELECT pair_id || '-' || side AS path, i::INT AS idx, place::INT AS block_at, (place + own)::INT AS block_to FROM p""")
def vtt_blocks(spark, d):
    """The extent of every cue in VTT files with names on some cues and notes between others."""
    x = inputs.lines(spark, d).select("pair_id", "side", "start", "end").distinct()
    g = x.groupBy("pair_id", "side").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cues"))
    t = lambda c: times.format_timestamp(c, "vtt")
    name = lambda i: F.when((i + 1) % 4 == 1, F.concat(F.lit("name"), (i + 1).cast("string"), F.lit("\n"))).otherwise("")
    note = lambda i: F.when((i + 1) % 3 == 0, F.lit("NOTE x\n\n\n")).otherwise("")
    body = F.transform("cues", lambda c, i: F.concat(name(i), t(c["start"]), F.lit(" --> "), t(c["end"]), F.lit("\nsay\n\n"), note(i)))
    files = g.select(F.concat_ws("-", F.col("pair_id").cast("string"), F.col("side").cast("string")).alias("path"), F.encode(F.concat(F.lit("WEBVTT\n\n"), F.array_join(body, "")), "UTF-8").alias("content"))
    return formats.read_cue_files(files).select("path", F.inline("cues")).select("path", "idx", "block_at", "block_to")
