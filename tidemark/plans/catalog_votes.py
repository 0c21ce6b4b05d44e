"""Readings of names that vote, and files compared with what was made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import census, opinions
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


_SIZES = ", ".join(map(str, sorted(names.RESOLUTIONS)))
_UNLIKELY = ", ".join(map(str, sorted({*names.RESOLUTIONS, *names.CODEC_NUMBERS})))


@query(f"""WITH x AS (SELECT o_orderkey AS k, o_custkey AS dir, o_orderkey % 13 + 1 AS a, o_orderkey % 29 + 1 AS b, CASE WHEN o_orderkey % 17 = 0 THEN 'batch' ELSE 'episode' END AS kind FROM orders),
v AS (SELECT *, CASE WHEN k % 5 > 0 THEN b END AS own, [a, b, k] AS numbers FROM x),
s AS (SELECT dir, slot, count(*) AS n, count(DISTINCT v) AS kinds, min(v) AS lo, max(v) AS hi, bool_and(v IN ({_SIZES})) AS sizes, bool_or(v IN ({_SIZES})) AS size, bool_and(v BETWEEN 1900 AND 2100) AS years
      FROM (SELECT dir, unnest([0, 1, 2]) AS slot, unnest(numbers) AS v FROM v) GROUP BY dir, slot HAVING count(*) >= 3),
c AS (SELECT dir, slot, 5e-1 * (kinds::DOUBLE / n) + 5e-1 * kinds::DOUBLE / (hi - lo + 1) - CASE WHEN size THEN 4e-1 ELSE 0e0 END - CASE WHEN years THEN 6e-1 ELSE 0e0 END AS score
      FROM s WHERE kinds::DOUBLE / n >= 5e-1 AND hi <= 2000 AND NOT sizes),
t AS (SELECT dir, slot FROM c WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, slot) = 1 AND score >= 5e-1),
d AS (SELECT v.*, numbers[slot + 1] AS scheme, coalesce(numbers[slot + 1] <> own, false) AS disputed FROM v LEFT JOIN t ON v.dir = t.dir),
q AS (SELECT *, (own IS NULL OR disputed) AND kind <> 'batch' AS asked FROM d),
r AS (SELECT *, asked AND k % 3 < 2 AS one, asked AND k % 4 < 3 AS two, CASE WHEN k % 2 = 0 THEN a ELSE b END AS e1, CASE WHEN k % 6 > 0 THEN a END AS e2 FROM q),
w AS (SELECT *, one::INT + two::INT AS m, CASE WHEN kind = 'batch' THEN [] ELSE list_filter([own, CASE WHEN one AND e1 NOT IN ({_UNLIKELY}) THEN e1 END, CASE WHEN two AND e2 NOT IN ({_UNLIKELY}) THEN e2 END, CASE WHEN disputed THEN scheme END], lambda z: z IS NOT NULL) END AS votes FROM r),
u AS (SELECT *, list_sort(list_distinct(votes)) AS candidates, list_sort(list_transform(list_distinct(votes), lambda z: {{'n': -len(list_filter(votes, lambda y: y = z)), 'e': z}}))[1] AS top FROM w),
z AS (SELECT *, CASE WHEN kind = 'batch' THEN 'agree' WHEN len(votes) = 0 THEN 'none' WHEN own IS NOT NULL AND NOT disputed THEN 'sole' WHEN len(candidates) = 1 THEN CASE WHEN len(votes) = m + 1 THEN 'agree' ELSE 'partial' END
      WHEN -top.n >= 2 AND -top.n > len(votes) + top.n THEN 'majority' ELSE 'disagree' END AS state FROM u)
SELECT k, state, CASE WHEN state = 'majority' THEN top.e::DOUBLE WHEN len(candidates) = 1 THEN candidates[1]::DOUBLE END AS episode, CASE WHEN one AND k % 7 = 0 THEN 1 END AS season, array_to_string(candidates, ',') AS candidates FROM z""")
def episode_opinions(spark, d):
    """Names of all orders in folders by customer: the name's own reading, the folder's scheme where it dissents, and two more parsers on doubt."""
    k, text = F.col("o_orderkey"), lambda c: c.cast("string")
    a, b = k % 13 + 1, k % 29 + 1
    name = F.concat(F.lit("Tale "), text(a), F.lit(" - "), text(b), F.lit(" #"), text(k), F.lit(".mkv"))
    path = F.concat(F.lit("/lib/"), text(F.col("o_custkey")), F.lit("/"), name)
    o = table(spark, d, "orders")
    items = o.select(path.alias("path"), name.alias("name"), F.when(k % 17 == 0, "batch").otherwise("episode").alias("kind"), F.when(k % 5 > 0, b).alias("episode"), F.lit(None).cast("int").alias("season"))
    one = o.where(k % 3 < 2).select(path.alias("path"), F.lit("one").alias("parser"), F.when(k % 2 == 0, a).otherwise(b).alias("episode"), F.when(k % 7 == 0, 1).alias("season"))
    two = o.where(k % 4 < 3).select(path.alias("path"), F.lit("two").alias("parser"), F.when(k % 6 > 0, a).alias("episode"), F.lit(None).cast("int").alias("season"))
    out = opinions.settle(items, one.union(two))
    shown = F.array_join(F.transform("candidates", lambda c: c.cast("long").cast("string")), ",")
    return out.select(F.regexp_extract("path", r"#(\d+)\.", 1).cast("long").alias("k"), "state", "episode", "season", shown.alias("candidates"))


DIFFS = """
x AS (SELECT doc_id AS k, coalesce(text, '') AS a, replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '  ', ' '), 'the', 'The') AS b, coalesce(lang, '') AS lang FROM documents WHERE doc_id IS NOT NULL)"""


def _copies(spark, d):
    t = F.coalesce("text", F.lit(""))
    made = F.replace(F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("  "), F.lit(" ")), F.lit("the"), F.lit("The"))
    docs = table(spark, d, "documents").where("doc_id is not null")
    return docs.select(F.col("doc_id").alias("k"), F.encode(t, "utf-8").alias("before"), F.encode(made, "utf-8").alias("after"), F.coalesce("lang", F.lit("")).alias("lang"))


@query(f"""WITH RECURSIVE {DIFFS},
s AS (SELECT k, hex(encode(a)) AS a, hex(encode(b)) AS b FROM x WHERE a <> b),
-- halving: the longest common beginning in hex digits, cut to whole bytes
h AS (SELECT k, a, b, 0 AS lo, least(length(a), length(b)) AS hi FROM s
      UNION ALL SELECT k, a, b, CASE WHEN substr(a, lo + 1, (hi - lo + 1) // 2) = substr(b, lo + 1, (hi - lo + 1) // 2) THEN lo + (hi - lo + 1) // 2 ELSE lo END,
      CASE WHEN substr(a, lo + 1, (hi - lo + 1) // 2) = substr(b, lo + 1, (hi - lo + 1) // 2) THEN hi ELSE lo + (hi - lo + 1) // 2 - 1 END FROM h WHERE lo < hi)
SELECT x.k, octet_length(encode(x.a)) AS before_bytes, octet_length(encode(x.b)) AS after_bytes,
CASE WHEN h.k IS NULL THEN 'same' WHEN lo // 2 = least(length(h.a), length(h.b)) // 2 THEN 'beginning' WHEN length(h.a) = length(h.b) THEN 'changed' ELSE 'changed and resized' END AS kind,
lo // 2 AS at, lower(substr(h.a, lo // 2 * 2 + 1, 16)) AS was, lower(substr(h.b, lo // 2 * 2 + 1, 16)) AS is_now
FROM x LEFT JOIN h ON x.k = h.k AND lo = hi""")
def byte_differences(spark, d):
    """Every text against an edited one: the first byte where they part, and what stands there."""
    x = census.compare(_copies(spark, d), "before", "after")
    hexed = lambda c: F.lower(F.hex(c))
    return x.select("k", "before_bytes", "after_bytes", "kind", "at", hexed("was").alias("was"), hexed("is_now").alias("is_now"))


@query(f"""WITH {DIFFS},
o AS (SELECT k, lang, CASE WHEN a = '' THEN 'empty' WHEN k % 31 = 0 THEN 'error' WHEN a = b THEN 'identical' ELSE 'mismatch' END AS outcome FROM x),
g AS (SELECT lang, count(*) AS files, count(*) FILTER (outcome = 'identical') AS identical, count(*) FILTER (outcome = 'mismatch') AS mismatches, count(*) FILTER (outcome = 'empty') AS empties, count(*) FILTER (outcome = 'error') AS errors FROM o GROUP BY lang),
b AS (SELECT coalesce(lang, '') AS lang, round(count(*) FILTER (doc_id % 2 = 0) / count(*)::DOUBLE, 6) AS rate FROM documents WHERE doc_id IS NOT NULL AND coalesce(lang, '') <> 'de' GROUP BY 1)
SELECT g.*, round(identical / files::DOUBLE, 6) AS rate, b.rate AS baseline, CASE WHEN b.rate IS NULL THEN 'new' WHEN round(identical / files::DOUBLE, 6) < b.rate - 2e-2 THEN 'worse' WHEN round(identical / files::DOUBLE, 6) > b.rate + 2e-2 THEN 'better' ELSE 'level' END AS verdict
FROM g LEFT JOIN b ON g.lang = b.lang""")
def round_trip_census(spark, d):
    """Shares of texts that came back byte for byte, by language, against a stored baseline."""
    k = F.col("k")
    x = census.compare(_copies(spark, d), "before", "after")
    read = F.when(F.col("before_bytes") == 0, "empty").when(k % 31 == 0, "error").otherwise("read")
    seen = census.outcomes(x.withColumn("status", read))
    base = table(spark, d, "documents").where("doc_id is not null").groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.round(F.count_if(F.col("doc_id") % 2 == 0) / F.count("*"), 6).alias("rate"))
    return census.against(census.rates(seen, ["lang"]), base.where("lang <> 'de'"), ["lang"], 0.02)
