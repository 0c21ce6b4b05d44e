"""What a run tells: counts, reasons, lines for people, and gates on names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import clock
from .verdict import noise_floor

#: Outcomes, and marks of an episode number in a title.
OUTCOMES = ("CONFIDENT", "REFUSED", "ERROR")
TITLE_MARKS = (r"(?i)\bs\d{1,3}\s*e(\d{1,4})\b", r"(?i)(?:^|[^a-z0-9])e(?:p|pisode)?\s*(\d{1,4})\b", r"[#＃]\s*(\d{1,4})", r"第\s*(\d{1,4})\s*[話回]")


def run_counts(results: DataFrame) -> DataFrame:
    """One row of counts: outcome, segments (count), landed, write_failed, forced, superseded (count)."""
    is_ = lambda o: F.coalesce(F.col("outcome") == o, F.lit(False))
    cut = is_("CONFIDENT") & (F.col("segments") > 1)
    return results.agg(
        F.count_if(is_("CONFIDENT") & ~cut).alias("clean"), F.count_if(cut).alias("cut"), F.count_if(is_("REFUSED")).alias("refused"), F.count_if(is_("ERROR")).alias("errored"),
        F.count_if(~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False))).alias("unknown"), F.count_if(is_("CONFIDENT")).alias("confident"), F.count_if("landed").alias("landed"),
        F.count_if("write_failed").alias("write_failed"), F.count_if("forced").alias("forced"), F.coalesce(F.sum("superseded"), F.lit(0)).alias("superseded"),
    )


def chance_reason(score: Column, chance: Column, n: Column) -> Column:
    """Why a match at chance level is refused."""
    return F.format_string(
        "%d%% of the lines match, %.1f times chance; over %d cues the best of many offsets reaches %.1f times by luck",
        F.bround(score * 100, 0).cast("int"), F.when(chance > 0, score / chance).otherwise(0.0), n.cast("int"), F.when(chance > 0, noise_floor(chance, n) / chance).otherwise(0.0),
    )


def stretch_reason(score: Column, stretches: Column, jump: Column, shape: Column) -> Column:
    """Why a fit that fails somewhere is refused; ``stretches``: array<struct<lo,hi>>."""
    spans = F.array_join(F.transform(stretches, lambda s: F.concat(clock(s["lo"]), F.lit("-"), clock(s["hi"]))), " and ")
    first = F.element_at(stretches, 1)
    where = F.when((F.size(stretches) == 1) & (first["lo"] <= 0), F.concat(F.lit("the first "), clock(first["hi"]))).otherwise(spans)
    cause = F.when(shape == "cut", "a break that the video lacks").when(shape == "drift", "a clock that runs at another rate").otherwise("a stretch of another cut")
    return F.format_string("%d%% of the lines match, but %s wants to move by %+.1f s: %s", F.bround(score * 100, 0).cast("int"), where, jump, cause)


def band_reason(score: Column, excess: Column, band: Column, size: Column, coherence: Column, accept_at: float = 2.5, refuse_below: float = 1.5, least: int = 3) -> Column:
    """Why the band refuses or leaves open."""
    seen = F.format_string("%d%% of the lines match, %.1f times chance", F.bround(score * 100, 0).cast("int"), excess)
    alone = F.when(size.isNull(), "nothing vouches for it").when(size < least, F.format_string("only %d of its folder could vouch for it", size.cast("int")))
    other = alone.otherwise(F.format_string("its folder does not agree (%d%%)", F.bround(coherence * 100, 0).cast("int")))
    return F.when(band == "refuse", F.concat(seen, F.lit(f", below {refuse_below}"))).otherwise(F.concat(seen, F.lit(f", between {refuse_below} and {accept_at}; "), other))


def witness_reason(scored: Column, hits: Column, better: Column) -> Column:
    return F.when(better > 0, F.format_string("%d windows fit better elsewhere", better.cast("int"))).otherwise(F.format_string("%d of %d windows say what is written", hits.cast("int"), scored.cast("int")))


def report_lines(results: DataFrame) -> DataFrame:
    """``line``, with ``place``: what needs attention first, then by video and subtitle."""
    rank = F.when(F.col("outcome") == "ERROR", 0).when(F.col("outcome") == "REFUSED", 1).when(F.col("segments") > 1, 2).otherwise(3)
    name = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    line = F.concat_ws("  ", F.rpad(F.lower("outcome"), 9, " "), name("subtitle"), F.lit("->"), name("video"), F.coalesce("word", "reason"))
    return results.select(rank.alias("attention"), "video", "subtitle", line.alias("line"))


def title_state(key: Column, title: Column, episode: Column, episode_end: Column) -> Column:
    """empty, contaminated by a marker that has the episode's own number, or clean."""
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all(title, F.lit(p), F.lit(1)), lambda x: x.cast("double")) for p in TITLE_MARKS]))
    hit = F.exists(found, lambda x: (x == episode) | F.coalesce(x == episode_end, F.lit(False)))
    return F.when(F.coalesce(key, F.lit("")) == "", "empty").when(episode.isNotNull() & F.coalesce(hit, F.lit(False)), "contaminated").otherwise("clean")


def parse_state(kind: Column, episode: Column, candidates: Column) -> Column:
    """resolved, arbitrate (several opinions), episode-less or missed."""
    return (
        F.when((kind == "episode") & episode.isNotNull(), "resolved").when(F.coalesce(candidates, F.lit(0)) > 0, "arbitrate")
        .when(kind.isin("film", "batch", "conjunction"), "episode-less").otherwise("missed")
    )


def pairing_recall(pairs: DataFrame) -> DataFrame:
    """``measure, value, n`` of known pairs (v_season, v_episode, s_season, s_episode, identity)."""
    v, s = F.col("v_episode"), F.col("s_episode")
    agree = (
        F.when(v.isNull() | s.isNull(), "one side unresolved").when((v == s) & F.col("v_season").eqNullSafe(F.col("s_season")), "agree")
        .when(v == s, "season differs").otherwise("disagree")
    )
    each = pairs.select(F.explode(F.array(F.struct(F.lit("episode").alias("measure"), agree.alias("value")), F.struct(F.lit("identity").alias("measure"), F.col("identity").alias("value")))).alias("x"))
    return each.groupBy("x.measure", "x.value").agg(F.count("*").alias("n"))


def read_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of NDJSON (value) as ``row``, and ``fault`` where a line is none."""
    row = F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    r = lines.where(F.trim("value") != "").select(row.alias("row"))
    return r.select("row", F.when(F.col("row").isNull() | F.col("row._corrupt").isNotNull(), "no JSON object").alias("fault"))
