"""What several readings of a name come to: the parser's, the folder's and those of other parsers.

The folder's scheme is inferred from its names alone, so it is a second opinion
that costs one pass; it votes where it dissents and never swells a majority.
Others are asked where the name itself gives no episode or the folder dissents.
All proposals stay as ``candidates``, so that timing can decide what names can't.

Defined results: a conjunction or a batch is settled as no episode, whatever
others say; null episodes are no votes; folders of fewer than three names of one
shape have no scheme; repeated rows of one path are one name; others' rows for
unknown paths are left out; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from . import agreement

REFUSED = ("conjunction", "batch")


def folder_episodes(items: DataFrame, least: float = 0.5) -> DataFrame:
    """``path, scheme_episode`` (null where the folder's scheme doesn't tell) of items ``path, name``."""
    n = items.select("path", F.regexp_extract("path", "^(.*)/", 1).alias("__dir"), names.shape(F.col("name")).alias("x")).select("path", "__dir", "x.shape", "x.numbers")
    schemes = agreement.infer_slots(n, ["__dir"], names.RESOLUTIONS)
    return agreement.scheme_episodes(n, schemes, ["__dir"], least).select("path", F.col("scheme_episode").cast("double").alias("scheme_episode"))


def settle(items: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """``path, state, episode, season, candidates`` of items ``path, name, kind, episode, season`` (kind as the parser's).

    ``others``: (path, parser, episode, season) of further parsers.
    States are sole, agree, partial, majority, disagree and none; of two readings
    that differ, neither is the episode.
    """
    x = items.select("path", "name", "kind", F.col("episode").cast("double").alias("episode"), "season").dropDuplicates(["path"])
    x = x.join(folder_episodes(x), "path", "left")
    disputed = F.coalesce(F.col("scheme_episode") != F.col("episode"), F.lit(False))
    if others is None:
        x = x.withColumn("answers", F.expr("array()").cast("array<struct<parser:string,episode:double,season:int>>"))
    else:
        one = F.struct("parser", F.col("episode").cast("double").alias("episode"), F.col("season").cast("int").alias("season"))
        x = x.join(others.dropDuplicates(["path", "parser"]).groupBy("path").agg(F.array_sort(F.collect_list(one)).alias("answers")), "path", "left")
    asked = F.when((F.col("episode").isNull() | disputed) & ~F.coalesce(F.col("kind"), F.lit("")).isin(*REFUSED), F.coalesce("answers", F.expr("array()"))).otherwise(F.expr("array()"))
    x = x.withColumn("answers", asked)
    plausible = F.transform(F.filter("answers", lambda a: names.is_plausible(a["episode"], F.col("name"))), lambda a: a["episode"])
    votes = F.array_compact(F.concat(F.array("episode"), plausible, F.array(F.when(disputed, F.col("scheme_episode")))))
    x = x.withColumn("votes", F.when(F.coalesce(F.col("kind"), F.lit("")).isin(*REFUSED), F.expr("array()")).otherwise(votes)).withColumn("candidates", F.array_sort(F.array_distinct("votes")))
    n, kinds = F.size("votes"), F.size("candidates")
    counts = F.transform("candidates", lambda c: F.struct(F.size(F.filter("votes", lambda v: v == c)).alias("n"), (-c).alias("first")))
    top = F.array_max(counts)
    major = (top["n"] >= 2) & (top["n"] > n - top["n"])
    state = (
        F.when(F.coalesce(F.col("kind"), F.lit("")).isin(*REFUSED), "agree").when(n == 0, "none").when(F.col("episode").isNotNull() & ~disputed, "sole")
        .when((kinds == 1) & (n == F.size("answers") + 1), "agree").when(kinds == 1, "partial").when(major, "majority").otherwise("disagree")
    )
    episode = F.when(state == "majority", -top["first"]).when(kinds == 1, F.get("candidates", F.lit(0)))
    season = F.coalesce("season", F.get(F.filter(F.transform("answers", lambda a: a["season"]), lambda s: s.isNotNull()), F.lit(0)))
    return x.select("path", state.alias("state"), episode.alias("episode"), season.alias("season"), "candidates")
