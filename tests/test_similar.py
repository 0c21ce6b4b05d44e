import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import pairing
from tidemark.plans import run


@pytest.mark.parametrize("least", [0.2, 0.4, 0.5, 0.8, 1.0])
def test_similar_sets_equal_all_pairs(spark, least):
    rng = random.Random(3)
    pick = lambda: sorted({rng.choice("abcdefghij") if rng.random() < 0.7 else rng.choice("klmnopqrstuvwxyz") for _ in range(rng.randint(0, 9))})
    a, b = [(i, pick()) for i in range(80)], [(100 + i, pick()) for i in range(90)]
    a += [(0, a[0][1]), (90, [])]
    df = [spark.createDataFrame(x, "id long, grams array<string>") for x in (a, b)]
    got = {(r["a"], r["b"]): r["jaccard"] for r in pairing.similar(*df, least).collect()}
    want = {}
    for i, x in a:
        for j, y in b:
            n, m = len({*x} & {*y}), len({*x} | {*y})
            if n and n / m >= least:
                want[i, j] = n / m
    assert got == want and (least > 0.8 or want)
    assert pairing.similar(df[0].where("false"), df[1], least).count() == 0


def test_likely_pairs_lose_none_that_is_not_surely_different(spark):
    rng = random.Random(8)
    titles = ["Blue Harbor", "BlueHarbor", "Blu Harbor", "Harbor Blue", "Quiet Tide", "Quiet Tides", "青い港", "青い Harbor", "", "Zz", "A", "Night of the Long Tide"]
    rows = [(f"/{k}/{i}", k, rng.choice(titles), rng.choice([None, 1, 2]), rng.randint(1, 4)) for k in ("video", "subtitle") for i in range(70)]
    x = spark.createDataFrame(rows, "path string, kind string, title string, season int, episode int")
    items = x.withColumn("key", text.title_key(F.col("title"))).withColumn("tokens", text.title_tokens(F.col("title"))).withColumn("signature", text.signature_of(F.col("title"))).withColumn("script", text.script_of(F.col("title"))).cache()
    alias = spark.createDataFrame([("zz", 1), ("blueharbor", 1)], "key string, entity int")

    def kept(pairs):
        known = lambda side: items.select(F.col("path").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("key", "tokens", "signature", "script")])
        p = pairs.select("video", "subtitle").distinct().join(known("video"), "video").join(known("subtitle"), "subtitle")
        score = text.title_similarity(*[F.col(c) for c in ("video_key", "subtitle_key", "video_tokens", "subtitle_tokens")])
        bridged = F.least("video_key", "subtitle_key").isin("blueharbor") & F.greatest("video_key", "subtitle_key").isin("zz")
        same = text.series_identity(score, *[F.col(f"{s}_{c}") for c in ("key", "signature", "script") for s in ("video", "subtitle")], bridged)
        same = F.when((F.col("video_key") == "") | (F.col("subtitle_key") == ""), "unsure").otherwise(same)
        return {(r["video"], r["subtitle"]) for r in p.where(same != "different").collect()}

    every = pairing.block(items.where("kind = 'video'"), items.where("kind = 'subtitle'"))
    few = run.likely(items, alias)
    assert kept(few) == kept(every) and few.count() < every.count()


def test_titles_whose_files_share_no_episode_are_not_compared(spark, monkeypatch):
    # films have no episode, the second series' numberings never meet
    rows = [(f"/{k}/{t}{n}", k, t, None, e) for k in ("video", "subtitle") for n in range(3) for t, e in (("Harbor One", None), ("Tide", float(n)), ("Tale", n + 10.0 * (k == "video") + 20))]
    x = spark.createDataFrame(rows, "path string, kind string, title string, season int, episode double").withColumn("candidates", F.when(F.col("episode").isNull(), F.array().cast("array<double>")).otherwise(F.array("episode")))
    items = x.withColumn("key", text.title_key(F.col("title"))).withColumn("tokens", text.title_tokens(F.col("title"))).withColumn("signature", text.signature_of(F.col("title"))).withColumn("script", text.script_of(F.col("title"))).cache()
    seen, compare = [], run.likely_titles
    monkeypatch.setattr(run, "likely_titles", lambda some, alias=None: seen.append({r["key"] for r in some.select("key").distinct().collect()}) or compare(some, alias))
    got = {(r["video"], r["subtitle"]) for r in run.likely(items).collect()}
    assert seen == [{"tide"}] and got == {(f"/video/Tide{n}", f"/subtitle/Tide{n}") for n in range(3)}
