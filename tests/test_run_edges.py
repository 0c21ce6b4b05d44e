from pyspark.sql import functions as F

from tidemark.plans import run


def test_titles_without_a_common_token_are_candidates(spark):
    rows = [("/v/BlueHarbor - 01.mkv", "video"), ("/v/とけい - 02.mkv", "video"), ("/s/Blue Harbor - 01.srt", "subtitle"), ("/s/Tokei - 02.srt", "subtitle")]
    items = spark.createDataFrame(rows, "path string, kind string").withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    got = {(r["video"], r["subtitle"]): r["identity"] for r in run.edges(run.stored(run.parsed(items, {"en": "en"}))).collect()}
    assert got == {(rows[0][0], rows[2][0]): "same", (rows[1][0], rows[3][0]): "unsure"}


def test_a_name_that_its_folder_disputes_pairs_by_each_reading(spark):
    shown = [f"/v/Tale 2 - {n:02}.mkv" for n in range(1, 6)]
    rows = [(p, "video") for p in shown] + [(f"/s/Tale 2 - {n:02}.srt", "subtitle") for n in range(1, 6)]
    items = spark.createDataFrame(rows, "path string, kind string").withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    # "2 - 03" reads as episodes 2 to 3, the folder's scheme says 3
    others = spark.createDataFrame([(shown[4], "other", 5.0, None), (shown[0], "other", 9.0, None)], "path string, parser string, episode double, season int")
    p = run.stored(run.parsed(items, {"en": "en"}, others))
    got = {r["path"]: (r["vote"], r["episode"], r["candidates"], r["film"]) for r in p.collect()}
    assert got[shown[0]] == ("sole", 1.0, [1.0], False) and got[shown[2]] == ("disagree", None, [2.0, 3.0], False) and got[shown[4]] == ("majority", 5.0, [2.0, 5.0], False)
    pairs = {(r["video"], r["subtitle"]) for r in run.likely(p).collect()}
    assert all((v, f"/s/Tale 2 - {n:02}.srt") in pairs for n, v in enumerate(shown, 1))
    assert (shown[2], "/s/Tale 2 - 02.srt") in pairs and (shown[2], "/s/Tale 2 - 01.srt") not in pairs
