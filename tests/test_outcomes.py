import pytest
from pyspark.sql import functions as F

from tidemark.operators import agreement, outcomes, ranking

DECIDED = "video string, lang string, subtitle string, action string, outcome string, rank int, reason string"


def test_languages_as_asked_for():
    tags = {"ja": "ja", "jpn": "ja", "japanese": "ja", "en": "en"}
    assert [outcomes.language(x, tags) for x in ("ja", " JPN", "ja-JP", "und", "Japanese")] == ["ja", "ja", "ja", "und", "ja"]
    for bad in ("xx", "jpn-JP", ""):
        with pytest.raises(ValueError):
            outcomes.language(bad, tags)


def test_unpaired_says_what_other_languages_had(spark):
    v = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("d",), (None,)], "video string")
    o = spark.createDataFrame([("a", "1", "ja"), ("a", "2", "en"), ("b", "3", "en"), ("b", "4", None), ("b", "4", None), (None, "5", "de")], "video string, subtitle string, lang string")
    got = lambda lang: {r["video"]: r["reason"] for r in outcomes.unpaired_in(v, o, lang).collect()}
    assert got(None) == {"c": "nothing was offered", "d": "nothing was offered"}
    assert got("ja") == {
        "b": "no ja file among the 3 offered (en, untagged); a name without a language is of none", "c": "nothing was offered", "d": "nothing was offered", None: "no ja file among the 1 offered (de)",
    }
    assert "b" not in got("und") and outcomes.unpaired_in(v.where("false"), o, "ja").count() == 0


def decided(spark):
    rows = [
        ("v1", "en", "/s/a", "write", "CONFIDENT", 1, None), ("v1", "en", "/s/b", "supersede", "CONFIDENT", 2, None), ("v1", "de", "/s/c", "refuse", "REFUSED", 2, "below chance"),
        ("v1", "de", "/s/d", "refuse", "REFUSED", 1, None), ("v2", None, "/s/e", "refuse", None, None, None), ("v3", "en", "/s/f", "refuse", "REFUSED", 1, "x"), ("v3", "en", "/s/g", "withheld", "CONFIDENT", 2, None),
        (None, "en", "/s/h", "refuse", "REFUSED", 1, "no video"), ("v4", "en", "/s/i", "write", "REFUSED", 1, "forced"),
    ]
    return spark.createDataFrame(rows, DECIDED).withColumn("score", F.lit(0.876))


def test_one_refusal_a_slot_without_a_write(spark):
    got = {(r["video"], r["lang"]): (r["subtitle"], r["outcome"], r["reason"], r["withheld"]) for r in outcomes.refusals(decided(spark)).collect()}
    assert got == {
        ("v1", "de"): ("/s/d", "REFUSED", "no candidate of 2 is good enough", False), ("v2", "und"): ("/s/e", "ERROR", "no candidate of 1 is good enough", False),
        ("v3", "en"): ("/s/g", "CONFIDENT", "not written: g also answers another video, which still has to read it", True), (None, "en"): ("/s/h", "REFUSED", "no video", False),
    }


def test_result_rows_have_all_fields(spark):
    d = decided(spark)
    dry = {r["subtitle"]: r for r in outcomes.result_rows(d).collect()}
    assert list(dry["/s/a"].asDict()) == list(outcomes.FIELDS) and len(dry) == 6
    assert dry["/s/a"]["reason"] == "dry run, nothing was written" and dry["/s/a"]["output_path"] is None and not dry["/s/a"]["write_failed"] and dry["/s/a"]["match_percent"] == 88
    o = spark.createDataFrame(
        [("v1\nen", "write", "/s/a", "/o/a", "done", None), ("v1\nen", "trash", "/s/b", "/t/b", "done", None), ("v4\nen", "write", "/s/i", "/o/i", "failed", "disk full")],
        "slot string, kind string, source string, target string, status string, reason string",
    )
    run = {r["subtitle"]: r for r in outcomes.result_rows(d, o, dry_run=False, force=True).collect()}
    assert run["/s/a"]["output_path"] == "/o/a" and run["/s/a"]["superseded"] == ["/s/b"] and run["/s/a"]["reason"] == "" and not run["/s/a"]["forced"]
    assert run["/s/i"]["write_failed"] and run["/s/i"]["forced"] and run["/s/i"]["reason"] == "not written: disk full; forced"
    assert run["/s/g"]["write_failed"] and not run["/s/d"]["write_failed"] and run["/s/d"]["notes"] == ["best of 2 candidates"]
    assert outcomes.result_rows(d.where("false"), o).count() == 0


def test_name_keys_split_one_title_in_two_scripts(spark):
    names = spark.createDataFrame([("NARUTO -ナルト-",), ("NARUTO -ナルト- 疾風伝",), ("Bleach 漂白",), ("ナルト",), ("OVA ナルト",), ("",), (None,), ("!!!",), ("NARUTO -ナルト-",)], "name string")
    got = {}
    for r in agreement.name_keys(names).collect():
        got.setdefault(r["name"], set()).add(r["key"])
    assert got["NARUTO -ナルト-"] == {"narutoナルト", "naruto", "ナルト"}
    assert {len(v) for k, v in got.items() if k != "NARUTO -ナルト-"} == {1} and "" not in got and None not in got and "!!!" not in got


def test_output_folders_are_folders(spark):
    rows = [("/lib/a", "/lib"), ("/lib2/x", "/lib"), ("/lib", "/lib"), ("/lib/a/b", "/lib/"), ("/x", "/")]
    d = spark.createDataFrame(rows, "f string, r string").select("f", ranking.output_folder(F.col("f"), F.col("r"), "/out/").alias("o"))
    assert [r["o"] for r in d.collect()] == ["/out/a", "/out", "/out", "/out/a/b", "/out/x"]
