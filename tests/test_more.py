import json

from pyspark.sql import functions as F

from tidemark.functions import kana
from tidemark.operators import state, witness
from tidemark.sources import tables


def test_kana():
    cases = {"きょう": "kyou", "チェック": "chekku", "ファイル": "fairu", "がっこう": "gakkou", "まっちゃ": "matchya", "ラーメン": "raamen", "ヴァイオリン": "vaiorin", "ティー": "tii", "しゃしん": "shashin", "ABC カナ": "abc kana", "": ""}
    assert {k: kana.to_romaji(k) for k in cases} == cases


def test_phonetic_best_title(spark):
    t = spark.createDataFrame([(1, "Shingeki no Kyojin"), (2, "Boku no Hero Academia"), (3, "One Piece")], "id long, text string")
    q = spark.createDataFrame([(10, "シンゲキノキョジン"), (11, "zzzz")], "id long, text string")
    assert [(r["query"], r["title"]) for r in kana.best_titles(q, t, accept=0.6).collect()] == [(10, 1)]


def test_witness(spark):
    say = ["alphabetagamma", "deltaepsilonzeta", "etathetaiotakappa", "lambdamunuxi", "omicronpirhosigma"]
    heard = spark.createDataFrame([(v, 100.0 * i, say[i]) for v in ("ok", "moved") for i in range(5)] + [("other", 100.0 * i, "completely different words") for i in range(5)] + [("few", 0.0, say[0])], "video string, start double, said string")
    rows = [(v, 100.0 * i + 10 + (60 if v == "moved" else 0), say[i]) for v in ("ok", "moved", "other", "few") for i in range(5)]
    got = {r["video"]: (r["passed"], r["reason"]) for r in witness.check(heard, spark.createDataFrame(rows, "video string, at double, text string")).collect()}
    assert got["ok"] == (True, "") and got["other"][0] is False and got["few"] == (False, "too few windows")
    w = spark.range(1).select(witness.sample_windows(F.lit(600.0)).alias("a"), witness.sample_windows(F.lit(20.0)).alias("b"), witness.sample_windows(F.lit(None).cast("double")).alias("c")).first()
    assert len(w["a"]) == 12 and w["b"] == [0.0] and w["c"] == []


def test_state(spark, tmp_path):
    path = str(tmp_path / "records")
    rec = lambda out, vid, lang, cons, at: (out, vid, "s", lang, {"rename": "1"}, cons, at, None)
    rows = [rec("o1", "v1", "en", [("o1", "CONFIDENT", False), ("k1", "REFUSED", True)], None), rec("o2", "v2", "en", [("k2", "REFUSED", True)], None)]
    state.append(spark.createDataFrame(rows, state.RECORD), path)
    now = state.current(spark, path)
    files = [("a", "v1", "o1"), ("a", "v1", "k1"), ("b", "v2", "o2"), ("b", "v2", "k2"), ("b", "v2", "new"), ("c", "v3", "x")]
    present = spark.createDataFrame(files, "video string, video_digest string, digest string")
    got = {r["video"]: (r["settled"], r["added"], r["gone"]) for r in state.work_left(now, present, {"rename": "1"}).collect()}
    assert got == {"a": (True, 0, 0), "b": (False, 1, 0), "c": (False, 1, 0)}
    assert not any(r["settled"] for r in state.work_left(now, present, {"rename": "0"}).collect())
    assert state.forget(now, spark.createDataFrame([("o1",)], "output_digest string")).count() == 1
    k = spark.createDataFrame([(b"x" * 200000,), (b"",)], "c binary").select(state.content_key(F.col("c")).alias("k")).collect()
    assert len({r["k"] for r in k}) == 2


def test_tables(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('{"v": 1}\nfoo\tQ1 Q2\nbar\tQ2\n##\nQ1\tFoo One\nQ2\tBar\n')
    keys, names = tables.read_alias(spark, str(tmp_path / "a.tsv"))
    assert sorted(map(tuple, keys.collect())) == [("bar", "Q2"), ("foo", "Q1"), ("foo", "Q2")]
    assert sorted(map(tuple, names.collect())) == [("Q1", "Foo One"), ("Q2", "Bar")]
    (tmp_path / "v.json").write_text(json.dumps({"tokens": ["web", "the"]}))
    assert [r[0] for r in tables.read_vocabulary(spark, str(tmp_path / "v.json"), spark.createDataFrame([("the",)], "token string")).collect()] == ["web"]
    (tmp_path / "m.json").write_text(json.dumps([["v.mkv", "s.srt"], {"video": "a", "subtitle": "b"}, ["x"], {"video": "a"}]))
    got = [(r["video"], r["subtitle"], r["fault"]) for r in tables.read_manifest(spark, str(tmp_path / "m.json")).orderBy("seq").collect()]
    assert got[:2] == [("v.mkv", "s.srt", None), ("a", "b", None)] and [g[2] for g in got[2:]] == ["not a pair", "video or subtitle missing"]
