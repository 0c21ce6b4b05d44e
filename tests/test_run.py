import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import rewrite
from tidemark.plans import run
from tidemark.sources import formats


def srt(starts):
    return "".join(f"{i}\n{rewrite.format_like(t, 'srt')} --> {rewrite.format_like(t + 1.5, 'srt')}\nline {i}\n\n" for i, t in enumerate(starts, 1))


def test_run(spark, tmp_path):
    v, s = tmp_path / "v", tmp_path / "s"
    v.mkdir(), s.mkdir()
    rng, refs = np.random.default_rng(0), []
    for e in (1, 2):
        true = np.sort(rng.uniform(0, 1400, 300)).round(2)
        (v / f"Blue Harbor S01E0{e}.mkv").write_bytes(b"x")
        (s / f"Blue Harbor - 0{e}.en.srt").write_text(srt(true))
        (s / f"Blue Harbor - 0{e}.en.sdh.srt").write_text(srt(true[::2]))
        (s / f"Other Tale - 0{e}.en.srt").write_text(srt(true))
        refs.append((f"file:{v}/Blue Harbor S01E0{e}.mkv", (true + 4.0).tolist(), 1410.0))
    (v / "sample.mkv").write_bytes(b"x")
    with pytest.raises(FileNotFoundError):
        run.scan(spark, str(tmp_path / "none"))
    items = run.scan(spark, str(v), str(s))
    assert items.count() == 8
    files = formats.scan_cue_files(spark, str(s))
    out = run.sync(items, spark.createDataFrame(refs, "video string, starts array<double>, duration double"), files).persist()
    rows = out.collect()
    assert {r["action"] for r in rows} == {"write", "supersede"} and len(rows) == 4
    for r in rows:
        assert "Other" not in r["subtitle"]
        if r["action"] == "write":
            assert r["outcome"] == "CONFIDENT" and abs(r["segments"][0]["offset"] - 4) < 0.1 and ".sdh" not in r["subtitle"] and r["target"].endswith(".en.srt")
    assert run.summary(out).first()["clean"] == sum(r["outcome"] == "CONFIDENT" for r in rows)


def test_a_second_run_measures_nothing(spark, tmp_path):
    from tidemark.operators import state
    from tidemark.plans import perform

    v, s, trash, store = (str(tmp_path / n) for n in ("v", "s", "trash", "store"))
    (tmp_path / "v").mkdir(), (tmp_path / "s").mkdir()
    rng, refs = np.random.default_rng(0), []
    for e in (1, 2):
        true = np.sort(rng.uniform(0, 1400, 300)).round(2)
        (tmp_path / "v" / f"Blue Harbor S01E0{e}.mkv").write_bytes(b"x")
        (tmp_path / "s" / f"Blue Harbor - 0{e}.en.srt").write_text(srt(true))
        (tmp_path / "s" / f"Blue Harbor - 0{e}.en.sdh.srt").write_text(srt(true[::2]))
        refs.append((f"file:{v}/Blue Harbor S01E0{e}.mkv", (true + 4.0).tolist(), 1410.0))
    references = spark.createDataFrame(refs, "video string, starts array<double>, duration double")

    def once(**more):
        files = formats.scan_cue_files(spark, s).unionByName(formats.scan_cue_files(spark, v))
        both = spark.read.format("binaryFile").option("pathGlobFilter", "*.srt")
        digests = both.load(s).union(both.load(v)).select("path", state.full_key(F.col("content")).alias("digest"))
        return perform.perform(run.scan(spark, v, s), references, files, digests, store, trash, tags={"en": "en"}, **more)

    first = once(dry_run=False)
    rows = first.results.collect()
    assert len(rows) == 2 and all(r["output_path"].endswith(".en.srt") and len(r["superseded"]) == 1 and not r["write_failed"] for r in rows)
    assert perform.read_records(spark, store).count() == 2 and len(list((tmp_path / "trash").rglob("*.srt"))) == 2
    again = once(dry_run=False)
    assert again.decided.count() == 0 and again.outcomes.count() == 0


def made(spark, rows):
    """Items (path, kind) as a scan gives them."""
    return spark.createDataFrame(rows, "path string, kind string").withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))


TAGS = {"en": "en", "ja": "ja"}


def edges_of(spark, rows, **more):
    return {(r["video"], r["subtitle"]): (r["identity"], r["speculative"]) for r in run.edges(run.stored(run.parsed(made(spark, rows), TAGS)), **more).collect()}


def test_films_shifts_and_fallbacks_become_candidates(spark):
    films = [("/v/Harbor (2009) [1080p].mkv", "video"), ("/s/The.Harbor.2009.BluRay.en.srt", "subtitle"), ("/v/Other Film (2010).mkv", "video")]
    shifted = [(f"/v/Blue Tale S01E0{k}.mkv", "video") for k in (1, 2, 3)] + [(f"/s/Blue Tale S01E{k}.srt", "subtitle") for k in (13, 14, 15)]
    apart = [("/v/Red Road S01E07.mkv", "video"), ("/s/Red Road S01E31.srt", "subtitle"), ("/s/Red Road S01E45.srt", "subtitle")]
    named = [("/v/Green Hill - 88.mkv", "video"), ("/s/Midori no Oka - 88.srt", "subtitle")]
    want = {(shifted[k][0], shifted[k + 3][0]): ("same", True) for k in range(3)} | {(apart[0][0], apart[k][0]): ("same", True) for k in (1, 2)}
    got = edges_of(spark, films + shifted + apart + named)
    assert got.pop((films[0][0], films[1][0]))[1] is False and got == want
    alias = spark.createDataFrame([("grenhill", 7), ("midorinooka", 7)], "key string, entity int")
    assert edges_of(spark, named, alias=alias) == {(named[0][0], named[1][0]): ("same", False)}


def cue_rows(spark, streams):
    rows = [(p, "OK", [(float(t), float(t) + 1.5, f"said at {t}") for t in ts]) for p, ts in streams.items()]
    return spark.createDataFrame(rows, "path string, status string, cues array<struct<start:double,end:double,text:string>>")


def test_asserted_pairs_have_a_row_each(spark):
    rng = np.random.default_rng(3)
    true = np.sort(rng.uniform(0, 1400, 300)).round(2)
    wrong = np.sort(rng.uniform(0, 1400, 40)).round(2)
    files = cue_rows(spark, {"/s/a.en.srt": true, "/s/b.en.srt": wrong, "/s/c.en.srt": true})
    refs = spark.createDataFrame([("/v/x.mkv", (true + 4).tolist(), 1410.0), ("/v/y.mkv", (true + 4).tolist(), 1410.0)], "video string, starts array<double>, duration double")
    entries = [(0, "/v/x.mkv", "/s/a.en.srt", None), (1, "/v/y.mkv", "/s/b.en.srt", None), (2, "/v/x.mkv", "/s/c.en.srt", None), (3, "/v/y.mkv", "/s/c.en.srt", None), (4, "/v/z.mkv", "/s/d.srt", None), (5, None, "/s/e.srt", "video or subtitle missing")]
    e = spark.createDataFrame(entries, "seq int, video string, subtitle string, fault string")
    for force in (False, True):
        got = {r["seq"]: r for r in run.sync_pairs(e, refs, files, TAGS, force).collect()}
        assert sorted(got) == list(range(6))
        assert got[0]["outcome"] == "CONFIDENT" and got[0]["action"] == "write" and got[0]["target"] == "/v/x.en.srt"
        assert got[1]["outcome"] == "REFUSED" and bool(got[1]["forced"]) == force
        assert got[2]["reason"] == got[3]["reason"] == "asserted for several videos" and got[4]["reason"] == "not measured" and got[5]["outcome"] == "ERROR"


def test_files_align_to_files(spark):
    rng = np.random.default_rng(4)
    true = np.sort(rng.uniform(0, 1400, 300)).round(2)
    files = cue_rows(spark, {"ref": true, "whole": true - 3, "late": np.r_[true - 3, 1500 + 5 * np.arange(60)], "ends": np.r_[true - 3, 1550 + 5 * np.arange(5)]})
    pairs = spark.createDataFrame([(s, "ref") for s in ("whole", "late", "ends", "ref", "absent")], "subtitle string, reference string")
    got = {r["subtitle"]: r for r in run.align_to_files(pairs, files).collect()}
    assert got["whole"]["outcome"] == "CONFIDENT" and abs(got["whole"]["segments"][0]["offset"] - 3) < 0.1 and got["whole"]["unchecked"] == 0
    assert got["late"]["outcome"] == "REFUSED" and got["late"]["unchecked"] > 0
    assert got["ends"]["outcome"] == "CONFIDENT" and got["ends"]["word"] == "fair" and got["ends"]["unchecked"] == 5
    assert got["ref"]["outcome"] == got["absent"]["outcome"] == "ERROR"


def test_run_skips_what_is_settled_and_hears(spark, tmp_path):
    rng = np.random.default_rng(5)
    true = np.sort(rng.uniform(0, 1400, 300)).round(2)
    rows = [(f"/v/Blue Tale - 0{k}.mkv", "video") for k in (1, 2)] + [(f"/s/Blue Tale - 0{k}.en.srt", "subtitle") for k in (1, 2)]
    refs = spark.createDataFrame([(p, (true + 4).tolist(), 1410.0) for p, k in rows if k == "video"], "video string, starts array<double>, duration double")
    files = cue_rows(spark, {p: true for p, k in rows if k == "subtitle"})
    skip = spark.createDataFrame([(rows[0][0],)], "video string")
    heard = spark.createDataFrame([(rows[1][0], float(t), "nothing like this at all") for t in range(0, 1400, 140)], "video string, start double, said string")
    out = run.sync(made(spark, rows), refs, files, TAGS, settled=skip, scratch=str(tmp_path / "a")).collect()
    assert [(r["video"], r["outcome"], r["action"]) for r in out] == [(rows[1][0], "CONFIDENT", "write")]
    out = run.sync(made(spark, rows), refs, files, TAGS, settled=skip, heard=heard, scratch=str(tmp_path / "b")).collect()
    assert [(r["outcome"], r["action"]) for r in out] == [("REFUSED", "keep")]
