import struct
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.operators import rewrite
from tidemark.sources import encoding, formats

SRT = "1\n00:00:01,000 --> 00:00:02,500\nHello\nthere\n\n2\n00:00:10,000 --> 00:00:12,000\nBye\n"
VTT = "WEBVTT\n\nNOTE x\n\nintro\n00:01.000 --> 00:02.000 line:0\nHi\n\n00:05.000 --> 00:06.000\nYo\n"
ASS = "[Script Info]\n\n[V4+ Styles]\n\n[Events]\nFormat: Layer, Start, End, Text\nDialogue: 0,0:00:01.00,0:00:02.50,Hello, you\nComment: 0,0:00:05.00,0:00:06.00,x\n"
IDX = "# VobSub index file, v7\nid: en\ntimestamp: 00:00:01:000, filepos: 0\ntimestamp: 00:00:04:500, filepos: 9\n"


def times(row):
    return [(c["start"], c["end"]) for c in row["cues"]]


@pytest.mark.parametrize(
    "name,text,kind,want",
    [
        ("a.srt", SRT, "srt", [(1.0, 2.5), (10.0, 12.0)]),
        ("a.vtt", VTT, "vtt", [(1.0, 2.0), (5.0, 6.0)]),
        ("a.ass", ASS, "ass", [(1.0, 2.5), (5.0, 6.0)]),
        ("a.idx", IDX, "vobsub", [(1.0, 4.5), (4.5, 6.5)]),
        ("wrong.vtt", SRT, "srt", [(1.0, 2.5), (10.0, 12.0)]),
    ],
)
def test_formats(name, text, kind, want):
    row = formats.read_bytes(text.encode(), name)
    assert (row["status"], row["format"], times(row)) == ("OK", kind, want)


def test_bodies_and_failures():
    assert [c["text"] for c in formats.read_bytes(SRT.encode(), "a.srt")["cues"]] == ["Hello\nthere", "Bye"]
    assert formats.read_bytes(ASS.encode(), "a.ass")["cues"][0]["text"] == "Hello, you"
    assert formats.read_bytes(b"", "a.srt") | {"reason": ""} == formats.read_bytes(b"", "a.srt") | {"reason": ""}
    assert formats.read_bytes(b"", "a.srt")["status"] == "OK"
    assert formats.read_bytes(b"1\n2\n3\n", "a.srt")["status"] == "ERROR"
    assert formats.read_bytes(b"[Events]\nDialogue: 0,1,2,x\n", "a.ass")["status"] == "ERROR"


def pcs(pts, objects):
    body = struct.pack(">HHBHBBBB", 1, 1, 0, 1, 0x80, 0, 0, objects)
    return b"PG" + struct.pack(">IIBH", int(pts * 90000), 0, 0x16, len(body)) + body


def test_pgs():
    row = formats.read_bytes(pcs(1, 1) + pcs(3, 0) + b"junk" + pcs(5, 1) + pcs(6, 1) + pcs(7, 0), "a.sup")
    assert times(row) == [(1.0, 3.0), (5.0, 6.0), (6.0, 7.0)]


@pytest.mark.parametrize("codec", ["utf-8", "utf-16-le", "utf-16-be", "cp932", "utf-32-le"])
def test_encodings(codec):
    text = "1\n00:00:01,000 --> 00:00:02,000\n" + "これは日本語の字幕です。" * 8 + "\n"
    if codec.startswith("utf-16"):
        text = SRT
    data = text.encode(codec)
    got, used, bom = encoding.decode(data)
    assert got == text and encoding.encode_back(got, used, bom) == data


def test_render_moves_drops_and_renumbers():
    row = formats.read_bytes(SRT.encode(), "a.srt")
    out = rewrite.render(row["text"], "srt", row["cues"], [{"split": None, "offset": 0.0}])
    assert out == SRT
    out = rewrite.render(row["text"], "srt", row["cues"], [{"split": None, "offset": -5.0}])
    assert out == "1\n00:00:05,000 --> 00:00:07,000\nBye\n"
    with pytest.raises(ValueError):
        rewrite.render(row["text"], "srt", row["cues"], [{"split": None, "offset": -500.0}])
    with pytest.raises(ValueError):
        rewrite.apply_edits("abc", [(0, 2, "x"), (1, 3, "y")])


def test_scan_and_render(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.srt").write_text(SRT)
    (tmp_path / "b.vtt").write_text(VTT)
    (tmp_path / "bad.ass").write_text("nothing")
    files = formats.scan_cue_files(spark, str(tmp_path))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.collect()}
    assert {k: r["status"] for k, r in rows.items()} == {"a.srt": "OK", "b.vtt": "OK", "bad.ass": "ERROR"}
    assert formats.cues_of(files).count() == 4
    moved = files.where("status = 'OK'").withColumn("segments", F.expr("array(struct(cast(null as double) as split, 1.5D as offset))"))
    out = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]).decode() for r in rewrite.render_files(moved).collect()}
    assert "00:00:02,500 --> 00:00:04,000" in out["a.srt"] and "00:02.500 --> 00:03.500 line:0" in out["b.vtt"]


@pytest.mark.parametrize(
    "name,season,episode,kind",
    [
        ("Show.S02E05.1080p.WEB-DL.x264-GRP.mkv", 2, 5, "episode"),
        ("[Grp] Show - 07v2 [720p].mkv", None, 7, "episode"),
        ("Show 13.5 [BD].mkv", None, 13.5, "episode"),
        ("Show 第12話.srt", None, 12, "episode"),
        ("Show 01~12.mkv", None, None, "batch"),
        ("Film (2009) [1080p].mkv", None, None, "film"),
        ("News 2021.03.04.mkv", None, None, "film"),
        ("S01E01 & S02E03 both.mkv", None, None, "conjunction"),
        ("", None, None, "unknown"),
    ],
)
def test_name_ladder(name, season, episode, kind):
    p = names.parse_name(name)
    assert (p["season"], p["episode"], p["kind"]) == (season, episode, kind)


def peak_of(task):
    tracemalloc.start()
    task()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


@pytest.mark.parametrize("kind", ["srt", "ass", "vtt", "idx"])
def test_reading_holds_columns_and_not_objects(kind):
    n = 20000
    clock = [f"{i // 3600:02}:{i // 60 % 60:02}:{i % 60:02}" for i in range(n + 1)]
    line = {
        "srt": lambda i: f"{i + 1}\n{clock[i]},000 --> {clock[i + 1]},000\nline {i}\n\n", "vtt": lambda i: f"{clock[i]}.000 --> {clock[i + 1]}.000\nsay\n\n",
        "ass": lambda i: f"Dialogue: 0,{clock[i]}.00,{clock[i + 1]}.00,text\n", "idx": lambda i: f"timestamp: {clock[i]}:000, filepos: 000000000\n",
    }[kind]
    head = {"srt": "", "vtt": "WEBVTT\n\n", "ass": "[Events]\nFormat: Layer, Start, End, Text\n", "idx": "# VobSub index file, v7\n"}[kind]
    data = (head + "".join(map(line, range(n)))).encode()
    rows = []
    assert peak_of(lambda: rows.append(formats.read_bytes(data, f"a.{kind}"))) < 2 * len(data) + 150 * n
    row = rows[0]
    assert len(row["cues"]) == n and row["cues"][-1]["start"] == n - 1 and row["cues"][7]["end"] == 8
    if kind != "idx":
        new = []
        assert peak_of(lambda: new.append(rewrite.render(row["text"], row["format"], row["cues"], [{"split": None, "offset": 1.0}]))) < 4 * len(data) + 150 * n
        assert formats.read_bytes(new[0].encode(), f"a.{kind}")["cues"][-1]["start"] == n


def test_files_of_a_batch_come_out_in_parts(spark, monkeypatch):
    made = formats.batch_of([formats.read_bytes(SRT.encode(), "a.srt"), formats.read_bytes(b"", "b.srt"), formats.read_bytes(IDX.encode(), "c.idx")])
    assert [len(x) for x in made.column("cues").to_pylist()] == [2, 0, 2] and made.column("cues")[2].as_py()[0]["block_at"] is None
    files = spark.createDataFrame([(f"{i}.srt", SRT.encode()) for i in range(5)], "path string, content binary").coalesce(1)
    assert formats.read_cue_files(files).selectExpr("size(cues) n").groupBy("n").count().collect()[0][:] == (2, 5)
    broken = formats.read_cue_files(files.limit(1)).selectExpr("*", "array(struct(cast(null as double) as split, -500.0D as offset)) as segments")
    assert rewrite.render_files(broken).first()["reason"] == "no cue survives"


def test_few_readings_of_an_unknown_encoding_are_held():
    data = "привет мир ".encode("cp1251") * 6000
    found = []
    peak = peak_of(lambda: found.append(encoding.decode(data)))
    assert found[0][1:] == ("cp1251", b"") and found[0][0].startswith("привет") and peak < 13 * len(data)
