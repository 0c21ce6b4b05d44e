"""Readings that vote, and byte comparison."""

import random

from tidemark.operators import census, opinions


def test_first_differences(spark):
    rng, rows = random.Random(3), []
    for n in (0, 1, 7, 255, 256, 257, 65_535, 65_536, 65_537, 200_001):
        a = rng.randbytes(n)
        rows += [(a, a), (a, a + b"x"), (a + b"xyz", a), (None, a), (a, None)]
        for at in {0, 1, 255, 256, 65_535, 65_536, n - 1, n // 2}:
            if 0 <= at < n:
                rows += [(a, a[:at] + bytes([a[at] ^ 1]) + a[at + 1 :]), (a, a[:at] + a[at + 1 :])]
    df = spark.createDataFrame([(i, *r, "keep") for i, r in enumerate(rows)], "i int, a binary, b binary, at_all string")
    got = {r["i"]: r for r in census.compare(df, "a", "b").collect()}
    for i, (a, b) in enumerate(rows):
        a, b = a or b"", b or b""
        at = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) if a != b else None
        r = got[i]
        assert (r["at"], r["before_bytes"], r["after_bytes"], r["at_all"]) == (at, len(a), len(b), "keep")
        assert r["kind"] == ("same" if at is None else "beginning" if at == min(len(a), len(b)) else "changed" if len(a) == len(b) else "changed and resized")
        assert (r["was"], r["is_now"]) == ((None, None) if at is None else (a[at : at + 8], b[at : at + 8]))


def test_census_against_a_baseline(spark):
    df = spark.createDataFrame([("a", b"1", b"1", "read"), ("a", b"1", b"2", "read"), ("b", b"1", b"2", "error"), ("b", None, None, "empty"), ("b", b"", b"", "read"), ("c", b"1", b"2", "read only"), (None, b"1", b"1", "read")], "ext string, x binary, y binary, status string")
    base = spark.createDataFrame([("a", 0.9), (None, 1.0)], "ext string, rate double")
    out = {r["ext"]: r for r in census.against(census.rates(census.outcomes(census.compare(df, "x", "y")), ["ext"]), base, ["ext"]).collect()}
    assert {k: (r["files"], r["identical"], r["mismatches"], r["empties"], r["errors"], r["verdict"]) for k, r in out.items()} == {
        "a": (2, 1, 1, 0, 0, "worse"), "b": (3, 1, 0, 1, 1, "new"), None: (1, 1, 0, 0, 0, "level")
    }
    assert census.rates(census.outcomes(census.compare(df.limit(0), "x", "y")), ["ext"]).count() == 0


def test_opinions(spark):
    folder = [f"Tale 2 - {n:02}.mkv" for n in range(1, 8)]
    rows = [(f"/f/{n}", n, "episode", float(i), None) for i, n in enumerate(folder, 1)]
    rows[3] = (rows[3][0], folder[3], "episode", 2.0, None)  # the name was misread, the folder dissents
    rows[4] = (rows[4][0], folder[4], "episode", None, None)
    rows += [("/g/a 09 x.mkv", "a 09 x.mkv", "episode", 9.0, 1), ("/g/b.mkv", "b.mkv", "film", None, None), ("/g/1-12.mkv", "1-12.mkv", "batch", None, None), ("/g/c.mkv", "c.mkv", None, None, 2), ("/g/c.mkv", "c.mkv", None, None, 2)]
    items = spark.createDataFrame(rows, "path string, name string, kind string, episode double, season int")
    get = lambda others=None: {r["path"][3:]: (r["state"], r["episode"], r["candidates"], r["season"]) for r in opinions.settle(items, others).collect()}
    alone = get()
    assert alone[folder[0]] == ("sole", 1.0, [1.0], None) and alone[folder[3]] == ("disagree", None, [2.0, 4.0], None) and alone[folder[4]] == ("none", None, [], None)
    assert alone["a 09 x.mkv"] == ("sole", 9.0, [9.0], 1) and alone["b.mkv"] == ("none", None, [], None) and alone["1-12.mkv"] == ("agree", None, [], None) and alone["c.mkv"] == ("none", None, [], 2)
    others = [(f"/f/{folder[3]}", "x", 4.0, None), (f"/f/{folder[4]}", "x", 5.0, 3), (f"/f/{folder[4]}", "y", 1080.0, None), (f"/f/{folder[0]}", "x", 7.0, None), ("/g/1-12.mkv", "x", 1.0, None), ("/gone", "x", 1.0, None), ("/g/c.mkv", "x", None, 7)]
    more = get(spark.createDataFrame(others, "path string, parser string, episode double, season int"))
    assert more[folder[3]] == ("majority", 4.0, [2.0, 4.0], None) and more[folder[4]] == ("partial", 5.0, [5.0], 3)
    assert more[folder[0]] == alone[folder[0]] and more["1-12.mkv"] == alone["1-12.mkv"] and more["c.mkv"] == alone["c.mkv"] and len(more) == 11
    assert opinions.settle(items.limit(0)).count() == 0
