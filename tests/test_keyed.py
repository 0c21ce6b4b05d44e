import hashlib
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import keyed

T0 = datetime(2024, 1, 1)


def rows(spark, items, kind="cues", version=1):
    """(name, payload, minutes)"""
    data = [(hashlib.sha256(n.encode()).hexdigest() if n is not None else None, len(n or ""), p, T0 + timedelta(minutes=m)) for n, p, m in items]
    return keyed.entries(spark.createDataFrame(data, "digest string, size long, payload string, written_at timestamp"), kind, version)


def wanted(spark, names):
    return spark.createDataFrame([(n, hashlib.sha256(n.encode()).hexdigest(), len(n)) for n in names], "name string, digest string, size long")


def found(spark, path, names, **more):
    return {r["name"]: (r["found"], r["payload"]) for r in keyed.lookup(wanted(spark, names), path, "cues", **more).collect()}


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def content(spark, path):
    return sorted(map(repr, keyed.read(spark, path).collect()))


def test_upserts_keep_the_latest_and_untouched_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    assert found(spark, path, ["a"]) == {"a": ("miss", None)}
    many = [(f"n{i}", f"p{i}", i) for i in range(60)]
    keyed.upsert(path, rows(spark, many))
    first, before = content(spark, path), files(path)
    keyed.upsert(path, rows(spark, many))
    assert content(spark, path) == first
    before = files(path)
    keyed.upsert(path, rows(spark, [("n3", "later", 100), ("n4", "earlier", -5), ("n3", "later", 100), (None, "x", 1), ("n5", None, 50)]))
    after = files(path)
    kept = {f for f in before if before[f] == after.get(f)}
    touched = {hashlib.sha256(n.encode()).hexdigest()[:2] for n in ("n3", "n4", "n5")}
    assert {f.split("part=")[1][:2] for f in set(before) - kept} == touched
    assert found(spark, path, ["n3", "n4", "n5", "n6", "gone"]) == {"n3": ("hit", "later"), "n4": ("hit", "p4"), "n5": ("hit", None), "n6": ("hit", "p6"), "gone": ("miss", None)}


def test_order_and_repeats_of_batches_make_no_difference(spark, tmp_path):
    batches = [[("a", "1", 1), ("b", "1", 5)], [("a", "2", 3), ("c", "1", 1)], [("a", "3", 2), ("b", "2", 5)]]
    seen = set()
    for k, order in enumerate(([0, 1, 2], [2, 1, 0], [1, 1, 0, 2, 0])):
        path = str(tmp_path / f"t{k}")
        for i in order:
            keyed.upsert(path, rows(spark, batches[i]))
        seen.add(tuple(content(spark, path)))
    assert len(seen) == 1
    assert found(spark, path, "abc") == {"a": ("hit", "2"), "b": ("hit", "2"), "c": ("hit", "1")}


def test_stale_and_damaged_rows_and_files_are_misses(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.upsert(path, rows(spark, [("a", "old", 1)], version=0))
    bad = rows(spark, [("b", "x", 1)]).withColumn("check", F.lit(7).cast("long"))
    size = keyed.entries(rows(spark, [("c", "x", 1)]).withColumn("size", F.lit(99)), "cues")
    keyed.upsert(path, bad.unionByName(size).unionByName(rows(spark, [("d", "fine", 1), ("e", "other kind", 1)]).where("payload = 'fine'")))
    keyed.upsert(path, rows(spark, [("e", "p", 1)], kind="other"))
    assert found(spark, path, "abcde") == {"a": ("stale", None), "b": ("damaged", None), "c": ("damaged", None), "d": ("hit", "fine"), "e": ("miss", None)}
    assert found(spark, path, "a", version=0) == {"a": ("hit", "old")}
    part = hashlib.sha256(b"d").hexdigest()[:2]
    for f in files(path):
        if f"part={part}" in f:
            open(f, "wb").write(b"no parquet")
            os.path.exists(os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")) and os.unlink(os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc"))
    assert found(spark, path, "d") == {"d": ("miss", None)}
    keyed.forget(path, spark, wanted(spark, ["a"]))
    assert found(spark, path, "ab", version=0) == {"a": ("miss", None), "b": ("damaged", None)}


def test_streams_merge_like_batches(spark, tmp_path):
    path, source, check = (str(tmp_path / n) for n in ("t", "in", "check"))
    for k, batch in enumerate([[("a", "1", 1), ("b", "1", 2)], [("a", "2", 3), ("a", "2", 3)], [("a", "0", 0)]]):
        rows(spark, batch).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(keyed.ROW).option("maxFilesPerTrigger", 1).parquet(source)
        keyed.upsert_stream(stream, path, check).awaitTermination()
    assert found(spark, path, "ab") == {"a": ("hit", "2"), "b": ("hit", "1")}


def test_cached_makes_only_what_is_missed(spark, tmp_path):
    path, made = str(tmp_path / "t"), []

    def make(missed):
        made.append(sorted(r["name"] for r in missed.collect()))
        return missed.where("name <> 'bad'").select("digest", "size", F.upper("name").alias("payload"))

    get = lambda names: {r["name"]: (r["found"], r["payload"]) for r in keyed.cached(wanted(spark, names), path, "cues", make).collect()}
    assert get(["a", "b", "bad"]) == {"a": ("miss", "A"), "b": ("miss", "B"), "bad": ("miss", None)}
    assert get(["a", "b", "c", "c"]) == {"a": ("hit", "A"), "b": ("hit", "B"), "c": ("miss", "C")}
    assert made == [["a", "b", "bad"], ["c"]]


@pytest.mark.parametrize("names", [[], ["x"]])
def test_empty_tables(spark, tmp_path, names):
    path = str(tmp_path / "t")
    keyed.upsert(path, rows(spark, []))
    assert keyed.read(spark, path) is None
    assert found(spark, path, names) == {n: ("miss", None) for n in names}


def test_a_merge_is_one_shuffle_and_keeps_any_digest(spark):
    digests = ["00ff", "00FF", "abc", "", "zz", "00ff"]  # hex goes as bytes, what isn't hex as it is
    rows = keyed.entries(spark.createDataFrame([(x, i, str(i), datetime(2024, 1, 1)) for i, x in enumerate(digests)], "digest string, size long, payload string, written_at timestamp"), "k")
    got = keyed.merged(rows.withColumn("part", F.substring("digest", 1, 1)), 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan
    assert sorted((r["digest"], r["payload"]) for r in got.collect()) == sorted((r["digest"], r["payload"]) for r in keyed.merged(rows.withColumn("part", F.substring("digest", 1, 1)), 4, 3).collect()) == [("", "3"), ("00FF", "1"), ("00ff", "5"), ("abc", "2"), ("zz", "4")]
