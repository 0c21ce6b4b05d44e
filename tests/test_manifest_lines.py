"""Manifests with a line for each entry are read in blocks, with the results of one text."""

from tidemark.sources import tables

ENTRIES = ['["v0","s0"]', '{"video":"v1","subtitle":"s,1"}', '["x"]', "null", '{"video":"v4"}', '["v[5]","s\\"5"]']


def read(spark, path):
    return [tuple(r) for r in tables.read_manifest(spark, str(path)).orderBy("seq").collect()]


def test_lines_equal_one_text(spark, tmp_path):
    (tmp_path / "one.json").write_text("[" + ", ".join(ENTRIES) + "]")
    (tmp_path / "lines.json").write_text("[\n" + ",\n".join(ENTRIES) + "\n]\n")
    parts = tmp_path / "parts"
    parts.mkdir()
    for i, text in enumerate(["[\n" + ",\n".join(ENTRIES[:2]) + ",\n", ",\n".join(ENTRIES[2:]) + "\n", "]\n"]):
        (parts / f"part-{i}").write_text(text)
    want = read(spark, tmp_path / "one.json")
    assert tables._listed_lines(spark, str(tmp_path / "one.json")) is None and [r[0] for r in want] == list(range(6))
    assert read(spark, tmp_path / "lines.json") == want == read(spark, parts)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30")  # several blocks a file
    try:
        assert read(spark, tmp_path / "lines.json") == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_other_forms_are_one_text(spark, tmp_path):
    for i, text in enumerate(['[\n["a","b"],\n]', '[\n["a","b"]\n["c","d"]\n]', '[\n"a"],["b",\n"c"\n]', '[\n{\n"video":"a",\n"subtitle":"b"\n}\n]', "[\n]", "{}"]):
        (tmp_path / f"{i}.json").write_text(text)
        assert tables._listed_lines(spark, str(tmp_path / f"{i}.json")) is None
