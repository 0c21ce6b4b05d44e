from tidemark.plans import catalog


def test_script_class_reads_the_whole_text(spark, tmp_path):
    rows = [(1, "1 " * 300 + "late"), (2, "latin first " + "- " * 300 + "漢字"), (3, "1 2 3")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["script"] for r in catalog.QUERIES["script_class"](spark, str(tmp_path)).collect()}
    assert got == {1: "latin", 2: "mixed", 3: "other"}
