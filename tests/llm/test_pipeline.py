import pytest

import corpus_pipeline
from tidemark.llm import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_the_smallest_tables(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append(docs.count())
        if i < 4:
            assert docs.columns == COLUMNS
    assert seen[0] >= seen[1] >= seen[2] == seen[3] and seen[4] == seen[5]


def test_filters_keep_repeated_clean_rows_apart(spark, docs, tmp_path):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(1, "clean text here"), (1, "clean text here"), (2, None), (3, ""), (None, "null id"), (1, "quite another text of one id")]
    d = docs(rows)
    assert corpus_pipeline.drop_toxic(spark, d, str(tmp_path)).count() == len(rows)
    left = corpus_pipeline.drop_near_copies(spark, d, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == [(0, "null id"), (1, "clean text here"), (1, "quite another text of one id"), (2, "")]
    mixed = corpus_pipeline.mix_sources(spark, d, str(tmp_path))
    assert mixed.columns == COLUMNS and 0 < mixed.count() <= 2 * len(rows)
    assert toxicity.THRESHOLD == 0.7


ODD = [(1, None), (2, ""), (3, " \t"), (None, "null id"), (4, "same text of four words"), (5, "same text of four words"), (5, "same text of four words"), (6, "w " * 60000 + "end"), (7, "été 日本 <b>")]


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows_and_empty_tables(spark, docs, tmp_path, k):
    spark.createDataFrame([(4, 0), (7, 1), (7, 0), (None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    rows = docs(ODD)
    got = stage(spark, rows, str(tmp_path)).collect()
    if name == "bpe":
        assert len(got) == len(ODD) and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {0}
    elif name == "near-dedup":
        assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 4, 6, 7]
    elif name == "mixing":
        assert 0 < len(got) <= 2 * len(ODD)
    else:
        assert len(got) == len(ODD)
    assert stage(spark, rows.where("false"), str(tmp_path)).count() == 0


def test_run_is_its_stages(spark, docs, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(4, 0)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    docs(ODD).select(*COLUMNS).write.parquet(f"{d}/documents.parquet")
    got = corpus_pipeline.run(spark, d).collect()
    assert got and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got[0].asDict())


#: Names of helper columns inside the stages and of columns that operators make.
HELPERS = "rows own copies kept_id m_id m_source take copy share kept fp component_id component size source_size target base p node class number score n n_id n_fp r ids h u v m words labels mask".split()


@pytest.mark.parametrize("k", range(5))
def test_stages_pass_over_columns_of_clashing_names(spark, docs, tmp_path, k):
    from pyspark.sql import functions as F

    spark.createDataFrame([(4, 0), (7, 1), (7, 0), (None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stage = corpus_pipeline.STAGES[k][1]
    plain = docs(ODD).select(*COLUMNS)
    clash = plain.select("*", *[F.lit("x").alias(c) for c in HELPERS])
    rows = lambda df: sorted(map(repr, stage(spark, df, str(tmp_path)).collect()))
    assert rows(clash) == rows(plain)
