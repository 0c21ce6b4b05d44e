from tidemark.operators import agreement
from tidemark.plans import catalog


def test_no_side_of_names_is_sent_to_the_driver(spark, tmp_path):
    spark.range(2000).selectExpr("id as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    plan = catalog.QUERIES["name_labels"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_every_row_of_a_name_has_its_keys(spark):
    names = spark.createDataFrame([("naruto -ナルト-", 1), ("naruto -ナルト-", 2), ("naruto -ナルト-", 2), ("?!", 3), (None, 4), ("", 5), ("plain", 6)], "name string, n int")
    got = sorted((r["n"], r["key"]) for r in agreement.name_keys(names).collect())
    both = ["naruto", "narutoナルト", "ナルト"]
    assert got == [(n, k) for n in (1, 2, 2) for k in both][:3] + sorted([(2, k) for k in both] * 2) + [(6, "plain")]
