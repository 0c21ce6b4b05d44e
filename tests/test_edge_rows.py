import os

import numpy as np

from tidemark.operators import pairing
from tidemark.plans import catalog


def test_dealt_edges_are_the_edges(spark):
    rng = np.random.default_rng(5)
    pick = lambda *of: of[rng.integers(len(of))]
    side = lambda name, n, kind: spark.createDataFrame([(f"{name}{i}", pick("a", "b", None), pick(1, 2, 3, 14, None), pick(1, 2, 3, None), pick(None, 0, 1)) for i in range(n)], f"path string, title string, season {kind}, episode long, shift long")
    v, s = side("v", 150, "long"), side("s", 130, "int").drop("shift")
    for videos in (v, v.drop("shift"), v.limit(0)):
        for keys in (["title"], []):
            want = sorted(map(tuple, pairing.block(videos, s, keys).collect()))
            for parts, deals in ((1, 8), (5, 8), (5, 1)):
                assert sorted(map(tuple, pairing.block(videos, s, keys, parts, deals).collect())) == want


def written(df, path) -> tuple[int, int]:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path).count(), sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".parquet"))


def test_edges_are_written_as_lists_of_few_names(spark, tmp_path):
    # 25 titles by turns, 200 videos and 400 cue files each
    spark.range(5000).selectExpr("id * 26 as o_orderkey", "id as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(10000).selectExpr("id * 31 as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    for name in ("candidate_join", "shifted_candidate_join"):
        rows, size = written(catalog.QUERIES[name](spark, str(tmp_path)), f"{tmp_path}/{name}")
        assert rows > 800_000 and size < rows
