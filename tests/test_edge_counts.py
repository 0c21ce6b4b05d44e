import numpy as np

from tidemark.operators import pairing
from tidemark.plans import catalog


def test_counts_of_edges_equal_the_edges(spark):
    rng = np.random.default_rng(3)
    pick = lambda *of: of[rng.integers(len(of))]
    side = lambda name, n: spark.createDataFrame([(f"{name}{i}", pick("a", "b", None), pick(1, 2, None), pick(1, 2, 3, None), pick(None, 0, 1)) for i in range(n)], "path string, title string, season long, episode long, shift long")
    v, s = side("v", 150), side("s", 130).drop("shift")
    for videos in (v, v.drop("shift")):
        for keys in (["title"], []):
            edges = pairing.block(videos, s, keys)
            want = {r["video"]: r["candidates"] for r in pairing.fan_out(videos, edges).collect()}
            counts = pairing.block_counts(videos, s, keys)
            assert {r["video"]: r["candidates"] for r in pairing.fan_out(videos, counts).collect()} == want
            assert {r["video"] for r in counts.collect()} == {k for k, n in want.items() if n}


def test_no_edge_is_made_to_be_counted(spark, tmp_path):
    # 40,000 by 40,000 files of one episode: 1.6 billion edges
    spark.range(40000).selectExpr("id * 78 as o_orderkey", "cast(0 as bigint) o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(40000).selectExpr("id * 25 * 31 * 12 as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    assert catalog.QUERIES["fan_out"](spark, str(tmp_path)).agg({"candidates": "sum"}).first()[0] == 40000 * 40000
    assert catalog.QUERIES["unpaired_videos"](spark, str(tmp_path)).count() == 0
