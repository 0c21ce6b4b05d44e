import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import embeddings, simhash, substring
from tidemark.llm.common import connected_components


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    """Copies, near copies, shared passages, nulls, empties, repeated rows, one long text."""
    rng = random.Random(7)
    passage, base = words(rng, 60), words(rng, 300)
    rows = [(i, " ".join(words(rng, 120))) for i in range(12)]
    rows += [(20 + i, " ".join(words(rng, 30) + passage + words(rng, 25))) for i in range(5)]
    for i in range(8):
        near = list(base)
        near[rng.randrange(300)] = "changed"
        rows.append((40 + i, " ".join(near)))
    rows += [(60, " ".join(base)), (61, " ".join(base)), (61, " ".join(base)), (62, None), (63, ""), (64, " \t\n"), (None, "lonely words here"), (65, "a b a b " * 40), (66, "x" * 300 + " y")]
    rows += [(70, " ".join(words(rng, 30000))), (71, "One  two\tTHREE"), (72, "one two three"), (73, "é ü One"), (74, "same id"), (74, "other text of the same id")]
    return rows


def brute_substring(rows, length):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(b" ".join(w[p : p + length]) for _, w in split for p in range(len(w) - length + 1))
    out = []
    for i, w in split:
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - length + 1):
            if seen[b" ".join(w[p : p + length])] > 1:
                gone[p : p + length] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [35, 8, 2])
def test_substring_equals_brute_force(docs, length):
    rows = corpus()
    got = [tuple(r)[:4] for r in substring.remove_repeats(docs(rows), length).collect()]
    assert sorted(got, key=repr) == sorted(brute_substring(rows, length), key=repr)


def test_substring_keeps_clean_texts_and_takes_an_empty_table(docs):
    out = substring.remove_repeats(docs([(1, "a  b"), (2, None)]), keep=("doc_id", "source"), rewrite=True).collect()
    assert {r["doc_id"]: r["kept"] for r in out} == {1: "a  b", 2: None}
    assert substring.remove_repeats(docs([(1, "a")]).where("false")).count() == 0


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(s)) if s else 0


def brute_components(fps, bits=2):
    root = {f: f for f in set(fps)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= bits:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in root}


@pytest.mark.parametrize("dense", [256, 1])
def test_simhash_equals_brute_force(docs, dense):
    rows = [r for r in corpus() if r[0] != 70] + [(70, " ".join(words(random.Random(1), 400)))]
    got = simhash.components(docs(rows), dense=dense).collect()
    comp = brute_components([brute_fingerprint(t) for _, t in rows])
    least = {}
    for i, t in rows:
        if i is not None:
            c = comp[brute_fingerprint(t)]
            least[c] = min(least.get(c, i), i)
    want = sorted(((i, brute_fingerprint(t), least.get(comp[brute_fingerprint(t)])) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got), key=repr) == want
    assert simhash.components(docs(rows).where("false")).count() == 0


@pytest.mark.parametrize("dense", [64, 2])
def test_crowded_variants_lose_no_link(spark, dense):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << rng.randrange(64) for _ in range(k)) for k in (0, 1, 2, 3, 4, 5) for _ in range(20)} | {rng.getrandbits(64) for _ in range(50)}
    fps = {f & (2**64 - 1) for f in fps}
    sign = lambda f: f - 2**64 if f >= 2**63 else f
    df = spark.createDataFrame([(sign(f),) for f in fps], "fp long")
    edges = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in simhash.links(df, dense=dense).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    want, root = brute_components(fps), {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {f: find(f) for f in fps} == want


def test_components_of_paths_and_ties(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (100, 100), (None, 5), (200, 201), (200, 201)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 200, 201: 200}


@pytest.mark.parametrize("block", [2048, 7])
def test_embeddings_equal_brute_force(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 16))
    v = [(i, (centres[i % 6] + 0.12 * rng.standard_normal(16)).tolist()) for i in range(90)] + [(100 + i, rng.standard_normal(16).tolist()) for i in range(40)]
    v += [(200, v[0][1]), (201, v[0][1]), (202, [2 * x for x in v[0][1]]), (203, [-0.0, *v[1][1][1:]]), (204, [0.0, *v[1][1][1:]])]
    odd = [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan"), *[1.0] * 15]), (304, [None, *[1.0] * 15]), (305, [float("inf"), *[1.0] * 15]), (306, [1.0] * 8), (307, [2.0] * 8), (302, [0.0] * 16)]
    df = spark.createDataFrame(v + odd, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1)).withColumn("n_links", F.lit("x"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df, miss=1e-6, block=block).collect()}
    x = np.array([np.array(e, np.float32).astype(float) for _, e in v])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    ids, root = [i for i, _ in v], list(range(len(v)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in zip(*np.nonzero(near), strict=True):
        p, q = find(int(a)), find(int(b))
        if ids[p] != ids[q]:
            p, q = sorted((p, q), key=lambda k: ids[k])
            root[q] = p
    want = {ids[k]: (int(near[k].sum()), ids[find(k)]) for k in range(len(v))}
    want |= {300: (0, 300), 301: (0, 301), 302: (0, 302), 303: (0, 303), 304: (0, 304), 305: (0, 305), 306: (1, 306), 307: (1, 306)}
    assert got == want
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_unsound_vectors_keep_a_row_each_and_link_with_nothing(spark):
    rows = [(1, [1.0, 2.0]), (2, [None, 1.0, 2.0]), (3, []), (4, [None]), (5, [2.0, 4.0]), (None, [1.0, 2.0]), (6, [0.0, 0.0]), (None, None), (6, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in embeddings.near_duplicates(df).collect()), key=repr)
    want = [(1, 2, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 2, 1, False), (None, 2, 1, False), (6, 0, 6, True), (6, 0, 6, True), (None, 0, None, True)]
    assert got == sorted(want, key=repr)


def test_recall_at_the_default_is_what_it_promises(spark):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((150, 32))
    rows = [(i, (centres[i % 150] + 0.16 * rng.standard_normal(32)).tolist()) for i in range(900)]
    x = np.array([np.array(v, np.float32).astype(float) for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = int((x @ x.T >= 0.95).sum()) - len(rows)
    found = sum(r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert want > 500 and 0.9 * want <= found <= want


def test_tables_reach_the_recall_they_promise():
    for n in (10**3, 10**6, 10**9):
        bits, tables = embeddings.plan_tables(n)
        same = (1 - np.arccos(0.95) / np.pi) ** bits
        assert (1 - same) ** tables <= embeddings.MISS
