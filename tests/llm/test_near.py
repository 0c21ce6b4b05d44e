"""The pipeline's near-copy stage against brute force."""

import random

import pytest

import corpus_pipeline
from tidemark.llm import near, simhash


def jaccard(a, b):
    def cut(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = cut(a), cut(b)
    return 1.0 if a == b else len(a & b) / len(a | b)


def made():
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(300))
    texts = []
    for g in range(12):
        base = [word() for _ in range(rng.randrange(40, 160))]
        texts.append(" ".join(base))
        for k in range(5):
            w = list(base)
            for _ in range(1 + (g + k) % 5):  # each changed word changes five shingles
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), "short one", "short one", "", "shared licence line of seven words here " + texts[6][:80]]
    rng.shuffle(texts)
    return list(enumerate(texts))


def brute(rows):
    root = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            if i < j and root[i] != root[j] and jaccard(a, b) >= 0.8:
                lo, hi = sorted((root[i], root[j]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    return root


@pytest.mark.parametrize("limit", [1 << 20, 150])
def test_components_equal_brute_force(docs, limit):
    rows = made()
    want = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in near.components(docs(rows), limit=limit).collect()} == want
    assert len(set(want.values())) < len(rows) - 10


def test_stage_drops_edited_copies_that_fingerprints_miss(spark, docs):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    a, b = " ".join(base), " ".join("edited" if i in (40, 100, 160) else w for i, w in enumerate(base))
    assert jaccard(a, b) >= 0.8
    assert (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > simhash.MAX_BITS
    left = corpus_pipeline.drop_near_copies(spark, docs([(5, a), (3, b), (9, "something else altogether")]), "")
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 9]


def test_fingerprints_draw_together_what_no_band_does(docs):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    a, b = " ".join(base), " ".join([*base[:-1], "edited"])
    assert (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= simhash.MAX_BITS
    assert not set(near.band_keys(near.shingles(a), 20000, 1, 16)) & set(near.band_keys(near.shingles(b), 20000, 1, 16))
    rows = [(4, a), (2, b), (7, "something else altogether"), (9, ""), (8, None)]
    got = {r["doc_id"]: r["component_id"] for r in near.components(docs(rows), rows=20000, bands=1).collect()}
    assert got == {4: 2, 2: 2, 7: 7, 9: 8, 8: 8}
