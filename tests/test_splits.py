import numpy as np
import pytest

from tidemark.operators import align, splits
from tidemark.operators.align import Fitter, Settings

K = ["pair"]


def spliced(rng, n, cuts, offsets, noise=0.0, drop=0.1):
    """Moments of a reference and of a subtitle whose offset changes at the cuts."""
    ref = np.round(np.cumsum(rng.uniform(1.2, 6.0, n)), 3)
    sub = ref.copy()
    for t, o in zip([0, *cuts], offsets, strict=True):
        sub = np.where(ref >= t, ref - o, sub)
    sub = sub[rng.random(n) > drop]
    sub = sub + rng.normal(0, noise, len(sub))
    return ref.tolist(), np.unique(np.round(sub, 3)).tolist()


def cases():
    rng = np.random.default_rng(1)
    out = {
        "plain": spliced(rng, 200, [], [1.5]),
        "one cut": spliced(rng, 260, [400], [2.0, -7.5]),
        "two cuts": spliced(rng, 400, [400, 900], [0.0, 12.0, 30.25]),
        "noise": (np.round(np.sort(rng.uniform(0, 900, 200)), 3).tolist(), np.round(np.sort(rng.uniform(0, 900, 180)), 3).tolist()),
        "self": (list(map(float, range(0, 600, 3))),) * 2,
        "few": ([1.0, 5.0, 9.5], [2.0, 6.0, 10.5]),
        "far": ([1.0, 2.0], [900.0, 901.0]),
        "repeats": ([float(i // 2 * 4) for i in range(120)], [float(i // 3 * 4 + 1) for i in range(150)]),
        "one": ([10.0], [10.2]),
        "no ref": ([], [1.0, 2.0]),
        "no sub": ([1.0, 2.0], []),
    }
    return out


def tables(spark, pairs):
    rows = lambda k: [(p, float(t)) for p, x in pairs.items() for t in x[k]] + [(next(iter(pairs)), None)]
    return [spark.createDataFrame(rows(k), "pair string, t double").repartition(3) for k in (0, 1)]


def test_candidates_equal_the_plain_search(spark):
    pairs = cases()
    got = {}
    for r in splits.offset_candidates(*tables(spark, pairs), K).orderBy("pair", "cand").collect():
        got.setdefault(r["pair"], []).append(r["offset"])
    want = {p: Fitter(*x).candidates() for p, x in pairs.items() if x[0] and x[1]}
    assert got == {p: c for p, c in want.items() if c} and len(got["two cuts"]) > 3


def test_peaks_of_other_settings(spark):
    s = Settings(window=40.0, bin=0.5, tol=2.0, separation=3.0, global_peaks=9, refine_passes=1)
    pairs = cases()
    ref, sub = tables(spark, pairs)
    got = {}
    d = align.differences(ref.where("t is not null"), sub.where("t is not null"), K, s.window)
    for r in splits.peaks(d, K, s.global_peaks, s).orderBy("pair", "rank").collect():
        got.setdefault(r["pair"], []).append(r["offset"])
    for p, offsets in got.items():
        f = Fitter(*pairs[p], settings=s)
        d = np.subtract.outer(f.R, f.A).ravel()
        assert offsets == f.peaks(d[np.abs(d) <= s.window], s.global_peaks), p


def test_prefix_sums_of_hits(spark):
    pairs = cases()
    ref, sub = tables(spark, pairs)
    cands = spark.createDataFrame([(p, k, o) for p in pairs for k, o in enumerate([0.0, 1.5, -30.0, 0.35])], "pair string, cand int, offset double")
    got = {(r["pair"], r["cand"]): r["prefix"] for r in splits.hit_prefixes(ref, sub, cands, K).collect()}
    for (p, k), sums in got.items():
        f = Fitter(*pairs[p])
        own = f.hits([0.0, 1.5, -30.0, 0.35][k]) if len(f.A) else np.zeros(len(f.R), bool)
        assert sums == np.r_[0, np.cumsum(own)].tolist(), (p, k)
    assert {p for p, _ in got} == {p for p, x in pairs.items() if x[0]}


@pytest.mark.parametrize("most", [None, 1, 2])
def test_fit_equals_the_plain_fit(spark, most):
    pairs = cases()
    durations = {p: d for p, d in zip(pairs, [None, 1800.0, 0.0, 900.0, None, 10.0, None, None, None, None, 5.0], strict=True)}
    asked = spark.createDataFrame(list(durations.items()), "pair string, duration double")
    rows = {r["pair"]: r.asDict(True) for r in splits.fit(*tables(spark, pairs), asked, K, max_segments=most).collect()}
    assert set(rows) == set(pairs)
    parts = {}
    for p, x in pairs.items():
        f = Fitter(*x, durations[p])
        f.refine = plain_refine.__get__(f)
        want, got = f.fit(most), rows[p]
        assert close(got["segments"], want["segments"]) and close(got["gaps"], want["gaps"]), (p, got["segments"], want["segments"])
        for c in ("score", "chance", "single_offset", "single_rate", "candidates", "n_ref", "n_sub"):
            assert close(got[c], want[c]), (p, c, got[c], want[c])
        assert close(got["buckets"], want["buckets"]), (p, got["buckets"], want["buckets"])
        parts[p] = len(got["segments"])
    assert most or (parts["one cut"], parts["two cuts"], parts["plain"]) == (2, 3, 1)


def plain_refine(self, offset, a, b):
    """The middle of the best of the offsets offset + k steps."""
    grid = [offset + k * self.s.refine_step for k in range(-60, 61)]
    rate = [self.hits(o, slice(a, b)).sum() for o in grid]
    top = [k for k, r in enumerate(rate) if r == max(rate)]
    return (grid[top[0]] + grid[top[-1]]) / 2 if max(rate) else offset


def close(a, b):
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(close(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(close, a, b))
    return a == b or (a is not None and b is not None and not isinstance(a, bool) and abs(a - b) < 1e-9)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "pair string, t double")
    assert splits.offset_candidates(none, none, K).count() == 0
    assert splits.fit(none, none, spark.createDataFrame([], "pair string, duration double"), K).count() == 0
    one = splits.fit(none, none, spark.createDataFrame([("p", 3.0)], "pair string, duration double"), K).collect()
    assert [(r["score"], r["segments"][0]["offset"], r["candidates"], r["buckets"]) for r in one] == [(0.0, 0.0, [], [])]


def test_best_cuts_of_several_segments(spark):
    sums = {0: [1] * 20 + [0] * 20, 1: [0] * 20 + [1] * 20}
    rows = [("x", c, float(c), 40, np.r_[0, np.cumsum(h)].tolist()) for c, h in sums.items()]
    p = spark.createDataFrame(rows, "pair string, cand int, offset double, n int, prefix array<int>")
    segs = spark.createDataFrame([("x", 0, 40), ("x", 0, 20), ("x", 15, 40), ("y", 0, 40)], "pair string, a int, b int")
    got = {(r["a"], r["b"]): (r["k"], r["p"], r["q"]) for r in splits.best_cuts(p, segs, K, 5).collect()}
    assert got == {(0, 40): (20, 0, 1), (15, 40): (20, 0, 1)}
    assert splits.best_cuts(p, segs, K, 30).count() == 0
