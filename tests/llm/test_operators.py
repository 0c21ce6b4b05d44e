import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, licenses, media, mixing, toxicity, warc


# mixing


def brute_targets(sizes):
    """Water filling by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def mix_rows():
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(0, 60)), f"s{i % 5}" if i % 11 else None) for i in range(600)] + [(1000 + i, "hot " * int(rng.integers(1, 30)), "hot") for i in range(400)]
    return rows + [(2000, None, "s1"), (2001, "", "empty"), (1001, "hot hot", "hot"), (1001, "hot hot", "hot"), (None, "a b c", "s2"), (2002, "x y", "")]


def test_mixing_meets_its_targets(docs):
    rows = mix_rows()
    got = mixing.mix(docs(rows), leaf_rows=32, fan_in=4).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = brute_targets(dict(sizes)), defaultdict(int)
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((i, s) for i, _, s in rows)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]], abs=1e-6) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 62  # about one document


def test_mixing_reruns_agree_and_take_an_empty_table(docs):
    d = docs(mix_rows())
    one = sorted(map(repr, mixing.mix(d, leaf_rows=32).collect()))
    assert one == sorted(map(repr, mixing.mix(d.repartition(7), leaf_rows=32).collect()))
    assert mixing.mix(d.where("false")).count() == 0


def test_rows_of_one_id_spread_over_leaves(docs):
    rows = [(None, "w x y", "s") for _ in range(400)] + [(1, "w x y", "s") for _ in range(400)] + [(2, "z " * 500, "t")]
    whole = mixing._round

    def counted(seed, last):  # copies tell how many rows their leaf had
        one = whole(seed, last)
        return lambda pdf: one(pdf).assign(base=len(pdf))

    mixing._round = counted
    try:
        got = mixing.mix(docs(rows), leaf_rows=50, fan_in=8).collect()
    finally:
        mixing._round = whole
    assert len(got) == len(rows) and max(r["copies"] for r in got) < 110


def test_marginals_over_seeds(docs):
    rows = [(i, "w " * (1 + i % 7), "st"[i % 2]) for i in range(40)]
    d, total = docs(rows), Counter()
    for seed in range(25):
        for r in mixing.mix(d, seed=seed, leaf_rows=8, fan_in=4).collect():
            total[r["doc_id"]] += r["copies"]
    want = {i: min(2.0, r) for i, r in ((x["doc_id"], x["target"] / x["source_size"]) for x in mixing.mix(d).collect())}
    assert max(abs(total[i] / 25 - w) for i, w in want.items()) < 0.45
    assert abs(sum(total.values()) / 25 - sum(want.values())) < 1.5


def test_targets_of_many_sources_equal_brute_force(docs):
    rows = [(i, "w " * (1 + i * i % 37), f"h{i % 61}.example") for i in range(400)]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = brute_targets(dict(sizes))
    assert {r["source"]: pytest.approx(r["target"]) for r in mixing.mix(docs(rows)).collect()} == want


def test_pivotal_keeps_probabilities():
    p = np.array([0.3, 0.9, 0.5, 0.2, 0.6, 1.0, 0.0])
    rng = np.random.default_rng(1)
    draws = np.array([mixing.pivotal(p, rng, True) for _ in range(4000)])
    assert set(np.unique(draws)) <= {0.0, 1.0} and np.abs(draws.mean(0) - p).max() < 0.04
    assert set(draws.sum(1)) <= {3.0, 4.0}
    assert sum(0 < x < 1 for x in mixing.pivotal(p, rng)) <= 1


# media

ODD = [(1, "plain"), (2, None), (3, ""), (4, "é" * 700), (5, "x" * 576), (6, "plain"), (6, "plain"), (None, "null id"), (7, "<img src='a'>\x00\r\n"), (8, "long " * 60000)]


def test_media_round_trip(spark, docs, tmp_path):
    d = docs(ODD)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    got = media.op2_media(spark, str(tmp_path)).collect()
    assert len(got) == len(ODD)
    text = {i: (t or "").encode() for i, t in ODD}
    for r in got:
        raw = text[r["doc_id"]]
        size = 576 * max(1, -(-len(raw) // 576))
        data = raw + b"\xff" * (size - len(raw))
        whole = b"P5\n24 %d\n255\n" % (size // 24) + data
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), size, hashlib.sha256(data).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(data[-32:]), len(whole), hashlib.sha256(whole).hexdigest())
        assert (r["position"], r["caption"]) == (1, "payload")
        words = " ".join(x for x in media.BLANK.split(dict(ODD)[r["doc_id"]] or "") if x)
        assert (r["n_segments"], r["text_md5"]) == (4 if words else 3, hashlib.md5("\n".join(["document", *filter(None, [words])]).encode()).hexdigest())
    assert len({r["feature"] for r in got if r["doc_id"] in (1, 6)}) == 1


def test_sequences_keep_order_captions_and_missing_payloads(spark):
    html = "<h1>T</h1><p>one <b>two</b></p><figure><img src='media:sha256:aa'><figcaption>cap &amp; x</figcaption></figure><script>no</script><p>three<img src='b.png' alt='alt'>four</p>"
    seq = media.parse_html(html)
    assert [(s["position"], s["kind"], s["text"], s["ref"], s["caption"]) for s in seq] == [
        (0, "text", "T", None, None), (1, "text", "one two", None, None), (2, "media", None, "media:sha256:aa", "cap & x"), (3, "text", "three", None, None), (4, "media", None, "b.png", "alt"), (5, "text", "four", None, None),
    ]
    assert media.parse_html(None) == [] and media.parse_html("<p>") == []
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    feats = spark.createDataFrame([("aa", 1)], "digest string, payload_bytes long")
    got = media.resolve(media.sequences(pages, keep=("page_id",)), feats, ("page_id",)).orderBy("position").collect()
    assert [(r["page_id"], r["position"], r["caption"], r["payload_bytes"]) for r in got] == [(1, 2, "cap & x", 1), (1, 4, "alt", None)]


# warc


def test_warc_rejects_magic_inside_payloads(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    big = "<p>" + "y" * 1200 + "</p>"
    rows = [(1, "http://a", fake + "z" * 900), (2, "u\r\nv", big), (3, "u", big), (4, None, None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (8, "u", fake * 40), (9, "é", big), (9, "é", big), (None, "n", "q" * 1500), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = warc.write_archives(pages, str(tmp_path / "w"), archive_bytes=3000)
    got = warc.read_archives(spark, path, stride=2).collect()
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "")]
        top = max((j for j in same if j is not None), default=None)
        again = len(raw) >= 1000 and top is not None and (i is None or i < top)
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None))
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in cols) for r in got), key=repr) == sorted(want, key=repr)
    empty = warc.write_archives(pages.where("false"), str(tmp_path / "e"))
    assert warc.read_archives(spark, empty).count() == 0


def test_warc_reads_files_of_any_name(spark, tmp_path):
    import gzip

    def record(page, body):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + body
        return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (page, len(block), block)

    (tmp_path / "deep").mkdir()
    (tmp_path / "a.warc").write_bytes(record(1, b"x") + record(2, b""))
    (tmp_path / "deep" / "b.warc.gz").write_bytes(gzip.compress(record(3, b"y")) + gzip.compress(record(4, b"z\r\n")))
    (tmp_path / "notes.txt").write_bytes(b"no archive")
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in got) == [(1, 1), (2, 0), (3, 1), (4, 3)]


# licences


def brute_base(text):
    word = lambda c: c.isascii() and c.isalnum() or not c.isascii()
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = "".join(c if word(c) else " " for c in low).split(" ")
    w = [x for x in w if x]
    hits = [(i, lab) for p, lab in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


TEXTS = [
    "All rights reserved.", "x CC BY-NC 4.0 cc-by cc  by", "GNU General Public License, version 3. ALL RIGHTS reserved all rights", None, "", "général public license", "general public license",
    "Released under the MIT License.", "released under the other licence", "Licensed under the Apache License, Version 2.0.", "the " * 4000 + "cc by " + "of " * 10, "cc cc by by general general public license license",
]


def test_licence_base_equals_brute_force(docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, "cc by")]
    got = licenses.scan(docs(rows)).collect()
    text = dict(rows)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(text[r["doc_id"]])
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    by = {r["doc_id"]: r["labels"] for r in got}
    assert (by[7], by[8], by[9], by[3]) == ("mit", "", "apache-2.0", "")
    assert licenses.scan(docs(rows).where("false")).count() == 0


def test_matching_statistics_equal_brute_force():
    rng = np.random.default_rng(4)
    texts = {"a": (" ".join(rng.choice(list("abcd"), 30)),), "b": (" ".join(rng.choice(list("abcd"), 25)), "a b a b c")}
    s = licenses.Scanner(texts, {"a b": "x"})
    pieces = [t.split() for ts in texts.values() for t in ts] + [["a", "b"]]
    inside = {tuple(p[i:j]) for p in pieces for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
    w = [str(x) for x in rng.choice(list("abcde"), 400)]
    got = {p: n for p, _, n in s.statistics(np.array([s.ids.get(x.encode(), -1) for x in w]))}
    for i in range(len(w)):
        want = max((n for n in range(1, i + 2) if tuple(w[i - n + 1 : i + 1]) in inside), default=0)
        assert got.get(i, 0) == (want if want > 1 else 0)


def brute_cover(template, words, least, gap):
    """Greatest number of words of a chain, over single words of matches."""
    ok = set()
    for d in range(-len(template), len(words) + 1):
        run = []
        for j in range(len(template) + 1):
            i = j + d
            if j < len(template) and 0 <= i < len(words) and words[i] == template[j]:
                run.append((i, j))
            else:
                if len(run) >= least:
                    ok |= set(run)
                run = []
    best = {}
    for i, j in sorted(ok):
        best[i, j] = 1 + max((best.get((i - 1 - x, j - 1 - y), 0) for x in range(gap + 1) for y in range(gap + 1)), default=0)
    return max(best.values(), default=0)


CHAINS = [
    ({"t": ("a b c x y z a b c p q r",)}, "x y z foo a b c bar p q r", {"t": 0.75}),
    ({"one": ("k l m n o",), "two": ("l m n q r s",)}, "k l m n foo q r s", {"one": 0.8, "two": 1.0}),
    ({"t": ("a b c d e f",)}, "a b c c d e f", {"t": 1.0}),
    ({"t": ("a b c " + " ".join(f"g{i}" for i in range(30)),)}, "a b c " * 20 + " ".join(f"g{i}" for i in range(30)), {"t": 1.0}),
]


@pytest.mark.parametrize("case", CHAINS)
def test_chains_take_every_place_of_every_template(case):
    templates, text, want = case
    s = licenses.Scanner(templates, {})
    codes = np.array([s.ids.get(x.encode(), -1) for x in text.split()])
    assert {s.labels[t]: round(c, 6) for t, c, _, _ in s.chain(s.matches(s.statistics(codes)))} == want


@pytest.mark.parametrize("least", [1, 2, 3])
def test_chains_cover_as_much_as_a_brute_force_search(least):
    rng = np.random.default_rng(least)
    for _ in range(60):
        texts = {str(k): (" ".join(rng.choice(list("abcdef"), int(rng.integers(4, 14)))),) for k in range(3)}
        w = [str(x) for x in rng.choice(list("abcdefg"), 40)]
        s = licenses.Scanner(texts, {}, min_match=least, max_gap=2)
        codes = np.array([s.ids.get(x.encode(), -1) for x in w])
        got = {s.labels[t]: c for t, c, _, _ in s.chain(s.matches(s.statistics(codes)))}
        want = {k: brute_cover(t[0].split(), w, least, 2) / len(t[0].split()) for k, t in texts.items()}
        assert {k: got.get(k, 0.0) for k in want} == pytest.approx(want)


def test_phrases_of_one_word_count():
    got = licenses.Scanner({"t": ("x y z mit",)}, {"mit": "m", "x y": "xy"}).scan("mit mit x y q mit")
    assert (got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == (4, 0, 5, "m,xy")


# toxicity


def test_pu_learning_finds_held_out_toxic_documents(spark, docs):
    rng = np.random.default_rng(8)
    fill, bad = [f"fill{i}" for i in range(300)], ["vile", "gross", "nastyish"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        w = list(rng.choice(fill, 40))
        if toxic:
            w[int(rng.integers(40))] = str(rng.choice(bad))
            w[int(rng.integers(40))] = str(rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "fill1")]
    d, lab = docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, lab)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(d, model).collect()}
    held = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    hit = [(t, got[i] >= 0.7) for i, t in held]
    assert sum(p for t, p in hit if t) / sum(t for t, _ in hit) > 0.9 and sum(p for t, p in hit if not t) <= 2
    assert got[5000] == got[5001] < 0.5 and all(0 <= s <= 1 for s in got.values())
    none = toxicity.train(d, lab.where("toxic = 0"))
    assert none["weights"] == {} and toxicity.train(d, lab.where("false"))["weights"] == {}


def test_the_sample_is_bounded_and_reads_no_held_out_row(spark, docs):
    rows = [(i, f"word{i} common text", "s") for i in range(200)] + [(7, "other text of a repeated id"), (None, "null id")]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(100)] + [(3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    got, prior = toxicity.sample(docs(rows), labels, 10, 25)
    sides = Counter(r["side"] for r in got.collect())
    assert sides[1] == 10 and sides[0] <= 25
    free = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert prior == pytest.approx(sum(i < 60 for i in free) / len(free))
    named = [(i, "letters " + "abcdefghij"[i // 10] + "abcdefghij"[i % 10] * 2) for i in range(100)]
    whole, _ = toxicity.sample(docs(named), labels, 1000, 1000)
    seen = {f for r in whole.collect() for f in r["feats"] if len(f) == 3}
    assert seen == {t.split()[1] for i, t in named if zlib.crc32(str(i).encode()) % 3 != 1}
    assert toxicity.train(docs(rows).where("false"), labels)["weights"] == {}


def test_words_of_any_length_have_short_features():
    assert max(map(len, toxicity.features_of_word("x" * 5000))) <= toxicity.LONG_WORD
    assert toxicity.features_of_word("x" * 5000)[0] != toxicity.features_of_word("x" * 5001)[0]


def entries(rows):
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([x for r in rows for x in r], np.int64)


def slow_risk(x, pos, unl, prior):
    loss = lambda z, y: math.log1p(math.exp(-y * z))
    z = lambda r: x[-1] + sum(x[j] for j in r)
    plus = prior * sum(loss(z(r), 1) for r in pos) / len(pos)
    minus = sum(loss(z(r), -1) for r in unl) / len(unl) - prior * sum(loss(z(r), -1) for r in pos) / len(pos)
    return plus, minus


@pytest.mark.parametrize("scale", [0.3, 3.0])
def test_risk_and_gradient_equal_a_plain_reckoning(scale):
    rng = np.random.default_rng(3)
    pos = [sorted(rng.choice(6, int(rng.integers(0, 5)), replace=False).tolist()) for _ in range(9)]
    unl = [sorted(rng.choice(6, int(rng.integers(0, 5)), replace=False).tolist()) for _ in range(14)]
    for _ in range(10):
        x = scale * rng.standard_normal(7)
        plus, minus, g = toxicity.risk(x[:-1], x[-1], entries(pos), entries(unl), 9, 14, 0.4)
        want = slow_risk(x, pos, unl, 0.4)
        assert (plus, minus) == pytest.approx(want)
        part = (lambda y: sum(slow_risk(y, pos, unl, 0.4))) if minus >= 0 else (lambda y: -slow_risk(y, pos, unl, 0.4)[1])
        for k in range(7):
            step = 1e-5 * (np.arange(7) == k)
            assert g[k] == pytest.approx((part(x + step) - part(x - step)) / 2e-5, abs=1e-6)


def test_fit_reaches_the_least_risk_of_a_small_case():
    # one feature that all positives have, and a share of the unlabelled that is above the prior: the risk is convex, its least can be searched
    pos, unl, prior = [[0]] * 4, [[0]] * 5 + [[]] * 5, 0.3
    w, b = toxicity.fit_nnpu(entries(pos), entries(unl), 4, 10, 1, prior, steps=3000, rate=0.02, l2=0.0)
    best = min(sum(slow_risk((x, y), pos, unl, prior)) for x in np.linspace(-1, 12, 66) for y in np.linspace(-12, 1, 66) if slow_risk((x, y), pos, unl, prior)[1] >= 0)
    plus, minus = slow_risk((w[0], b), pos, unl, prior)
    assert plus + minus <= best + 0.01 and minus >= -0.01


# bpe


def test_bpe_equals_the_library(docs):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    lib = Tokenizer.from_file(path)
    texts = ["", None, "Hello  world\n\n x", "x" * 3000, "<|endoftext|>a <|endoftext|>", "日本語の。長い文 と " * 200, " " * 400 + "a", "I'm you'll 'S 've", " x　y\x1cz \x85", "ab cd " * 9000, "😀 👩‍👩‍👧 é́"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "null id")]
    for limits in ({}, {"mask": 1, "most": 9, "cache": 5}):
        for r in bpe.encode_documents(docs(rows), with_ids=True, **limits).collect():
            text = dict(rows)[r["doc_id"]] or ""
            ids = lib.encode(text, add_special_tokens=False).ids
            assert r["ids"] == ids and r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(docs(rows).where("false")).count() == 0


def test_chunks_are_shared_and_bounded():
    e = bpe.Encoder(bpe.Codec(bpe.default_vocabulary()))
    passage = " ".join(f"word{i}" for i in range(600))
    e.encode("head one " + passage)
    first = e.encoded
    e.encode("a different and longer head " + passage)
    assert e.reused > 0 and e.encoded - first < first
    raw = ("y" * 100_000).encode()
    cuts = [0, *bpe.cut_places(raw), len(raw)]
    assert max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) <= bpe.MAX_CHUNK


# chat


def test_chat_keeps_maximal_conversations(spark):
    rows = []
    talk = [("user", "hi"), ("bot", "hello"), ("user", None), ("bot", "")]
    for conv, n in ((1, 1), (2, 2), (3, 4), (4, 4), (5, 3)):
        rows += [(conv, k, *talk[k]) for k in range(n)]
    rows += [(6, 0, "user", "hi"), (6, 1, "bot", "other"), (None, 0, "user", "x"), (7, 0, "user", ""), (8, 0, "user", None), (9, 0, "user", "hi"), (9, 0, "user", "hi"), (10, 5, "user", "hi"), (11, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(9)).withColumn("n", F.lit(9))
    got = {r["conv_id"]: (r["n_turns"], r["chat"]) for r in chat.render(chat.maximal(df)).collect()}
    assert set(got) == {3, 6, None, 7, 8, 9, 11}
    assert got[3] == (4, "<|user|>\nhi<|end|>\n<|bot|>\nhello<|end|>\n<|user|>\n<|end|>\n<|bot|>\n<|end|>\n")
    assert chat.render(chat.maximal(df.where("false"))).count() == 0


def test_source_targets_of_one_source(docs):
    got = mixing.mix(docs([(1, "a b c", "only"), (2, None, "only")])).collect()
    assert {r["doc_id"]: r["size"] for r in got} == {1: 3, 2: 0} and all(math.isclose(r["target"], 4.5) for r in got)
