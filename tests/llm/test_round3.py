import hashlib
import random
import struct
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import audit, bpe, centroids, tokenfiles
from tidemark.llm.common import WORD, scratch_path

# centroids


def brute_lloyd(rows, k=16, rounds=3, dim=64):
    kept = [(i, [int(np.floor(np.float64(x) * 64)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [q for _, q in first]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        centres = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centres)]
    got = [(i, *near(q)) for i, q in kept]
    per = {}
    for _, d, n in got:
        per[n] = per.get(n, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((repr(i), n, d, per[n], sum(per.values()), sha[n]) for i, d, n in got)


def vectors(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.select("*", *[F.lit(1).alias(c) for c in ("q", "copies", "cluster", "distance")]) if extra else df


def result(df):
    return sorted((repr(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def test_centroids_equal_brute_force_on_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = (rng.standard_normal((60, 64)) * 0.2).astype(np.float32)
    rows = [(i, base[i % 50].tolist()) for i in range(90)] + [(200 + i, base[3].tolist()) for i in range(40)]
    rows += [(300, None), (301, []), (302, [0.1] * 63), (303, [None] + [0.1] * 63), (304, [float("nan")] + [0.0] * 63), (305, [float("inf")] * 64)]
    rows += [(306, [0.0] * 64), (307, [-0.0] * 64), (5, base[7].tolist()), (5, base[7].tolist()), (None, base[9].tolist()), (308, [1e6] * 64), (309, [-3.5e5] * 64)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert result(centroids.cluster(vectors(spark, rows, True))) == brute_lloyd(rows)


def test_centroids_few_vectors_ties_and_empty_tables(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(5)]
    assert result(centroids.cluster(vectors(spark, rows))) == brute_lloyd(rows)
    assert centroids.cluster(vectors(spark, [])).count() == 0
    assert centroids.cluster(vectors(spark, [(1, [1.0])])).count() == 0
    huge = result(centroids.cluster(vectors(spark, [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)])))
    assert [r[2] for r in huge] == [0, 0, 0]


def test_nearest_is_exact_beyond_doubles():
    x = np.array([[2**27, 1], [-(2**27), 0]], np.int64)
    c = np.array([[-(2**27), 0], [-(2**27), 1]], np.int64)
    at, d = centroids.nearest(x, c)
    assert at.tolist() == [1, 0] and d.tolist() == [2**56, 0]


def test_clusters_of_other_shapes(spark):
    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(50)]
    got = result(centroids.cluster(vectors(spark, rows), k=4, dim=2, rounds=5))
    assert got == brute_lloyd(rows, 4, 5, 2)


# token files


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_padding(), t.no_truncation()
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 2]


def token_rows():
    rng = random.Random(4)
    words = [f"wort{i}" for i in range(50)] + ["été", "日本", "😀", "a'll", "  ", "\n\n", "x" * 40, "<|endoftext|>"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(120)]
    return rows + [(500, None), (501, ""), (7, "again"), (7, "again"), (7, "other"), (None, "no id"), (-3, "negative"), (502, "long text \n" * 40_000)]


def want_tokens(rows):
    encode, start, out = library(), 0, []
    found = [(i, encode(t)) for i, t in rows]
    by_id = {}
    for i, ids in sorted(found, key=lambda r: (r[0] is not None, r[0] or 0)):
        by_id.setdefault(i, []).append(ids)
    for i, many in by_id.items():
        out.append((i, start, sorted((len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for x in many)))
        start += sum(map(len, many))
    return out


@pytest.mark.parametrize("block", [300, 1 << 24])
def test_token_files_read_back(spark, docs, block):
    rows = token_rows()
    path = tokenfiles.write_files(docs(rows).repartition(5), scratch_path(spark, "t"), block_bytes=block)
    got = {}
    for r in tokenfiles.read_counts(spark, path).orderBy("start").collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"], r["ids_crc32"]))
    assert sorted(((i, rs[0][0], sorted(r[1:] for r in rs)) for i, rs in got.items()), key=lambda r: r[1]) == want_tokens(rows)
    for rs in got.values():  # documents of one id stand one behind another
        assert all(a[0] + a[1] == b[0] for a, b in zip(rs, rs[1:], strict=False))
    ids = library()
    some = {r["doc_id"]: r["ids"] for r in tokenfiles.read_ids(spark, path, [500, 502, 3]).collect()}
    assert some == {i: ids(dict(rows)[i]) for i in (500, 502, 3)}
    assert tokenfiles.read_ids(spark, path).count() == len(rows)


def test_reruns_write_the_same_blocks_and_an_empty_table_none(spark, docs):
    rows = token_rows()
    paths = [tokenfiles.write_files(docs(rows).repartition(n), scratch_path(spark, "t"), block_bytes=2000) for n in (2, 6)]
    blocks = [sorted(bytes(r[0]) for r in tokenfiles._blocks(spark, p).collect()) for p in paths]
    frames = [{(d, x.ids(i)) for b in bs for x in [tokenfiles.Block(b, tokenfiles.read_dictionary(spark, p))] for i, d in enumerate(x.doc_ids)} for bs, p in zip(blocks, paths, strict=True)]
    assert frames[0] == frames[1] and len(blocks[0]) > 5
    none = tokenfiles.write_files(docs([(1, "x")]).where("false"), scratch_path(spark, "t"))
    assert tokenfiles.read_counts(spark, none).count() == 0 and tokenfiles.read_ids(spark, none).count() == 0


def test_dictionary_is_shared_and_told_apart(spark, docs):
    rows = [(i, f"the ship number {i} left the old harbour before {i % 7} in the morning") for i in range(3000)]
    d = docs(rows)
    trained = tokenfiles.train(d)
    assert trained[:4] == b"\x37\xa4\x30\xec" and tokenfiles.train(d.repartition(3)) == trained
    size = lambda z: tokenfiles.encode_frames(d, z).agg(F.sum(F.length("frame"))).first()[0]
    assert size(trained) < 0.6 * size(b"")
    block = tokenfiles.pack_block(0, 0, [1], [1], [b"x"], hashlib.sha256(trained).digest())
    with pytest.raises(ValueError):
        tokenfiles.Block(block, b"another")
    with pytest.raises(ValueError):
        tokenfiles.Block(b"NOTABLOK" + block[8:], trained)


# filter audit


def brute_counts(text):
    import re

    words = re.findall(WORD, text)
    return len(words), len(set(words)), sum("A" <= c <= "Z" for c in text), sum(c in "#$%&*|" for c in text), len(text)


def odd_texts():
    rng = random.Random(9)
    words = ["a", "b", "Wort", "ÄÖ", "日本", "$5", "x|y", "x" * 300, "X" * 300, " ", "　z", "é", "😀", "aa", "\x0b"]
    out = ["".join(rng.choice(words) + rng.choice(" \t\n\r\x0c\x1f") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    return out + [None, "", " ", "one", " \n\t", "ab" * 5000, "w " * 3000, "y" * 9000 + " " + "y" * 9000]


@pytest.mark.parametrize("piece", [64, 1000, 1 << 21])
def test_scan_equals_plain_counts(piece):
    texts = odd_texts()
    for array in (pa.array(texts), pa.array(["skipped", *texts])[1:], pa.array(texts, pa.large_string())):
        found, digests = audit.scan_texts(array, audit._Powers(), piece)
        assert list(zip(*(found[c].tolist() for c in audit.COUNTS), strict=True)) == [brute_counts(t or "") for t in texts]
        assert digests == [hashlib.sha256((t or "").encode()).digest() for t in texts]


def test_words_of_one_hash_are_told_apart():
    data = np.frombuffer(b"ab cd ab ef ab cd", np.uint8)
    starts, ends = audit.word_places(data, np.array([0, 9, 17]))
    doc = np.array([0, 0, 0, 1, 1, 1])
    none = np.zeros(6, np.uint64)
    assert audit.distinct_words(data, doc, starts, ends, none, 2).tolist() == [2, 3]


def audit_rows():
    rng = random.Random(2)
    rows = []
    for i in range(150):
        n = rng.choice([0, 5, 199, 200, 201, 400])
        some = ["word", "Other", "third"] + [f"w{j}" for j in range(rng.choice([1, 300]))]
        text = " ".join(rng.choice(some) for _ in range(n)) + rng.choice(["", "", " #", " LOUD LOUD LOUD"])
        rows.append((i, text, rng.choice(["en", "de", None, ""])))
    rows += [(1000 + i, rows[i % 5][1], "en") for i in range(40)] + [(3, rows[3][1], "fr"), (3, rows[3][1], "fr"), (None, rows[2][1], "de"), (2000, None, "en"), (2001, "", "xx")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (9999, 1, 1), (None, 1, 1), (1001, 1, 1)]
    return rows, labels


def brute_audit(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    mark = {}
    for i, q, x in labels:
        a, b = mark.get(i, (False, False))
        mark[i] = (a or q == 1, b or x == 1)
    parts, out = {}, {}
    for i, t, lang in rows:
        w, d, c, s, n = brute_counts(t or "")
        fails = {"A": w < 200, "B": 100 * d < 50 * w, "C": 100 * c > 3 * n, "D": s > 0, "E": i is not None and i > least[t or ""]}
        parts.setdefault(lang or "", []).append((fails, *(mark.get(i, (False, False)) if i is not None else (False, False))))
    for part, ds in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        own = {}
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                gone = lambda d, o=order[:k]: any(d[0][x] for x in o)
                here = [d for d in ds if d[0][f] and not gone(d)]
                total[f] += len(here)
                own["".join(order), k + 1] = [
                    sum(not gone(d) and not d[0][f] for d in ds), len(here), sum(d[0][f] and gone(d) for d in ds),
                    sum(d[0][f] and sum(d[0].values()) == 1 for d in ds), sum(d[1] for d in here), sum(d[2] for d in here),
                ]
        out |= {(part, o, k): (*v, total[o[k - 1]]) for (o, k), v in own.items()}
    return out


NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_equals_brute_force_and_sql(spark):
    rows, labels = audit_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    clash = docs.select("*", *[F.lit(1).alias(c) for c in ("part", "digest", "copy", "words", "mask", "n", "quality")])
    got = audit.interactions(audit.masks(clash, marks.withColumn("part", F.lit(2))), "ABCDE").collect()
    want = brute_audit(rows, labels)
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in NAMES) for r in got} == want and len(got) == len(want)
    duck = duckdb.connect()
    for name, df in (("documents", docs), ("labels", marks)):
        duck.register(name, df.toArrow())
    sql = duck.sql(audit.OP13_SQL)
    cols = sql.columns
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in NAMES) for r in (dict(zip(cols, x, strict=True)) for x in sql.fetchall())} == want


def test_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(audit.masks(docs, labels), "ABCDE").count() == 0
    one = spark.createDataFrame([(1, "x", None)], docs.schema)
    got = audit.interactions(audit.masks(one, labels), "ABCDE")
    assert got.count() == 600 and got.where("removed > 0").count() == 120


# queries as registered


def test_queries_take_odd_tables(spark, tmp_path):
    from tidemark.llm.queries import QUERIES

    rows, labels = audit_rows()
    full = [(i, t, lang, "s", 1, "x") for i, t, lang in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, mask string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    vectors(spark, [(1, [0.5] * 64), (2, None), (3, [0.5] * 64)], True).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {n: QUERIES[n](spark, str(tmp_path)) for n in ("op11_centroids", "op12_token_files", "op13_filter_audit")}
    assert got["op11_centroids"].count() == 2 and got["op12_token_files"].count() == len(rows)
    assert got["op13_filter_audit"].count() == 600 * len({lang or "" for _, _, lang in rows})
    assert got["op12_token_files"].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


# warc


def warc_record(i, payload):
    from tidemark.llm.warc import MAGIC

    http = b"HTTP/1.1 200 OK\r\n\r\n"
    head = MAGIC + b"WARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n" % (i, len(http) + len(payload))
    return head + http + payload + b"\r\n\r\n"


def test_warc_names_without_a_stem(spark, tmp_path):
    import gzip

    from tidemark.llm import warc

    for k, (name, zipped) in enumerate([("z", False), ("gz", True), ("A.GZ", True), ("b.gz", True), ("xz", False), ("agz", True)]):
        data = warc_record(k, b"p" * k)
        (tmp_path / name).write_bytes(gzip.compress(data) if zipped else data)
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in got) == [(k, k) for k in range(6)]


def test_quoted_heads_cost_what_they_are_long(tmp_path):
    import time

    from tidemark.llm import warc

    def took(n, far=10**9):
        quoted = b"".join(warc.MAGIC + b"Content-Length: %d\r\n\r\n" % (far + i) for i in range(n))
        data = warc_record(1, quoted) + warc_record(2, b"after")
        began = time.perf_counter()
        file = warc._File("f", 32)
        out = [b for piece in data.split(warc.NEXT.encode()) for b in file.piece(piece)] + list(file.known(True))
        rows = [r for b in out for r in b.to_pylist()]
        assert [(r["page_id"], r["payload_bytes"]) for r in rows] == [(1, len(quoted)), (2, 5)]
        assert rows[0]["payload_digest"] == hashlib.sha1(quoted).hexdigest()
        return time.perf_counter() - began

    took(500)
    few, many = min(took(1000) for _ in range(3)), min(took(16000) for _ in range(2))
    assert many < 40 * few + 0.5


@pytest.mark.parametrize("stretch", [1, 3, 4096])
def test_rows_of_an_archive_leave_in_stretches(stretch):
    from tidemark.llm import warc

    rng = random.Random(stretch)
    payloads = [rng.choice([b"", b"x" * 50, b"a\r\n\r\nb", b"\r\n", warc_record(9, b"inner"), warc.MAGIC + b"Content-Length: 3\r\n\r\nabc\r\n\r\n"]) for _ in range(200)]
    data = b"".join(warc_record(i, p) for i, p in enumerate(payloads))
    file, out, most = warc._File("f", 4, stretch), [], 0
    for piece in data.split(warc.NEXT.encode()):
        out += [r for b in file.piece(piece) for r in b.to_pylist()]
        most = max(most, len(file.rows))
    out += [r for b in file.known(True) for r in b.to_pylist()]
    by = {r["at"]: r for r in out}
    assert len(by) == len(out) and (stretch > 200 or most < 2 * stretch + 20)
    at, seen = 0, []
    while at is not None:  # every chain is whole, whatever the stretch
        for x in by[at]["path"]:
            seen.append((by[x]["page_id"], by[x]["payload_bytes"], by[x]["payload_digest"]))
        at = by[at]["jump"]
    assert seen == [(i, len(p), hashlib.sha1(p).hexdigest()) for i, p in enumerate(payloads)]
