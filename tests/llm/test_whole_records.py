"""Whitening, exact dedup and periodic runs against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import exact, mixing, periodic, runs, substring, suffix, warc, whitening
from keelson.session import scratch_path

SF = "/root/testdata/sf0.001"


def brute_runs(s):
    """Maximal repetitions by trying every period at every place."""
    n, out = len(s), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            if j - i >= p:
                w = s[i : j + p]
                if not any(w[q:] == w[: len(w) - q] for q in range(1, p)):
                    out.add((i, j + p - i, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_document(text):
    w = (text or "").encode().split()
    runs = [r for r in brute_runs(w) if r[1] >= max(12, 2 * r[2])]
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(w), len(runs), *head, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), sha(kept))


def test_runs_of_random_sequences():
    rng = random.Random(4)
    for _ in range(800):
        n, k = rng.randint(0, 40), rng.choice([1, 2, 3, 5])
        s = [rng.randint(1, k) for _ in range(n)]
        if n and rng.random() < 0.4:
            a, p = rng.randrange(n), rng.randint(1, 8)
            s = [s[i] if i < a else s[min(n - 1, a + (i - a) % p)] for i in range(n)]
        assert [tuple(r) for r in periodic.maximal_runs(s).tolist()] == brute_runs(s), s


def test_extension_is_the_longest_common_prefix():
    rng = random.Random(8)
    s = [rng.randint(1, 2) for _ in range(70)]
    tree = periodic.SuffixTree(s)
    pairs = [(i, j) for i in range(70) for j in range(70) if i != j]
    got = tree.extension(np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))
    for (i, j), found in zip(pairs, got.tolist()):
        k = 0
        while max(i, j) + k < 70 and s[i + k] == s[j + k]:
            k += 1
        assert found == k
    assert np.argsort(tree.rank).tolist() == sorted(range(71), key=lambda i: s[i:])


def run_rows():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeiéust") for _ in range(rng.randint(1, 4)))
    rows = [(None, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "x " * 11), (5, "x " * 12), (6, "a b c d e f " * 2), (7, "a b c d e f g " * 2)]
    for i in range(8, 40):
        w = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            a = rng.randrange(len(w) + 1)
            w[a:a] = [word() for _ in range(rng.randint(1, 9))] * rng.randint(1, 5) + (["t"] * 13 if i % 4 == 0 else [])
        rows.append((i, "\n".join(w[: len(w) // 2]) + "  " + " ".join(w[len(w) // 2 :])))
    passage = " ".join(word() for _ in range(30))
    rows += [(40, passage + " apart " + passage), (41, passage + " " + passage + " " + passage[:9]), (41, rows[12][1]), (None, "b c " * 9)]
    rows += [(50, " ".join(f"w{i % 4001}" for i in range(20_000)))]
    return rows


def test_periodic_runs(spark):
    rows = run_rows()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, start string, more int")
    got = periodic.periodic_runs(df)
    assert got.columns == ["doc_id", "text", "more", *periodic.ADDED]
    short = [r for r in rows if len(r[1] or "") < 20_000]
    found = got.drop("text", "more").collect()
    assert sorted((tuple(r) for r in found if r.n_words < 5000), key=str) == sorted(((i, *brute_document(t)) for i, t in short), key=str)
    long = next(r for r in found if r.doc_id == 50)
    assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 20_000, 4001)
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_periodic_query(spark):
    wanted = []
    for i, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w = (text or "").encode().split()
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        if len(w) < 1500:
            wanted.append((i, *brute_document(b" ".join(w).decode())))
    names = ["doc_id", *periodic.ADDED]
    got = [tuple(r) for r in periodic.query(spark, SF).select(*names).where("n_words < 1500").collect()]
    assert sorted(got) == sorted(wanted) and any(r[2] for r in got)


def test_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 77, 5000):
        keys = rng.integers(0, 1 << 63, (n, 4)).astype(np.uint64)
        found = exact.PerfectHash.build(keys)
        assert sorted(found.slots(keys).tolist()) == list(range(n))
        others = found.slots(rng.integers(0, 1 << 63, (100, 4)).astype(np.uint64))
        assert others.min() >= -1 and others.max() < max(1, n)


def test_exact_dedup(spark):
    rng = random.Random(9)
    rows = [(None, None), (None, ""), (3, ""), (3, ""), (4, "é" * 90_000), (5, "é" * 90_000), (None, "only"), (None, "only"), (7, "A"), (8, "a"), (-(2**63), "a ")]
    rows += [(100 + i, f"text {rng.randrange(40)}") for i in range(150)] + [(300 + i, "hot") for i in range(150)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, more int").repartition(5)
    got = exact.mark_repeats(exact.digested(df))
    assert got.columns == ["doc_id", "text", "more", *exact.ADDED]
    got = got.collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(rows, key=str)
    stay = {}
    for r in got:
        ids = groups[r.text or ""]
        assert r.keep_id == max((i for i in ids if i is not None), default=None) and r.group_size == len(ids)
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        if r.kept:
            assert r.doc_id == r.keep_id
            stay[r.text or ""] = stay.get(r.text or "", 0) + 1
    assert stay == dict.fromkeys(groups, 1)
    assert exact.mark_repeats(exact.digested(df.limit(0))).count() == 0


def test_exact_dedup_against_an_earlier_index(spark):
    old = spark.createDataFrame([(1, "a"), (9, "b"), (9, "c"), (9, "c")], "doc_id long, text string")
    new = spark.createDataFrame([(5, "a"), (5, "b"), (5, "d"), (6, "d")], "doc_id long, text string")
    slim = exact.digested(old).select(F.unhex("text_sha256").alias("digest"), F.col("doc_id").alias("id"), F.col("doc_id").alias("place"))
    index = exact.build_index(exact.groups_of(slim), 3)
    assert sum(len(bytes(r.digests)) for r in index.collect()) == 3 * 32
    got = exact.mark_repeats(exact.digested(new), history=index).collect()
    assert sorted((r.doc_id, r.text, r.keep_id, r.group_size, r.kept) for r in got) == [
        (5, "a", 5, 2, True), (5, "b", 9, 2, False), (5, "d", 6, 2, False), (6, "d", 6, 2, True)]


def checked(got, vectors, wanted):
    """Compare with a dense eigenproblem; vectors that take part are given by id."""
    x = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v in vectors.items()}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(0)
    c = fit - sums / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    assert {(r.vec_id, r.component) for r in got} == {(i, k + 1) for i in x for k in range(wanted)}
    signs = {}
    for r in got:
        k = r.component - 1
        plain = float((x[r.vec_id] - sums / n) @ u[:, k] / np.sqrt(e[k]))
        sign = signs.setdefault(k, 1 if plain * r.whitened >= 0 else -1) if abs(plain) > 1e-6 else signs.get(k, 1)
        assert abs(sign * r.whitened - plain) < 1e-9
        assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[r.vec_id], sums))
        assert abs(r.explained / (e[k] / np.trace(v)) - 1) < 1e-9 and r.identity_error < 1e-9
    return e, u


def test_whitening(spark):
    rng = np.random.default_rng(3)
    good = {i: [float(a) for a in np.float32(rng.standard_normal(9) * np.linspace(0.2, 1.5, 9))] for i in range(60)}
    rows = [(i, v, "x", 1) for i, v in good.items()] + [(i, good[i % 3], "x", 2) for i in range(100, 140)]
    bad = [None, [], [1.0] * 8, [1.0] * 8 + [None], [float("nan")] + [1.0] * 8, [1.0] * 8 + [float("-inf")]]
    df = spark.createDataFrame(rows + [(200 + i, v, "x", 3) for i, v in enumerate(bad)], "vec_id long, embedding array<float>, n string, more int")
    got = whitening.whiten(df.repartition(3))
    assert got.columns == ["vec_id", "embedding", "more", *whitening.ADDED.names]
    checked(got.collect(), good | {i: good[i % 3] for i in range(100, 140)}, 4)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id in (0, 102, 105)").withColumn("embedding", F.array(F.lit(1.0)))).count() == 0
    two = whitening.whiten(df.where("vec_id < 60").withColumn("embedding", F.slice("embedding", 1, 2)))
    checked(two.collect(), {i: v[:2] for i, v in good.items()}, 2)
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), -2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<double>"))
    checked(line.collect(), {i: [float(i), -2.0 * i, 5.0] for i in range(9)}, 1)
    huge = whitening.whiten(spark.createDataFrame([(i, [float(i), (-1.0) ** i * 1e300]) for i in range(4)], "vec_id long, embedding array<double>"))
    assert {(r.n, r.deviation) for r in huge.collect()} == {(4, None)}


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    checked(whitening.query(spark, SF).collect(), {r.vec_id: r.embedding for r in rows}, 4)


@pytest.mark.parametrize("d", [1, 3, 20, 90, 400])
def test_jacobi_davidson(d):
    rng = np.random.default_rng(d)
    x = rng.standard_normal((500, d)) * np.linspace(1, 1.3, d)
    a = x.T @ x / 500
    values, vectors = whitening.jacobi_davidson(lambda q: a @ q, d, 4)
    e = np.linalg.eigvalsh(a)[::-1][: min(4, d)]
    assert np.abs(values - e).max() < 1e-12 * e[0] * d
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-11 * e[0]


def test_jacobi_davidson_equal_values():
    a = np.diag([5.0, 5.0, 5.0, 5.0, 5.0, 1.0, 0.0, 0.0])
    values, vectors = whitening.jacobi_davidson(lambda q: a @ q, 8, 4)
    assert np.abs(values - 5).max() < 1e-12 and np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12


def test_minres():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    b = rng.standard_normal((30, 3))
    b[:, 1] = 0
    shift = np.array([0.5, 0.0, 3.0])
    x = whitening.minres(lambda z: a @ z - z * shift, b, 90, 1e-12)
    assert np.abs(a @ x - x * shift - b).max() < 1e-6


def standard_record(kind, identity, body, *more):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{identity}>", "warc-date: 2024-01-01T00:00:00Z", *more, f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    """A gzip member a record, missing lengths and digests, repeated headers, several metadata records a capture, other kinds of records."""
    import base64
    import gzip

    http = "Content-Type: application/http; msgtype=response"
    big = b"x" * 3_000_000
    records = [
        standard_record("warcinfo", "w", b"software: some\r\n", "Content-Type: application/warc-fields"),
        standard_record("request", "q1", b"GET /a HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <urn:uuid:r1>", "WARC-Concurrent-To: <urn:uuid:r2>"),
        standard_record("response", "r1", b"HTTP/1.1 200 OK\r\n\r\n\xff\r\n\r\nbody", http, "WARC-Target-URI: http://a/"),
        standard_record("response", "r2", b"HTTP/1.1 200 OK\r\ncontent-length: 3000000\r\n\r\n" + big, http),
        standard_record("metadata", "m1", b"a: 1", "WARC-Concurrent-To:<urn:uuid:r1>"),
        standard_record("metadata", "m2", b"b: \xff", "WARC-Concurrent-To: <urn:uuid:r1>"),
        standard_record("revisit", "v1", b"HTTP/1.1 304 Not Modified\r\n\r\n", http, "WARC-Payload-Digest: sha1:ABC"),
        standard_record("resource", "o1", b"\x00\x01", "Content-Type: image/png"),
        standard_record("response", "d1", b"a.example. 1 IN A 1.2.3.4", "Content-Type: text/dns"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records[:4])) + b"\0\0")
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(records[4:7])))
    (tmp_path / "c.warc").write_bytes(b"".join(records[7:]))
    (tmp_path / "d.warc.gz").write_bytes(b"")
    found = warc.read_warc(spark, str(tmp_path))
    rows = {r.record_id[10:-1]: r for r in found.collect()}
    assert set(rows) == {"w", "q1", "r1", "r2", "m1", "m2", "v1", "o1", "d1"}
    assert (rows["r1"].payload_bytes, bytes(rows["r1"].payload)) == (9, b"\xff\r\n\r\nbody")
    assert rows["r2"].payload_digest == base64.b32encode(hashlib.sha1(big).digest()).decode()
    assert (rows["v1"].payload_bytes, rows["v1"].payload_digest, rows["v1"].payload) == (None, "ABC", None)
    assert bytes(rows["o1"].payload) == b"\x00\x01" and bytes(rows["d1"].payload).endswith(b"1.2.3.4")
    got = {r.record_id[10:-1]: r for r in warc.captures(found).collect()}
    assert set(got) == {"r1", "r2", "v1", "d1"}
    assert got["r1"].request.record_id == got["r2"].request.record_id == "<urn:uuid:q1>" and got["v1"].request is None
    assert got["r1"].metadata.info == "a: 1" and [o.record_id for o in got["r1"].others] == ["<urn:uuid:m2>"]
    assert got["r2"].metadata is None and got["r2"].others == []


@pytest.mark.parametrize("cut", [1, 10, 300])
def test_broken_archives_are_errors(cut):
    import gzip

    whole = standard_record("response", "r", b"HTTP/1.1 200 OK\r\n\r\nbody " + bytes(range(256)), "Content-Type: application/http")
    read = lambda data: list(warc._records(warc._inflated(memoryview(data))))
    assert len(read(gzip.compress(whole) * 3)) == len(read(whole * 3)) == 3
    with pytest.raises(ValueError):
        read(gzip.compress(whole)[:-cut])
    with pytest.raises(ValueError):
        read(whole[:-cut])


def test_anchor_buckets_are_even(spark):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 123, 400_000).astype(np.uint8)).decode()
    group = suffix._Group(pa.table({"doc_id": pa.array([1]), "text": pa.array([text])}), "doc_id", "text")
    keys = np.unique(group.anchors()[0])
    for buckets in (16, 128):
        sizes = np.bincount((keys >> np.uint64(64 - buckets.bit_length() + 1)).astype(int), minlength=buckets)
        assert sizes.max() < 2 * sizes.mean()


def test_suffix_anchors_are_found_once_and_in_whole_documents(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffix, "SEGMENT", 300)
    hashed = []
    grams = suffix.gram_hashes
    monkeypatch.setattr(suffix, "gram_hashes", lambda words, n: hashed.append(len(words)) or grams(words, n))
    rng = np.random.default_rng(11)
    sizes = [0, 1, 49, 50, 51, 0, 700, 120, 0]
    texts = [bytes(rng.integers(97, 99, n).astype(np.uint8)).decode() for n in sizes] + ["a" * 130, "abc" * 40, ""]
    ids = pa.array(range(len(texts)), pa.int64())
    group = suffix._Group(pa.table({"doc_id": ids, "text": pa.array(texts)}), "doc_id", "text")
    keys = np.unique(group.anchors()[0])
    answer = np.packbits(np.ones(len(keys), bool)).tobytes()
    replies = pa.Table.from_arrays([pa.array([0], pa.int32()), pa.array([1], pa.int32()), pa.array([0], pa.int32()), pa.array([answer])], schema=suffix.runs.REPLY_SCHEMA)
    found = group.suffixes(replies, 1)
    assert len(hashed) <= -(-len(group.buf) // 300)  # before: once for the question and twice for the suffixes
    # Every start of a whole string in one stretch, and its anchor the first smallest hash, as in a plain search.
    every = grams(suffix.BYTE[group.buf], suffix.GRAM) & ~suffix._PLACE
    want, base = [], 0
    for text in texts:
        for i in range(base, base + len(text) - suffix.LENGTH + 1):
            want.append((i, i + int(np.argmin(every[i : i + suffix.SPAN]))))
        base += len(text)
    got = [(i, p) for p, a, e in zip(found.place.tolist(), found.first.tolist(), found.last.tolist()) for i in range(a, e + 1)]
    assert got == want
    whole = group.buf.tobytes()
    for row, place, a, e in zip(found.rows, found.place, found.first, found.last):
        after, before = whole[place : e + suffix.LENGTH], whole[a:place][::-1]
        assert row[: suffix.LENGTH].tobytes() == after.ljust(suffix.LENGTH, b"\0")
        assert row[suffix.LENGTH : -2].tobytes() == before.ljust(suffix.BACK, b"\0")


def test_mixing_ranks_rows_without_ids_alike_in_any_order(spark):
    rows = [(None if i % 3 else 7, f"s{i % 2}", f"word{i} and more", {"k": i}) for i in range(60)]
    found = set()
    for order in range(3):
        random.Random(order).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, source string, text string, m map<string,int>").repartition(1 + 2 * order)
        out = mixing.mix(mixing.sized(df)).select("text", "copies").collect()
        found.add(tuple(sorted((r.text, r.copies) for r in out)))
    assert len(found) == 1 and {c for _, c in next(iter(found))} == {1, 2}


def test_mixing_comes_near_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(mixing.sized(docs.select("doc_id", "source", "text"))).groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")
    )
    for r in got.collect():
        assert abs(r.taken - r.target) <= 2 * r.most and r.over <= 0


def test_equal_rows_are_dealt_evenly(spark, tmp_path):
    """Repeats of one row, null ones too, fill all groups, whether read from files or made by a plan."""
    rows = [(7, "one two " * 40)] * 3000 + [(None, None)] * 3000
    made = spark.createDataFrame(rows, "doc_id long, text string")
    made.repartition(3).write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    for df in (made, read.where("doc_id is null or doc_id > 1").select("text", "doc_id"), read.groupBy("doc_id", "text").count()):
        dealt, _ = runs.grouped(df, "text", 64_000, 64_000)
        assert dealt.drop(runs.GROUP).columns == df.columns
        if df is not made and "count" in df.columns:
            assert dealt.count() == 2
            continue
        sizes = [r["count"] for r in dealt.groupBy(runs.GROUP).count().collect()]
        assert sum(sizes) == 6000 and len(sizes) >= 16 and max(sizes) < 1.5 * 6000 / len(sizes)
    got = substring.dedup_substrings(read, group_bytes=64_000).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, got), key=str) == [(7, 80, 0, 3000), (None, 0, 0, 3000)]
