"""The training-data operators against brute force, round trips and held-out labels, with odd rows in every table."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from syndromeframe.llm import common, components, hamming, html_text, langid, licenses, media, minhash, mixing, packing, quality, vectext, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, score double, count int"


def odd_docs(spark):
    """Null and empty texts, ties, repeated rows, null ids, very long texts, clashing columns."""
    long_text = "".join(f"Wort {i % 977} und satz.\n" for i in range(40_000))
    texts = [None, "", "   \n\t", "one", "one", "All rights reserved. CC-BY all rights RESERVED", long_text, "日本語 テスト ÀÉ \x1c\x85", "a" * 5000, "!!! ### $$$"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else "s", 0, "x", 0.5, i) for i, t in enumerate(texts)]
    rows += [(3, "one", "en", "s", 0, None, None, None), (None, "one", "en", "s", 0, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(spark):
    return {r.doc_id: r.text for r in docs(spark).collect()}


# --- op9 ---


def brute_simhash(text, n=4):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    parts = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius):
    """rows: (doc_id, fp); component by repeated merging."""
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc_id, _), g in zip(rows, group, strict=True):
        if doc_id is not None:
            least[g] = min(least.get(g, doc_id), doc_id)
    return [least.get(g) for g in group]


def test_simhash_and_components(spark):
    got = hamming.query(spark, SF).collect()
    t = texts(spark)
    rows = [(r.doc_id, int(r.fingerprint, 16)) for r in got]
    assert len(got) == len(t)
    assert all(fp == brute_simhash(t[i]) for i, fp in rows)
    assert [r.component_id for r in got] == brute_components(rows, 4)


@pytest.mark.parametrize("block", [4, 4096])
def test_links_of_dense_fingerprints(spark, block):
    rng = np.random.default_rng(3)
    centers = rng.integers(0, 1 << 63, 6)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.integers(0, 63, rng.integers(0, 5))) for c in centers for _ in range(60)})
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    edges = [(r.u, r.v) for r in hamming.links(df, 4, block=block).collect()]
    assert all((u ^ v).bit_count() <= 4 for u, v in edges) or edges
    roots = dict(zip(fps, fps, strict=True))

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for u, v in edges:
        roots[max(find(u), find(v))] = min(find(u), find(v))
    want = brute_components([(f, f) for f in fps], 4)
    assert [find(f) for f in fps] == want


def test_thresholds_are_complete():
    for radius in range(1, 9):
        costs = [[0.0, 5.0, 9.0, 30.0], [0.0, 1.0, 2.0, 4.0], [0.0, 7.0, 8.0, 9.0]]
        _, t = hamming.allocate(costs, radius)
        assert sum(x + 1 for x in t) == radius + 1


def test_keep_one_and_odd_rows(spark):
    odd = odd_docs(spark)
    found = hamming.components(odd).collect()
    assert len(found) == odd.count()
    kept = hamming.keep_one(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    # blank texts form one group, "one" another
    assert sorted(r.doc_id for r in rows if r.text in (None, "", "   \n\t")) == [0]
    assert sum(r.text == "one" for r in rows) == 1
    assert hamming.keep_one(empty_docs(spark)).count() == 0 == hamming.components(empty_docs(spark)).count()


def test_own_names_as_extra_columns(spark):
    names = ["own_key", "keep_id", "keep_key", "text_key", "sig", "fp", "cid", "rank", "rep", "comp", "size", "of", "n", "key", "id", "held_out", "lang_pred", "score", "share", "predicted", "position", "bucket", "h", "_p", "_id", "_own_hash", "_source", "row", "length", "low", "kept"]
    odd = odd_docs(spark).select("doc_id", "text", "lang", "source", *[F.concat(F.lit(f"{name}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(name) for name in names])
    all_rows = Counter(map(tuple, odd.collect()))
    labels = spark.createDataFrame([(3, 1, 0), (9, 0, 0), (6, 1, 0)], "doc_id bigint, quality int, toxic int").withColumn("rank", F.lit(1)).withColumn("n", F.lit(1))
    for got in (hamming.keep_one(odd), langid.known_language(odd), quality.good(odd, labels), mixing.interleaved(odd)):
        assert got.columns == odd.columns
        rows = Counter(map(tuple, got.collect()))
        assert rows and rows <= all_rows
    assert len(packing.pack_documents(odd).collect()) >= odd.count() == len(licenses.scan(odd).collect()) == len(minhash.neighbour_digests(odd).collect()) == len(hamming.components(odd).collect()) == len(mixing.schedule(odd).collect())
    assert len(langid.with_language(odd).collect()) == odd.count() == len(quality.with_quality(odd, labels).collect())


def test_near_groups_against_all_pairs(spark):
    rng = np.random.default_rng(21)
    words = [f"w{k}" for k in range(400)]
    rows, texts_ = [], []
    for _ in range(12):
        base = list(rng.choice(words, int(rng.integers(30, 160))))
        for _ in range(int(rng.integers(1, 7))):
            copy = list(base)
            for k in rng.integers(0, len(copy), int(rng.integers(0, 4))):
                copy[k] = str(rng.choice(words))
            texts_.append(" ".join(copy))
    rows = list(enumerate(texts_))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts_]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                lo, hi = sorted((group[i], group[j]))
                group = [lo if g == hi else g for g in group]
    want = [min(i for i, h in enumerate(group) if h == g) for g in group]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for block in (3,):
        got = {r.doc_id: r.group_id for r in hamming.near_groups(df, block=block).collect()}
        assert np.mean([got[i] == want[i] for i in range(len(rows))]) > 0.97
        assert all(group[i] == group[got[i]] for i in got)  # no false link
    assert sorted(r.doc_id for r in hamming.keep_one(df).collect()) == sorted(set(got.values()))


def test_near_groups_of_appended_cut_and_repeated_text(spark):
    rng = np.random.default_rng(8)
    texts_, kinds = [], []
    for k in range(120):
        base = [f"x{w}" for w in rng.integers(0, 5000, int(rng.integers(60, 200)))]
        more = [f"y{w}" for w in rng.integers(0, 5000, len(base) // 5)]
        copy = {"append": base + more, "cut": base[: len(base) - len(base) // 6], "repeat": base + base[:12] * 15}[kind := ("append", "cut", "repeat")[k % 3]]
        texts_ += [" ".join(base), " ".join(copy)]
        kinds.append(kind)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts_]
    alike = [len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    got = {r.doc_id: r.group_id for r in hamming.near_groups(spark.createDataFrame(list(enumerate(texts_)), "doc_id bigint, text string")).collect()}
    for kind in ("append", "cut", "repeat"):
        mine = [k for k in range(120) if kinds[k] == kind and alike[k]]
        assert len(mine) > 5 and all(got[2 * k + 1] == 2 * k for k in mine)
    assert all(got[2 * k + 1] == 2 * k + 1 for k in range(120) if not alike[k])


def test_connected_chains(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100)], "u bigint, v bigint")
    got = {r.node: r.root for r in components.connected(chain).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


# --- op3 ---


def shingle_set(text, n=5):
    w = re.findall(r"[^\t\n\x0b\x0c\r ]+", text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_minhash_digests(spark):
    t = texts(spark)
    order = sorted(t, reverse=True)
    nxt = {a: b for a, b in zip(order, order[1:] + order[:1], strict=True)}
    got = {r.doc_id: r for r in minhash.query(spark, SF).collect()}
    assert got.keys() == t.keys()
    errors = []
    for i, r in got.items():
        own, other = t[i], t[nxt[i]]
        k = len(own) // 3
        changed = own[: len(own) - k] + other[:k]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        for near, text in ((r.near_edited, changed), (r.near_next, other)):
            a, b = shingle_set(own), shingle_set(text)
            errors.append(near - (len(a & b) / len(a | b) if a | b else 1.0))
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.25


def test_minhash_odd_rows(spark):
    rows = minhash.neighbour_digests(odd_docs(spark)).collect()
    assert len(rows) == odd_docs(spark).count()
    same = {r.fingerprint for r in rows if r.n_chars == 3}
    assert len(same) == 1  # "one" everywhere
    assert minhash.neighbour_digests(empty_docs(spark)).count() == 0
    one = minhash.neighbour_digests(spark.createDataFrame([(1, "a b c d e f g")], "doc_id bigint, text string")).collect()
    assert one[0].near_next == 1.0


def test_near_groups_by_bands(spark):
    base = " ".join(f"w{i}" for i in range(300))
    near = base.replace("w150 ", "changed ")
    rows = [(1, base), (2, base), (3, near), (4, " ".join(f"v{i}" for i in range(300))), (5, None), (6, ""), (3, base), (None, near), (None, "alone")]
    for block in (2, 2048):
        got = minhash.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), block=block).collect()
        assert len(got) == len(rows)
        groups = sorted(((r.doc_id, r.group_id) for r in got), key=repr)
        assert groups == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (3, 1), (None, 1), (None, None)], key=repr)
    assert minhash.near_groups(empty_docs(spark)).count() == 0


def test_pivots_lose_no_link(spark):
    """Stars, chains and strangers in one bucket: blocks of every size give the components of all pairs."""
    rng = np.random.default_rng(31)
    words = [f"w{k}" for k in range(3000)]
    texts_ = []
    for _ in range(3):
        base = [str(w) for w in rng.choice(words, 200)]
        texts_.append(" ".join(base))
        for _ in range(25):  # copies of the original, each edited elsewhere
            copy = list(base)
            for k in rng.integers(0, 200, 3):
                copy[k] = str(rng.choice(words))
            texts_.append(" ".join(copy))
        for _ in range(12):  # a chain: each one is near the one before only
            for k in rng.integers(0, 200, 3):
                base[k] = str(rng.choice(words))
            texts_.append(" ".join(base))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for t in texts_]
    rows = list(enumerate(texts_))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                lo, hi = sorted((group[i], group[j]))
                group = [lo if g == hi else g for g in group]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for block in (8, 1024):
        got = {r.doc_id: r.group_id for r in minhash.near_groups(df, block=block).collect()}
        assert [got[i] for i in range(len(rows))] == group


def test_shingles_are_equal_for_equal_words():
    a = pa.array(["a b c d e f", "x", "", None, "b c d e f", "a  b\tc\nd e f"])
    got = {}
    for row, _, hashes, counts in minhash.shingle_hashes(a, 5):
        stops = np.cumsum(counts)
        got |= {row + k: hashes[s - c : s].tolist() for k, (s, c) in enumerate(zip(stops, counts, strict=True))}
    assert got[0] == got[5] and got[0][1:] == got[4] and got[2] == got[3] == [] and len(got[1]) == 1


def test_chunks_cover_long_rows():
    a = pa.array(["x" * 10, None, "y" * 100, "z"])
    parts = [(r, e, bytes(b)) for r, e, b, _ in vectext.chunks(a, 16)]
    assert b"".join(p[2] for p in parts) == b"x" * 10 + b"y" * 100 + b"z" and parts[-1][1] == 4


# --- op1 ---


def test_warc_round_trip(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 77\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    big = "<p>" + "x" * 2000
    rows = [(1, "http://a/ b\r\nX: y", fake * 3 + big), (2, None, big), (5, "u", big), (3, "u", big), (4, "u", None), (6, "u", "é" * 600), (5, "u", big), (None, "u", big), (7, "u", ""), (8, "u", "\r\n\r\nWARC/1.0\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, digest string")
    folder = common.new_path(spark, "t")
    warc.write(pages, folder)
    for block in (64, 1000, 1 << 20):
        got = warc.read(spark, folder, block).collect()
        ids = sorted(r.headers.get("X-Page-Id", "") for r in got)
        assert ids == sorted(str(i) if i is not None else "" for i, _, _ in rows)
        kinds = {r.headers.get("X-Page-Id"): r.headers["WARC-Type"] for r in got}
        assert kinds["2"] == kinds["3"] == "revisit" and kinds["5"] == "response" and kinds["1"] == "response"
        by_id = {r.headers.get("X-Page-Id"): r for r in got}
        assert bytes(by_id["1"].payload) == (fake * 3 + big).encode() and bytes(by_id["8"].payload) == b"\r\n\r\nWARC/1.0\r\n\r\n"
        assert by_id["2"].headers["X-Refers-To-Page"] == "5" and by_id["2"].headers["X-Payload-Length"] == str(len(big))


def test_many_magics_in_a_payload_cost_no_squares(tmp_path):
    import time

    took = []
    for n in (20_000, 80_000):
        payload = b"WARC/1.1\r\nx: y\r\n" * n
        path = tmp_path / f"{n}.warc"
        path.write_bytes(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload + b"\r\n\r\n")
        size = path.stat().st_size
        began = time.time()
        with warc._open(str(path)) as f:
            found = warc.candidates(f, 0, size, size)
        took.append(time.time() - began)
        assert found[0] == (0, size) and len(found) == 1
    assert took[1] < 12 * took[0] + 0.5


def test_headers_are_those_of_a_plain_parse():
    rng = np.random.default_rng(2)
    parts = [b"WARC/1.1\r\n", b"Content-Length: 12\r\n", b"content-length: 3\r\n", b"x: y\r\n", b"\r\n", b"\r\n\r\n", b"junk"]
    for _ in range(200):
        data = b"".join(parts[k] for k in rng.integers(0, len(parts), 30))
        headers = warc.Headers(data)
        for m in re.finditer(rb"WARC/1\.[01]\r\n", data):
            at = m.start()
            end = data.find(b"\r\n\r\n", at)
            n = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", data[at : end + 2]) if end >= 0 else None
            assert headers.at(at) == ((-1, -1) if end < 0 else (end + 4, int(n[1])) if n else None)


def test_warc_query(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in warc.query(spark, SF).collect()}
    assert got.keys() == pages.keys()
    for i, r in got.items():
        assert r.payload_bytes == len(pages[i]) and r.payload_digest == hashlib.sha1(pages[i]).hexdigest()


def test_warc_empty_and_truncated(spark, tmp_path):
    folder = common.new_path(spark, "t")
    warc.write(spark.createDataFrame([], "page_id bigint, url string, html string"), folder)
    assert warc.read(spark, folder).count() == 0
    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nok\r\n\r\nWARC/1.1\r\nContent-Length: 99\r\n\r\nshort")
    (tmp_path / "b.warc").write_bytes(b"junk WARC/1.1\r\nContent-Length: 2\r\n\r\nok\r\n\r\n")
    got = warc.read(spark, str(tmp_path), 16).collect()
    assert [bytes(r.payload) for r in got] == [b"ok"]


# --- op2, op4 ---


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = quality.query(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    known = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in known]) > 0.95
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1, 0), (9, 0, 0), (6, 1, 0), (3, 1, 0), (None, 0, 1), (77, None, 1)], "doc_id bigint, quality int, toxic int")
    rows = quality.with_quality(odd_docs(spark), labels).collect()
    assert len(rows) == odd_docs(spark).count() and all(0 <= r.score <= 1 for r in rows)
    none = quality.with_quality(odd_docs(spark), labels.filter("quality = 1")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.with_quality(empty_docs(spark), labels).count() == 0
    assert quality.good(odd_docs(spark), labels).columns == odd_docs(spark).columns


def test_marginals_match_enumeration():
    rng = np.random.default_rng(5)
    per_doc, trans = np.array([3, 0, 1, 4]), rng.normal(size=(2, 2))
    unary = rng.normal(size=8)
    good, expected, log_z = quality.marginals(unary, per_doc, trans)
    at, total, z_sum, pairs = 0, [], 0.0, np.zeros((2, 2))
    for n in per_doc[per_doc > 0]:
        p, z, tr = np.zeros(n), 0.0, np.zeros((2, 2))
        for y in np.ndindex(*[2] * n):
            w = np.exp(sum(unary[at + k] * y[k] for k in range(n)) + sum(trans[y[k], y[k + 1]] for k in range(n - 1)))
            z += w
            p += w * np.array(y)
            for k in range(n - 1):
                tr[y[k], y[k + 1]] += w
        total += list(p / z)
        z_sum += np.log(z)
        pairs += tr / z
        at += n
    assert np.allclose(good, total) and np.isclose(log_z, z_sum) and np.allclose(expected, pairs)


def plain_score(model, text):
    """A document's score line by line: features counted in Python, marginals by the chain's own recursion."""
    lines = [x for x in (text or "").split("\n") if x]
    kinds = list(quality._KINDS.values())

    def features(line):
        raw = line.encode()
        n = [sum(b in set(k) for b in raw) for k in kinds]
        words = re.findall(rb"[^\t\n\x0b\x0c\r ]+", raw)
        letters, m = max(n[0] + n[1] + n[4], 1), max(len(words), 1)
        again = sum(w in words[max(0, k - 2) : k] for k, w in enumerate(words))
        repeated = sum(w in words[:k] for k, w in enumerate(words))
        return np.array([*(c / len(raw) for c in n), n[0] / letters, np.log1p(len(raw)), letters / m / 10, again / m, repeated / m, float(raw[-1:] == b"."), np.log1p(m)])

    if not lines:
        return 1 / (1 + np.exp(-(model.slope * quality._logit(model.prior) + model.offset)))
    x = [(features(line) - model.mean) / model.sd for line in lines]
    zero = np.zeros(len(x[0]))
    unary = [float(np.concatenate([v, x[k - 1] if k else zero, x[k + 1] if k + 1 < len(x) else zero, [1]]) @ model.weights) for k, v in enumerate(x)]
    phi = [np.array([1.0, np.exp(u)]) for u in unary]
    e = np.exp(model.trans)
    alpha, beta = [phi[0] / phi[0].sum()], [np.ones(2)]
    for p in phi[1:]:
        a = (alpha[-1] @ e) * p
        alpha.append(a / a.sum())
    for p in phi[:0:-1]:
        b = e @ (p * beta[0])
        beta.insert(0, b / b.sum())
    good = [a[1] * b[1] / (a * b).sum() for a, b in zip(alpha, beta, strict=True)]
    size = [len(line.encode()) for line in lines]
    share = sum(g * n for g, n in zip(good, size, strict=True)) / sum(size)
    return 1 / (1 + np.exp(-(model.slope * quality._logit(share) + model.offset)))


def test_quality_scores_against_a_plain_version(spark):
    d = docs(spark)
    model = quality.learn(d.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r.score for r in quality.query(spark, SF).collect()}
    for r in d.collect():
        assert abs(got[r.doc_id] - plain_score(model, r.text)) < 1e-6, r.text[:100]


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = langid.query(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in got if r.held_out]) > 0.98


def test_language_odd_rows(spark):
    rows = langid.with_language(odd_docs(spark)).collect()
    assert len(rows) == odd_docs(spark).count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.text in (None, "", "   \n\t", "!!! ### $$$"))
    assert langid.with_language(empty_docs(spark)).count() == 0
    assert langid.known_language(odd_docs(spark)).columns == odd_docs(spark).columns


def test_letters_decide_und(spark):
    texts_ = {"😀😀😀": True, "١٢٣": True, "०१": True, "。、「」": True, "123 !?": True, "½ ² §": True, "ⁿ": False, "日本": False, "é": False, "x": False, "": True, None: True}
    known = [(100 + k, "the quick brown fox and the lazy dog of the town", "en") for k in range(20)]
    rows = [(k, t, None) for k, t in enumerate(texts_)]
    got = {r.text: r for r in langid.with_language(spark.createDataFrame(rows + known, "doc_id bigint, text string, lang string")).collect()}
    for t, und in texts_.items():
        assert (got[t].lang_pred == "und") == und, t
        assert not und or got[t].score == 0


def plain_grams(text):
    low = "".join(c.lower() if c.isalpha() else " " for c in text)
    raw = (" " + re.sub(" +", " ", low).lstrip() + "  ").encode()
    return [raw[i : i + 4] for i in range(len(raw) - 3)]


def brute_language(learned, text):
    """Share of each language's n-grams in the text from plain sets, without a filter."""
    found = plain_grams(text)
    return {name: sum(g in own for g in found) / max(1, len(found)) for name, own in learned.items()}


def test_predictions_are_those_of_plain_sets(spark):
    """Learned n-grams as plain sets give the same language on Latin text; the filter's corrected shares differ little."""
    d = docs(spark)
    model = langid.learn(d.filter(common.crc_fold("doc_id", 5) != 0))
    grams_of = {}
    rows = [r for r in d.collect() if r.lang and r.text]
    everything = {g for r in rows for g in plain_grams(r.text)}
    packed = np.array([int.from_bytes(g, "big") for g in sorted(everything)], np.uint32)
    bits = model.lookup(packed)
    for k, name in enumerate(model.languages):
        grams_of[name] = {g for g, b in zip(sorted(everything), bits[:, k // 8] >> (k % 8) & 1, strict=True) if b}
    got = {r.doc_id: r for r in langid.with_language(d).collect()}
    checked = 0
    for r in rows:
        share = brute_language(grams_of, r.text)
        best = sorted(share.values())[-2:]
        if len(best) > 1 and best[1] - best[0] > 0.02:
            checked += 1
            assert got[r.doc_id].lang_pred == max(share, key=share.get)
            assert abs(got[r.doc_id].share - max(share.values())) < 0.01, (r.text[:80], share)
    assert checked > 0.9 * len(rows)


def test_language_stage_rejects_what_it_does_not_know(spark):
    d = docs(spark).select("doc_id", "text", "lang")
    more = [(10**6, "日本語のテキストです。" * 20, None), (10**6 + 1, "1234 5678 !!", None), (10**6 + 2, None, None), (10**6 + 3, "qxzv kjwq zzxq vvkq " * 30, None)]
    kept = {r.doc_id for r in langid.known_language(d.unionByName(spark.createDataFrame(more, d.schema))).collect()}
    assert not kept & {m[0] for m in more} and len(kept) > 0.97 * d.count()


def test_known_language_without_labels(spark):
    d = docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert langid.known_language(d).count() == d.count() > 0


def test_bloom_filter_has_no_false_negative():
    rng = np.random.default_rng(1)
    sets = {k: rng.integers(0, 1 << 32, 3000, np.uint32) for k in ("a", "b", "c")}
    m = langid.build(sets)
    for k, name in enumerate(m.languages):
        assert ((m.lookup(sets[name])[:, 0] >> k) & 1).all()
    assert 0 < m.false_positive.max() < 0.05


# --- op5 ---


def test_token_ids_are_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))  # as loaded
    odd = ["It's we'LL DON'T o''s x'", "a\x1cb\x85c\xa0d", "naïve ÀÉÎ ½²3 45 × ÷ µª", "日本 テスト", "<|endoftext|>", "x <|endoftext|> y", "a<|StartOfText|>b <|startoftext|>", "", "é İstanbul ΑΣ ", "'", "\x00\x01 ''' ''s 's's", "ab" * 500, "!!'s ?'re'"]
    w = packing.WordIds()
    for _ in range(2):
        assert [x.tolist() for x in w.encode(odd)] == [t.encode(x, add_special_tokens=False).ids for x in odd]


def test_packing(spark):
    t = texts(spark)
    tok = packing._tokenizer(packing.TOKENIZER)
    ids = {i: np.array([*tok.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in t.items()}
    got = packing.query(spark, SF).collect()
    by_sequence = {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and len(part) == r.length and r.ids_crc32 == zlib.crc32(part.tobytes())
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    for s in by_sequence.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_sequence) <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_packing_levels_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    n = [int(x) for x in rng.integers(1, 4097, 3000)]
    rows = spark.createDataFrame(list(enumerate(n)), "row bigint, length bigint")
    got = packing.pack(rows, shard=1000).collect()
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + n[r.row]
    assert len(got) == 3000 and max(fill.values()) <= 4096
    assert len(fill) <= len(packing.best_fit(n, 4096)) * 1.01
    odd = packing.pack_documents(odd_docs(spark)).collect()
    assert len({(r.doc_id, r.piece, r.sequence_id, r.offset) for r in odd}) == len(odd) >= odd_docs(spark).count()
    assert packing.pack_documents(empty_docs(spark)).count() == 0


def test_local_search_tries_every_bin():
    """After it, no underfull bin has an exchange that its search would still make."""
    rng = np.random.default_rng(12)
    for _ in range(10):
        n = [int(x) for x in rng.integers(1200, 2200, 120)]
        bins = packing.improve(packing.best_fit(n, 4096), n, 4096)
        assert max(sum(n[k] for k in b) for b in bins) <= 4096 and sorted(k for b in bins for k in b) == list(range(120))
        search = packing._Search(bins, n, 4096)
        for v in search.open_bins().tolist():
            others = search.open_bins()
            others = others[(others != v) & (search.room[others] <= search.room[v])]
            if search.room[others].sum() >= 4096 - search.room[v] and len(bins) > -(-sum(n) // 4096):
                search.empty(v)
                assert search.bins[v]


def plain_exchange(bins, n, v, d, capacity):
    """The best gain of an exchange of document d of bin v by looking at every move, swap and two for one."""
    fill, best = [sum(n[k] for k in b) for b in bins], 0
    for i, b in enumerate(bins):
        if i != v and fill[v] <= fill[i] < capacity:
            backs = [()] + [(e,) for e in b] + [(e, g) for x, e in enumerate(b) for g in b[x + 1 :]]
            for back in backs:
                given = sum(n[k] for k in back)
                if given < n[d] and fill[i] + n[d] - given <= capacity:
                    best = max(best, n[d] - given)
    return best


def test_exchanges_are_the_best_ones():
    rng = np.random.default_rng(14)
    for _ in range(20):
        n = [int(x) for x in rng.integers(300, 2200, 40)]
        bins = packing.best_fit(n, 4096)
        search = packing._Search(bins, n, 4096)
        for v in search.open_bins().tolist():
            others = search.open_bins()
            others = others[(others != v) & (search.room[others] <= search.room[v])]
            for d in search.bins[v]:
                got = search.exchange(v, d, others)
                assert (got[0] if got else 0) == plain_exchange(search.bins, n, v, d, 4096)
            d = search.bins[v][0]
            if found := search.exchange(v, d, others):
                search.apply(v, d, *found)


def test_levels_go_on_while_they_save_bins(spark):
    for lengths in ([2460, 1230] * 1500, [3000, 900] * 1500):
        rows = spark.createDataFrame(list(enumerate(lengths)), "row bigint, length bigint")
        fill = {}
        for r in packing.pack(rows, shard=500).collect():
            fill[r.sequence_id] = fill.get(r.sequence_id, 0) + lengths[r.row]
        assert max(fill.values()) <= 4096 and sum(fill.values()) == sum(lengths)
        assert len(fill) <= len(packing.best_fit(lengths, 4096)) * 1.01


def test_windows_keep_the_order_of_rows(spark):
    for name, lengths in {"even": [2460, 1230] * 1500, "rising": [1200 + k // 4 for k in range(4000)], "mixed": np.random.default_rng(5).integers(1, 4097, 3000).tolist()}.items():
        rows = spark.createDataFrame([(k << packing.PIECE_BITS, n) for k, n in enumerate(lengths)], "row bigint, length bigint")
        seen = {}
        for r in packing.pack(rows, shard=600, window=F.floor(F.shiftright("row", packing.PIECE_BITS) / packing.WINDOW)).collect():
            seen.setdefault(r.sequence_id, []).append((r.offset, r.row >> packing.PIECE_BITS))
        placed = [sorted(s) for s in seen.values()]
        assert sorted(k for s in placed for _, k in s) == list(range(len(lengths)))
        for sequence, s in zip(seen, placed, strict=True):
            ends = [at + lengths[k] for at, k in s]
            assert [at for at, _ in s] == [0, *ends[:-1]] and ends[-1] <= 4096
            assert [k for _, k in s] == sorted(k for _, k in s) and s[0][1] << packing.PIECE_BITS == sequence
        if name != "rising":
            assert len(placed) <= len(packing.best_fit(lengths, 4096)) * 1.01


def test_pieces_keep_the_order_of_files(spark, tmp_path):
    """Positions are those of files and rows, not of the tasks that read them (large files come first there)."""
    long, short = "alpha beta gamma " * 3000, "delta epsilon"
    d = spark.createDataFrame([(k, f"{k} {short}" if k < 300 else f"{k} {long}") for k in range(400)], "doc_id bigint, text string")
    ranges = d.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").withColumn("more", F.lit(1))
    ranges.write.parquet(f"{tmp_path}/d.parquet")
    stored = spark.read.parquet(f"{tmp_path}/d.parquet")
    for rows in (stored, d, ranges):
        assert {(r.doc_id, r.position) for r in packing._placed(rows).collect()} == {(k, k) for k in range(400)}
    got = packing.pack_documents(stored, in_order=True).collect()
    plain = packing.pack_documents(stored).collect()
    own = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(tuple(r[c] for c in own) for r in got) == Counter(tuple(r[c] for c in own) for r in plain)
    first = [r.doc_id for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)) if r.piece == 0]
    assert len(first) == 400 and all(r.sequence_id >> packing.PIECE_BITS <= r.doc_id for r in got)
    for make in (odd_docs, empty_docs):
        odd = packing.pack_documents(make(spark), in_order=True)
        assert odd.columns == packing.pack_documents(make(spark)).columns
        assert Counter(r.doc_id for r in odd.collect() if not r.piece) == Counter(r.doc_id for r in make(spark).collect())


def test_local_search_only_improves():
    rng = np.random.default_rng(9)
    for _ in range(20):
        n = [int(x) for x in rng.integers(1200, 2200, 200)]
        first = packing.best_fit(n, 4096)
        better = packing.improve([list(b) for b in first], n, 4096)
        assert len(better) <= len(first) and sorted(k for b in better for k in b) == list(range(200))
        assert max(sum(n[k] for k in b) for b in better) <= 4096


# --- op6 ---


def test_article_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar"><header>Site</header><nav><a>One</a></nav>
    <div class="cookie-notice">Accept, please.</div><article><h1>Head &amp; line</h1><p>First,   <b>bold</b>&nbsp;text.<p>Second &#233;. <!-- no --> <a href="x>y">link</a></p><form>Name</form><ul><li>a<li>b</ul>
    <div class="comments"><p>Nice post, really.</p></div></article><aside>Buy, now.</aside><footer>(c)</footer></body></html>"""
    assert html_text.extract(page) == "Head & line\nFirst, bold text.\nSecond é. link\na\nb"


def test_ratios_without_article():
    body = "".join(f"<p>Paragraph {i}, with text, and more of it; it goes on for a while, as texts do.</p>" for i in range(8))
    page = f"<html><body><table><tr><td><a>x</a></td><td><a>y</a></td></tr></table><div><h2>Title</h2>{body}</div><ul><li><a>more</a></li><li><a>less</a></li></ul></body></html>"
    got = html_text.extract(page)
    assert got.startswith("Title\nParagraph 0") and "more" not in got.split("\n") and got.count("Paragraph") == 8


def test_broken_markup():
    assert html_text.extract(None) == "" == html_text.extract("")
    assert html_text.extract("a < b & c") == "a < b & c"
    for page in ("<p>a<b>b<p>c", "<div" * 1000, "<a href='" * 500, "</p></div>x", "<script>x", "<p>ok</p><!-- open", "<![CDATA[x]]>y"):
        assert isinstance(html_text.extract(page), str)
    assert html_text.extract("<article><p>cut &am") == "cut &am"


def test_main_text_query(spark):
    rows = html_text.query(spark, SF).collect()
    assert all(r.n_chars == len(r.text) for r in rows) and len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert html_text.main_texts(spark.createDataFrame([(1, "u", None, "c")], "page_id bigint, url string, html string, text string")).first().text == ""


# --- op7 ---

_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_license(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_AZ))
    starts, labels = [], set()
    for phrase, label in {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                starts.append(k)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_base(spark):
    sf = "/root/testdata/sf0.01"
    t = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in licenses.query(spark, sf).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(t[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_rules(spark):
    rows = [
        (1, "Licensed under the terms of the GNU Lesser General Public License, version 3.", "gpl,lgpl"),
        (2, "cc by cc by CC-BY-SA all all rights reserved rights", "cc-by,cc-by-sa,reserved"),
        (3, "Released under the MIT License and the Apache License, Version 2.0", "apache,mit"),
        (4, "the commitment license, admit licenses", ""),
        (5, None, ""),
        (6, "Permission is hereby granted, free of charge", "permissive-grant"),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, t, 7) for i, t, _ in rows], "doc_id bigint, text string, n_words int")).collect()}
    for i, t, want in rows:
        assert ",".join(sorted({d.label for d in got[i].detections} | set(got[i].base))) == want
        assert (got[i].n_words, got[i].n_base) == brute_license(t)[:2]
        spans = [(d.start, d.end) for d in got[i].detections]
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert len(licenses.scan(odd_docs(spark)).collect()) == odd_docs(spark).count()
    assert licenses.scan(empty_docs(spark)).count() == 0


def brute_detections(text):
    """(start, end, priority, label) by the rules' definition: all places, sorted, the first and longest, unless a better one overlaps it."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_AZ))
    low = "".join(f" {x} " for x in w)
    spans = []
    for label, key, priority, rx in licenses.rules():
        if key in low:
            for m in re.finditer(rx, low):
                start = low[: m.start()].count(" ") // 2
                spans.append((start, -(start + m[0].count(" ") // 2), -priority, label))
    kept = []
    for s in sorted(spans):
        if not kept or s[0] >= -kept[-1][1]:
            kept.append(s)
        elif s[2] < kept[-1][2]:
            kept[-1] = s
    return [(a, -b, -p, label) for a, b, p, label in kept]


def test_license_detections_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rng = np.random.default_rng(4)
    phrases = [re.sub(r"\(\?:([^)|]*)[^)]*\)\??", r"\1", rx) for _, _, _, rx in licenses.rules()]
    rows = [(k, " ".join(str(x) for x in rng.choice(phrases + ["of", "the"] * 40, 30))) for k in range(40)]
    rows += [(1000, "gpl lgpl agpl " * 1500), (1001, "all rights reserved cc by sa " * 900), (1002, "x" * 100_000), (1003, None), (1004, "")]
    rows += [(2000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts_ = dict(rows)
    found, some = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), 0
    for r in found:
        want = brute_detections(texts_[r.doc_id])
        assert [(d.start, d.end, d.priority, d.label) for d in r.detections] == want
        some += bool(want)
    assert some > 50 and len(found) == len(rows)


def test_license_labels_and_score_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    t = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in licenses.query(spark, sf).collect():
        want, base = brute_detections(t[r.doc_id]), brute_license(t[r.doc_id])
        labels = {d[3] for d in want} | set(filter(None, base[4].split(",")))
        assert r.labels == ",".join(sorted(labels))
        assert abs(r.score - max([50 if base[1] else 0, *(d[2] for d in want)]) / 110) < 1e-12


def test_license_rules_hold_their_keyword_and_a_stem():
    found = licenses.rules()
    assert len(found) > 400 and len(licenses.SINGLE) > 140
    for _, key, _, rx in found:
        assert key in rx or key in rx.replace("(?:", "").replace("|", "")
        assert any(stem in rx for stem in licenses.STEMS)


# --- op8 ---


def test_media_round_trip(spark):
    for rows in (docs(spark), odd_docs(spark)):
        folder = common.new_path(spark, "m")
        media.store(rows, folder)
        want = sorted(((r.text or "").encode() for r in rows.collect()))
        got = media.load(spark, folder, range_bytes=20_000).collect()
        assert sorted(bytes(r.payload).rstrip(b"\xff") for r in got) == want
        assert all(len(r.payload) % 576 == 0 and len(r.payload) > 0 and media.from_png(bytes(r.media)) == bytes(r.payload) for r in got)
    folder = common.new_path(spark, "m")
    media.store(empty_docs(spark), folder)
    assert media.load(spark, folder).count() == 0


def test_media_query(spark):
    t = texts(spark)
    for r in media.query(spark, SF).collect():
        raw = (t[r.doc_id] or "").encode()
        full = media.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))


def test_media_retries_a_member(monkeypatch, tmp_path):
    a = media._Archive(str(tmp_path))
    for k in range(3):
        a.add(f"{k}.png", str(k).encode(), media.to_png(media.padded(b"x%d" % k)))
    done = a.close()
    part, members = media.Range(done["path"], done["bytes"], 0, done["bytes"]), media.directory(done["path"], done["bytes"])
    calls, real = [], media.from_png

    def flaky(body):
        calls.append(len(body))
        if len(calls) == 2:
            raise ValueError("damaged")
        return real(body)

    monkeypatch.setattr(media, "from_png", flaky)
    rows = [r for b in media.ArchiveReader(str(tmp_path), 1, 2).read(part) for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == [0, 1, 2] and len(calls) == 4
    with open(done["path"], "r+b") as f:  # damage the second member for good
        f.seek(members[1][1] + members[1][2] + 20)
        f.write(b"\0\0\0\0")
    with pytest.raises(Exception):
        list(media.ArchiveReader(str(tmp_path), 1, 1).read(part))


def test_media_plans_by_bytes(spark):
    """The driver holds a few numbers a range, however many members there are, and ranges meet each member once."""
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("tiny").alias("text")).coalesce(2)
    folder = common.new_path(spark, "m")
    media.store(rows, folder)
    reader = media.ArchiveReader(folder, 20_000, 0)
    parts = reader.partitions()
    assert 2 < len(parts) < 60 and all(set(vars(p)) == {"path", "size", "start", "stop"} for p in parts)
    assert sorted(m[0] for p in parts for m in reader._members(p)) == list(range(3000))


def test_media_columns_are_of_the_stored_form(spark):
    """media_bytes, media_sha256 and feature against the image as another decoder of the format sees it."""
    folder = common.new_path(spark, "m")
    media.store(docs(spark), folder)
    stored = {r.doc_id: bytes(r.media) for r in media.load(spark, folder).collect()}
    for r in media.query(spark, SF).collect():
        png = stored[r.doc_id]
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        # the format read by its definition: chunks of length, kind, body, crc
        at, body = 8, b""
        while at < len(png):
            n = int.from_bytes(png[at : at + 4], "big")
            if png[at + 4 : at + 8] == b"IDAT":
                body += png[at + 8 : at + 8 + n]
            at += 12 + n
        lines = zlib.decompress(body)
        samples = b"".join(lines[k + 1 : k + 577] for k in range(0, len(lines), 577))
        assert hashlib.sha256(samples).hexdigest() == r.payload_sha256
        cuts = [k * len(samples) // 64 for k in range(65)]
        cells = [sum(samples[a:b]) / (b - a) for a, b in zip(cuts, cuts[1:])]
        mean = sum(cells) / 64
        bits = int("".join("1" if c > mean else "0" for c in cells), 2)
        assert r.feature.split("-")[0] == f"{bits:016x}" and abs(float(r.feature.split("-")[1]) - sum(samples) / len(samples)) < 0.001


# --- op10 ---


def test_pfair_windows_and_lag():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 12))
        slots = {str(k): int(rng.integers(1, 2 + 60 * rng.random() ** 3)) for k in range(n)}
        period, order = sum(slots.values()), mixing.edf(slots)
        assert sorted(t for v in order.values() for t in v) == list(range(period))
        for s, q in slots.items():
            for t in range(period + 1):
                assert abs(np.searchsorted(order[s], t) - t * q / period) < 1
            for i, t in enumerate(order[s]):
                assert i * period // q <= t and t + 1 <= -(-(i + 1) * period // q)


def test_lag_against_unrounded_targets():
    for blocks in ({"a": 100_003, "b": 61_001, "c": 7, "d": 1}, {str(k): 30_000 // (k + 1) + 1 for k in range(40)}):
        w = mixing.target_weights(blocks)
        plan = mixing.phases(blocks, w)
        for s in blocks:
            slots = np.concatenate([p.start + p.order[s] for p in plan if s in p.slots])
            assert len(slots) == blocks[s] and (np.diff(slots) > 0).all()
        p = plan[0]
        for s, order in p.order.items():
            k = np.arange(len(order))
            ahead, behind = k + 1 - (order + 1) * float(w[s]), order * float(w[s]) - k
            assert max(ahead.max(), behind.max()) < 1
    one = {f"s{k}": 5000 for k in range(20)} | {"": 1}
    assert sum(map(len, mixing.phases(one, mixing.target_weights(one))[0].order.values())) > 99_980  # a tiny source ends nothing


def test_schedule(spark):
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for weights in (None, {"src0": 0.5, "src1": 0.3, "src2": 0.2}):
        rows = mixing.schedule(d, weights, 4).collect()
        assert len(rows) == d.count() and len({r.position for r in rows}) == len(rows)
        assert all(r.release_slot <= r.slot < r.deadline_slot for r in rows)
        # a block that is not full counts as one, so targets are shares of blocks' documents
        w = weights or mixing.target_weights({r.source: r["count"] for r in d.groupBy("source").count().collect()})
        first = sorted({(r.slot, r.source) for r in rows if r.selected})
        seen = dict.fromkeys(w, 0)
        for k, (slot, s) in enumerate(first, 1):
            assert slot == k - 1
            seen[s] += 1
            assert all(abs(seen[x] - k * Fraction(w[x])) < 1 for x in w)


def test_null_and_repeated_sources(spark):
    """A null source and an empty name are two sources; equal rows share a row until they have places."""
    rows = [(k, None) for k in range(40)] + [(k, "") for k in range(40)] + [(k, "a") for k in range(80)] + [(7, "a")] * 300 + [(None, None)] * 100
    df = spark.createDataFrame(rows, "doc_id bigint, source string")
    for weights in (None, {None: 0.25, "": 0.25, "a": 0.5}):
        got = mixing.schedule(df, weights, 4).collect()
        assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
        assert len({r.position for r in got}) == len(rows) and all(r.release_slot <= r.slot < r.deadline_slot for r in got)
    # in the first phase both small sources have their own quarter
    first = sorted({(r.slot, r.source is None, r.source) for r in got if r.selected}, key=lambda x: x[0])
    for k in range(4, len(first) + 1, 4):
        assert abs(sum(x[1] for x in first[:k]) - k / 4) < 1 and abs(sum(x[2] == "" for x in first[:k]) - k / 4) < 1


def test_mixture_and_odd_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = mixing.mixture(d, {"src0": 0.5, "src1": 0.5}, 2)
    sched = {r.doc_id for r in mixing.schedule(d, {"src0": 0.5, "src1": 0.5}, 2).collect() if r.selected}
    assert {r.doc_id for r in kept.collect() if r.source in ("src0", "src1")} == sched and kept.columns == d.columns
    odd = mixing.schedule(odd_docs(spark)).collect()
    assert len(odd) == odd_docs(spark).count() and len({r.position for r in odd}) == len(odd)
    assert mixing.mixture(odd_docs(spark)).columns == odd_docs(spark).columns
    assert mixing.schedule(empty_docs(spark)).count() == 0 == mixing.mixture(empty_docs(spark)).count()


def test_interleaved_keeps_every_document(spark):
    import corpus_pipeline

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    d = d.unionByName(d.limit(1).withColumn("source", F.lit(None).cast("string")))  # one row of a tiny source
    for rows in (d, odd_docs(spark), empty_docs(spark)):
        got = corpus_pipeline.source_mix(spark, rows, "")
        assert got.columns == rows.columns and got.exceptAll(rows).isEmpty() and rows.exceptAll(got).isEmpty()
    places = sorted(mixing.schedule(d).collect(), key=lambda r: r.position)
    assert [r.doc_id for r in mixing.interleaved(d).collect()] == [r.doc_id for r in places]


def test_hot_source_loses_nothing(spark):
    import corpus_pipeline

    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 < 2, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    kept = [r.source for r in corpus_pipeline.source_mix(spark, d, "").collect()]
    assert len(kept) == 4000 and kept.count("hot") == 1600
    assert abs(kept[:1600].count("hot") - 0.3 * 1600) < 32  # the cap orders, the surplus comes last
    assert set(kept[-300:]) == {"hot"}


def test_sequences_follow_the_mix(spark):
    """The sequences that packing makes of the mix hold its shares from the first to the last, not those of all documents."""
    import corpus_pipeline

    text = F.concat_ws(" ", F.array_repeat(F.concat(F.lit("w"), F.col("id") % 89), (20 + F.col("id") * 37 % 400).cast("int")))
    d = spark.range(4000).select(F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 5 < 2, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    source = {r.doc_id: r.source for r in d.select("doc_id", "source").collect()}
    mixed = common.stored(corpus_pipeline.source_mix(spark, d, ""), "mixed")
    got = corpus_pipeline.best_fit_packing(spark, mixed, "").collect()
    assert sorted(r.doc_id for r in got) == list(range(4000))
    order = [source[r.doc_id] for r in sorted(got, key=lambda r: (r.sequence_id, r.offset))]
    for k in range(0, 3200, 800):
        assert 0.25 < order[k : k + 800].count("hot") / 800 < 0.36  # about the cap of 0.3, where all documents have 0.4
    assert order[-300:].count("hot") > 290  # the surplus


# --- pipeline ---


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet").cache()
    columns, before = d.columns, d.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = common.stored(stage(spark, d, sf), name)
        now = {r.doc_id for r in d.select("doc_id").collect()}
        assert d.columns == columns and 0 < len(now) <= before
        if name == "quality_classifier":
            assert sum(labels.get(i) == 0 for i in now) <= 3
        before = len(now)
    rows = corpus_pipeline.STAGES[-1][1](spark, d, sf).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in d.select("doc_id").collect()}


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(3, 1, 0), (9, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for make in (odd_docs, empty_docs):
        d = make(spark)
        for name, stage in corpus_pipeline.STAGES:
            d = common.stored(stage(spark, d, str(tmp_path)), name)
            if name == "source_mix":
                assert d.columns == make(spark).columns
