"""Substring dedup, separators, classifier, top-k and archives against brute force."""

import base64
import hashlib
import random
import struct
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecskein.llm import bwt, files, gam, separators, substrings, topk, warc
from vecskein.llm.queries import vocabulary_path

from .test_texts import SCHEMA, SF, odd_rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def brute_dedup(rows, n=100):
    """rows (id, text): each row's result; equal texts under one id share it."""
    last = 2**63 - 1
    key = lambda r: (last if r[0] is None else r[0], hashlib.sha256((r[1] or "").encode()).hexdigest())
    seen, done = {}, {}
    for i, t in sorted(rows, key=key):
        b = (t or "").encode()
        k = key((i, t))
        if k in done:
            continue
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            if w in seen:
                gone[p : p + n] = True
            else:
                seen[w] = k
        done[k] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return Counter((i, *done[key((i, t))]) for i, t in rows)


def test_repeats_of_merged_transforms():
    rnd = random.Random(4)
    for _ in range(25):
        base = [bytes(rnd.choice(b"ab\0c") for _ in range(rnd.randrange(5, 60))) for _ in range(4)]
        strings = [b"".join(rnd.choice(base) for _ in range(rnd.randrange(3))) for _ in range(rnd.randrange(2, 30))]
        n, want, got = rnd.choice([4, 8, 12, 20]), defaultdict(list), defaultdict(list)
        for k, s in enumerate(strings):
            for i in range(len(s) - n + 1):
                want[s[i : i + n]].append((k, i))
        for g, k, i in zip(*(x.tolist() for x in bwt.repeats(strings, n, rnd.choice([1, 50, 10000]))), strict=True):
            got[g].append((k, i))
        assert sorted(sorted(v) for v in got.values()) == sorted(v for v in want.values() if len(v) > 1)


def test_common_prefixes_of_merged_transforms():
    left, right = [b"banana band", b"bandana"], [b"ananas banana", b""]
    shards = [bwt.Shard(left), bwt.Shard(right)]
    source, _, common = bwt.merge(shards, 12)
    places = np.concatenate([shards[0].suffixes, shards[1].suffixes + shards[0].n])[source]
    text = b"".join(s + b"\1" for s in left + right)
    for r in range(1, len(source)):
        a, b, k = text[places[r - 1] :], text[places[r] :], 0
        while a[k : k + 1] == b[k : k + 1] != b"\1" and k < 12:
            k += 1
        assert common[r] == k // 4 * 4
    # without the rows that are alone: the same intervals, and the least of the prefixes between those left
    block = bwt.merge(shards, 12)[1]
    kept = np.flatnonzero(np.bincount(block)[block] > 1)
    few, _, shared = bwt.merge(shards, 12, whole=False)
    assert few.tolist() == source[kept].tolist()
    assert shared.tolist()[1:] == [int(common[a + 1 : b + 1].min()) for a, b in zip(kept, kept[1:])]


@pytest.mark.parametrize("hot", [1000, 2])
def test_substrings(spark, docs, odd, hot):
    rnd = random.Random(9)
    text = "".join(rnd.choice("abcdefghij ") for _ in range(700))
    made = [(500 + k, text[rnd.randrange(300) : rnd.randrange(300, 700)] + "".join(rnd.choice("xyz") for _ in range(rnd.randrange(120)))) for k in range(40)]
    made += [(490, "z" * 1000), (491, "q" * 99 + "z" * 150), (492, "ab" * 400), (493, "y" + text[:99]), (494, text[:100]), (489, text[:99])]
    extra = spark.createDataFrame(made, "doc_id long, text string")
    for df in (docs.select("doc_id", "text").union(extra), odd):
        rows = [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]
        assert Counter(map(tuple, substrings.dedup(df, hot=hot).collect())) == brute_dedup(rows)


def test_substrings_empty(spark):
    assert substrings.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_segments_cover_all_windows():
    rnd = random.Random(3)
    for n in (0, 99, 100, 101, 500):
        t = bytes(rnd.choice(b"ab") for _ in range(n))
        _, a, k, o = substrings.anchors(t)
        assert k.sum() == max(0, n - 99) and (np.diff(a) == k[:-1]).all()
        for x, y, z in zip(a.tolist(), k.tolist(), o.tolist(), strict=True):
            parts = sorted((s, m) for _, _, s, m in substrings.split(t, x, y, z))
            assert [w for s, m in parts for w in range(s, s + m)] == list(range(x, x + y))


def test_token_counts(spark, docs, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    ranks, vocab = public_tokenizers.path("byte_bpe_50k.tiktoken"), vocabulary_path()
    tok = Tokenizer.from_file(vocab)
    tok.encode_special_tokens = True
    for df, block, size in ((docs, 1 << 20, 1 << 24), (docs, 37, 5000), (odd, 64, 1000)):
        want = Counter((r.doc_id, len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
        assert Counter(map(tuple, separators.token_counts(df, ranks, vocab, block=block, file_tokens=size).collect())) == want
    assert separators.token_counts(spark.createDataFrame([], SCHEMA), ranks, vocab).count() == 0


def test_separator_blocks(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows, want = [], Counter()
    for k in range(12):
        ids = rng.integers(0, 4, rng.integers(0, 90)).astype("<u4")
        (tmp_path / f"{k}.bin").write_bytes(ids.tobytes())
        rows.append((str(tmp_path / f"{k}.bin"), ids.nbytes, 4))
        lens, n = [], 0
        for x in ids.tolist():
            if x == 3:
                lens.append(n)
                n = 0
            else:
                n += 1
        if n:
            lens.append(n)
        want.update((rows[-1][0], j, v) for j, v in enumerate(lens))
    df = spark.createDataFrame(rows, "file string, n_bytes long, width int")
    for block in (1, 7, 1000):
        assert Counter(map(tuple, separators.count(df, 3, block).collect())) == want


def auc(y, s):
    r = np.argsort(np.argsort(s)) + 1
    return (r[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_classifier(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = gam.score(docs, gam.train(docs, labels)).join(labels, "doc_id").toPandas()
    for i, h in zip(got.doc_id, got.held_out, strict=True):
        assert h == (zlib.crc32(str(i).encode()) % 3 == 1)
    test = got[got.held_out]
    assert auc(test.quality.to_numpy(), test.score.to_numpy()) > 0.95
    assert ((test.predicted == 1) == (test.score >= 0.5)).all() and got.score.between(0, 1).all()
    # labels of the test fold change nothing
    held = gam.held_out(F.col("doc_id"))
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = gam.score(docs, gam.train(docs, flipped)).toPandas().set_index("doc_id").score
    assert np.allclose(again.loc[got.doc_id], got.score)


def test_classifier_odd(spark, odd):
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 0), (5, 1, 1), (6, None, 0), (None, 1, 0), (3, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0), labels.where("quality = 1")):
        got = gam.score(odd, gam.train(odd, lab)).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert gam.score(spark.createDataFrame([], SCHEMA), gam.fit(np.zeros((0, len(gam.FEATURES))), np.zeros(0))).count() == 0


def test_interaction_is_learnt():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gam.fit(x, y, rounds=20, pairs=1)
    assert list(model.pairs) == [(0, 1)] and auc(y, model.score(x)) > 0.95


def brute_topk(rows, k=5, every=50):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in rows:
        if i is not None and i % every == 0 and any(i == j for j, _ in ok):
            vs = [list(map(float, w)) for j, w in rows if j == i and w is not None and all(x is not None and np.isfinite(x) for x in w)]
            asked[i] = [int(np.floor(256 * x)) for x in min(vs)]
    out = Counter()
    for q, v in asked.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in ok if j != q)[:k]
        out.update((q, r, j, -s) for r, (s, j) in enumerate(best, 1))
    return out


def test_topk(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    for kw in ({}, {"rows": 64, "queries": 3, "slices": 5}):
        got = topk.search(df, F.col("vec_id") % 50 == 0, **kw)
        assert Counter(map(tuple, got.collect())) == brute_topk(rows)


def test_topk_odd(spark):
    rnd = random.Random(2)
    vec = lambda n=4: [rnd.uniform(-2, 2) for _ in range(n)]
    same = vec()
    rows = [(i, same if i % 3 == 0 else vec()) for i in range(130)]
    rows += [(200, None), (201, [1.0, None, 2.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf"), 0, 0, 0]), (None, vec()), (50, vec()), (51, vec()), (51, same), (250, vec(2)), (300, []), (204, [1e9, -1e9, 1e9, 1.0]), (350, [1e9, 3e8, -1e9, 0.5])]
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string")
    assert Counter(map(tuple, topk.search(df, F.col("vec_id") % 50 == 0, rows=16).collect())) == brute_topk(rows)
    few = df.where("vec_id in (0, 1, 50)")
    assert Counter(map(tuple, topk.search(few, F.col("vec_id") % 50 == 0).collect())) == brute_topk([r for r in rows if r[0] in (0, 1, 50)])
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def brute_warc(rows, least=0):
    first = {}
    for i, h in rows:
        k = 2**63 - 1 if i is None else i
        first[h or ""] = min(first.get(h or "", k), k)
    out = Counter()
    for i, h in rows:
        b = (h or "").encode()
        again = len(b) >= least and (2**63 - 1 if i is None else i) > first[h or ""]
        out[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None)] += 1
    return out


def test_warc(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r.page_id, r.html) for r in pages.collect()]
    for kw in ({}, {"package_bytes": 20000}):
        assert Counter(map(tuple, warc.round_trip(pages, **kw).collect())) == brute_warc(rows)


def test_warc_odd(spark):
    rows = [(5, "u", "same"), (3, "u\r\nX: y", "same"), (3, None, "same"), (None, "v", "same"), (None, "v", "alone"), (7, "w", None), (8, "w", ""), (9, "é", "\r\n\r\n"), (10, "x", "ü" * 200000), (11, "x", "PK\5\6")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, record_type string, sha int")
    plain = [(i, h) for i, _, h in rows]
    assert Counter(map(tuple, warc.round_trip(df).collect())) == brute_warc(plain)
    assert Counter(map(tuple, warc.round_trip(df, least=5).collect())) == brute_warc(plain, 5)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_zip_directories(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.comment = b"PK\5\6 in a comment"
        for name, how in (("one", zipfile.ZIP_STORED), ("two", zipfile.ZIP_DEFLATED)):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as f:
                f.write(name.encode() * 10) if how == zipfile.ZIP_STORED else f.write(b"")
        z.writestr("packed", "p" * 100, zipfile.ZIP_DEFLATED)
    with files.read(str(path)) as f:
        found = warc.members(f, f.size())
        assert set(found) == {"one", "two"} and files.read_range(f, *found["one"]) == b"one" * 10


def test_zip64_end_of_directory(tmp_path):
    """A directory whose short record is full everywhere."""
    path = tmp_path / "b.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("m", b"payload")
    raw = path.read_bytes()
    k = raw.rfind(b"PK\5\6")
    n, size, offset = struct.unpack_from("<HII", raw, k + 10)
    end = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, offset)
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, k, 1)
    path.write_bytes(raw[:k] + end + locator + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    with files.read(str(path)) as f:
        assert files.read_range(f, *warc.members(f, f.size())["m"]) == b"payload"
