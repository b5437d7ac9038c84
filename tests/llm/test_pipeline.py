"""The corpus pipeline, stage by stage, against plain Python over whole tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from vecskein.llm import mixing, quality_rules, secrets
from vecskein.llm.queries import vocabulary_path

from .test_texts import SCHEMA, SF, base, classes, odd_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute_quality(rows):
    ratio = lambda b: len(b) / len(zstandard.ZstdCompressor(level=quality_rules.LEVEL).compress(b))

    def good(text):
        b = (text or "").encode()
        if base(text)[-1]:
            return False
        _, low, high = next(x for x in quality_rules.BANDS if x[0] is None or len(b) < x[0])
        if (low is not None and ratio(b) < low) or (high is not None and ratio(b) > high):
            return False
        c = quality_rules.CHUNK
        chunks = [b[i : i + c] for i in range(0, len(b), c) if i + c <= len(b)] if len(b) >= 2 * c else []
        return all(quality_rules.CHUNK_BAND[0] <= ratio(x) <= quality_rules.CHUNK_BAND[1] for x in chunks)

    return [r for r in rows if good(r["text"])]


def brute_copies(rows):
    """Of every group the row with the smallest id; rows here have ids of their own."""
    of = {i: c for i, _, c in classes([(r["doc_id"], r["text"]) for r in rows])}
    return [r for r in rows if of[r["doc_id"]] == r["doc_id"]]


def brute_masks(spark, rows):
    weights, letters = secrets.train(secrets.labelled_samples(spark)), secrets.ALPHABET

    def random_(m):
        t = m[0]
        if not (re.search("[0-9]", t) and re.search("[A-Za-z]", t)):
            return False
        steps = [round(weights[letters.index(a) * len(letters) + letters.index(b)], 5) for a, b in zip(t, t[1:])]
        return sum(steps) / len(steps) >= secrets.THRESHOLD

    yes = lambda m: True
    kinds = (
        (r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 8),
        (r"AKIA[A-Z0-9]{12,}", yes), (r"[0-9a-f]{32,}", yes), (r"[A-Za-z0-9+/_=-]{20,}", random_),
    )
    out = []
    for r in rows:
        t = r["text"]
        for pattern, keep in kinds:
            t = re.sub(pattern, lambda m, keep=keep: "[SECRET]" if keep(m) else m[0], t)
        out.append(r | {"text": t, "n_chars": len(t)})
    return out


def brute_mix(rows):
    def topic(t, n):
        marks = ((" | ",), "table"), (("###", "$$$"), "markup"), (("!! ",), "shout")
        return next((k for ms, k in marks if any(m in t for m in ms)), "note" if n < 100 else "article" if n < 1000 else "book")

    def cell(r):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        return (r["source"] or "(none)", r["lang"] or "(none)", topic(r["text"], n)), n

    mass = defaultdict(float)
    for r in rows:
        c, n = cell(r)
        mass[c] += n
    sums = lambda w, d: {v: math.fsum(x for c, x in w.items() if c[d] == v) for v in {c[d] for c in w}}
    goal = []
    for d, name in enumerate(mixing.DIMS):
        p = {v: m ** mixing.TEMPER[name] if m > 0 else 0.0 for v, m in sums(mass, d).items()}
        goal.append({v: x / math.fsum(p.values()) for v, x in p.items()})
    w = dict(mass)
    for _ in range(mixing.ROUNDS):
        for d in range(3):
            own = sums(w, d)
            w = {c: x * goal[d][c[d]] / own[c[d]] if own[c[d]] > 0 else 0.0 for c, x in w.items()}
    budget, full, k = mixing.FRACTION * math.fsum(mass.values()), set(), 0.0
    for _ in range(mixing.CAP_ROUNDS):
        free = math.fsum(x for c, x in w.items() if c not in full)
        k = (budget - math.fsum(mass[c] for c in full)) / free if free > 0 else 0.0
        full |= {c for c in w if mass[c] > 0 and k * w[c] / mass[c] >= 1}
    chance = {c: round(1.0 if c in full else min(1.0, max(0.0, k * w[c] / mass[c])) if mass[c] else 0.0, 6) for c in w}
    u = lambda i: int(hashlib.md5(f"{i}:{mixing.SEED}".encode()).hexdigest()[:12], 16) / 2**48
    return [r for r in rows if u(r["doc_id"]) < chance[cell(r)[0]]]


def test_pipeline_is_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert docs.columns == COLUMNS
    want = [r.asDict() for r in docs.collect()]
    # near copies of some texts besides those that the table has
    near = [r | {"doc_id": r["doc_id"] + 10_000, "text": r["text"] + " tail"} for r in want[:40]]
    now = docs.unionByName(spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in near], docs.schema))
    want += near
    steps = [brute_quality, brute_copies, lambda rows: brute_masks(spark, rows), brute_mix]
    for (name, stage), brute in zip(corpus_pipeline.STAGES, steps, strict=False):
        before, want = len(want), brute(want)
        now = stage(spark, now, SF)
        assert now.columns == COLUMNS, name
        got = now.collect()
        assert Counter(map(tuple, got)) == Counter(tuple(r[c] for c in COLUMNS) for r in want), name
        assert 0 < len(want) and (len(want) < before or name == "secret scan"), name
        now = spark.createDataFrame(got, docs.schema)
    tok = Tokenizer.from_file(vocabulary_path())
    tok.no_truncation()
    tok.no_padding()
    ids = {r.doc_id: (r.n_tokens, r.ids) for r in corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()}
    assert ids == {r["doc_id"]: (len(t), t) for r in want for t in [tok.encode(r["text"], add_special_tokens=False).ids]}


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    key = lambda df: Counter((r.doc_id, r.n_tokens, tuple(r.ids)) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(now)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_tables(spark, empty):
    rows = [r for r in odd_rows() if not empty]
    odd = spark.createDataFrame(rows, SCHEMA).withColumn("probability", F.lit("z")).withColumn("root", F.lit(None).cast("int"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        n = out.count()
        assert n <= len(rows), name
        if name == "encoding":
            assert n == len(rows) and out.columns == ["doc_id", "n_tokens", "ids"]
            assert np.all([r.n_tokens == len(r.ids) for r in out.collect()])
        else:
            assert out.schema.names == odd.schema.names, name
