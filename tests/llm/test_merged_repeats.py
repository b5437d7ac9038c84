"""Removed windows come from intervals of merged transforms, also where one passage or anchor is everywhere."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecskein.llm import bwt, substrings

from .test_files import SF, brute_dedup


def removed_windows(texts, n=100):
    """Windows of distinct texts that start earlier in them."""
    seen, out = set(), 0
    for t in texts:
        b = t.encode()
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                out += 1
            seen.add(b[p : p + n])
    return out


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(11)
    letters = lambda n: "".join(rnd.choice("abcdefghij klmnop") for _ in range(n))
    passage, gram = letters(400), letters(110)
    rows = [(k, letters(rnd.randrange(80)) + passage[rnd.randrange(40) : 400 - rnd.randrange(40)] + letters(rnd.randrange(80))) for k in range(150)]
    # one anchor in many different strings: only its neighbourhood repeats
    rows += [(1000 + k, letters(60) + gram[: 100 + k % 11] + letters(60)) for k in range(200)]
    rows += [(2000 + k, rows[k % 7][1]) for k in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


@pytest.mark.parametrize("hot", [1000, 40, 3])
def test_skewed_tables(skewed, hot):
    df, rows = skewed
    told = []

    def note(level, firsts, later):
        told.append((level, *(t.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for t in (firsts, later))))

    got = substrings.dedup(df, hot=hot, told=note)
    assert Counter(map(tuple, got.collect())) == brute_dedup(rows)
    assert [x[0] for x in told] == list(range(len(told))) and (len(told) > 1) == (hot < 1000)
    # windows of first copies are told once each; those of later copies of a part as often as parts hold it
    distinct = list(dict.fromkeys(t for _, t in rows))
    assert sum(a + b for _, a, b in told) >= 0.9 * removed_windows(distinct)


def test_share_of_merged_intervals(spark):
    """Besides whole equal texts, every removed window is in a repeated interval."""
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    told = []
    substrings.dedup(df, told=lambda level, firsts, later: told.append(sum(t.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for t in (firsts, later)))).count()
    texts = [r.text for r in df.orderBy("doc_id").collect()]
    assert sum(told) == removed_windows(list(dict.fromkeys(t for t in texts if t)))


def test_weights_are_copies():
    rnd = random.Random(8)
    for _ in range(20):
        base = [bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 40))) for _ in range(6)]
        weights = np.array([rnd.choice([1, 1, 2, 5]) for _ in base])
        n = rnd.choice([3, 7, 10, 20])
        want = {}
        for k, s in enumerate(base):
            for i in range(len(s) - n + 1):
                want.setdefault(s[i : i + n], []).append((k, i))
        got = {}
        for g, k, i in zip(*(x.tolist() for x in bwt.repeats(base, n, 30, weights)), strict=True):
            got.setdefault(g, []).append((k, i))
        assert sorted(map(sorted, got.values())) == sorted(v for v in want.values() if sum(weights[k] for k, _ in v) > 1)


def test_prefixes_without_lone_rows():
    rnd = random.Random(2)
    for _ in range(20):
        strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(30))) for _ in range(8)]
        shards = [bwt.Shard(strings[:3]), bwt.Shard(strings[3:])]
        for step in (1, 3, 4, 6):
            source, block, common = bwt.merge(shards, 12, step)
            few, inside, shared = bwt.merge(shards, 12, step, whole=False)
            kept = np.flatnonzero(np.bincount(block)[block] > 1)
            assert few.tolist() == source[kept].tolist()
            assert shared.tolist()[1:] == [int(common[a + 1 : b + 1].min()) for a, b in zip(kept, kept[1:], strict=False)]
            assert (np.diff(inside) > 0).tolist() == (shared[1:] < 12).tolist()
