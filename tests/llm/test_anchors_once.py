"""Texts are searched for anchors once, many at a time, and what is found is what a search text by text finds."""

import random
from collections import Counter

import pytest

from vecskein.llm import substrings

from .test_files import brute_dedup


def by_hand(text, length):
    """(anchor, its place, first window, windows), window by window."""
    out = []
    for p in range(len(text) - length + 1):
        grams = substrings._grams(substrings.np.frombuffer(text[p : p + length], substrings.np.uint8)).tolist()
        at = min(range(len(grams)), key=lambda k: (grams[k] >> 24, k))
        if out and out[-1][1] == p + at:
            out[-1][3] += 1
        else:
            out.append([grams[at], p + at, p, 1])
    return [tuple(x) for x in out]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    some = [bytes(rnd.choices(b"abcdefgh ", k=rnd.choice([0, 99, 100, 101, 150, 700]))) for _ in range(40)]
    return [*some, b"x" * 400, some[0] + some[7] * 2, b"\0" * 130, bytes(range(256))]


@pytest.mark.parametrize("piece, near", [(1 << 18, 1 << 14), (1000, 64), (5000, 333)])
@pytest.mark.parametrize("length", [100, 60])
def test_many_texts_at_a_time(texts, monkeypatch, piece, near, length):
    monkeypatch.setattr(substrings, "PIECE", piece)
    monkeypatch.setattr(substrings, "NEAR", near)
    got, strings = {}, {}
    for part in substrings.anchored(texts, length):
        for k, h, d, a, n, o in zip(*(x.tolist() for x in part), strict=True):
            got.setdefault(k, []).append((h, a + o, a, n))
            strings.setdefault(texts[k][a : a + n + length - 1], set()).add((h, d))
    assert got == {k: found for k, t in enumerate(texts) if (found := by_hand(t, length))}
    # equal strings have one name, different ones different names
    names = [x for s in strings.values() for x in s]
    assert len(names) == len(strings) == len(set(names))


def test_short_texts_share_a_search(texts, monkeypatch):
    calls, grams = [], substrings._grams
    monkeypatch.setattr(substrings, "_grams", lambda b: calls.append(len(b)) or grams(b))
    assert sum(len(x[0]) for x in substrings.anchored(texts * 20)) > len(texts) * 20
    assert len(calls) < len(texts)


def test_one_reading_and_no_second_count(spark, monkeypatch):
    """One passage in all rows: its copies are counted where they are found, and the counts meet once."""
    rnd = random.Random(9)
    letters = lambda n: "".join(rnd.choices("abcdefghij ", k=n))
    passage = letters(300)
    rows = [(k, letters(50) + passage + letters(50)) for k in range(80)] + [(100 + k, letters(300)) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tags, made, wrote = [], {}, substrings.materialize

    def noted(table, tag, *args, **options):
        out = wrote(table, tag, *args, **options)
        tags.append(tag)
        if tag == "segments":
            made["first"] = [r.w for r in out.where("w > 1").select("w").collect()]
        return out

    monkeypatch.setattr(substrings, "materialize", noted)
    assert Counter(map(tuple, substrings.dedup(df).collect())) == brute_dedup(rows)
    assert tags[:5] == ["rows", "units", "texts", "segments", "strings"] and max(made["first"]) >= 80


@pytest.mark.parametrize("hot, wait", [(3, 20), (1, 1), (256, 10)])
def test_anchors_of_many_rows(spark, monkeypatch, hot, wait):
    """Rows of one anchor go on before the last has come, when it has too many different segments anyhow."""
    monkeypatch.setattr(substrings, "WAIT", wait)
    rnd = random.Random(13)
    letters = lambda n: "".join(rnd.choices("abcdefghij ", k=n))
    line = letters(100)
    rows = [(k, letters(40) + line + letters(40) * (k % 3)) for k in range(150)] + [(200 + k, letters(20) + line[:90]) for k in range(50)]
    rows += [(300 + k, rows[k % 5][1] + letters(30)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, substrings.dedup(df, hot=hot).collect())) == brute_dedup(rows)
