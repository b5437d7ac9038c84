"""Spans of the chains against plain Python, and what they find of strings that they were not trained on."""

import importlib
import random
import re
import string
import sys
import warnings

import pytest

from vecskein.llm import secrets

ALPHABETS = {
    "base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "letters": string.ascii_letters,
    "lower": string.ascii_lowercase, "upper": string.ascii_uppercase, "base36": string.ascii_lowercase + string.digits, "base32": string.ascii_uppercase + "234567",
}


@pytest.fixture(scope="module")
def weights(spark):
    return [float(f"{w:.5f}") for w in secrets.train(secrets.labelled_samples(spark))]


def brute_parts(token, weights):
    """(start, end) of what is random: the whole, or stretches that rise over the threshold, written out."""
    place = {c: i for i, c in enumerate(secrets.ALPHABET)}
    steps = [weights[place[a] * len(place) + place[b]] for a, b in zip(token, token[1:], strict=False)]
    if sum(steps) / len(steps) >= secrets.THRESHOLD:
        return [(0, len(token))]
    out, k = [], 0
    while k < len(steps):  # one stretch begins at transition k
        total = best = 0.0
        end, j = None, k
        while j < len(steps):
            total += steps[j] - secrets.THRESHOLD
            j += 1
            if total <= 0 or total <= best - secrets.DROP:
                break
            if total > best:
                best, end = total, j + 1
        if end is not None and end - k >= secrets.WINDOW:
            out.append((k, end))
        k = j
    return out


def brute_markov(text, weights):
    return [(m.start() + a, m.start() + b) for m in re.finditer(secrets.CANDIDATE, text) for a, b in brute_parts(m[0], weights)]


def found(spark, texts):
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("markov:")] for r in rows}


def strings(rnd, name, n):
    return ["".join(rnd.choice(ALPHABETS[name]) for _ in range(rnd.choice([20, 24, 32, 40]))) for _ in range(n)]


def identifiers():
    """Names of the standard library, as attributes and as paths."""
    names = set()
    for m in ("asyncio", "bdb", "calendar", "codecs", "concurrent.futures", "configparser", "decimal", "email.message", "http.client", "inspect", "logging", "mailbox", "pathlib", "pickle", "socket", "ssl", "tarfile", "threading", "typing", "unittest", "urllib.request", "xml.dom.minidom", "zipfile"):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            importlib.import_module(m)
            for a in dir(sys.modules[m]):
                of = getattr(sys.modules[m], a, None)
                names |= {a, f"{m.replace('.', '/')}/{a}"} | ({x for b in dir(of) for x in (f"{a}_{b}", f"{m.replace('.', '/')}/{a}/{b}")} if isinstance(of, type) else set())
    return sorted(n for n in names if re.fullmatch(secrets.CANDIDATE, n))


def test_spans_are_brute_force(spark, weights):
    rnd, names = random.Random(8), identifiers()
    texts = []
    for _ in range(400):
        parts = [rnd.choice([rnd.choice(names), strings(rnd, rnd.choice(list(ALPHABETS)), 1)[0], " ", "é", "=", "/", "user", "-" * 3, str(rnd.randrange(10**6))]) for _ in range(rnd.randrange(1, 9))]
        texts.append("".join(parts))
    texts += ["A" * 300, "QZkWpLmVbNtRcXyHjGfDsQwErTy", "9" * 40, "=" * 25, ""]
    got = found(spark, texts)
    assert got == {k: brute_markov(t, weights) for k, t in enumerate(texts)}
    assert sum(map(bool, got.values())) > 100 and got[401] == [(0, 27)]


def test_recall_of_random_strings(spark):
    rnd = random.Random(21)
    for name in ALPHABETS:
        got = found(spark, strings(rnd, name, 300))
        assert sum(map(bool, got.values())) >= 0.97 * 300, name


def test_names_in_code_stay(spark):
    names = identifiers()
    rnd = random.Random(4)
    rnd.shuffle(names)
    assert len(names) > 3000
    got = found(spark, names[:3000])
    assert sum(map(bool, got.values())) <= 0.01 * 3000


def test_samples_are_a_table(spark):
    """Other samples make another model: here letters are ordinary and digits random."""
    rows = [("abcdefghij" * 4, False), ("1234567890" * 4, True), (None, True), ("x", False)] * 20
    samples = spark.createDataFrame(rows, "sample string, random boolean")
    df = spark.createDataFrame([(1, "see 12345678901234567890 and abcdefghijabcdefghij")], "doc_id long, text string")
    assert secrets.scan(df, samples=samples).first().spans == "markov:4:24"
