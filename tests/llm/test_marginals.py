"""Raking to a tolerance, topics of one's own, and tiles of more blocks."""

import random

import numpy as np
import pytest

from vecskein.llm import mixing, simhash


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(1)
    rows = [(k, " ".join(["w"] * rnd.randrange(1, 60)), rnd.choice(["en", "de", "fr"]), f"s{int(rnd.paretovariate(0.6)) % 90}", rnd.choice(["law", "art", None])) for k in range(1500)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, subject string")


def test_tolerance_is_met(docs):
    cells = mixing.with_features(docs, topic_col="subject").groupBy(*mixing.DIMS).agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "mass")
    few = mixing.residuals(mixing.rake(cells, rounds=1)).toPandas()
    raked = mixing.rake(cells, tolerance=1e-6)
    many = mixing.residuals(raked).toPandas()
    assert many.error.max() <= 1e-6 < few.error.max()
    assert set(many[many.dimension == "topic"].category) == {"law", "art", "(none)"}
    assert np.isclose(raked.toPandas().weight.sum(), 1)


def test_targets_that_cannot_be_met(spark):
    cells = spark.createDataFrame([("a", "x", "t", 5.0), ("b", "y", "t", 5.0)], "source string, lang string, topic string, mass double")
    with pytest.raises(ValueError, match="not within"):
        mixing.rake(cells, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}}, tolerance=1e-3)


def test_too_many_cells(docs, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_CELLS", 3)
    with pytest.raises(ValueError, match="too many categories"):
        mixing.mix(docs)


def test_topic_column(docs):
    rows = mixing.mix(docs, topic_col="subject", tolerance=1e-4)
    assert set(r.topic for r in rows.select("topic").distinct().collect()) == {"law", "art", "(none)"}
    assert mixing.sample(docs, topic_col="subject", tolerance=1e-4).count() == rows.where("sampled").count()


@pytest.mark.parametrize("blocks", [6, 7, 8, 9])
def test_blocks_lose_no_link(spark, blocks):
    rng = np.random.default_rng(blocks)
    seeds = rng.integers(0, 2**63, 30, dtype=np.uint64).tolist()
    fps = set(seeds)
    for x in seeds:
        for _ in range(15):
            y = x
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    root = {f: f for f in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[top(a)] = top(b)
    want = sorted(sorted(f for f in fps if top(f) == r) for r in {top(f) for f in fps})
    for tile in (2048, 5):
        tree = {r.node % 2**64: r.root % 2**64 for r in simhash.components(simhash.links(df, tile_rows=tile, blocks=blocks)).collect()}
        got = {}
        for f in fps:
            got.setdefault(tree.get(f, f), []).append(f)
        assert sorted(map(sorted, got.values())) == want


def test_number_of_blocks_grows_with_rows():
    assert [simhash.n_blocks(n) for n in (0, 10**6, 10**9, 10**10, 10**12)] == [6, 6, 7, 8, 9]
    for n in (6, 7, 8, 9):
        assert sum(w for _, w in simhash.blocks_of(n)) == 64


def test_rows_that_differ_in_where_nulls_stand(spark):
    df = spark.createDataFrame([(1, "same text here", "a", None), (1, "same text here", None, "a")], "doc_id long, text string, lang string, source string")
    assert simhash.keep_one(df).count() == 1
