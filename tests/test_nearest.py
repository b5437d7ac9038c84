"""Query sets meet rows in tiles: the whole result, ties by id, and memory that neither side's size moves."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecskein.operators import search

METRICS = ("l2", "ip", "cosine")


def brute(metric, q, x, ids, k, kept=None):
    """Ids of the k nearest of each query; equal rows have equal distances."""
    out = []
    for i in range(len(q)):
        at = np.arange(len(x)) if kept is None else np.flatnonzero(kept[i])
        d = search.paired(metric, np.repeat(q[i : i + 1], len(at), 0), x[at])
        out.append(ids[at[np.lexsort((ids[at], d))[:k]]].tolist())
    return out


@pytest.mark.parametrize("metric", METRICS)
def test_tiles_keep_the_nearest(monkeypatch, metric):
    monkeypatch.setattr(search, "TILE", 16)
    monkeypatch.setattr(search, "PAIRED", 50)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(150, 5)), np.repeat(rng.normal(size=(3, 5)), 20, 0), 1e-9 * rng.normal(size=(20, 5)) + 7, 1e160 * rng.normal(size=(5, 5)), np.zeros((2, 5)), [[np.nan] * 5, [np.inf] + [0.0] * 4]])
    ids = rng.permutation(len(x))
    q, kinds, groups = x[::4], np.arange(len(x[::4])) % 3, np.arange(len(x)) % 4
    allowed = np.array([[1, 0, 1, 1], [0, 0, 0, 1], [1, 1, 1, 1]], bool)
    for given, kept in (({}, None), ({"classes": kinds, "allowed": allowed}, allowed[kinds][:, groups])):
        best = search.Nearest(metric, np.arange(len(q)), q, 7, **given)
        for at in np.array_split(rng.permutation(len(x)), 6):
            best.add(ids[at], x[at], groups[at])
        got = {}
        for b in best.found():
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got.setdefault(k, []).append(v)
        with np.errstate(all="ignore"):
            assert [got.get(i, []) for i in range(len(q))] == brute(metric, q, x, ids, 7, kept)


def test_memory_of_many_queries():
    """A batch of rows against many queries once made a matrix of both, and several for cosine."""
    rng = np.random.default_rng(2)
    q, x = rng.normal(size=(6000, 8)), rng.normal(size=(6000, 8))
    best = search.Nearest("cosine", np.arange(len(q)), q, 5)
    tracemalloc.start()
    best.add(np.arange(len(x)), x)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20  # 6000 * 6000 doubles are 275 MB
    tracemalloc.stop()
    assert sum(b.num_rows for b in best.found()) == 5 * len(q)


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(60, 4)), 3, 0)
    labels = [None if k % 7 == 0 else f"l{k % 5}" for k in range(len(x))]
    df = spark.createDataFrame([(k, v, s, k % 3) for k, (v, s) in enumerate(zip(x.tolist(), labels, strict=True))], "id int, embedding array<float>, label string, part int")
    asked = df.where("id % 2 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label"), F.col("part").alias("query_part"))
    return df, asked, x.astype(np.float32).astype(float), labels


@pytest.mark.parametrize("shipped", [True, False])
@pytest.mark.parametrize("metric", METRICS)
def test_predicates_told_by_classes(sides, monkeypatch, metric, shipped):
    """Pairs that few values decide meet as matrices; before, every pair was a row of a join, dealt over two or three keys."""
    df, asked, x, labels = sides
    monkeypatch.setattr(search, "BLOCK_QUERIES", 40)
    monkeypatch.setattr(search, "BLOCK", 25)
    if not shipped:
        monkeypatch.setattr(search, "SHIPPED", 0)
    ids = np.arange(len(x))
    kept = np.array([[labels[i] is not None and labels[j] is not None and labels[i] != labels[j] and (j % 3 >= i % 3) for j in ids] for i in ids[::2]])
    found = search.lateral_topk(asked, df, 4, metric, (F.col("label") != F.col("query_label")) & (F.col("part") >= F.col("query_part")))
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString() and dict(found.dtypes) == {"query_id": "int", "rank": "int", "id": "int", "distance": "double"}
    got = found.orderBy("query_id", "rank").collect()
    want = brute(metric, x[::2], x, ids, 4, kept)
    assert [[r.id for r in got if r.query_id == i] for i in ids[::2]] == want
    monkeypatch.setattr(search, "CLASSES", 2)  # any other predicate is asked of all pairs
    pairs = search.lateral_topk(asked, df, 4, metric, (F.col("label") != F.col("query_label")) & (F.col("part") >= F.col("query_part"))).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, round(r.distance, 9)) for r in pairs] == [(r.query_id, r.id, round(r.distance, 9)) for r in got]


def test_predicates_of_one_side_and_none(sides):
    df, asked, x, _ = sides
    ids = np.arange(len(x))
    by = lambda p: [[r.id for r in got if r.query_id == i] for got in [search.lateral_topk(asked, df, 3, predicate=p).orderBy("query_id", "rank").collect()] for i in ids[::2]]
    assert by(None) == brute("l2", x[::2], x, ids, 3)
    assert by(F.col("part") == 1) == brute("l2", x[::2], x, ids, 3, np.tile(ids % 3 == 1, (len(ids[::2]), 1)))
    assert by(F.lit(False)) == [[]] * len(ids[::2])
    assert by(F.col("id") > F.col("query_id")) == brute("l2", x[::2], x, ids, 3, ids[None, :] > ids[::2][:, None])


@pytest.mark.parametrize("metric", METRICS)
def test_lists_searched_for_many_queries(spark, tmp_path, monkeypatch, metric):
    """Blocks of rows meet groups of queries, in any order and number: the exact result where all lists are probed, ties by id."""
    from vecskein.plans import ivf

    monkeypatch.setattr(ivf, "BLOCK_ROWS", 8)
    monkeypatch.setattr(ivf, "BLOCK_QUERIES", 16)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(100, 4)).astype(np.float32), 4, 0)
    e = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "id long, embedding array<float>")
    asked = e.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    index = ivf.IvfIndex.build(e, str(tmp_path / metric), metric, {"internal": {"lists": [3]}})
    found = index.search_many(asked, 3, probes=[3])
    got = found.orderBy("query_id", "rank").collect()
    want = {(r.query_id, r["rank"]): r.distance for r in search.knn_join(asked, e, 3, metric).collect()}
    assert {(r.query_id, r["rank"]) for r in got} == set(want) and all(abs(r.distance - want[r.query_id, r["rank"]]) < 1e-5 for r in got)
    assert len({r.query_id for r in got}) == 40 and all(a.row_id < b.row_id for a, b in zip(got, got[1:]) if a.query_id == b.query_id and a.distance == b.distance)


def test_best_of_several_searches():
    best = search.KBest(2)
    best.most = 4
    for part in ([(1, 10, 0.5), (2, 11, float("nan")), (1, 9, 0.5)], [(1, 8, 0.7), (2, 12, 1.0)], [(2, 13, 0.1), (1, 7, 0.5)]):
        q, i, d = zip(*part, strict=True)
        best.add([search.pa.RecordBatch.from_arrays([search.pa.array(q), search.pa.array(i), search.pa.array(d)], ["query_id", "id", "distance"])])
        assert best.rows <= 8
    (b,) = best.found()
    assert list(zip(*(c.to_pylist() for c in b.columns), strict=True)) == [(1, 7, 0.5), (1, 9, 0.5), (2, 13, 0.1), (2, 12, 1.0)]
