"""Deletes and inserts in order, replays, what a scan reads, and builds where the sample lies."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecskein.operators import kmeans, search
from vecskein.plans import ivf
from vecskein.plans.graph import GraphIndex
from vecskein.plans.ivf import IvfIndex
from vecskein.sources import store
from vecskein.streaming import ingest

from .test_engine import Q8, exact, ids, t  # noqa: F401

ALL = {IvfIndex: {"probes": [4], "epsilon": 4.0}, GraphIndex: {"ef_search": 1000}}


def build(kind, df, path):
    return kind.build(df, str(path), "l2", {"internal": {"lists": [4]}} if kind is IvfIndex else None, "val")


def key(df):
    return df.select(F.col("id").alias("row_id"))


@pytest.mark.parametrize("kind", [IvfIndex, GraphIndex])
def test_update_in_one_batch(spark, t, tmp_path, kind):  # noqa: F811
    index = build(kind, t, tmp_path / "i")
    turned = t.where("id < 50").withColumn("val", F.transform("val", lambda x: -x))
    ops = turned.select("id", "val", F.lit("insert").alias("op")).union(t.where("id < 60").select("id", "val", F.lit("delete")))
    ops.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ops.schema).parquet(str(tmp_path / "in"))
    for checkpoint in ("a", "b"):  # under a new checkpoint the same batch comes again: a replay
        ingest.ingest(stream, index, str(tmp_path / checkpoint), "op", {"availableNow": True}).awaitTermination(120)
        now = t.where("id >= 60").select("id", "val").union(turned.select("id", "val"))
        found = index.search(Q8, 400, **ALL[kind]).collect()
        assert sorted(r["row_id"] for r in found) == sorted(r["id"] for r in now.collect())
        assert ids(index.search(Q8, 10, **ALL[kind])) == exact(now, Q8, 10)


@pytest.mark.parametrize("kind", [IvfIndex, GraphIndex])
def test_replayed_inserts_are_stored_once(spark, t, tmp_path, kind):  # noqa: F811
    index = build(kind, t.where("id < 300"), tmp_path / "i")
    t.where("id >= 250").select("id", "val").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, val array<float>").parquet(str(tmp_path / "in"))
    for checkpoint in ("a", "b"):
        ingest.ingest(stream, index, str(tmp_path / checkpoint), None, {"availableNow": True}).awaitTermination(120)
    found = ids(index.search(Q8, 500, **ALL[kind]))
    assert len(found) == len(set(found)) == 400


@pytest.mark.parametrize("kind", [IvfIndex, GraphIndex])
def test_insert_after_delete_shows_without_vacuum(t, tmp_path, kind):  # noqa: F811
    index = build(kind, t, tmp_path / "i")
    index.delete(key(t.where("id % 2 = 0")))
    index.insert(t.where("id % 4 = 0"))
    want = exact(t, Q8, 10, where=F.expr("id % 4 <> 2"))
    assert ids(index.search(Q8, 10, **ALL[kind])) == want
    index.delete(key(t.where("id = -1")))
    assert ids(index.search(Q8, 10, **ALL[kind])) == want
    assert index.known_ids().count() == 300
    after = index.vacuum(t) if kind is GraphIndex else (index.vacuum(), index)[1]
    assert ids(after.search(Q8, 10, **ALL[kind])) == want
    assert not store.children(t.sparkSession, f"{after.root}/tombstones")


def test_vectors_of_survivors_alone_are_read(t, tmp_path):  # noqa: F811
    index = build(IvfIndex, t, tmp_path / "i")
    found = index.search(Q8, 3, probes=[2])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(row_id" in plan and "vector:array<float>" in plan and "signs" not in plan
    codes = index.postings([0, 1])._jdf.queryExecution().executedPlan().toString()
    assert "vector:" not in codes and "grp#" in codes and "In(list_id" in codes
    far = index._estimated(index._prepared(Q8)[0], index.postings())
    assert index._emitted(Q8, far, range(4), 3, 1.9, None).count() < 200 < far.count()


@pytest.mark.parametrize("epsilon", [0.0, 1.9])
def test_two_passes_give_the_order_of_one(t, tmp_path, epsilon):  # noqa: F811
    index = build(IvfIndex, t, tmp_path / "i")
    whole = [tuple(r) for r in index.search(Q8, None, probes=[3], epsilon=epsilon).collect()]
    for k in (1, 7, 60):
        assert [tuple(r) for r in index.search(Q8, k, probes=[3], epsilon=epsilon).collect()] == whole[:k]
    ball = [r for r in whole if r[1] < 2.5]
    assert [tuple(r) for r in index.search(Q8, 5, probes=[3], epsilon=epsilon, radius=2.5).collect()] == ball[:5]


@pytest.mark.parametrize("options", [{"lists": [9]}, {"lists": [9], "kmeans_algorithm": "hierarchical"}, {"lists": [2, 9], "kmeans_dimension": 3}, {"lists": [9], "kmeans_algorithm": "hierarchical", "kmeans_dimension": 3}])
def test_builds_where_the_sample_lies(t, tmp_path, monkeypatch, options):  # noqa: F811
    monkeypatch.setattr(ivf, "DRIVER_BYTES", 0)
    monkeypatch.setattr(kmeans, "TASK_BYTES", 10_000)
    index = IvfIndex.build(t, str(tmp_path / "i"), "l2", {"internal": options}, "val")
    n = len(options["lists"])
    assert ids(index.search(Q8, 10, probes=[500] * n, epsilon=4.0)) == exact(t, Q8, 10)
    assert not store.exists(t.sparkSession, f"{index.root}/sample")
    x = np.array([r["val"] for r in t.collect()], np.float64)
    cost = lambda c: ((x - c[kmeans.assign(x, c)]) ** 2).sum()
    from vecskein.functions.rotation import rotate

    assert len(index.tree.leaves) >= 6
    if "kmeans_dimension" not in options:
        assert cost(np.asarray(index.tree.leaves) @ np.linalg.pinv(rotate(np.eye(8)))) < 1.15 * cost(kmeans.lloyd(x, 9))


def test_bounds_spare_rows_and_change_nothing():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(m, 0.3, (300, 6)) for m in (0, 4, 9)])
    told = []
    got = kmeans.lloyd(x, 5, 25, told=told)
    now = x[np.sort(np.random.default_rng(kmeans.SEED).choice(len(x), 5, replace=False))].copy()
    last = None
    for _ in range(25):
        to = kmeans.assign(x, now)
        if last is not None and (to == last).all():
            break
        last = to
        sums = np.zeros_like(now)
        np.add.at(sums, to, x)
        now = kmeans.update(sums, np.bincount(to, minlength=5), now, None)
    assert np.allclose(got, now) and told[0] == 900 and min(told[1:]) < 450


def test_seats_by_odd_divisors():
    assert sorted(kmeans.seats(51, [10, 10, 10, 11, 9])) == [9, 10, 10, 10, 12]


def test_json_is_replaced_in_one_step(spark, tmp_path):
    path = str(tmp_path / "x.json")
    for k in range(3):
        store.write_json(spark, path, {"k": k})
        assert json.loads((tmp_path / "x.json").read_text()) == {"k": k}
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["x.json"]


def test_maxsim_estimate_is_the_greater_one(spark, tmp_path):
    """Rows that a token's lists lack get the greater of the farthest exact distance and the list where the count passes."""
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=(2, 4)).astype(np.float32).tolist()) for k in range(80)]
    docs = spark.createDataFrame(rows, "id long, val array<array<float>>")
    index = IvfIndex.build(docs, str(tmp_path / "m"), "ip", {"internal": {"lists": [8]}}, "val", multivector=True)
    asked = rng.normal(size=(2, 4)).tolist()
    sizes = {r["list_id"]: r["rows"] for r in index.list_counts().collect()}
    x = {k: np.array(v, np.float64) for k, v in rows}
    held = {}
    for r in index.postings().select("row_id", "extra", "list_id").collect():
        held.setdefault(r["list_id"], []).append((r["row_id"], r["extra"]))
    for threshold in (0, 30, 10_000):
        want = {k: 0.0 for k in x}
        fills, seen = [], []
        for q, raw in zip(index._prepared(asked), asked, strict=True):
            order = np.argsort(-(index.tree.leaves @ q), kind="stable").tolist()
            mine = {}
            for row, extra in held.get(order[0], []):
                d = -float(x[row][extra] @ np.array(raw))
                mine[row] = min(mine.get(row, np.inf), d)
            every = [-float(x[row][extra] @ np.array(raw)) for row, extra in held.get(order[0], [])]
            left, beyond = threshold - sizes.get(order[0], 0), -np.inf
            for j in order[1:]:
                if left <= 0:
                    break
                left, beyond = left - sizes.get(j, 0), -float(index.tree.leaves[j] @ q)
            fills.append(max(max(every), beyond) if every else 0.0)
            seen.append((mine, every))
        for row in x:
            want[row] = sum(m.get(row, f) for (m, _), f in zip(seen, fills, strict=True))
        touched = {r for m, _ in seen for r in m}
        got = {r["row_id"]: r["distance"] for r in index.maxsim(asked, None, probes=[1], maxsim_refine=1000, maxsim_threshold=threshold).collect()}
        assert set(got) == touched
        assert all(np.isclose(got[r], want[r], atol=1e-4) for r in touched), threshold
