"""What a build holds and a search sends, at sizes of several blocks."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from vecskein.operators import search
from vecskein.plans import graph
from vecskein.plans.options import GraphOptions
from vecskein.session import held

SF = "/root/testdata/sf0.1"


def test_a_build_compares_few_rows_at_once():
    x = np.random.default_rng(4).normal(size=(6000, 8))
    tracemalloc.start()
    try:
        graph.build_graph(x, "l2", GraphOptions.parse({"m": 4, "ef_construction": 8}))
        assert tracemalloc.get_traced_memory()[1] < 32 << 20
    finally:
        tracemalloc.stop()


def test_a_search_sends_shards_once_a_line(spark, tmp_path):
    rng = np.random.default_rng(5)
    e = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(2000, 4)).tolist())], "vec_id long, embedding array<double>")
    index = graph.GraphIndex.build(e, str(tmp_path / "g"), "l2", {"m": 128, "ef_construction": 128}, id_col="vec_id", shard_rows=500)
    size = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    status = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(x.totalShuffleWrite() for x in (status.executorList(True).apply(i) for i in range(status.executorList(True).size())))
    asked = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    with held(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        before = written()
        found = index.search_many(asked, 3).collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        sent = written() - before
    assert len(found) == 6000 and sent < 3 * size


def test_lines_and_groups_are_bounded():
    assert graph._cells(76, 30769, 30769 * 528, 12) == (64, 2)
    assert graph._cells(2, 513, 513 * 528, 12) == (2, 6)
    assert graph._cells(1, 17, 17 * 528, 64) == (1, 17)


def test_cells_lose_no_pair(spark, tmp_path, monkeypatch):
    """Many lines and groups, inserted and deleted rows: all nodes walked, the exact result."""
    monkeypatch.setattr(graph, "LINE", 8 << 10)
    e = spark.read.parquet(f"{SF}/embeddings.parquet").where("embedding IS NOT NULL AND vec_id < 700").cache()
    index = graph.GraphIndex.build(e.where("vec_id < 500"), str(tmp_path / "g"), "cosine", {"m": 16}, id_col="vec_id", shard_rows=90)
    index.insert(e.where("vec_id >= 500"))
    index.delete(e.where("vec_id % 7 = 0").select(F.col("vec_id").alias("row_id")))
    asked = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {(r.query_id, r["rank"]): (r.row_id, round(r.distance, 4)) for r in index.search_many(asked, 4, ef_search=65535).collect()}
    truth = search.knn_join(asked, e.where("vec_id % 7 <> 0"), 4, "cosine", id_col="vec_id")
    assert got == {(r.query_id, r["rank"]): (r.id, round(r.distance, 4)) for r in truth.collect()}


def test_one_query_takes_k_rows_a_shard(spark, tmp_path):
    rng = np.random.default_rng(6)
    e = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(600, 4)).tolist())], "vec_id long, embedding array<double>")
    index = graph.GraphIndex.build(e, str(tmp_path / "g"), "l2", {"m": 8, "ef_construction": 16}, id_col="vec_id", shard_rows=200)
    asked = spark.createDataFrame([(0, [0.0] * 4)], "query_id long, query array<double>")
    assert index._walked(asked, graph.ALL_NODES, 1).count() == 600
    found = index._walked(asked, graph.ALL_NODES, 1, 7)
    near = sorted((sum(x * x for x in r.embedding), r.vec_id) for r in e.collect())[:7]
    assert found.count() <= 7 * 3
    assert [r.row_id for r in found.orderBy("distance").limit(7).collect()] == [i for _, i in near]
