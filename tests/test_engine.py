"""Options, builds, maintenance, sampling, the query log, streams and SQL names."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecskein import session
from vecskein.functions import sql
from vecskein.functions import vectors as V
from vecskein.operators import kmeans, search
from vecskein.plans.graph import GraphIndex
from vecskein.plans.ivf import IvfIndex, external_tree
from vecskein.plans.partitioned import PartitionedIndex
from vecskein.plans.options import GraphOptions, IvfOptions, scan_options
from vecskein.sources import sampling, store
from vecskein.sources.query_log import QueryLog
from vecskein.streaming import ingest


@pytest.fixture(scope="module")
def t(spark):
    x = np.random.default_rng(1).normal(size=(400, 8)).astype(np.float32)
    return spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(x.tolist())], "id long, val array<float>, category int").cache()


def ids(df, name="row_id"):
    return [r[name] for r in df.collect()]


def exact(t, q, k, metric="l2", where=None):
    return ids(search.topk(t, q, k, metric, "val", where=where), "id")


Q8 = [0.3, -0.2, 0.5, 0.1, 0.0, -0.7, 0.2, 0.4]


@pytest.mark.parametrize("given_", [
    "nonsense = 1", "[build.internal]\nlists = [4, 2]", "[build.internal]\nlists = [0]", "[build.internal]\nsampling_factor = 0", "[build.internal]\nkmeans_algorithm = 'other'",
    "[build.internal]\nkmeans_dimension = 0", "[build.external]\ntable = 'a; DROP TABLE b'", "[build.external]\ntable = 'a.b.c'", "degree_of_parallelism = 300",
    "[build.internal]\nlists = [1, 2, 3, 4, 5, 6, 7, 8, 9]", "[build]\nother = 1", "[build.internal]\nlists = [2]\n[build.external]\ntable = 'a'",
])
def test_bad_options(given_):
    with pytest.raises((ValueError, TypeError)):
        IvfOptions.parse(given_)


def test_good_options():
    o = IvfOptions.parse("residual_quantization = true\n[build]\npin = 2\n[build.internal]\nlists = [2, 4]\nspherical_centroids = true\nkmeans_algorithm.hierarchical = {}")
    assert (o.residual_quantization, o.pin, o.internal.lists, o.internal.kmeans_algorithm) == (True, 2, [2, 4], "hierarchical")
    assert IvfOptions.parse({k: v for k, v in o.as_dict().items() if v is not None}) == o
    assert GraphOptions.parse("m = 8\nalpha = [1.0, 1.1]").m == 8
    for bad in ({"bits": 3}, {"m": 0}, {"alpha": [1.1]}, {"alpha": [1.0, 2.0]}, {"ef_construction": 0}, {"other": 1}):
        with pytest.raises(ValueError):
            GraphOptions.parse(bad)


def test_order_of_settings(spark):
    assert scan_options(spark, "ivf")["epsilon"] == 1.9
    assert scan_options(spark, "ivf", None, {"epsilon": 1.0})["epsilon"] == 1.0
    session.set_option(spark, "ivf.epsilon", 0.5)
    try:
        assert scan_options(spark, "ivf", None, {"epsilon": 1.0})["epsilon"] == 0.5
        assert scan_options(spark, "ivf", {"epsilon": 2.0}, {"epsilon": 1.0})["epsilon"] == 2.0
    finally:
        session.unset_option(spark, "ivf.epsilon")
    for bad in ({"epsilon": 5}, {"probes": "x"}, {"max_scan_tuples": -2}, {"io_search": "x"}, {"other": 1}):
        with pytest.raises(ValueError):
            scan_options(spark, "ivf", bad)


def test_external_tree(spark):
    tree = lambda *rows: external_tree(spark.createDataFrame(rows, "id int, parent int, vector array<float>"), 2)
    one, two = [1.0, 0.0], [0.0, 1.0]
    flat = tree((0, None, one), (1, None, two))
    assert len(flat) == 2 and flat[1][0].tolist() == [[0.5, 0.5]]
    deep = tree((0, None, one), (1, 0, two), (2, 0, one), (3, 1, two), (4, 2, one))
    assert [len(c) for c, _ in deep] == [2, 2, 1]
    for bad, said in (
        ([(0, None, one), (0, None, two)], "more than once"), ([(0, None, [1.0]), (1, None, two)], "dimension"), ([(0, None, one), (1, 7, two)], "does not exist"),
        ([(0, None, one), (1, None, two), (2, 0, one)], "more than one root"), ([(0, 1, one), (1, 0, two)], "no root"), ([(0, None, one), (1, 0, one), (2, 3, one), (3, 2, two)], "cycle"),
        ([(0, None, one), (1, 0, two), (2, 0, two), (3, 2, one)], "unequal height"), ([(0, None, one)], "height"), ([(0, None, None), (1, None, one)], "null"),
    ):
        with pytest.raises(ValueError, match=said):
            tree(*bad)


def test_external_build(spark, t, tmp_path):
    rows = [(k, None, [float(k == j) for j in range(8)]) for k in range(8)]
    spark.createDataFrame(rows, "id int, parent int, vector array<float>").createOrReplaceTempView("centroids_of_test")
    index = IvfIndex.build(t, str(tmp_path / "x"), "l2", "[build.external]\ntable = 'centroids_of_test'", "val")
    assert index.tree.heights == [8]
    assert ids(index.search(Q8, 10, probes=[8])) == exact(t, Q8, 10)


@pytest.mark.parametrize("options", [
    {"internal": {"lists": [3, 9]}}, {"internal": {"lists": [9], "kmeans_algorithm": "hierarchical"}}, {"internal": {"lists": [9], "spherical_centroids": True}},
    {"internal": {"lists": [9], "kmeans_dimension": 3}}, {"residual_quantization": True, "internal": {"lists": [2, 4, 8]}},
])
@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_builds(t, tmp_path, options, metric):
    index = IvfIndex.build(t, str(tmp_path / "b"), metric, options, "val")
    n = len(index.tree.heights)
    assert ids(index.search(Q8, 10, probes=[500] * n)) == exact(t, Q8, 10, metric)
    assert index.list_counts().agg(F.sum("rows")).first()[0] == 400
    assert index.cost([500] * n) >= 400
    some = index.search(Q8, 10, probes=[1] * n)
    assert set(ids(some)) <= set(range(400))


def test_maintenance(t, tmp_path):
    half = t.where("id % 2 = 0")
    index = IvfIndex.build(half, str(tmp_path / "i"), "l2", {"internal": {"lists": [4]}}, "val")
    index.insert(t.where("id % 2 = 1"))
    assert ids(index.search(Q8, 10, probes=[4])) == exact(t, Q8, 10)
    index.delete(t.where("id % 5 = 0").select(F.col("id").alias("row_id")))
    want = exact(t, Q8, 10, where=F.expr("id % 5 <> 0"))
    assert ids(index.search(Q8, 10, probes=[4])) == want
    index.vacuum()
    assert ids(index.search(Q8, 10, probes=[4])) == want
    assert not store.children(t.sparkSession, f"{index.root}/tombstones")
    assert '"rows": 320' in index.prewarm()
    assert ids(index.reindex(t).search(Q8, 10, probes=[4])) == exact(t, Q8, 10)
    with pytest.raises(Exception, match="unequal"):
        index.reindex(t).insert(t.select("id", F.slice("val", 1, 3).alias("val")))
    index.drop()
    assert not store.exists(t.sparkSession, index.path)


def test_graph_maintenance(t, tmp_path):
    index = GraphIndex.build(t.where("id < 300"), str(tmp_path / "g"), "cosine", {"m": 16}, "val")
    index.insert(t.where("id >= 300"))
    index.delete(t.where("id % 4 = 0").select(F.col("id").alias("row_id")))
    want = exact(t, Q8, 5, "cosine", F.expr("id % 4 <> 0"))
    assert ids(index.search(Q8, 5, ef_search=400)) == want
    assert ids(index.vacuum(t).search(Q8, 5, ef_search=400)) == want


def test_partial_and_partitioned(t, tmp_path):
    index = IvfIndex.build(t, str(tmp_path / "p"), "l2", None, "val", where="category = 1")
    assert ids(index.search(Q8, 5)) == exact(t, Q8, 5, where=F.expr("category = 1"))
    best = search.partitioned_topk(t, Q8, 2, "category", "l2", "val").collect()
    for c in range(3):
        assert [r["id"] for r in sorted(best, key=lambda r: r["rank"]) if r["category"] == c] == exact(t, Q8, 2, where=F.col("category") == c)


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_joins(t, tmp_path, metric, monkeypatch):
    asked = t.where("id < 20").select(F.col("id").alias("query_id"), F.col("val").alias("query"))
    want = {r["query_id"]: exact(t, r["query"], 4, metric) for r in asked.collect()}
    by_query = lambda df, name: {k: [r[name] for r in sorted(df, key=lambda r: r["rank"]) if r["query_id"] == k] for k in want}
    assert by_query(search.knn_join(asked, t, 4, metric, vector_col="val").collect(), "id") == want
    index = IvfIndex.build(t, str(tmp_path / "j"), metric, {"internal": {"lists": [4]}}, "val")
    assert by_query(index.search_many(asked, 4, probes=[4]).collect(), "row_id") == want
    # the forms for large query sets give the same
    monkeypatch.setattr(search, "SHIPPED", 0)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 6)
    assert by_query(search.knn_join(asked, t, 4, metric, vector_col="val").collect(), "id") == want
    assert by_query(search.lateral_topk(asked, t, 4, metric, vector_col="val").collect(), "id") == want
    pairs = {(r[0], r[1]) for r in search.range_join(t, t, 2.0 if metric == "l2" else -8.0, metric, left_vector="val", right_vector="val", distinct=True).collect()}
    x = np.array([r["val"] for r in t.orderBy("id").collect()], np.float64)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) if metric == "l2" else -(x @ x.T)
    assert pairs == {(i, j) for i, j in zip(*np.nonzero(d < (2.0 if metric == "l2" else -8.0))) if i < j}


def test_top_k_is_pushed_down(spark, t, tmp_path):
    t.write.parquet(str(tmp_path / "t"))
    plan = search.topk(spark.read.parquet(str(tmp_path / "t")), Q8, 3, "l2", "val", where=F.expr("category = 1"))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(category,1)" in plan and "Python" not in plan and "Exchange" not in plan.replace("TakeOrdered", "")


def test_kmeans(t):
    x = np.array([r["val"] for r in t.collect()], np.float64)
    cost = lambda c: ((x - c[kmeans.assign(x, c)]) ** 2).sum()
    local, spread = kmeans.lloyd(x, 6), kmeans.lloyd_distributed(t, 6, vector_col="val")
    assert local.shape == spread.shape == (6, 8)
    assert cost(spread) < 1.1 * cost(local) < 1.1 * cost(x.mean(axis=0, keepdims=True))
    assert kmeans.lloyd(x[:3], 5).shape == (5, 8)
    assert kmeans.lloyd(x[:0].reshape(0, 8), 1).tolist() == [[0.0] * 8]
    # as many different centroids as lists, where all rows but one are the same
    same = np.concatenate([np.ones((50, 2)), [[5.0, 5.0]]])
    assert len(kmeans.lloyd(same, 4)) == 4


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 300), st.integers(0, 1000))
def test_permutation(n, seed):
    assert sorted(sampling.permuted(n, seed)) == list(range(n))


def test_samples(spark, t, tmp_path):
    t.repartition(3).write.parquet(str(tmp_path / "t"))
    got = sampling.block_sample(spark, str(tmp_path / "t"), 100, 16)
    assert 100 <= got.count() <= 400 and set(got.columns) == set(t.columns)
    assert sampling.block_sample(spark, str(tmp_path / "t"), 10_000, 16).count() == 400
    assert ids(sampling.row_sample(t, 5), "id") == ids(sampling.row_sample(t, 5), "id")


def test_query_log(spark, tmp_path):
    log = QueryLog(spark, str(tmp_path / "log"))
    on = {"enable": True, "max_records": 2, "rate": 1.0}
    assert not log.record("i", "t", "val", "l2", [1.0]) and not log.record("i", "t", "val", "l2", None, **on)
    for v in ([0.5, 0.25, 1.0], [2.0], [3.0]):
        assert log.record("i", "t", "val", "l2", v, **on)
    assert log.record("j", "t", "val", "ip", [0.5, 0.25, 1.0], **on)
    assert sorted(ids(log.sampled_values("i"), "value")) == ["[2]", "[3]"]
    assert log.sampled_queries("j").first().asDict() == {"index_name": "j", "table_name": "t", "column_name": "val", "operator": "<#>", "value": "[0.5,0.25,1]"}
    log.create_view("logged")
    assert spark.sql("SELECT count(*) FROM logged").first()[0] == 3
    log.drop("i")
    assert log.sampled_queries().count() == 1
    with pytest.raises(ValueError):
        log.record("i", "t", "val", "l2", [1.0], rate=2.0)


def test_stream(spark, t, tmp_path):
    index = IvfIndex.build(t.where("id < 100"), str(tmp_path / "i"), "l2", {"internal": {"lists": [2]}}, "val")
    marked = t.where("id >= 100").select("id", "val", F.lit("insert").alias("op")).union(t.where("id < 20").select("id", "val", F.lit("delete")))
    marked.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(marked.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second start finds nothing new
        ingest.ingest(stream, index, str(tmp_path / "ck"), "op", {"availableNow": True}).awaitTermination(120)
    assert index.postings().count() == 380
    assert ids(index.search(Q8, 10, probes=[2])) == exact(t, Q8, 10, where=F.expr("id >= 20"))


def test_partitions(t, tmp_path):
    parts = {"zero": "category = 0", "others": "category in (1, 2)"}
    index = PartitionedIndex.build(t.where("id < 300"), str(tmp_path / "p"), parts, "l2", None, {"others": {"internal": {"lists": [1]}}}, vector_col="val", scan_defaults=None)
    index.insert(t.where("id >= 300"))
    probes = {"zero": [], "others": [1]}
    for names in (["zero"], ["others"]):
        assert ids(index.search(Q8, 7, partitions=names, probes=probes[names[0]])) == exact(t, Q8, 7, where=F.expr(parts[names[0]]))
    same = PartitionedIndex.build(t, str(tmp_path / "q"), parts, "cosine", vector_col="val")
    assert ids(same.search(Q8, 7)) == exact(t, Q8, 7, "cosine")
    assert ids(same.search(Q8, 7, t, "id % 2 = 0", prefilter=True)) == exact(t, Q8, 7, "cosine", F.expr("id % 2 = 0"))
    same.delete(t.where("id % 3 = 1").select(F.col("id").alias("row_id")))
    same.vacuum()
    assert ids(same.search(Q8, 7)) == exact(t, Q8, 7, "cosine", F.expr("id % 3 <> 1"))
    with pytest.raises(ValueError):
        same.search(Q8, 7, partitions=[])
    same.drop()
    assert not store.exists(t.sparkSession, same.path)


def test_phases(spark, t, tmp_path):
    told = []
    IvfIndex.build(t, str(tmp_path / "i"), "l2", None, "val", on_phase=told.append)
    assert told == ["checking rows", "finding lists", "writing lists", "writing rows"]
    GraphIndex.build(t, str(tmp_path / "g"), "l2", None, "val", on_phase=told.append)
    assert told[4:] == ["checking rows", "building graphs"]
    assert spark.sparkContext.getLocalProperty("spark.job.description") is None


def test_searches_are_sampled(spark, t, tmp_path):
    log = QueryLog(spark, str(tmp_path / "log"))
    index = IvfIndex.build(t, str(tmp_path / "i"), "ip", None, "val").sampled_by(log, "idx", "t")
    index.search(Q8, 3)
    assert log.sampled_queries().count() == 0  # off unless switched on
    for name, value in (("enable", "on"), ("max_records", 10), ("rate", 1.0)):
        session.set_option(spark, f"log.{name}", value)
    try:
        index.search(Q8, 3)
    finally:
        for name in ("enable", "max_records", "rate"):
            session.unset_option(spark, f"log.{name}")
    row = log.sampled_queries("idx").first()
    assert (row["operator"], row["column_name"], row["value"]) == ("<#>", "val", "[0.3,-0.2,0.5,0.1,0,-0.7,0.2,0.4]")
    index.drop()
    assert log.sampled_queries().count() == 0


def test_sql_names(spark, t):
    made = sql.register(spark)
    assert {"l2_distance", "cosine_distance", "maxsim", "quantize_to_rabitq8", "dequantize_rabitq4_to_halfvec"} <= set(made)
    t.createOrReplaceTempView("sql_t")
    q = ", ".join(f"{v}D" for v in Q8)
    got = spark.sql(f"SELECT id FROM (SELECT id, l2_distance(val, array({q})) AS d FROM sql_t) ORDER BY d, id LIMIT 10")
    assert ids(got, "id") == exact(t, Q8, 10)
    row = spark.sql("SELECT cosine_distance(array(1D, 0D), array(0D, 2D)) AS c, vector_dims(array(1D)) AS n, vector_norm(array(3D, 4D)) AS m, maxsim(array(array(1D, 2D)), array(array(1D, 1D), array(0D, 1D))) AS s").first()
    assert tuple(row) == (1.0, 1, 5.0, -5.0)
    back = spark.sql("SELECT dequantize_rabitq8_to_vector(quantize_to_rabitq8(array(1D, 2D, 3D, 4D))) AS v").first()["v"]
    assert np.allclose(back, [1, 2, 3, 4], atol=0.05)
    with pytest.raises(Exception, match="unequal"):
        spark.sql("SELECT l2_distance(array(1D), array(1D, 2D))").collect()


def test_edges_of_functions(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0], None)], "z array<float>, v array<float>, n array<float>")
    got = row.select(V.cosine_distance(F.col("z"), F.col("v")), V.l2(F.col("v"), F.col("n")), V.compare(F.col("z"), F.col("v")), V.l2_normalize(F.col("z"))).first()
    assert math.isnan(got[0]) and got[1] is None and got[2] == -1 and got[3] == [0.0, 0.0]
    none = F.array().cast("array<array<double>>")
    v = F.array(F.array(F.lit(1.0)))
    assert row.select(V.maxsim(v, none), V.maxsim(none, v)).first()[0:2] == (0.0, math.inf)
