"""Results known in advance: fixed inputs, and the ids or numbers that they must give."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecskein.functions import quantized as Q
from vecskein.functions import vectors as V
from vecskein.functions.rotation import rotate, unrotate
from vecskein.operators import kmeans, search
from vecskein.plans.graph import GraphIndex
from vecskein.plans.ivf import ALL, IvfIndex, evaluate_recall

Q64 = [0.6, 0.8] + [0.0] * 62
NEAR = [1608, 155, 1643, 174, 818, 1603, 1629, 60, 218, 1080]
NEAR_4_BITS = [155, 1643, 174, 818, 1207, 1608, 1940, 331, 1568, 1839]


def md5_vectors():
    """2048 unit vectors whose components come from digests of numbers."""
    digest = lambda n: int.from_bytes(hashlib.md5(str(n).encode()).digest()[:8], "big", signed=True) / 18446744073709551615.0
    x = np.array([[digest(64 * i + j) for j in range(1, 65)] for i in range(1, 2049)]).astype(np.float32).astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def t(spark):
    rows = [(i + 1, v) for i, v in enumerate(md5_vectors().tolist())]
    return spark.createDataFrame(rows, "id long, val array<float>").repartition(4).cache()


def ids(df, name="id"):
    return [r[name] for r in df.collect()]


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_exact_and_half_precision(t, metric):
    assert ids(search.topk(t, Q64, 10, metric, "val")) == NEAR
    assert ids(search.topk(t.withColumn("val", V.to_half("val")), Q64, 10, metric, "val")) == NEAR


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
@pytest.mark.parametrize("bits, want", [(8, NEAR), (4, NEAR_4_BITS)])
def test_quantised_order(spark, t, metric, bits, want):
    asked = spark.createDataFrame([(Q64,)], "q array<float>").select(Q.quantize(F.col("q"), bits).alias("q"))
    d = Q.quantized_distance(metric, Q.quantize(F.col("val"), bits), F.col("q"), bits)
    found = t.join(F.broadcast(asked)).select("id", d.alias("d")).orderBy("d", "id").limit(10)
    assert ids(found) == want


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
@pytest.mark.parametrize("options", [None, {"residual_quantization": True, "internal": {"lists": [16], "kmeans_iterations": 3}}])
def test_inverted_lists(t, tmp_path, metric, options):
    index = IvfIndex.build(t, str(tmp_path / "i"), metric, options, "val")
    assert ids(index.search(Q64, 10, probes=[ALL] if options else []), "row_id") == NEAR


@pytest.mark.parametrize("bits, want", [(8, NEAR), (4, NEAR_4_BITS)])
def test_index_of_quantised_vectors(spark, t, tmp_path, bits, want):
    """The distance of two codes is that of the vectors they stand for, so those are what is indexed."""
    coded = t.select("id", Q.quantize(F.col("val"), bits).alias("code"))
    index = IvfIndex.build(coded.select("id", Q.dequantize(F.col("code"), bits).alias("val")), str(tmp_path / "i"), "l2", None, "val")
    query = Q.decode(Q.encode(np.array(Q64), bits)[0], bits).tolist()
    assert ids(index.search(query, 10), "row_id") == want


def test_rerank_in_table(t, tmp_path):
    index = IvfIndex.build(t, str(tmp_path / "i"), "l2", {"rerank_in_table": True}, "val")
    assert ids(index.search(Q64, 10, t), "row_id") == NEAR
    with pytest.raises(ValueError, match="needs it"):
        index.search(Q64, 10)


def test_graph(t, tmp_path):
    index = GraphIndex.build(t, str(tmp_path / "g"), "l2", None, "val")
    assert len(set(ids(index.search(Q64, 10), "row_id")) & set(NEAR)) >= 8
    whole = GraphIndex.build(t, str(tmp_path / "h"), "l2", None, "val", shard_rows=300)
    assert ids(whole.search(Q64, 10, ef_search=400), "row_id") == NEAR


def test_multivectors(spark, t, tmp_path):
    docs = t.select("id", F.array("val", "val").alias("val"))
    asked = [Q64, [v / 2 for v in Q64]]
    assert ids(search.maxsim_topk(docs, asked, 10, "val")) == NEAR
    index = IvfIndex.build(docs, str(tmp_path / "m"), "ip", None, "val", multivector=True)
    assert ids(index.maxsim(asked, 10), "row_id") == [1207, 919, 1639, 1821, 174, 79, 1076, 1125, 239, 194]
    assert ids(index.maxsim(asked, 10, maxsim_refine=5000), "row_id") == NEAR
    with pytest.raises(ValueError, match="max_scan_tuples"):
        index.maxsim(asked, 10, max_scan_tuples=5)
    with pytest.raises(ValueError, match="multivector"):
        index.search(Q64, 10)


def test_multivectors_on_the_circle(spark):
    point = lambda k: [math.cos(k % 10000 / 10000 * 2 * math.pi), math.sin(k % 10000 / 10000 * 2 * math.pi)]
    docs = spark.createDataFrame([(i, [point(i), point(i + 22), point(i + 777)]) for i in range(1, 10001)], "id long, val array<array<float>>")
    asked = [[0.7197411498053302, 0.6942425205048314], [0.10645067063129976, 0.9943179847122079]]
    want = [1387, 1388, 1386, 1389, 1385, 1390, 1384, 1391, 1383, 1392, 1382, 1393, 1381, 1394, 1380, 1395, 1379, 1396]
    assert ids(search.maxsim_topk(docs, asked, 18, "val")) == want


def test_distances(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 3.0, 4.0])], "a array<float>, b array<float>")
    got = row.select(*[V.distance(m, F.col("a"), F.col("b")) for m in ("l2", "ip", "cosine")]).first()
    assert [round(v, 3) for v in got] == [1.732, -20.0, 0.007]


def test_spheres(spark):
    t = spark.createDataFrame([([v] * 3,) for v in (0.1, 0.2, 0.3, 0.4)], "val array<float>")
    got = search.range_search(t, [0.24] * 3, 0.12, "l2", "val").collect()
    assert sorted(round(r["val"][0], 1) for r in got) == [0.2, 0.3]
    for bad in ((None, 0.12), ([0.24] * 3, None)):
        with pytest.raises(ValueError, match="sphere"):
            search.range_search(t, *bad, "l2", "val")
    with pytest.raises(Exception, match="unequal dimensions"):
        search.range_search(t, [0.24] * 2, 0.12, "l2", "val").collect()


def test_expressions_and_lateral_queries(spark, tmp_path):
    t = spark.range(1, 2001).select("id", F.array(*[F.col("id").cast("float")] * 3).alias("val"))
    assert ids(search.topk(t, [1.9] * 3, 9, "l2", "val")) == [2, 1, 3, 4, 5, 6, 7, 8, 9]
    asked = spark.createDataFrame([(1, [1.9, 1.99, 1.999], 1999), (2, [2.1, 2.11, 2.111], 2111)], "query_id long, query array<float>, e int")
    found = search.lateral_topk(asked, t, 9, predicate=F.expr("(id <= 5 OR id % 2 = 1) OR e >= 2000"), vector_col="val").orderBy("query_id", "rank").collect()
    assert [r["id"] for r in found if r["query_id"] == 1] == [2, 1, 3, 4, 5, 7, 9, 11, 13]
    assert [r["id"] for r in found if r["query_id"] == 2] == [2, 3, 1, 4, 5, 6, 7, 8, 9]
    # an index over an expression, filtered before and after the scan
    plain = spark.range(1, 2001)
    index = IvfIndex.build(plain, str(tmp_path / "e"), "l2", None, "array(cast(id as float), cast(id as float), cast(id as float))")
    for prefilter in (False, True):
        assert ids(index.search([1.9] * 3, 5, plain, "id % 2 = 1", prefilter=prefilter), "row_id") == [1, 3, 5, 7, 9]
    assert ids(index.search([1.9] * 3, 9, plain, "id % 2 = 1", max_scan_tuples=4), "row_id") == [1, 3]


def test_recall_and_probes(spark, tmp_path, t):
    line = spark.range(1, 1001).select("id", F.array(*[(F.col("id") * s).cast("float") for s in (1e-4, 5e-5, 2e-4)]).alias("val"))
    index = IvfIndex.build(line, str(tmp_path / "r"), "l2", None, "val")
    assert evaluate_recall(index, [0.05, 0.02, 0.1], 10, line, exact_search=True) == 1.0
    assert math.isnan(evaluate_recall(index, [0.05, 0.02, 0.1], 10, line, where="false"))
    assert evaluate_recall(index, None) is None
    two = spark.createDataFrame([(1, [1.0] * 3), (2, [2.0] * 3)], "id long, val array<float>")
    index = IvfIndex.build(two, str(tmp_path / "p"), "l2", {"internal": {"lists": [2]}}, "val", scan_defaults={"probes": "2"})
    assert ids(index.search([0.0] * 3), "row_id") == [1, 2]
    assert ids(index.search([0.0] * 3, probes=[1]), "row_id") == [1]
    assert ids(index.search([0.0] * 3, probes="0"), "row_id") == []
    with pytest.raises(ValueError, match="need 1 probes, but 2 probes provided"):
        index.search([0.0] * 3, probes=[1, 1])
    assert index.search(None).count() == 0
    near = IvfIndex.build(t, str(tmp_path / "n"), "l2", {"internal": {"lists": [32]}}, "val")
    recall = [evaluate_recall(near, Q64, 10, t, probes=[n]) for n in (1, 8, 32)]
    assert recall[0] <= recall[1] <= recall[2] == 1.0


def test_nulls_and_numbers_that_are_none(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    t = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [nan, inf]), (4, [3.0, 4.0])], "id long, val array<float>")
    assert ids(search.topk(t, [0.0, 0.0], 9, "l2", "val")) == [1, 4, 3]
    nulls = spark.createDataFrame([(i, None) for i in range(50)], "id long, val array<float>")
    assert search.topk(nulls, [0.0, 0.0], 9, "l2", "val").count() == 0
    assert IvfIndex.build(nulls, str(tmp_path / "n"), "l2", None, "val").search([0.0], 9).count() == 0


def test_dequantised(spark):
    v = list(map(float, range(1, 9)))
    for bits, most in ((8, 0.07), (4, 1.0)):
        assert np.linalg.norm(Q.decode(Q.encode(np.array(v), bits)[0], bits) - np.array(v)) < most


def test_rotation():
    assert np.allclose(rotate(np.array([[2.0, 3.0, 4.0]]))[0], [3.981917, 1.8043789, 3.1446066], atol=1e-5)
    for n in (1, 2, 3, 7, 64, 100):
        x = np.random.default_rng(n).normal(size=(5, n))
        assert np.allclose(unrotate(rotate(x)), x)
        assert np.allclose(np.linalg.norm(rotate(x), axis=1), np.linalg.norm(x, axis=1))


def test_seats():
    assert kmeans.seats(51, [10, 10, 10, 11, 9]) == [10, 10, 10, 12, 9]


def test_code_forms():
    rnd = random.Random(3)
    for bits in (8, 4):
        for n in (1, 3, 64):
            q = Q.encode(np.array([rnd.gauss(0, 1) for _ in range(n)]), bits)[0]
            assert Q.from_text(Q.to_text(q, bits), bits) == q
            assert Q.from_bytes(Q.to_bytes(q), bits) == q


def test_bounds_hold():
    """The lower bound of the one-bit estimate lies under the true distance nearly always."""
    rng = np.random.default_rng(5)
    x, q = rotate(rng.normal(size=(2000, 64))), rotate(rng.normal(size=(1, 64)))[0]
    sign, m = Q.bit_codes(x)
    for inner, true in (("l2", ((x - q) ** 2).sum(axis=1)), ("ip", -(x @ q))):
        rough, err = Q.estimate(inner, q, sign, m)
        assert (rough - 1.9 * err <= true).mean() > 0.95
        assert np.corrcoef(rough, true)[0, 1] > 0.7
