"""Reranking by codes is exact wherever codes rank badly."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecskein import facts
from vecskein.functions import quantized as Q
from vecskein.operators import search

METRICS = ("l2", "ip", "cosine")


@pytest.mark.parametrize("bits, first", [(4, 100), (8, 50)])
@pytest.mark.parametrize("metric", METRICS)
def test_rows_nearer_than_the_error_of_codes(spark, metric, bits, first):
    """Many rows about as far from the query as codes err: the first by codes lack most of the nearest."""
    rng = np.random.default_rng(7)
    q = rng.normal(size=64) / 8
    near = q + (0.01 if bits == 4 else 0.001) * rng.normal(size=(1500, 64))
    near *= np.linalg.norm(q) / np.linalg.norm(near, axis=1, keepdims=True)  # lengths tell nothing
    x = np.concatenate([[q], near, 0.5 * rng.normal(size=(300, 64)) / 8, np.zeros((1, 64))])
    e = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").cache()
    query = e.orderBy("vec_id").first()["embedding"]
    want = [r.vec_id for r in search.topk(e, query, 10, metric, id_col="vec_id").collect()]
    rough = e.select("vec_id", Q.quantized_distance(metric, Q.quantize(F.col("embedding"), bits), facts._code(query, bits), bits).alias("rough"))
    kept = {r.vec_id for r in rough.orderBy("rough", "vec_id").limit(first).collect()}
    assert not set(want) <= kept  # a cut at the first by codes loses some
    assert [r.vec_id for r in facts.reranked(e, query, metric, bits, first).collect()] == want


@pytest.mark.parametrize("dim", [1, 3, 64, 100])
def test_error_bound(spark, dim):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(200, dim)), np.zeros((1, dim)), np.eye(dim)[:3], 1e6 * rng.normal(size=(20, dim)), 1e-6 * rng.normal(size=(20, dim)), rng.normal(size=(50, dim)) ** 9])
    e = spark.createDataFrame([(v,) for v in x.tolist()], "v array<double>")
    q = rng.normal(size=dim).tolist()
    for metric in METRICS:
        for bits in (4, 8):
            code = Q.quantize(F.col("v"), bits)
            rows = e.select("v", Q.quantized_distance(metric, code, facts._code(q, bits), bits).alias("d"), Q.error_bound(metric, code, q, bits).alias("err")).collect()
            true = search.paired(metric, np.repeat([q], len(rows), 0), np.array([r.v for r in rows]))
            for r, t in zip(rows, true, strict=True):
                assert np.isnan(t) or np.isnan(r.err) or abs(r.d - t) <= r.err, (metric, bits, r, t)
