"""Codes by matrices against codes one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecskein.functions import quantized as Q


@pytest.mark.parametrize("bits", [4, 8])
def test_distances_by_matrices(spark, bits):
    rng = np.random.default_rng(bits)
    rows = [(k, rng.normal(size=n).astype(np.float32).tolist(), rng.normal(size=n).astype(np.float32).tolist()) for k, n in enumerate([5, 5, 8, 8, 8, 1])] + [(9, None, [1.0]), (10, [1.0], None)]
    df = spark.createDataFrame(rows, "id long, a array<float>, b array<float>").select("id", Q.quantize(F.col("a"), bits).alias("a"), Q.quantize(F.col("b"), bits).alias("b"), F.col("a").alias("x"), F.col("b").alias("y"))
    for metric in ("l2", "ip", "cosine"):
        got = {r[0]: r[1] for r in df.select("id", Q.quantized_distance(metric, F.col("a"), F.col("b"), bits)).collect()}
        for k, x, y in rows:
            if x is None or y is None:
                assert got[k] is None
            else:
                assert np.isclose(got[k], Q.distance(metric, Q.encode(np.array(x), bits)[0], Q.encode(np.array(y), bits)[0], bits))
    back = {r[0]: r[1] for r in df.select("id", Q.dequantize(F.col("a"), bits)).collect()}
    for k, x, _ in rows:
        assert back[k] is None if x is None else np.allclose(back[k], Q.decode(Q.encode(np.array(x), bits)[0], bits))
    with pytest.raises(Exception, match="unequal"):
        spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<float>, b array<float>").select(Q.quantized_distance("l2", Q.quantize(F.col("a"), bits), Q.quantize(F.col("b"), bits), bits)).collect()


@pytest.mark.parametrize("bits", [4, 8])
def test_maxsim_is_one_product(bits):
    rng = np.random.default_rng(3)
    docs, asked = Q.encode(rng.normal(size=(5, 7)), bits), Q.encode(rng.normal(size=(3, 7)), bits)
    want = sum(min(Q.distance("ip", d, q, bits) for d in docs) for q in asked)
    assert np.isclose(Q.maxsim([None, *docs], asked, bits), want)
    assert Q.maxsim([], asked, bits) == float("inf") and Q.maxsim(docs, [], bits) == 0.0
    with pytest.raises(ValueError):
        Q.maxsim(Q.encode(rng.normal(size=(1, 3)), bits), asked, bits)
