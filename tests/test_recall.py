"""Recall of the approximate indexes against brute force, over every vec_id divisible by 20."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecskein import catalog
from vecskein.plans.graph import GraphIndex

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def nearest(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").where("embedding IS NOT NULL").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    return {int(ids[k]): set(ids[np.lexsort((ids, ((x - x[k]) ** 2).sum(axis=1)))[:10]].tolist()) for k in np.flatnonzero(ids % 20 == 0)}


def recall(found, nearest):
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], set()).add(r[2])
    return np.mean([len(got.get(q, set()) & want) / len(want) for q, want in nearest.items()])


def test_partial_probe(spark, nearest):
    assert recall(catalog.ivf_partial_probe(spark, SF), nearest) >= 0.9


def test_graph(spark, nearest, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").where("embedding IS NOT NULL")
    index = GraphIndex.build(e, str(tmp_path / "g"), "l2", None, id_col="vec_id")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = recall(index.search_many(asked, 10), nearest)
    print("graph recall", found)
    assert found >= 0.9
