"""Filters, spheres and scans without limit on the graph index."""

from pyspark.sql import functions as F

from vecskein.operators import search
from vecskein.plans.graph import GraphIndex

SF = "/root/testdata/sf0.1"


def test_graph_scans_lose_nothing_to_ef(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").where("embedding IS NOT NULL").limit(1000).cache()
    index = GraphIndex.build(e, str(tmp_path / "g"), "l2", None, id_col="vec_id")
    query = e.orderBy("vec_id").first()["embedding"]
    exact = {r.vec_id: r.distance for r in search.topk(e, query, 1000, "l2", id_col="vec_id").collect()}
    near = sorted(exact, key=lambda i: (exact[i], i))
    got = [r.row_id for r in index.search(query, 10, e, F.col("vec_id") % 90 == 0).collect()]
    assert got == [i for i in near if i % 90 == 0][:10]
    radius = (exact[near[400]] + exact[near[401]]) / 2
    assert {r.row_id for r in index.search(query, None, radius=radius).collect()} == set(near[:401])
    assert index.search(query, None).count() == len(exact)
