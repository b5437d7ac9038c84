"""All registered queries of the vector engine, over the whole embeddings table, and their SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecskein.functions import quantized as Q
from vecskein.functions import vectors as V
from vecskein.operators import kmeans, search
from vecskein.plans.graph import GraphIndex
from vecskein.plans.ivf import ALL, IvfIndex
from vecskein.plans.partitioned import PartitionedIndex
from vecskein.session import spread
from vecskein.sources import sampling

K = 10


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The table, dealt over the cores: one row group would be one task."""
    return spread(spark.read.parquet(f"{d}/embeddings.parquet"))


def _query(spark: SparkSession, d: str) -> list[float]:
    """The vector with the smallest id: one row."""
    return spark.read.parquet(f"{d}/embeddings.parquet").where("embedding IS NOT NULL").orderBy("vec_id").select("embedding").first()[0]


def _scratch(spark: SparkSession, name: str) -> str:
    """A path below the cluster's shared folder; where none is named, below one that goes with this process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or _own_dir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@cache
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="vecskein-index-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def finished(result: DataFrame, index) -> DataFrame:
    """``result`` of an index that a query has built, written down so that the index can go."""
    spark = result.sparkSession
    path = _scratch(spark, "result")
    result.write.parquet(path)
    index.drop()
    return spark.read.schema(result.schema).parquet(path)


def _r(c, name: str = "distance", digits: int = 6):
    return F.round(c, digits).alias(name)


def _topk(metric: str):
    def run(spark, d):
        return search.topk(_embeddings(spark, d), _query(spark, d), K, metric, id_col="vec_id").select("vec_id", _r(F.col("distance")))

    return run


_DIST = {"l2": "list_distance({a}, {b})", "ip": "list_negative_inner_product({a}, {b})", "cosine": "list_cosine_distance({a}, {b})"}
_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), q AS (SELECT v AS qv FROM e ORDER BY vec_id LIMIT 1)"


def _d(metric: str, a: str = "v", b: str = "qv") -> str:
    return _DIST[metric].format(a=a, b=b)


def _topk_sql(metric: str, where: str = "TRUE") -> str:
    return f"WITH {_E} SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, {_d(metric)} AS d FROM e, q WHERE {where}) ORDER BY d, vec_id LIMIT {K}"


_RADII = {"l2": 1.25, "ip": -0.25, "cosine": 0.75}


def _sphere(metric: str):
    def run(spark, d):
        ball = V.sphere(V.vector(_query(spark, d)), F.lit(_RADII[metric]))
        return _embeddings(spark, d).where(V.within(metric, F.col("embedding"), ball)).select("vec_id")

    return run


def sphere_ordered(spark, d):
    return search.range_search(_embeddings(spark, d), _query(spark, d), 1.25).orderBy("distance", "vec_id").limit(K).select("vec_id", _r(F.col("distance")))


def filtered_topk(spark, d):
    return search.topk(_embeddings(spark, d), _query(spark, d), K, id_col="vec_id", where=F.col("label") == 3).select("vec_id", _r(F.col("distance")))


def partitioned_topk(spark, d):
    return search.partitioned_topk(_embeddings(spark, d), _query(spark, d), 3, "label", id_col="vec_id").select("label", "rank", "vec_id", _r(F.col("distance")))


def ordered_scan(spark, d):
    return search.ordered(_embeddings(spark, d), _query(spark, d), id_col="vec_id").select("vec_id", _r(F.col("distance")))


def _asked(e: DataFrame) -> DataFrame:
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label"))


def _knn(metric: str):
    def run(spark, d):
        e = _embeddings(spark, d)
        return search.knn_join(_asked(e), e, 5, metric, id_col="vec_id").select("query_id", "rank", F.col("id").alias("vec_id"), _r(F.col("distance")))

    return run


def _knn_sql(metric: str, on: str = "TRUE") -> str:
    return f"WITH {_E}, p AS (SELECT a.vec_id AS query_id, b.vec_id, {_d(metric, 'a.v', 'b.v')} AS d FROM e a JOIN e b ON {on} WHERE a.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p) SELECT query_id, rank::INTEGER AS rank, vec_id, round(d, 6) AS distance FROM r WHERE rank <= 5"


def lateral_topk(spark, d):
    e = _embeddings(spark, d)
    return search.lateral_topk(_asked(e), e, 5, predicate=F.col("label") != F.col("query_label"), id_col="vec_id").select("query_id", "rank", F.col("id").alias("vec_id"), _r(F.col("distance")))


def range_join(spark, d):
    e = _embeddings(spark, d)
    return search.range_join(e, e, 1.1, left_id="vec_id", right_id="vec_id", distinct=True).select("left_id", "right_id", _r(F.col("distance")))


def _documents(e: DataFrame) -> DataFrame:
    """Four neighbouring vectors make a document."""
    rows = e.groupBy(F.floor(F.col("vec_id") / 4).alias("doc")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("s"))
    return rows.select("doc", F.transform("s", lambda x: x["embedding"].cast("array<double>")).alias("vectors"))


def _maxsim_query(spark, d) -> list[list[float]]:
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").limit(4).collect()
    return [list(map(float, r["embedding"])) for r in rows]


def maxsim_topk(spark, d):
    return search.maxsim_topk(_documents(_embeddings(spark, d)), _maxsim_query(spark, d), K, id_col="doc").select("doc", _r(F.col("distance")))


_MAXSIM_SQL = f"""WITH {_E}, asked AS (SELECT vec_id AS qid, v AS qv FROM e ORDER BY vec_id LIMIT 4),
 s AS (SELECT e.vec_id // 4 AS doc, qid, min(-list_inner_product(e.v, asked.qv)) AS m FROM e, asked GROUP BY ALL)
 SELECT doc, round(sum(m), 6) AS distance FROM s GROUP BY doc ORDER BY sum(m), doc LIMIT {K}"""


def vector_functions(spark, d):
    v, q = F.col("embedding"), V.vector(_query(spark, d))
    sums = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return _embeddings(spark, d).where("embedding IS NOT NULL").select(
        "vec_id", V.dim(v).alias("dims"), _r(V.norm(v), "norm"), _r(sums(V.add(v, q)), "added"), _r(sums(V.subtract(v, q)), "subtracted"), _r(sums(V.multiply(v, q)), "multiplied"), _r(F.get(V.l2_normalize(v), F.lit(0)), "first"), V.compare(v, q).alias("compared"), _r(V.l2_squared(v, q), "squared"),
    )


_FUNCTIONS_SQL = f"""WITH {_E} SELECT vec_id, len(v)::INTEGER AS dims, round(sqrt(list_inner_product(v, v)), 6) AS norm,
 round(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] + qv[i])), 6) AS added, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] - qv[i])), 6) AS subtracted,
 round(list_inner_product(v, qv), 6) AS multiplied, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first,
 CASE WHEN v < qv THEN -1 WHEN v > qv THEN 1 ELSE 0 END::INTEGER AS compared, round(pow(list_distance(v, qv), 2), 6) AS squared FROM e, q"""


def _sparsified(v):
    """Components beyond 0.125 alone."""
    at = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.abs(F.get(v, i)) > 0.125)
    return V.sparse(F.size(v), at, F.transform(at, lambda i: F.get(v, i)))


def sparse_functions(spark, d):
    a, b = _sparsified(F.col("embedding")), _sparsified(V.vector(_query(spark, d)))
    rows = _embeddings(spark, d).where("embedding IS NOT NULL").select("vec_id", a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("vec_id", F.size("a.indexes").alias("n"), _r(V.sparse_dot(a, b), "dot"), _r(V.sparse_l2(a, b), "l2"), _r(V.sparse_norm(V.sparse_add(a, b)), "sum_norm"), _r(V.sparse_norm(V.sparse_subtract(a, b)), "difference_norm"), _r(V.sparse_norm(V.sparse_multiply(a, b)), "product_norm"))


_SPARSE_SQL = f"""WITH {_E}, s AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN abs(x) > 0.125 THEN x ELSE 0 END) AS a, list_transform(qv, lambda x: CASE WHEN abs(x) > 0.125 THEN x ELSE 0 END) AS b FROM e, q),
 z AS (SELECT *, list_transform(range(1, len(a) + 1), lambda i: a[i] + b[i]) AS p, list_transform(range(1, len(a) + 1), lambda i: a[i] * b[i]) AS m FROM s)
 SELECT vec_id, len(list_filter(a, lambda x: x <> 0))::INTEGER AS n, round(list_inner_product(a, b), 6) AS dot, round(list_distance(a, b), 6) AS l2, round(sqrt(list_inner_product(p, p)), 6) AS sum_norm,
 round(list_distance(a, b), 6) AS difference_norm, round(sqrt(list_inner_product(m, m)), 6) AS product_norm FROM z"""


def _sign_words(v):
    """Bit i of word i / 64 is set for a positive component."""
    word = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.when(F.get(v, w * 64 + i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 64).cast("int")), word)


def bit_functions(spark, d):
    a, b = _sign_words(F.col("embedding")), _sign_words(V.vector(_query(spark, d)))
    rows = _embeddings(spark, d).where("embedding IS NOT NULL").select("vec_id", a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("vec_id", V.bit_dot(a, b).alias("dot"), V.bit_hamming(a, b).alias("hamming"), _r(V.bit_jaccard(a, b), "jaccard"))


_BIT_SQL = f"""WITH {_E}, s AS (SELECT vec_id, len(list_filter(range(1, len(v) + 1), lambda i: v[i] > 0 AND qv[i] > 0)) AS shared, len(list_filter(range(1, len(v) + 1), lambda i: v[i] > 0 OR qv[i] > 0)) AS either FROM e, q)
 SELECT vec_id, shared::BIGINT AS dot, (either - shared)::BIGINT AS hamming, round(1 - shared / either, 6) AS jaccard FROM s"""


def ivf_full_probe_topk(spark, d):
    """Every list probed and every row reranked: the exact result."""
    index = IvfIndex.build(_embeddings(spark, d), _scratch(spark, "ivf"), "l2", {"internal": {"lists": [16], "kmeans_iterations": 5}}, id_col="vec_id")
    found = index.search(_query(spark, d), None, probes=[ALL])
    return finished(found.orderBy("distance", "row_id").limit(K).select(F.col("row_id").alias("vec_id"), _r(F.col("distance"), digits=4)), index)


def ivf_filtered_range(spark, d):
    """A sphere and a filter below the rerank."""
    e = _embeddings(spark, d)
    index = IvfIndex.build(e, _scratch(spark, "ivf"), "cosine", None, id_col="vec_id")
    return finished(index.search(_query(spark, d), None, e, "label < 5", radius=0.75, prefilter=True).select(F.col("row_id").alias("vec_id")), index)


def ivf_join(spark, d):
    """All lists for every query."""
    e = _embeddings(spark, d)
    index = IvfIndex.build(e, _scratch(spark, "ivf"), "ip", {"internal": {"lists": [4], "kmeans_iterations": 3}}, id_col="vec_id")
    found = index.search_many(_asked(e), 5, probes=[ALL])
    return finished(found.select("query_id", "rank", F.col("row_id").alias("vec_id"), _r(F.col("distance"), digits=4)), index)


def ivf_partial_probe(spark, d):
    """Part of the lists for every query; on sf0.1 a recall of 0.95 (0.60 at probes of 2 and 8)."""
    e = _embeddings(spark, d)
    index = IvfIndex.build(e, _scratch(spark, "ivf"), "l2", {"residual_quantization": True, "internal": {"lists": [4, 32], "kmeans_algorithm": "hierarchical"}}, id_col="vec_id")
    found = index.search_many(_asked(e), K, probes=[4, 24])
    return found.select("query_id", "rank", F.col("row_id").alias("vec_id"), _r(F.col("distance"), digits=4))


def partitioned_index_topk(spark, d):
    """An index for each of two partitions; of the second one's rows only even ids."""
    e = _embeddings(spark, d)
    index = PartitionedIndex.build(e, _scratch(spark, "parts"), {"low": "label < 5", "high": "label >= 5"}, "cosine", id_col="vec_id")
    found = index.search(_query(spark, d), K, e, "label < 5 OR vec_id % 2 = 0", prefilter=True)
    return finished(found.orderBy("distance", "row_id").select(F.col("row_id").alias("vec_id"), _r(F.col("distance"), digits=4)), index)


def partitioned_index_all(spark, d):
    """An index for each of two partitions, both asked for all rows: the exact result."""
    e = _embeddings(spark, d)
    index = PartitionedIndex.build(e, _scratch(spark, "parts"), {"low": "label < 5", "high": "label >= 5"}, "cosine", id_col="vec_id")
    found = index.search(_query(spark, d), None, e)
    return finished(found.orderBy("distance", "row_id").limit(K).select(F.col("row_id").alias("vec_id"), _r(F.col("distance"), digits=4)), index)


def ivf_after_maintenance(spark, d):
    """Half the rows built, half inserted, a seventh deleted, then vacuumed."""
    e = _embeddings(spark, d)
    index = IvfIndex.build(e.where("vec_id % 2 = 0"), _scratch(spark, "ivf"), "l2", {"internal": {"lists": [8]}}, id_col="vec_id")
    index.insert(e.where("vec_id % 2 = 1"))
    index.delete(e.where("vec_id % 7 = 3").select(F.col("vec_id").alias("row_id")))
    index.vacuum()
    found = index.search(_query(spark, d), None, probes=[ALL])
    return finished(found.orderBy("distance", "row_id").limit(K).select(F.col("row_id").alias("vec_id"), _r(F.col("distance"), digits=4)), index)


def recall_intersect(spark, d):
    """Ids that l2 and inner product, both exact, put among the first hundred."""
    e, q = _embeddings(spark, d), _query(spark, d)
    a = search.topk(e, q, 100, "l2", id_col="vec_id").select("vec_id")
    b = search.topk(e, q, 100, "ip", id_col="vec_id").select("vec_id")
    return a.intersect(b).agg(F.count("*").alias("hits"))


_RECALL_SQL = f"""WITH {_E}, a AS (SELECT vec_id FROM e, q ORDER BY {_d("l2")}, vec_id LIMIT 100), b AS (SELECT vec_id FROM e, q ORDER BY {_d("ip")}, vec_id LIMIT 100)
 SELECT count(*) AS hits FROM (SELECT * FROM a INTERSECT SELECT * FROM b)"""


def text_round_trip(spark, d):
    v = F.col("embedding")
    rows = _embeddings(spark, d).where("embedding IS NOT NULL").select("vec_id", v, V.from_text(V.as_text(v)).alias("back"))
    return rows.select("vec_id", (F.col("embedding") == F.col("back")).alias("same"))


def queries() -> dict:
    found = {f"exact_{m}_topk": _topk(m) for m in ("l2", "ip", "cosine")}
    found |= {f"sphere_{m}": _sphere(m) for m in ("l2", "ip", "cosine")}
    found |= {f"knn_join_{m}": _knn(m) for m in ("l2", "ip", "cosine")}
    for f in (sphere_ordered, filtered_topk, partitioned_topk, ordered_scan, lateral_topk, range_join, maxsim_topk, vector_functions, sparse_functions, bit_functions, ivf_full_probe_topk, ivf_filtered_range, ivf_join, partitioned_index_topk, partitioned_index_all, ivf_after_maintenance, recall_intersect, text_round_trip):
        found[f.__name__] = f
    from vecskein import facts

    return found | facts.queries()


def oracle_sql() -> dict[str, str]:
    found = {f"exact_{m}_topk": _topk_sql(m) for m in _DIST}
    found |= {f"sphere_{m}": f"WITH {_E} SELECT vec_id FROM e, q WHERE {_d(m)} < {_RADII[m]}" for m in _DIST}
    found |= {f"knn_join_{m}": _knn_sql(m) for m in _DIST}
    found["sphere_ordered"] = _topk_sql("l2", f"{_d('l2')} < 1.25")
    found["filtered_topk"] = _topk_sql("l2", "label = 3")
    found["partitioned_topk"] = f"WITH {_E}, r AS (SELECT label, vec_id, {_d('l2')} AS d, row_number() OVER (PARTITION BY label ORDER BY {_d('l2')}, vec_id) AS rank FROM e, q) SELECT label, rank::INTEGER AS rank, vec_id, round(d, 6) AS distance FROM r WHERE rank <= 3"
    found["ordered_scan"] = f"WITH {_E} SELECT vec_id, round({_d('l2')}, 6) AS distance FROM e, q"
    found["lateral_topk"] = _knn_sql("l2", "a.label <> b.label")
    found["range_join"] = f"WITH {_E} SELECT a.vec_id AS left_id, b.vec_id AS right_id, round({_d('l2', 'a.v', 'b.v')}, 6) AS distance FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE {_d('l2', 'a.v', 'b.v')} < 1.1"
    found |= {"maxsim_topk": _MAXSIM_SQL, "vector_functions": _FUNCTIONS_SQL, "sparse_functions": _SPARSE_SQL, "bit_functions": _BIT_SQL, "recall_intersect": _RECALL_SQL}
    found["ivf_full_probe_topk"] = _topk_sql("l2").replace("round(d, 6)", "round(d, 4)")
    found["ivf_filtered_range"] = f"WITH {_E} SELECT vec_id FROM e, q WHERE {_d('cosine')} < 0.75 AND label < 5"
    found["ivf_join"] = _knn_sql("ip").replace("round(d, 6)", "round(d, 4)")
    found["ivf_after_maintenance"] = _topk_sql("l2", "vec_id % 7 <> 3").replace("round(d, 6)", "round(d, 4)")
    found["partitioned_index_topk"] = _topk_sql("cosine", "label < 5 OR vec_id % 2 = 0").replace("round(d, 6)", "round(d, 4)")
    found["partitioned_index_all"] = _topk_sql("cosine").replace("round(d, 6)", "round(d, 4)")
    found["text_round_trip"] = f"WITH {_E} SELECT vec_id, TRUE AS same FROM e"
    from vecskein import facts

    return found | facts.oracle_sql()
