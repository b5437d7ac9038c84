"""Registered queries beyond the plain searches: codes, index options, maintenance and streams, with results that SQL can state.

Where an approximate structure is asked for all it has, the result is exact and so is its SQL. Elsewhere a query reports whether what
it promises holds (a recall, a bound, a round trip), computed over the whole table; SQL states the same with TRUE.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecskein.functions import quantized as Q
from vecskein.functions import vectors as V
from vecskein.operators import kmeans, search
from vecskein.plans.graph import GraphIndex
from vecskein.plans.ivf import ALL, IvfIndex, evaluate_recall
from vecskein.sources import sampling
from vecskein.sources.query_log import QueryLog
from vecskein.streaming import ingest

from .catalog import _E, _MAXSIM_SQL, _RADII, K, _asked, _d, _documents, _embeddings, _maxsim_query, _query, _r, _scratch, _topk_sql, finished

LISTS = {"internal": {"lists": [16], "kmeans_iterations": 5}}


def _ids(found: DataFrame, name: str = "vec_id") -> DataFrame:
    return found.orderBy("distance", "row_id").limit(K).select(F.col("row_id").alias(name), _r(F.col("distance"), digits=4))


def _code(vector: list[float], bits: int):
    """A code as a literal."""
    q = Q.encode(np.array(vector), bits)[0]
    return F.struct(*[F.lit(bytearray(q[f]) if f == "code" else q[f]).alias(f) for f in Q.FIELDS]).cast(Q.KIND)


def _reranked(metric: str, bits: int, first: int):
    """The nearest by codes, and of these the nearest by their vectors; these limit what other codes leave open, so that the result is exact."""

    def run(spark, d):
        e, query = _embeddings(spark, d).where("embedding IS NOT NULL"), _query(spark, d)
        return reranked(e, query, metric, bits, first).select("vec_id", _r(F.col("distance"), digits=4))

    return run


def reranked(e: DataFrame, query: list[float], metric: str, bits: int, first: int) -> DataFrame:
    """The K nearest rows of ``e``: vectors are compared for the ``first`` by codes, then for those that their codes let be as near as the K-th of these."""
    coded = e.withColumn("code", Q.quantize(F.col("embedding"), bits))
    coded = coded.withColumns({"rough": Q.quantized_distance(metric, F.col("code"), _code(query, bits), bits), "err": Q.error_bound(metric, F.col("code"), query, bits)}).drop("code")
    bar = search.topk(coded.orderBy("rough", "vec_id").limit(max(first, K)), query, K, metric, id_col="vec_id").agg(F.max("distance").alias("bar"))
    low = F.col("rough") - F.col("err")
    open_ = coded.crossJoin(F.broadcast(bar)).where(F.isnan(low) | (low <= F.col("bar")) | low.isNull())
    return search.topk(open_.drop("rough", "err", "bar"), query, K, metric, id_col="vec_id")


def recall_of_codes(spark, d):
    """Of the hundred nearest by full precision, those among the hundred nearest by 8-bit codes: 95 or more, for each metric."""
    e, query = _embeddings(spark, d).where("embedding IS NOT NULL"), _query(spark, d)
    out = None
    for metric in ("l2", "ip", "cosine"):
        far = Q.quantized_distance(metric, Q.quantize(F.col("embedding"), 8), _code(query, 8), 8)
        rough = e.select("vec_id", far.alias("rough")).orderBy("rough", "vec_id").limit(100).select("vec_id")
        hits = search.topk(e, query, 100, metric, id_col="vec_id").select("vec_id").intersect(rough).agg(F.lit(metric).alias("metric"), (F.count("*") >= 95).alias("enough"))
        out = hits if out is None else out.unionByName(hits)
    return out


def quantized_sphere(spark, d):
    """A sphere on codes holds all rows that lie inside by more than the codes' error, and none that lie outside by more."""
    e, query = _embeddings(spark, d).where("embedding IS NOT NULL"), _query(spark, d)
    code, slack = Q.quantize(F.col("embedding"), 8), 0.02
    inside = Q.quantized_within("l2", code, F.struct(_code(query, 8).alias("center"), F.lit(_RADII["l2"]).cast("float").alias("radius")), 8)
    far = V.l2(F.col("embedding"), V.vector(query))
    return e.select("vec_id", inside.alias("i"), far.alias("f")).select("vec_id", F.when(F.col("f") < _RADII["l2"] - slack, F.col("i")).when(F.col("f") > _RADII["l2"] + slack, ~F.col("i")).otherwise(True).alias("holds"))


def quantize_round_trip(spark, d):
    """The errors of 8 and of 4 bits are within a fiftieth and a fifth of its length, for every vector."""
    v = F.col("embedding")
    rows = _embeddings(spark, d).where("embedding IS NOT NULL").select("vec_id", v, Q.dequantize(Q.quantize(v, 8), 8).alias("a"), Q.dequantize(Q.quantize(v, 4), 4).alias("b"))
    return rows.select("vec_id", (V.l2(v, F.col("a")) < 0.02 * V.norm(v)).alias("within8"), (V.l2(v, F.col("b")) < 0.2 * V.norm(v)).alias("within4"))


def code_text_and_bytes(spark, d):
    """A code's text and bytes give the code back."""
    v = F.col("embedding")
    rows = _embeddings(spark, d).where("embedding IS NOT NULL").select("vec_id", Q.quantize(v, 8).alias("a"), Q.quantize(v, 4).alias("b"))
    same = lambda c, bits: (Q.parse_code(Q.format_code(F.col(c), bits), bits)["code"] == F.col(f"{c}.code")) & (Q.receive_code(Q.send_code(F.col(c)), bits) == F.col(c))
    return rows.select("vec_id", same("a", 8).alias("same8"), same("b", 4).alias("same4"))


def half_precision(spark, d):
    """Halves differ from the vector by at most one part in 2048 of each component, and come back from their bytes."""
    v = F.col("embedding")
    rows = _embeddings(spark, d).where("embedding IS NOT NULL").select("vec_id", v, V.to_half(v).alias("h"), V.from_half_bytes(V.half_bytes(v)).alias("b"))
    close = F.forall(F.zip_with(v, "h", lambda x, y: F.abs(x - y) <= F.abs(x) / 2048 + 1e-7), lambda ok: ok)
    return rows.select("vec_id", close.alias("close"), (F.col("b") == F.col("h")).alias("same"))


def quantized_maxsim(spark, d):
    """The fifty documents that late interaction on 8-bit codes ranks first, ranked again by their vectors."""
    asked, docs = _maxsim_query(spark, d), _documents(_embeddings(spark, d))
    code = F.array(*[_code(q, 8) for q in asked])
    coded = _embeddings(spark, d).where("embedding IS NOT NULL").select(F.floor(F.col("vec_id") / 4).alias("doc"), Q.quantize(F.col("embedding"), 8).alias("c")).groupBy("doc").agg(F.collect_list("c").alias("codes"))
    near = coded.select("doc", Q.quantized_maxsim(F.col("codes"), code, 8).alias("rough")).orderBy("rough", "doc").limit(50)
    return search.maxsim_topk(search.fetch(docs, near, "doc"), asked, K, id_col="doc").select("doc", _r(F.col("distance")))


def half_maxsim(spark, d):
    """As ``quantized_maxsim``, from halves."""
    asked, docs = _maxsim_query(spark, d), _documents(_embeddings(spark, d))
    halves = _embeddings(spark, d).where("embedding IS NOT NULL").select(F.floor(F.col("vec_id") / 4).alias("doc"), V.to_half(F.col("embedding")).cast("array<double>").alias("h")).groupBy("doc").agg(F.collect_list("h").alias("vectors"))
    near = search.maxsim_topk(halves, asked, 50, id_col="doc", name="rough").select("doc")
    return search.maxsim_topk(search.fetch(docs, near, "doc"), asked, K, id_col="doc").select("doc", _r(F.col("distance")))


def sparse_more(spark, d):
    from .catalog import _sparsified

    a, b = _sparsified(F.col("embedding")), _sparsified(V.vector(_query(spark, d)))
    rows = _embeddings(spark, d).where("embedding IS NOT NULL").select("vec_id", a.alias("a"), b.alias("b"))
    return rows.select("vec_id", _r(V.sparse_cosine_distance(F.col("a"), F.col("b")), "cosine"), _r(V.sparse_norm(V.sparse_normalize(F.col("a"))), "unit"))


def bit_logic(spark, d):
    from .catalog import _sign_words

    a, b = _sign_words(F.col("embedding")), _sign_words(V.vector(_query(spark, d)))
    rows = _embeddings(spark, d).where("embedding IS NOT NULL").select("vec_id", a.alias("a"), b.alias("b"))
    ones = lambda c: F.aggregate(F.transform(c, lambda w: F.bit_count(w)), F.lit(0).cast("long"), lambda x, y: x + y)
    a, b = F.col("a"), F.col("b")
    return rows.select("vec_id", ones(V.bit_and(a, b)).alias("shared"), ones(V.bit_or(a, b)).alias("either"), ones(V.bit_xor(a, b)).alias("apart"))


# Index options.


def _full(metric: str, options: dict | None, where: str | None = None, n: int = 1, external: bool = False, **scan):
    """An index under ``options``, all of whose lists are probed: the exact result."""

    def run(spark, d):
        e = _embeddings(spark, d)
        if external:
            table = f"centroids_{abs(hash(d)) % 10**6}"
            spark.read.parquet(f"{d}/embeddings.parquet").where("embedding IS NOT NULL").orderBy("vec_id").limit(8).select(F.col("vec_id").cast("int").alias("id"), F.lit(None).cast("int").alias("parent"), F.col("embedding").alias("vector")).createOrReplaceTempView(table)
            index = IvfIndex.build(e, _scratch(spark, "ivf"), metric, f"[build.external]\ntable = '{table}'", id_col="vec_id")
        else:
            index = IvfIndex.build(e, _scratch(spark, "ivf"), metric, options, id_col="vec_id", where=where)
        own = {k: v for k, v in scan.items() if k != "filter"}
        return finished(_ids(index.search(_query(spark, d), K, e, scan.get("filter"), probes=[ALL] * n, epsilon=4.0, **own)), index)

    return run


def ivf_max_scan_tuples(spark, d):
    """Of the fifty rows that leave the scan first, those that pass the filter."""
    e = _embeddings(spark, d)
    index = IvfIndex.build(e, _scratch(spark, "ivf"), "l2", LISTS, id_col="vec_id")
    found = index.search(_query(spark, d), None, e, "label < 5", probes=[ALL], max_scan_tuples=50, epsilon=4.0)
    return finished(found.select(F.col("row_id").alias("vec_id"), _r(F.col("distance"), digits=4)), index)


def ivf_list_counts(spark, d):
    """Every live row is in one of the lists, and no list is lost."""
    index = IvfIndex.build(_embeddings(spark, d), _scratch(spark, "ivf"), "l2", LISTS, id_col="vec_id")
    return finished(index.list_counts().agg(F.sum("rows").alias("rows"), (F.min("list_id") >= 0).alias("known"), (F.max("list_id") < 16).alias("bounded")), index)


def ivf_recall(spark, d):
    """The recall of a scan of all lists, of an exact search, and of a filter that nothing passes (NaN, as -1)."""
    e, query = _embeddings(spark, d), _query(spark, d)
    index = IvfIndex.build(e, _scratch(spark, "ivf"), "l2", LISTS, id_col="vec_id")
    found = [("lists", evaluate_recall(index, query, K, accurate_epsilon=4.0, probes=[ALL], epsilon=4.0)), ("exact", evaluate_recall(index, query, K, e, True, probes=[ALL], epsilon=4.0)), ("none", evaluate_recall(index, query, K, e, where="label < 0", probes=[ALL]))]
    index.drop()
    return spark.createDataFrame([(n, -1.0 if np.isnan(v) else float(v)) for n, v in found], "kind string, recall double")


def _recall(spark, d, found: DataFrame) -> DataFrame:
    """(queries, enough): whether the mean share of each query's true neighbours in ``found`` is 0.9 or more."""
    e = _embeddings(spark, d).where("embedding IS NOT NULL")
    truth = search.knn_join(_asked(e), e, K, id_col="vec_id").select("query_id", F.col("id").alias("row_id"))
    hits = truth.join(found.select("query_id", "row_id", F.lit(1).alias("hit")), ["query_id", "row_id"], "left")
    return hits.agg(F.count_distinct("query_id").alias("queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("enough"))


def ivf_partial_probe(spark, d):
    """Three quarters of the lists for every query: the recall over all of them."""
    e = _embeddings(spark, d)
    index = IvfIndex.build(e, _scratch(spark, "ivf"), "l2", {"residual_quantization": True, "internal": {"lists": [4, 32], "kmeans_algorithm": "hierarchical"}}, id_col="vec_id")
    return finished(_recall(spark, d, index.search_many(_asked(e), K, probes=[4, 24])), index)


def graph_recall(spark, d):
    """The graph at its usual ef, over all queries."""
    e = _embeddings(spark, d)
    index = GraphIndex.build(e, _scratch(spark, "graph"), "l2", None, id_col="vec_id")
    return finished(_recall(spark, d, index.search_many(_asked(e), K)), index)


def _graph(metric: str, **scan):
    """Walks that end nowhere before all nodes are seen: the exact result."""

    def run(spark, d):
        e = _embeddings(spark, d)
        index = GraphIndex.build(e, _scratch(spark, "graph"), metric, None, id_col="vec_id")
        own = {k: v for k, v in scan.items() if k not in ("filter", "radius")}
        return finished(_ids(index.search(_query(spark, d), K, e, scan.get("filter"), radius=scan.get("radius"), ef_search=65535, **own)), index)

    return run


def ivf_maxsim(spark, d):
    """Late interaction with every row of every token refined: the exact result."""
    docs = _documents(_embeddings(spark, d))
    index = IvfIndex.build(docs, _scratch(spark, "ivf"), "ip", None, vector_col="vectors", id_col="doc", multivector=True)
    found = index.maxsim(_maxsim_query(spark, d), K, probes=[], maxsim_refine=2**31 - 1)
    return finished(found.select(F.col("row_id").alias("doc"), _r(F.col("distance"), digits=4)), index)


def ivf_maxsim_by_codes(spark, d):
    """Late interaction by one-bit codes alone: of the ten best, how many are among the fifty that it ranks first (eight or more)."""
    docs, asked = _documents(_embeddings(spark, d)), _maxsim_query(spark, d)
    index = IvfIndex.build(docs, _scratch(spark, "ivf"), "ip", None, vector_col="vectors", id_col="doc", multivector=True)
    best = search.maxsim_topk(docs, asked, K, id_col="doc").select("doc")
    return finished(best.intersect(index.maxsim(asked, 50, probes=[]).select(F.col("row_id").alias("doc"))).agg((F.count("*") >= 8).alias("enough")), index)


# Maintenance.


def _updated(kind: type, all_: dict):
    """Rows with label 3 deleted and inserted again with turned vectors, those with label 5 deleted, those above 7 inserted late."""

    def run(spark, d):
        e = _embeddings(spark, d)
        key = F.col("vec_id").alias("row_id")
        options = LISTS if kind is IvfIndex else None
        index = kind.build(e.where("label <= 7"), _scratch(spark, "index"), "l2", options, id_col="vec_id")
        index.insert(e.where("label > 7"))
        index.delete(e.where("label IN (3, 5)").select(key))
        index.insert(e.where("label = 3").withColumn("embedding", F.transform("embedding", lambda x: -x)))
        return finished(_ids(index.search(_query(spark, d), K, **all_)), index)

    return run


def graph_after_vacuum(spark, d):
    """Half built, half inserted, one label deleted, then rebuilt."""
    e = _embeddings(spark, d)
    index = GraphIndex.build(e.where("label < 5"), _scratch(spark, "graph"), "cosine", None, id_col="vec_id")
    index.insert(e.where("label >= 5"))
    index.delete(e.where("label = 4").select(F.col("vec_id").alias("row_id")))
    index = index.vacuum(e)
    return finished(_ids(index.search(_query(spark, d), K, ef_search=65535)), index)


def stream_ingest(spark, d):
    """A stream that inserts the rows of half the labels and deletes those of one."""
    e, base = _embeddings(spark, d), _scratch(spark, "stream")
    index = IvfIndex.build(e.where("label < 5"), f"{base}/index", "l2", LISTS, id_col="vec_id")
    ops = e.where("label >= 5").withColumn("op", F.lit("insert")).unionByName(e.where("label = 2").withColumn("op", F.lit("delete")))
    ops.write.parquet(f"{base}/in")
    ingest.ingest(spark.readStream.schema(ops.schema).parquet(f"{base}/in"), index, f"{base}/checkpoint", "op", {"availableNow": True}).awaitTermination()
    return finished(_ids(index.search(_query(spark, d), K, probes=[ALL], epsilon=4.0)), index)


def stream_matches(spark, d):
    """The rows of a stream inside a sphere."""
    base = _scratch(spark, "stream")
    _embeddings(spark, d).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    found = ingest.matches(stream, _query(spark, d), _RADII["l2"]).select("vec_id")
    found.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("vec_id long").parquet(f"{base}/out")


def sampled_queries(spark, d):
    """Three searches of an index whose queries are sampled, and what the log holds of them: the newest two."""
    e, query = _embeddings(spark, d), _query(spark, d)
    log = QueryLog(spark, f"{_scratch(spark, 'log')}")
    for k in range(3):
        log.record("idx", "embeddings", "embedding", "l2", [float(k), *query[1:]], enable=True, max_records=2, rate=1.0)
    got = log.sampled_queries("idx").groupBy("index_name", "operator").agg(F.count("*").alias("n"), F.min(F.size(V.from_text(F.col("value")))).alias("dims"))
    return got.join(e.where("embedding IS NOT NULL").agg(F.min(F.size("embedding")).alias("size"))).select("index_name", "operator", "n", (F.col("dims") == F.col("size")).alias("whole"))


def kmeans_lists(spark, d):
    """Distributed Lloyd: eight lists that hold all rows, and no farther from them than lists of one iteration."""
    e = _embeddings(spark, d).where("embedding IS NOT NULL").select("embedding")
    few, many = (kmeans.lloyd_distributed(e, 8, n) for n in (1, 8))

    def cost(centroids: np.ndarray):
        far = [V.l2_squared(F.col("embedding"), V.vector(c.tolist())) for c in centroids]
        return F.array_min(F.array(*far))

    return e.select(cost(few).alias("a"), cost(many).alias("b")).agg(F.lit(len(many)).alias("lists"), F.count("*").alias("rows"), (F.sum("b") <= F.sum("a")).alias("nearer"))


def block_sample(spark, d):
    """A sample of whole blocks: enough rows, each of the table and none twice."""
    path = f"{d}/embeddings.parquet"
    got = sampling.block_sample(spark, path, 200, 64).select("vec_id", "label")
    known = got.join(spark.read.parquet(path).select("vec_id", "label"), ["vec_id", "label"], "left_semi")
    return got.agg((F.count("*") >= 200).alias("enough"), (F.count("*") <= 264).alias("few"), (F.count("*") == F.count_distinct("vec_id")).alias("once")).join(known.agg(F.count("*").alias("k"))).select("enough", "few", "once", (F.col("k") >= 200).alias("known"))


def range_join_cosine(spark, d):
    e = _embeddings(spark, d)
    return search.range_join(e, e, 0.6, "cosine", left_id="vec_id", right_id="vec_id", distinct=True).select("left_id", "right_id", _r(F.col("distance")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f"rabitq{b}_topk": _reranked("l2", b, n) for b, n in ((8, 50), (4, 100))}
    found |= {"rabitq8_ip_topk": _reranked("ip", 8, 50), "rabitq4_cosine_topk": _reranked("cosine", 4, 100)}
    found |= {
        "ivf_rerank_in_table": _full("l2", {"rerank_in_table": True, **LISTS}),
        "ivf_postfilter": _full("l2", LISTS, filter="label = 3", prefilter=False),
        "ivf_external_build": _full("l2", None, external=True),
        "ivf_partial_index": _full("ip", LISTS, where="label < 5"),
        "ivf_residual_cosine": _full("cosine", {"residual_quantization": True, "internal": {"lists": [4, 16], "kmeans_dimension": 16}}, n=2),
        "ivf_sequential": _full("l2", LISTS, enable_scan=False),
        "graph_topk": _graph("l2"),
        "graph_filtered_range": _graph("cosine", filter="label < 5", radius=0.75),
        "ivf_updated": _updated(IvfIndex, {"probes": [ALL], "epsilon": 4.0}),
        "graph_updated": _updated(GraphIndex, {"ef_search": 65535}),
    }
    for f in (recall_of_codes, quantized_sphere, quantize_round_trip, code_text_and_bytes, half_precision, quantized_maxsim, half_maxsim, sparse_more, bit_logic, ivf_max_scan_tuples, ivf_list_counts, ivf_recall, ivf_partial_probe, graph_recall, ivf_maxsim, ivf_maxsim_by_codes, graph_after_vacuum, stream_ingest, stream_matches, sampled_queries, kmeans_lists, block_sample, range_join_cosine):
        found[f.__name__] = f
    return found


def oracle_sql() -> dict[str, str]:
    near = lambda metric, where="TRUE": _topk_sql(metric, where).replace("round(d, 6)", "round(d, 4)")
    each = lambda *names: f"WITH {_E} SELECT vec_id, {', '.join(f'TRUE AS {n}' for n in names)} FROM e"
    asked = f"WITH {_E} SELECT count(*) AS queries, TRUE AS enough FROM e WHERE vec_id % 20 = 0"
    turned = _E.replace("embedding::DOUBLE[] AS v FROM embeddings", "CASE WHEN label = 3 THEN list_transform(embedding, lambda x: -x) ELSE embedding END::DOUBLE[] AS v FROM embeddings").replace("q AS (SELECT v AS qv FROM e ORDER BY vec_id LIMIT 1)", "q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1)")
    updated = f"WITH {turned} SELECT vec_id, round(d, 4) AS distance FROM (SELECT vec_id, {_d('l2')} AS d FROM e, q WHERE label <> 5) ORDER BY d, vec_id LIMIT {K}"
    sparse = f"WITH {_E}, s AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN abs(x) > 0.125 THEN x ELSE 0 END) AS a, list_transform(qv, lambda x: CASE WHEN abs(x) > 0.125 THEN x ELSE 0 END) AS b FROM e, q) SELECT vec_id, round(list_cosine_distance(a, b), 6) AS cosine, 1.0::DOUBLE AS unit FROM s"
    bits = f"WITH {_E}, s AS (SELECT vec_id, len(list_filter(range(1, len(v) + 1), lambda i: v[i] > 0 AND qv[i] > 0))::BIGINT AS shared, len(list_filter(range(1, len(v) + 1), lambda i: v[i] > 0 OR qv[i] > 0))::BIGINT AS either FROM e, q) SELECT vec_id, shared, either, either - shared AS apart FROM s"
    maxsim4 = _MAXSIM_SQL.replace("round(sum(m), 6)", "round(sum(m), 4)")
    return {
        "rabitq8_topk": near("l2"), "rabitq4_topk": near("l2"), "rabitq8_ip_topk": near("ip"), "rabitq4_cosine_topk": near("cosine"),
        "ivf_rerank_in_table": near("l2"), "ivf_postfilter": near("l2", "label = 3"), "ivf_external_build": near("l2"), "ivf_partial_index": near("ip", "label < 5"),
        "ivf_residual_cosine": near("cosine"), "ivf_sequential": near("l2"), "graph_topk": near("l2"), "graph_filtered_range": near("cosine", f"label < 5 AND {_d('cosine')} < 0.75"),
        "ivf_updated": updated, "graph_updated": updated,
        "recall_of_codes": "SELECT * FROM (VALUES ('l2', TRUE), ('ip', TRUE), ('cosine', TRUE)) t(metric, enough)",
        "quantized_sphere": each("holds"), "quantize_round_trip": each("within8", "within4"), "code_text_and_bytes": each("same8", "same4"), "half_precision": each("close", "same"),
        "quantized_maxsim": _MAXSIM_SQL, "half_maxsim": _MAXSIM_SQL, "sparse_more": sparse, "bit_logic": bits,
        "ivf_max_scan_tuples": f"WITH {_E}, f AS (SELECT vec_id, label, {_d('l2')} AS d FROM e, q ORDER BY d, vec_id LIMIT 50) SELECT vec_id, round(d, 4) AS distance FROM f WHERE label < 5",
        "ivf_list_counts": f"WITH {_E} SELECT count(*) AS rows, TRUE AS known, TRUE AS bounded FROM e",
        "ivf_recall": "SELECT * FROM (VALUES ('lists', 1.0::DOUBLE), ('exact', 1.0::DOUBLE), ('none', -1.0::DOUBLE)) t(kind, recall)",
        "ivf_partial_probe": asked, "graph_recall": asked, "ivf_maxsim": maxsim4, "ivf_maxsim_by_codes": "SELECT TRUE AS enough",
        "graph_after_vacuum": near("cosine", "label <> 4"), "stream_ingest": near("l2", "label <> 2"),
        "stream_matches": f"WITH {_E} SELECT vec_id FROM e, q WHERE {_d('l2')} < {_RADII['l2']}",
        "sampled_queries": "SELECT 'idx' AS index_name, '<->' AS operator, 2::BIGINT AS n, TRUE AS whole",
        "kmeans_lists": f"WITH {_E} SELECT 8 AS lists, count(*) AS rows, TRUE AS nearer FROM e",
        "block_sample": "SELECT TRUE AS enough, TRUE AS few, TRUE AS once, TRUE AS known",
        "range_join_cosine": f"WITH {_E} SELECT a.vec_id AS left_id, b.vec_id AS right_id, round({_d('cosine', 'a.v', 'b.v')}, 6) AS distance FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE {_d('cosine', 'a.v', 'b.v')} < 0.6",
    }
