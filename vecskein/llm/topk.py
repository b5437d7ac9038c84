"""Exact top-k by inner product with a three-phase uniform threshold.

The score of a row is a sum over slices of the dimensions, so a block of rows holds one score list per
slice. Rows and queries are packed into blocks:

1. An eighth of the blocks of rows gather, for every query, the heads of every slice list, add up the whole scores of
   those rows and report the k best. The k-th best of a query is a safe cutoff: k rows reach it.
2. The cutoffs go out with the query blocks to all blocks of rows. A block whose norms can't reach a query's cutoff
   is passed over. A row whose whole score reaches the cutoff exceeds the uniform share of it (cutoff less the
   slice minima, over the slices) in at least one list; only such entries are collected.
3. Their remaining scores are added up exactly, those under the cutoff fall away, and the k best of each
   query in the block go to the final ranking: about eight times k rows of a query, however many rows there are.

Scores are integers and exact; one beyond a long among the results is an error. No table is broadcast and no group is
collected: what one task holds at a time is a pair of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, release, spread

SCALE = 256.0
ROWS, QUERIES, SLICES = 2048, 1024, 4
#: One in so many blocks of rows takes part in the first phase.
PILOT = 8
_NONE = -(2**63)
_MOST = 2**63 - 1


def usable(vector: Column) -> Column:
    """Not null, and no component null or not finite."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _pack(df: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows (id, vector): n, dim, ids and scaled components as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, size):
                part = b.slice(i, size)
                lists = part.column(1)
                lens = np.diff(lists.offsets.to_numpy())
                flat = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                dim = int(lens.max(initial=0))
                out = np.zeros((len(lens), dim))
                out[np.arange(dim)[None, :] < lens[:, None]] = flat  # a shorter vector counts as padded with zeros
                kind = np.int16 if np.abs(out).max(initial=0) < 32768 else np.float64
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([len(ids)]), pa.array([dim]), pa.array([kind == np.int16]), pa.array([ids.tobytes()]), pa.array([out.astype(kind).tobytes()])], ["n", "dim", "small", "ids", "data"])

    return df.mapInArrow(run, "n long, dim long, small boolean, ids binary, data binary")


def _unpack(n: int, dim: int, small: bool, ids: bytes, data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.zeros((n, width))
    m[:, :dim] = np.frombuffer(data, np.int16 if small else np.float64).reshape(n, dim)
    return np.frombuffer(ids, np.int64), m


def _slices(q: np.ndarray, c: np.ndarray, slices: int) -> list[np.ndarray]:
    """Inner products by slices of the dimensions: in doubles while they and their sums are exact, else in Python's integers."""
    edges = np.linspace(0, q.shape[1], slices + 1).astype(int)
    bound = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1])
    if bound < 2**53:
        product = lambda a, b: (a @ b.T).astype(np.int64)
    else:
        whole = lambda m: np.array([int(x) for x in m.ravel().tolist()], object).reshape(m.shape)
        product = lambda a, b: whole(a) @ whole(b).T
    return [product(q[:, a:b], c[:, a:b]) for a, b in zip(edges, edges[1:], strict=False) if b > a] or [np.zeros((len(q), len(c)), np.int64)]


def _best(query: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of every query, by score and then smaller id."""
    order = np.lexsort((ident, -score, query))
    q = query[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])[: len(q)])
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def _every(qids, cids, parts, k: int, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(query, row, whole score) of the k best of ``queries``, among all rows; for scores of any size."""
    at, rows, out = [], [], []
    for i in queries.tolist():
        total = sum(p[i] for p in parts).tolist()
        best = sorted((j for j in range(len(cids)) if cids[j] != qids[i]), key=lambda j: (-total[j], cids[j]))[:k]
        at, rows, out = at + [i] * len(best), rows + best, out + [total[j] for j in best]
    return np.array(at, np.int64), np.array(rows, np.int64), out


def local_heads(qids, q, cids, c, k: int, slices: int) -> tuple[np.ndarray, list[int]]:
    """Phase 1: (query, whole score) of the k best rows among the heads of every slice list."""
    parts = _slices(q, c, slices)
    if parts[0].dtype == object:
        at, _, score = _every(qids, cids, parts, k, np.arange(len(qids)))
        return at, score
    n = min(k + 1, len(cids))  # the query itself may be among them
    heads = np.sort(np.concatenate([np.argpartition(p, len(cids) - n, axis=1)[:, len(cids) - n :] for p in parts], axis=1), axis=1)
    fresh = np.concatenate([np.ones((len(heads), 1), bool), heads[:, 1:] != heads[:, :-1]], axis=1) & (cids[heads] != qids[:, None])
    at, col = np.nonzero(fresh)
    rows = heads[at, col]
    total = sum(p[at, rows] for p in parts)
    best = _best(at, total, cids[rows], k)
    return at[best], total[best].tolist()


def resolve(qids, q, cids, c, cutoffs: np.ndarray, k: int, slices: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Phases 2 and 3: (query, row, whole score) of the k best of each query that reach its cutoff."""
    # by their norms no row of the block reaches these cutoffs
    most = np.sqrt((q * q).sum(axis=1)) * np.sqrt((c * c).sum(axis=1).max(initial=0.0))
    live = np.flatnonzero((cutoffs == _NONE) | (most * (1 + 1e-9) + 1 >= cutoffs))
    if not len(live):
        return live, live, []
    qids, q, cutoffs = qids[live], q[live], cutoffs[live]
    parts = _slices(q, c, slices)
    if parts[0].dtype == object:
        at, rows, score = _every(qids, cids, parts, k, np.arange(len(qids)))
        return live[at], rows, score
    least = [p.min(axis=1) for p in parts]
    # a whole score of at least the cutoff needs a share above the uniform one in some list
    share = (cutoffs.astype(np.float64) - sum(x.astype(np.float64) for x in least)) / len(parts)
    share -= np.abs(share) * 1e-9 + 1
    enough = np.broadcast_to(cutoffs[:, None] == _NONE, parts[0].shape).copy()
    for p, low in zip(parts, least, strict=True):
        enough |= p - low[:, None] >= share[:, None]
    enough &= cids[None, :] != qids[:, None]
    at, rows = np.nonzero(enough)
    total = sum(p[at, rows] for p in parts)
    keep = total >= cutoffs[at]
    at, rows, total = at[keep], rows[keep], total[keep]
    best = _best(at, total, cids[rows], k)
    return live[at[best]], rows[best], total[best].tolist()


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", slices: int = SLICES, rows: int = ROWS, queries: int = QUERIES, pilot: int = PILOT) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every query row, ties to the smaller id.

    Rows whose id is null or whose vector isn't usable take no part. Repeated rows are candidates as
    often as they occur; of query rows that share an id, the one with the least vector is the query, and
    no row with its id is among its candidates. Vectors of unequal length count as padded with zeros.
    With fewer than k candidates all are returned; with none, nothing. A score among the results that no long
    holds is an error, never another number.
    """
    spark = vectors.sparkSession
    good = vectors.where(vectors[id_col].isNotNull() & usable(vectors[vector_col]))
    cand = good.select(good[id_col].cast("long").alias("id"), good[vector_col].cast("array<double>").alias("v"))
    asked = good.where(is_query).select(good[id_col].cast("long").alias("id"), good[vector_col].cast("array<double>").alias("v"))
    cblocks = materialize(_pack(spread(cand), rows).withColumn("cb", F.monotonically_increasing_id()), "rows", rows=rows)
    qblocks = materialize(_pack(asked.groupBy("id").agg(F.min("v").alias("v")).coalesce(1 + spark.sparkContext.defaultParallelism // 4), queries).withColumn("qb", F.monotonically_increasing_id()), "queries", rows=queries)
    # every block of rows meets every block of queries: rows are sent once for each group of query blocks, queries once for each salt
    groups = max(1, qblocks.count())
    salts = max(1, -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // groups))
    names = ("n", "dim", "small", "ids", "data")
    asked_by = F.pmod(F.xxhash64("qb"), F.lit(groups)).cast("int").alias("g")

    def pairs(block_rows: DataFrame, block_queries: DataFrame, more: list[str]) -> DataFrame:
        left = block_rows.select(*names, F.pmod(F.xxhash64("cb"), F.lit(salts)).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
        right = block_queries.select("qb", asked_by, *more, *[F.col(n).alias(f"q_{n}") for n in names], F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
        return left.join(right, ["g", "s"]).drop("g", "s")

    def pair(row: dict):
        width = max(row["dim"], row["q_dim"])
        cids, c = _unpack(*(row[n] for n in names), width)
        qids, q = _unpack(*(row[f"q_{n}"] for n in names), width)
        return qids, q, cids, c

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j in range(b.num_rows):
                row = {n: b.column(x)[j].as_py() for x, n in enumerate(b.schema.names)}
                at, score = local_heads(*pair(row), k, slices)
                fits = [abs(x) <= _MOST for x in score]  # fewer heads make a lower cutoff
                yield pa.RecordBatch.from_arrays([pa.array(np.full(sum(fits), row["qb"])), pa.array(at[fits]), pa.array([x for x, f in zip(score, fits, strict=True) if f], pa.int64())], ["qb", "at", "score"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j in range(b.num_rows):
                row = {n: b.column(x)[j].as_py() for x, n in enumerate(b.schema.names)}
                args = pair(row)
                cut = np.full(len(args[0]), _NONE)
                for c in row["cutoffs"] or []:
                    cut[c["at"]] = c["cutoff"]
                at, found, score = resolve(*args, cut, k, slices)
                beyond = [abs(x) > _MOST for x in score]
                score = [max(-_MOST, min(_MOST, x)) for x in score]  # ranked at the end it belongs to, and never returned
                yield pa.RecordBatch.from_arrays([pa.array(args[0][at]), pa.array(args[2][found]), pa.array(score, pa.int64()), pa.array(beyond, pa.bool_())], ["query_id", "vec_id", "score", "beyond"])

    heads = pairs(cblocks.where(F.pmod(F.xxhash64("cb"), F.lit(pilot)) == 0), qblocks, []).mapInArrow(first, "qb long, at long, score long")
    ranked = heads.withColumn("r", F.row_number().over(W.partitionBy("qb", "at").orderBy(F.desc("score")))).where(F.col("r") <= k)
    cutoffs = ranked.groupBy("qb", "at").agg(F.min("score").alias("cutoff"), F.count("*").alias("n")).where(F.col("n") == k)
    packed = materialize(cutoffs.groupBy("qb").agg(F.collect_list(F.struct("at", "cutoff")).alias("cutoffs")), "cutoffs")
    found = pairs(cblocks, qblocks.join(packed, "qb", "left"), ["cutoffs"]).mapInArrow(second, "query_id long, vec_id long, score long, beyond boolean")
    last = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    checked = F.when(F.col("beyond"), F.raise_error(F.lit("a score among the results is beyond a long")).cast("long")).otherwise(F.col("score"))
    out = materialize(best.select("query_id", "rank", "vec_id", checked.alias("score")), "best")
    for t in (cblocks, qblocks, packed):
        release(t)
    return out


def oracle(k: int = 5, every: int = 50) -> str:
    return f"""WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0
    ) SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""
