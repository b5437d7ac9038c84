"""Exact search: top-k, spheres, joins and late interaction over plain DataFrames.

Single queries are column expressions, so Catalyst prunes columns, pushes filters to the scan and plans a
top-k of the limit. Query sets are scored as matrices over Arrow batches: a side that is checked to be small is shipped to
the tasks, a larger one meets the corpus in packed blocks, dealt over a grid so that either side is sent about as
often as the square root of the number of tasks.

Rows with a null vector have a null distance and are left out; NaN distances sort last; ties go by id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import pairwise
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecskein.functions import vectors as V

#: Bytes of query vectors that are shipped to every task; a larger set is joined in blocks.
SHIPPED = 32 << 20
BLOCK_QUERIES = 4096
#: Rows of a packed block, at most.
BLOCK = 1024
#: Queries and rows of a matrix of distances, and components that are compared pair by pair at once.
TILE, PAIRED = 1024, 1 << 21
#: Different values of a side's columns in a predicate over pairs, up to which it is told by a table.
CLASSES = 1000
#: Pivots of a range join, picked among four times as many rows.
PIVOTS = 16


def _as_vector(q) -> Column:
    return q if isinstance(q, Column) else V.vector(q)


def _distance(df: DataFrame, query, metric: str, vector_col: str) -> Column:
    return V.distance(metric, df[vector_col], _as_vector(query))


def scored(df: DataFrame, query, metric: str = "l2", vector_col: str = "embedding", name: str = "distance") -> DataFrame:
    """``df`` with the distance of each row; null queries give no rows."""
    if query is None:
        return df.limit(0).withColumn(name, F.lit(None).cast("double"))
    return df.withColumn(name, _distance(df, query, metric, vector_col))


def topk(df: DataFrame, query, k: int, metric: str = "l2", vector_col: str = "embedding", id_col: str = "id", where: Column | None = None, name: str = "distance") -> DataFrame:
    """The k nearest rows; ``where`` filters before any distance is computed."""
    rows = df if where is None else df.where(where)
    return scored(rows, query, metric, vector_col, name).where(F.col(name).isNotNull()).orderBy(F.isnan(name), name, id_col).limit(k)


def ordered(df: DataFrame, query, metric: str = "l2", vector_col: str = "embedding", id_col: str = "id", name: str = "distance") -> DataFrame:
    """All rows in order of distance: a ranged sort, for a scan without limit."""
    return scored(df, query, metric, vector_col, name).where(F.col(name).isNotNull()).orderBy(F.isnan(name), name, id_col)


def range_search(df: DataFrame, center, radius: float, metric: str = "l2", vector_col: str = "embedding", name: str = "distance") -> DataFrame:
    """Rows strictly inside a sphere. A missing centre or radius is an error."""
    if center is None or radius is None:
        raise ValueError("a sphere needs a center and a radius")
    return scored(df, center, metric, vector_col, name).where(F.col(name) < F.lit(float(np.float32(radius))))


def partitioned_topk(df: DataFrame, query, k: int, partition_col: str, metric: str = "l2", vector_col: str = "embedding", id_col: str = "id", name: str = "distance") -> DataFrame:
    """The k nearest rows of every partition value. The limit works within each task before rows are dealt."""
    rows = scored(df, query, metric, vector_col, name).where(F.col(name).isNotNull())
    rank = F.row_number().over(W.partitionBy(partition_col).orderBy(F.isnan(name), name, id_col))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def maxsim_topk(df: DataFrame, queries: Sequence[Sequence[float]] | Column, k: int, vectors_col: str = "vectors", id_col: str = "id", name: str = "distance") -> DataFrame:
    """The k documents (arrays of vectors) that late interaction ranks best."""
    asked = queries if isinstance(queries, Column) else F.array(*[V.vector(q) for q in queries]).cast("array<array<double>>")
    return df.withColumn(name, V.maxsim(df[vectors_col], asked)).where(F.col(name).isNotNull()).orderBy(name, id_col).limit(k)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that aren't null, their vectors as doubles)."""
    ok = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return ok, flat.reshape(len(ok), -1) if len(ok) else np.zeros((0, 0))


def pair_distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of every query row to every row, as matrices."""
    if q.shape[1] != x.shape[1]:
        raise ValueError("vectors of unequal dimensions")
    if metric == "l2":
        # differences, block by block: the expanded form loses digits among near rows
        out = np.empty((len(q), len(x)))
        for i in range(len(q)):
            d = x - q[i]
            out[i] = np.sqrt(np.einsum("ij,ij->i", d, d))
        return out
    dot = q @ x.T
    if metric == "ip":
        return -dot
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 - dot / np.sqrt((q * q).sum(1)[:, None] * (x * x).sum(1)[None, :])


def nearest(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k least, NaN last, ties by id."""
    if len(dist) > 8 * k:
        bar = np.partition(dist, k - 1)[k - 1]
        at = np.flatnonzero(~(dist > bar)) if not np.isnan(bar) else np.arange(len(dist))
    else:
        at = np.arange(len(dist))
    return at[np.lexsort((ids[at], dist[at]))[:k]]


def paired(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``q`` to the same rows of ``x``: equal vectors have equal distances, wherever they lie."""
    if metric == "l2":
        d = x - q
        return np.sqrt(np.einsum("ij,ij->i", d, d))
    dot = np.einsum("ij,ij->i", q, x)
    if metric == "ip":
        return -dot
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        return 1 - dot / np.sqrt(np.einsum("ij,ij->i", q, q) * np.einsum("ij,ij->i", x, x))


class Nearest:
    """The k nearest rows of each query among those that were added, NaN last, ties by id.

    Queries and rows meet in tiles, so that memory holds for any number of either. A product of matrices, with a bound of its rounding,
    picks the pairs that may be among the k; these are measured pair by pair. ``allowed``, by the classes of both sides, says which pairs count.
    """

    def __init__(self, metric: str, qids: np.ndarray, q: np.ndarray, k: int, classes: np.ndarray | None = None, allowed: np.ndarray | None = None) -> None:
        self.metric, self.qids, self.q, self.k, self.classes, self.allowed = metric, qids, q, k, classes, allowed
        none = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        #: Of each tile of queries: (query, distance, id) in order, and the k-th distance, NaN until there are k.
        self.held = [(none, np.full(len(q[i : i + TILE]), np.nan)) for i in range(0, len(q), TILE)]

    def add(self, ids: np.ndarray, x: np.ndarray, classes: np.ndarray | None = None) -> None:
        if not len(x) or not len(self.q) or self.k < 1:
            return
        if self.q.shape[1] != x.shape[1]:
            raise ValueError("vectors of unequal dimensions")
        for j in range(0, len(x), TILE):
            for t in range(len(self.held)):
                kinds = None if self.allowed is None else self.allowed[self.classes[t * TILE : (t + 1) * TILE]][:, classes[j : j + TILE]]
                self._add(t, ids[j : j + TILE], x[j : j + TILE], kinds)

    def _rough(self, q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(squared distances for l2, else distances, NaN where these can't be told; the bound of each query's rounding)."""
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            qq, xx, slack = (q * q).sum(axis=1), (x * x).sum(axis=1), 8 * (q.shape[1] + 8) * np.finfo(np.float64).eps
            if self.metric == "l2":
                one = lambda v: np.ones((len(v), 1))
                out = np.hstack([-2 * q, qq[:, None], one(q)]) @ np.hstack([x, one(x), xx[:, None]]).T
                err = slack * (qq + xx.max())
            elif self.metric == "ip":
                out = -q @ x.T
                err = slack * np.sqrt(qq * xx.max())
            else:
                qn, xn = (np.where(v > 1e-140, np.sqrt(v), np.nan)[:, None] for v in (qq, xx))
                out = (q / -qn) @ (x / xn).T
                out += 1
                err = np.full(len(q), slack)
            if not max(qq.max(), xx.max()) < 1e150:
                out[~np.isfinite(out)] = np.nan
        return out, err + 1e-290

    def _add(self, t: int, ids: np.ndarray, x: np.ndarray, kinds: np.ndarray | None) -> None:
        q, ((pos, dist, old), bar) = self.q[t * TILE : (t + 1) * TILE], self.held[t]
        rough, err = self._rough(q, x)
        with np.errstate(invalid="ignore", over="ignore"):
            most = (bar * bar if self.metric == "l2" else bar) + err
            few = np.flatnonzero(np.isnan(bar))
            if self.k < len(x) and len(few):
                some = rough[few] if kinds is None else np.where(kinds[few], rough[few], np.inf)
                most[few] = np.partition(some, self.k - 1, axis=1)[:, self.k - 1] + 2 * err[few]
            far = rough > most[:, None]
            i, j = np.divmod(np.flatnonzero(~far if kinds is None else kinds & ~far), len(x))
        step = max(1, PAIRED // q.shape[1])
        far = np.concatenate([np.zeros(0), *(paired(self.metric, q[i[a : a + step]], x[j[a : a + step]]) for a in range(0, len(i), step))])
        near = ~(far > bar[i])
        if not near.any():
            return
        pos, dist, new = np.concatenate([pos, i[near]]), np.concatenate([dist, far[near]]), np.concatenate([old, ids[j[near]]])
        order = np.lexsort((new, dist, pos))
        pos, dist, new = pos[order], dist[order], new[order]
        first = np.arange(len(pos)) - np.searchsorted(pos, pos) < self.k
        pos, dist, new = pos[first], dist[first], new[first]
        last, bar = np.flatnonzero(np.append(np.diff(pos), 1)), np.full(len(q), np.nan)
        full = np.bincount(pos, minlength=len(q))[pos[last]] >= self.k
        bar[pos[last][full]] = dist[last][full]
        self.held[t] = ((pos, dist, new), bar)

    def found(self) -> Iterator[pa.RecordBatch]:
        for t, ((pos, dist, ids), _) in enumerate(self.held):
            if len(pos):
                yield pa.RecordBatch.from_arrays([pa.array(self.qids[t * TILE + pos], pa.int64()), pa.array(ids, pa.int64()), pa.array(dist)], ["query_id", "id", "distance"])


class KBest:
    """The k least of each query among results of several searches, in memory for twice as many."""

    def __init__(self, k: int) -> None:
        self.k, self.parts, self.rows, self.most = k, [], 0, 1 << 18

    def add(self, found: Iterator[pa.RecordBatch]) -> None:
        for b in found:
            self.parts.append(b)
            self.rows += b.num_rows
        if self.rows > self.most:
            self.parts = list(self.found())
            self.rows = sum(b.num_rows for b in self.parts)
            self.most = max(self.most, 2 * self.rows)

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            qids, ids, dist = (np.concatenate([b.column(i).to_numpy() for b in self.parts]) for i in range(3))
            order = np.lexsort((ids, dist, qids))
            qids = qids[order]
            first = np.arange(len(qids)) - np.searchsorted(qids, qids) < self.k
            yield pa.RecordBatch.from_arrays([pa.array(qids[first]), pa.array(ids[order][first]), pa.array(dist[order][first])], ["query_id", "id", "distance"])


def _pivot_distances(x: np.ndarray, pivots: np.ndarray, spherical: bool) -> np.ndarray:
    """Distances of every row to every pivot; ``spherical``: of the unit vectors."""
    if x.shape[1] != pivots.shape[1]:
        raise ValueError("vectors of unequal dimensions")
    with np.errstate(invalid="ignore", over="ignore"):
        if spherical:
            length = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
        return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _equal_rows(column: pa.Array) -> np.ndarray:
    """A batch of vectors as a matrix."""
    lens = np.diff(column.offsets.to_numpy())
    if len(set(lens.tolist())) > 1:
        raise ValueError("vectors of unequal dimensions")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lens), -1)


def _spread_pivots(x: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` rows, each the one farthest from those before it."""
    at, far = [0], np.full(len(x), np.inf)
    while len(at) < min(most, len(x)):
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(axis=1))
        if not far.max() > 0:
            break
        at.append(int(np.argmax(far)))
    return x[at]


def _dealt(df: DataFrame, pivots: np.ndarray, spherical: bool) -> DataFrame:
    """``df`` (id, v) with ``own``, the nearest pivot, and ``p0``, the distance to the first one.

    Rows with components that aren't finite are near to none and left out.
    """
    kind, stored = (df.schema[n].dataType.simpleString() for n in ("id", "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _pivot_distances(_equal_rows(b.column(1)), pivots, spherical)
                ok = np.flatnonzero(np.isfinite(d).all(axis=1))
                own = d[ok].argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(ok)) for c in b.columns), pa.array(own.astype(np.int32)), pa.array(d[ok, 0])], ["id", "v", "own", "p0"])

    return df.mapInArrow(run, f"id {kind}, v {stored}, own int, p0 double")


def _packed(df: DataFrame, side: str, size: int = 0, pivots: np.ndarray | None = None, spherical: bool = False) -> DataFrame:
    """Blocks of ``df`` (id, v, and perhaps own or c): ids, dimension, vectors and classes as bytes, and the least and greatest distance to each pivot.

    Rows without a vector are left out; a block holds rows of one ``own`` alone. Single precision stays what it is.
    """
    size, owned, classed = size or min(BLOCK, BLOCK_QUERIES), "own" in df.columns, "c" in df.columns
    kind = df.schema["id"].dataType.simpleString()
    df = df.withColumn("v", _numbers(df, "v"))
    stored = np.float32 if df.schema["v"].dataType.simpleString() == "array<float>" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _equal_rows(b.column(1))
            edges = np.flatnonzero(np.diff(b.column(2).to_numpy())) + 1 if owned else []
            for low, high in pairwise([0, *edges, len(x)]):
                for i in range(low, high, size):
                    y = x[i : min(i + size, high)]
                    d = np.zeros((1, 0)) if pivots is None else _pivot_distances(y, pivots, spherical)
                    ids = b.column(0).slice(i, len(y))
                    bounds = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (d.min(axis=0), d.max(axis=0))]
                    kinds = b.column(2).slice(i, len(y)).to_numpy(zero_copy_only=False).astype(np.int32).tobytes() if classed else b""
                    yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([x.shape[1]]), pa.array([y.astype(stored).tobytes()]), pa.array([kinds]), *bounds], ["ids", "dim", "data", "classes", "low", "high"])

    names = ("ids", "dim", "data", "classes", "low", "high")
    blocks = df.where("v IS NOT NULL").mapInArrow(run, f"ids array<{kind}>, dim long, data binary, classes binary, low array<double>, high array<double>")
    return blocks.select(*[F.col(n).alias(f"{side}_{n}") for n in names])


def _numbers(df: DataFrame, name: str) -> Column:
    """A column of vectors in single precision if it is that, else in double."""
    return df[name] if df.schema[name].dataType.simpleString() == "array<float>" else df[name].cast("array<double>")


def _unpacked(block: dict) -> np.ndarray:
    """The vectors of a packed block (Arrow scalars)."""
    raw, n, dim = block["data"].as_buffer(), len(block["ids"].values), block["dim"].as_py()
    return np.frombuffer(raw, np.float32 if raw.size == 4 * n * dim else np.float64).reshape(n, dim).astype(np.float64)


def _classes_of(block: dict) -> np.ndarray:
    return np.frombuffer(block["classes"].as_buffer(), np.int32)


def _lines(spark: SparkSession) -> int:
    """Lines of the grid either way, and so how often each row is sent: four cells a core, 64 at least, four a shuffle partition at most."""
    cells = min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), max(64, 4 * spark.sparkContext.defaultParallelism))
    return max(1, int(np.ceil(np.sqrt(cells))))


def _grid(a: DataFrame, b: DataFrame, a_key: Sequence[str] = ("a_ids", "a_data"), b_key: Sequence[str] = ("b_ids", "b_data")) -> DataFrame:
    """Every row of ``a`` with every row of ``b``, once, by an equi-join on the cells of a grid."""
    n = _lines(a.sparkSession)
    cells = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda key: F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")
    return a.withColumns({"_r": deal(a_key)}).withColumn("_c", cells).join(b.withColumns({"_c": deal(b_key)}).withColumn("_r", cells), ["_r", "_c"]).drop("_r", "_c")


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "l2", query_id: str = "query_id", query_vector: str = "query", id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, distance): the k nearest corpus rows of every query.

    Each task keeps k rows per query of its part, so what is dealt for the final ranking is at most k per query and task.
    """
    asked = queries.where(queries[query_vector].isNotNull()).select(queries[query_id].cast("long").alias("id"), queries[query_vector].alias("v"))
    return _ranked(asked, corpus.select(corpus[id_col].cast("long").alias("id"), corpus[vector_col].alias("v")), k, metric)


def _ranked(asked: DataFrame, rows: DataFrame, k: int, metric: str, allowed: np.ndarray | None = None) -> DataFrame:
    """``knn_join`` of ``asked`` and ``rows`` (id, v); with ``allowed``, which tells by the classes of both (column c) which pairs count."""
    spark, out = rows.sparkSession, "query_id long, id long, distance double"
    size = asked.agg(F.coalesce(F.sum(F.size("v") * 8 + 16), F.lit(0))).first()[0]
    if size <= SHIPPED:
        # checked above: the set is small enough for every task
        few = asked.withColumn("v", F.col("v").cast("array<double>")).toPandas()
        if not len(few) or k < 1:
            return spark.createDataFrame([], "query_id long, rank int, id long, distance double")
        if few["v"].map(len).nunique() > 1:
            raise ValueError("vectors of unequal dimensions")
        shared = spark.sparkContext.broadcast((few["id"].to_numpy(), np.stack(few["v"].to_list()), k, None if allowed is None else few["c"].to_numpy(), allowed))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Nearest(metric, *shared.value)
            for b in batches:
                ok, x = _matrix(b.column(1))
                ids, *kinds = (b.column(i).to_numpy(zero_copy_only=False)[ok] for i in ((0,) if allowed is None else (0, 2)))
                best.add(ids, x, *kinds)
            yield from best.found()

        found = rows.mapInArrow(run, out)
    else:
        met = _grid(_packed(asked, "a"), _packed(rows, "b"))

        def run_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, block = None, None
            for b in batches:
                col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
                for r in range(b.num_rows):
                    mine, theirs = ({n: col[f"{side}_{n}"][r] for n in ("ids", "dim", "data", "classes")} for side in ("a", "b"))
                    if best is None or not mine["ids"].values.equals(block["ids"].values) or not mine["data"].equals(block["data"]):
                        # a block of queries meets the blocks of its cell one after another
                        if best is not None:
                            yield from best.found()
                        block, best = mine, Nearest(metric, mine["ids"].values.to_numpy(), _unpacked(mine), k, _classes_of(mine), allowed)
                    best.add(theirs["ids"].values.to_numpy(), _unpacked(theirs), _classes_of(theirs))
            if best is not None:
                yield from best.found()

        found = met.mapInArrow(run_blocks, out)
    order = W.partitionBy("query_id").orderBy(F.isnan("distance"), "distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _bounded(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows, counting no further."""
    return df.limit(rows + 1).count() <= rows


def _classed(asked: DataFrame, corpus: DataFrame, predicate: Column | None) -> tuple[DataFrame, DataFrame, np.ndarray | None] | None:
    """Both sides with column c, the class of their values in ``predicate``, and which classes it lets meet; None if these aren't few.

    Columns that the predicate reads are found in its plan. Where each side has few different values of its own, the predicate is asked once
    for each pair of them.
    """
    if predicate is None:
        return asked, corpus, None
    plan = corpus.crossJoin(asked).where(predicate)._jdf.queryExecution().analyzed()
    if plan.nodeName() != "Filter" or not plan.condition().deterministic():
        return None
    read = plan.condition().references().toSeq()
    names, sides, plain = {read.apply(i).name() for i in range(read.size())}, [], re.compile(r"(boolean|tinyint|smallint|int|bigint|float|double|date|string|decimal\(.*\))$")
    for df, side in ((asked, "_a"), (corpus, "_b")):
        own = [n for n in df.columns if n in names]
        if not all(plain.match(df.schema[n].dataType.simpleString()) for n in own):
            return None
        kinds = df.select(*[F.col(f"`{n}`") for n in own]).distinct()
        values = kinds.limit(CLASSES + 1).collect() if own else [()]
        if len(values) > CLASSES:
            return None
        schema = T.StructType([*(kinds.schema[n] for n in own), T.StructField(side, T.IntegerType())])
        sides.append((own, len(values), df.sparkSession.createDataFrame([(*v, k) for k, v in enumerate(values)], schema)))
    (mine, n, a), (theirs, m, b) = sides
    allowed = np.zeros((n, m), bool)
    for i, j in b.crossJoin(a).where(predicate).select("_a", "_b").collect():
        allowed[i, j] = True

    def told(df: DataFrame, own: list[str], kinds: DataFrame, side: str) -> DataFrame:
        if not own:
            return df.withColumn("c", F.lit(0))
        kinds = kinds.select(*[F.col(f"`{n}`").alias(f"_k{i}") for i, n in enumerate(own)], F.col(side).alias("c"))
        same = reduce(and_, [df[f"`{n}`"].eqNullSafe(kinds[f"_k{i}"]) for i, n in enumerate(own)])
        return df.join(F.broadcast(kinds), same)

    return told(asked, mine, a, "_a"), told(corpus, theirs, b, "_b"), allowed


def lateral_topk(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "l2", predicate: Column | None = None, query_id: str = "query_id", query_vector: str = "query", id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """As ``knn_join``, with a predicate over the columns of both sides that each pair must meet.

    Column names of the two sides must differ. A predicate that reads columns of few different values (checked) is told by a table of these,
    and vectors meet as matrices. Any other is asked of all pairs: a small set of queries (checked) is shipped to the scan of the corpus;
    a larger one meets it on a grid, through an equi-join.
    """
    asked = queries.where(F.col(query_vector).isNotNull())
    kinds = (asked.schema[query_id].dataType, corpus.schema[id_col].dataType)
    known = _classed(asked, corpus, predicate) if all(isinstance(t, T.IntegralType) for t in kinds) else None
    if known is not None:
        mine, theirs, allowed = known
        few = [] if allowed is None else ["c"]
        mine, theirs = (df.select(F.col(i).cast("long").alias("id"), F.col(v).alias("v"), *few) for df, i, v in ((mine, query_id, query_vector), (theirs, id_col, vector_col)))
        return _ranked(mine, theirs, k, metric, allowed).withColumns({"query_id": F.col("query_id").cast(kinds[0]), "id": F.col("id").cast(kinds[1])})
    if _bounded(asked, BLOCK_QUERIES):
        one = asked.withColumn("_g", F.lit(0))
        pairs = corpus.withColumn("_g", F.lit(0)).join(F.broadcast(one), "_g")
    else:
        pairs = _grid(corpus, asked, [id_col], [query_id])
    if predicate is not None:
        pairs = pairs.where(predicate)
    scoredp = pairs.withColumn("distance", V.distance(metric, F.col(vector_col), F.col(query_vector))).where("distance IS NOT NULL")
    order = W.partitionBy(query_id).orderBy(F.isnan("distance"), "distance", id_col)
    return scoredp.select(F.col(query_id).alias("query_id"), F.col(id_col).alias("id"), "distance", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _meeting(a: DataFrame, b: DataFrame, radius: float, metric: str, grid: Sequence[float] | None = None) -> DataFrame | None:
    """Pairs of blocks of ``a`` and ``b`` (id, v) that may hold a pair within ``radius``; none if none can.

    For l2, and for cosine as l2 of unit vectors, rows are dealt by the nearest of up to ``PIVOTS`` pivots (``grid`` alone if given; else
    far-apart ones of a few vectors of ``b``) and their distance to the first, and a block knows the least and greatest distance of its rows to
    every pivot: by the triangle inequality, two blocks that are farther apart than the radius in one of these hold no pair. Where the
    radius is narrow against the spread about the first pivot, blocks meet by cells one radius wide; else, and for inner products, on a grid.
    """
    if radius <= 0 and metric != "ip":
        return None
    if metric == "ip":
        return _grid(_packed(a, "a"), _packed(b, "b"))
    spherical = metric == "cosine"
    reach = float((np.sqrt(2 * radius) + 1e-7 if spherical else radius) * (1 + 1e-9))
    if grid is None:
        few = [r[0] for r in b.orderBy(F.xxhash64("id"), "id").limit(PIVOTS * 4).select("v").collect()]
        if not few:
            return None
        if len({len(v) for v in few}) > 1:
            raise ValueError("vectors of unequal dimensions")
        some = np.array(few, np.float64)
        some = some[np.isfinite(some).all(axis=1)] if np.isfinite(some).all(axis=1).any() else np.zeros((1, some.shape[1]))
    else:
        some = np.array([grid], np.float64)
    if spherical:
        length = np.linalg.norm(some, axis=1, keepdims=True)
        some = np.divide(some, length, out=np.zeros_like(some), where=length > 0)
    pivots = _spread_pivots(some, PIVOTS)
    a, b = (_dealt(x, pivots, spherical) for x in (a, b))
    ends = b.agg(F.min("p0"), F.max("p0")).first()
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_cells = ends[0] is not None and np.isfinite(reach) and (ends[1] - ends[0]) / reach >= 2 * parts
    ab, bb = (_packed(x.repartitionByRange(parts, "own", "p0").sortWithinPartitions("own", "p0").select("id", "v", "own"), side, 0, pivots, spherical) for x, side in ((a, "a"), (b, "b")))
    if by_cells:
        cell = lambda name: F.floor(F.get(name, F.lit(0)) / F.lit(reach))
        ab = ab.withColumn("_first", cell("a_low")).withColumn("_cell", F.explode(F.sequence("_first", cell("a_high"))))
        bb = bb.withColumn("_from", cell("b_low") - 1).withColumn("_cell", F.explode(F.sequence("_from", cell("b_high") + 1)))
        # two blocks share neighbouring cells: they meet in the first of them
        met = ab.join(bb, "_cell").where(F.col("_cell") == F.greatest("_first", "_from")).drop("_cell", "_first", "_from")
    else:
        met = _grid(ab, bb)
    apart = lambda low, high: F.coalesce(F.array_max(F.zip_with(low, high, lambda x, y: x * (1 - 1e-12) - y)), F.lit(0.0))
    return met.where((apart("a_low", "b_high") <= reach) & (apart("b_low", "a_high") <= reach))


def range_join(left: DataFrame, right: DataFrame, radius: float, metric: str = "l2", left_id: str = "id", left_vector: str = "embedding", right_id: str = "id", right_vector: str = "embedding", distinct: bool = False, grid: Sequence[float] | None = None) -> DataFrame:
    """(left_id, right_id, distance) of the pairs strictly within ``radius``; ``distinct`` keeps left_id < right_id.

    Rows are packed into blocks and compared as matrices; which blocks meet is told by ``_meeting``.
    """
    if metric not in V.DISTANCES:
        raise ValueError(f"unknown metric {metric!r}")
    a = left.select(left[left_id].alias("id"), _numbers(left, left_vector).alias("v")).where("v IS NOT NULL")
    b = right.select(right[right_id].alias("id"), _numbers(right, right_vector).alias("v")).where("v IS NOT NULL")
    ids = (a.schema["id"].dataType.simpleString(), b.schema["id"].dataType.simpleString())
    out = f"left_id {ids[0]}, right_id {ids[1]}, distance double"
    met = _meeting(a, b, radius, metric, grid)
    if met is None:
        return left.sparkSession.createDataFrame([], out)

    def close(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if x.shape[1] != y.shape[1]:
            raise ValueError("vectors of unequal dimensions")
        dot = x @ y.T
        if metric == "ip":
            i, j = np.nonzero(-dot < radius)
            return i, j, -dot[i, j]
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        if metric == "cosine":
            with np.errstate(invalid="ignore", divide="ignore"):
                far = 1 - dot / np.sqrt(xx[:, None] * yy[None, :])
            i, j = np.nonzero(far < radius)
            return i, j, far[i, j]
        # the expanded form loses digits among near rows: it picks, the difference decides
        square = xx[:, None] + yy[None, :] - 2 * dot
        i, j = np.nonzero(square <= radius * radius + 1e-9 * (xx[:, None] + yy[None, :]) + 1e-12)
        far = np.sqrt(((x[i] - y[j]) ** 2).sum(axis=1))
        inside = far < radius
        return i[inside], j[inside], far[inside]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                mine, theirs = ({n: b.column(f"{side}_{n}")[k] for n in ("ids", "dim", "data")} for side in ("a", "b"))
                i, j, far = close(_unpacked(mine), _unpacked(theirs))
                yield pa.RecordBatch.from_arrays([mine["ids"].values.take(pa.array(i)), theirs["ids"].values.take(pa.array(j)), pa.array(far)], ["left_id", "right_id", "distance"])

    found = met.select(*[f"{side}_{n}" for side in ("a", "b") for n in ("ids", "dim", "data")]).mapInArrow(run, out)
    return found.where("left_id < right_id") if distinct else found


def fetch(table: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of ``table`` by id, with the columns of ``ids``; Catalyst broadcasts the candidates where their size allows."""
    return table.join(ids, id_col)


def recall(rough: DataFrame, accurate: DataFrame, id_col: str = "id") -> float:
    """Share of the accurate ids that the rough result has; NaN if there are none."""
    want = accurate.select(id_col).distinct()
    n = want.count()
    return want.intersect(rough.select(id_col)).count() / n if n else float("nan")
