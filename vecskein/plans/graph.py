"""The graph index: one proximity graph per shard, all shards searched side by side, the results merged.

Walking one graph is sequential, so rows are dealt to shards of bounded size and each shard is a graph of its own,
stored as one row of packed arrays. A search broadcasts the query to the shards, walks each with a beam over coarse codes
and exact distances of the nodes it opens, and ranks what all shards found. Recall is at least that of one graph at the same ef.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecskein.functions import quantized as Q
from vecskein.functions.rotation import rotate
from vecskein.operators.search import KBest
from vecskein.plans.options import MAX_DIM, METRICS, GraphOptions, scan_options
from vecskein.sources import store

SHARD_ROWS = 8192
#: Distances that a build holds at once.
COMPARED = 1 << 19
#: Queries that are sent with the search; a larger set is dealt to cells, in lines of so many bytes.
FEW, LINE = 16, 8 << 20
#: Rows of a batch of results, at least, where a shard has as many.
PART = 1 << 14
#: An ef that no shard reaches.
ALL_NODES = 1 << 62
FOUND = "query_id long, row_id long, distance double"
SHARD = "shard long, n long, ids binary, vectors binary, codes binary, measures binary, start long, heads binary, edges binary"


def _distances(inner: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return ((x - q) ** 2).sum(axis=1) if inner == "l2" else -(x @ q)


def _matrix(inner: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``x`` to all rows of ``y``."""
    dot = x @ y.T
    if inner != "l2":
        return np.negative(dot, out=dot)
    dot *= 2
    out = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
    out -= dot
    return out


def prune(dist: np.ndarray, ids: np.ndarray, x: np.ndarray, m: int, alphas: Sequence[float], inner: str) -> np.ndarray:
    """Up to ``m`` out-edges among candidates ``ids`` of ``x`` at ``dist``.

    A candidate is shadowed while a kept one is nearer to it, times alpha, than it is to the node. The nearest candidate that is not
    shadowed is kept, and its row of the candidates' distance matrix shadows more; when none is left, the next alpha, if
    squared l2 gives it a meaning, lifts some shadows, and at last the nearest shadowed ones fill up.
    """
    ids, at = np.unique(ids, return_index=True)
    order = np.argsort(dist[at], kind="stable")
    ids, dist = ids[order], dist[at][order]
    among = _matrix(inner, x[ids], x[ids])
    free, kept = np.ones(len(ids), bool), []
    for alpha in (*(alphas if inner == "l2" else (1.0,)), np.inf):
        nearest_kept = among[kept].min(axis=0) if kept else np.full(len(ids), np.inf)
        while len(kept) < m:
            lit = free & (dist < alpha * nearest_kept) if np.isfinite(alpha) else free
            k = int(np.argmax(lit)) if len(lit) else 0
            if not len(lit) or not lit[k]:
                break
            kept.append(k)
            free[k] = False
            nearest_kept = np.minimum(nearest_kept, among[k])
    return ids[np.array(kept, int)]


def build_graph(x: np.ndarray, inner: str, options: GraphOptions) -> tuple[int, list[np.ndarray]]:
    """(start, edges) of a shard: candidates are the nearest ef_construction rows, then pruned both ways.

    A shard is small enough for exact candidates by matrix products, which searches of the unfinished graph would only approach.
    """
    n = len(x)
    edges: list[np.ndarray] = []
    step = max(1, COMPARED // max(1, n))
    for i in range(0, n, step):
        far = _matrix(inner, x[i : i + step], x)
        far[np.arange(len(far)), np.arange(i, i + len(far))] = np.inf
        k = min(n - 1, options.ef_construction)
        near = np.argpartition(far, k - 1, axis=1)[:, :k] if 0 < k < n else np.zeros((len(far), 0), int)
        for r in range(len(far)):
            out = prune(far[r, near[r]], near[r], x, options.m, options.alpha, inner) if k else np.zeros(0, int)
            edges.append(out)
        del far, near
    to = np.concatenate([np.zeros(0, int), *edges])
    back = np.repeat(np.arange(n), [len(e) for e in edges])[np.argsort(to, kind="stable")]
    ends = np.concatenate(([0], np.cumsum(np.bincount(to, minlength=n))))
    for v in range(n):
        if ends[v] < ends[v + 1]:
            both = np.unique(np.concatenate([edges[v], back[ends[v] : ends[v + 1]]]))
            edges[v] = both if len(both) <= options.m else prune(_distances(inner, x[both], x[v]), both, x, options.m, options.alpha, inner)
    start = int(np.argmin(_distances("l2", x, x.mean(axis=0)))) if n else -1
    # a node that no walk from the start reaches is hung onto the nearest one that is reached, so that none is lost
    if n:
        seen, stack = np.zeros(n, bool), [start]
        seen[start] = True
        while True:
            while stack:
                new = edges[stack.pop()]
                new = new[~seen[new]]
                seen[new] = True
                stack += new.tolist()
            lost = int(np.argmin(seen))
            if seen[lost]:
                break
            reached = np.flatnonzero(seen)
            to = int(reached[np.argmin(_distances("l2", x[reached], x[lost]))])
            edges[to] = np.append(edges[to], lost)
            seen[lost] = True
            stack.append(lost)
    return start, edges


def walk(q: np.ndarray, x: np.ndarray, coarse: Callable[[np.ndarray], np.ndarray], start: int, edges, inner: str, ef: int, beam: int = 1, alive: np.ndarray | None = None) -> list[tuple[float, int]]:
    """(distance, node) of up to ef nodes: nodes wait by coarse distance, and are exact once opened.

    ``coarse`` estimates the nodes that it is given, and is given those alone that the walk comes to; the walk ends when the
    next estimates lie beyond the ef-th exact distance.
    """
    if start < 0:
        return []
    seen, found = np.zeros(len(x), bool), []
    seen[start] = True
    waiting = [(float(coarse(np.array([start]))[0]), start)]
    while waiting:
        opened = [heapq.heappop(waiting) for _ in range(min(beam, len(waiting)))]
        if len(found) >= ef and opened[0][0] > -found[0][0]:
            break
        nodes = np.array([u for _, u in opened])
        for d, u in zip(_distances(inner, x[nodes].astype(np.float64), q).tolist(), nodes.tolist(), strict=True):
            if alive is None or alive[u]:
                (heapq.heappushpop if len(found) >= ef else heapq.heappush)(found, (-d, u))
        out = edges(opened[0][1]) if len(opened) == 1 else np.unique(np.concatenate([edges(u) for u in nodes.tolist()]))
        out = out[~seen[out]]
        if len(out):
            seen[out] = True
            far = coarse(out)
            if beam == 1 and len(found) >= ef:  # the bound never grows, so the walk would end before it opened these
                near = ~(far > -found[0][0])
                far, out = far[near], out[near]
            for item in zip(far.tolist(), out.tolist(), strict=True):
                heapq.heappush(waiting, item)
    return sorted((-d, u) for d, u in found)


def _coarse(inner: str, q: np.ndarray, codes: np.ndarray, measures: np.ndarray, bits: int) -> np.ndarray:
    """Estimates from 1- or 2-bit lattice codes; measures: squared norm, norm of the lattice point."""
    dot = (codes.astype(np.float64) - ((1 << bits) - 1) / 2) @ q * np.sqrt(measures[:, 0]) / np.maximum(measures[:, 1], 1e-30)
    return measures[:, 0] + q @ q - 2 * dot if inner == "l2" else -dot


class GraphIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.version = store.read_json(spark, f"{self.path}/current.json")["version"]
        self.root = f"{self.path}/{self.version}"
        self.meta = store.read_json(spark, f"{self.root}/meta.json")
        self.options = GraphOptions.parse(self.meta["options"])

    @property
    def inner(self) -> str:
        return "l2" if self.meta["metric"] == "l2" else "ip"

    @classmethod
    def build(cls, df: DataFrame, path: str, metric: str = "l2", options: str | dict | None = None, vector_col: str = "embedding", id_col: str = "id", where: str | None = None, shard_rows: int = SHARD_ROWS, scan_defaults: dict | None = None, on_phase: Callable[[str], None] | None = None) -> GraphIndex:
        with store.phases(df.sparkSession, on_phase) as phase:
            return cls._build(df, path, metric, options, vector_col, id_col, where, shard_rows, scan_defaults, phase)

    @classmethod
    def _build(cls, df, path, metric, options, vector_col, id_col, where, shard_rows, scan_defaults, phase) -> GraphIndex:
        phase("checking rows")
        spark, opts = df.sparkSession, GraphOptions.parse(options)
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}")
        scan_options(spark, "graph", None, scan_defaults)
        rows = cls._rows(df if where is None else df.where(where), vector_col, id_col)
        n, dim, most = rows.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
        if dim != most:
            raise ValueError("vectors of unequal dimensions")
        Q.check_dim(dim or 1, MAX_DIM["graph"])
        version = f"v-{uuid.uuid4().hex}"
        root = f"{path.rstrip('/')}/{version}"
        store.write_json(spark, f"{root}/meta.json", {"metric": metric, "dim": dim or 1, "options": opts.as_dict(), "vector_col": vector_col, "id_col": id_col, "where": where, "shard_rows": shard_rows, "scan": scan_defaults or {}})
        phase("building graphs")
        cls._write(rows, n, metric, opts, shard_rows, f"{root}/shards/seq=1")
        pointer = f"{path.rstrip('/')}/current.json"
        old = store.read_json(spark, pointer)["version"] if store.exists(spark, pointer) else None
        store.write_json(spark, pointer, {"version": version})
        if old:
            store.remove(spark, f"{path.rstrip('/')}/{old}")
        return cls(spark, path)

    @staticmethod
    def _rows(df: DataFrame, vector_col: str, id_col: str) -> DataFrame:
        v = F.expr(vector_col) if vector_col not in df.columns else F.col(f"`{vector_col}`")
        return df.where(v.isNotNull()).select(F.col(id_col).cast("long").alias("row_id"), v.cast("array<float>").alias("vector"))

    @staticmethod
    def _write(rows: DataFrame, n: int, metric: str, options: GraphOptions, shard_rows: int, path: str) -> None:
        inner, cosine, bits = ("l2" if metric == "l2" else "ip"), metric == "cosine", options.bits
        shards = max(1, -(-n // shard_rows))
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row_id", F.lit(11)), F.lit(shards)))

        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            ids = table["row_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            x = _rows_of(table["vector"])[order]
            if cosine:
                length = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
            x = rotate(x).astype(np.float32).astype(np.float64)
            start, edges = build_graph(x, inner, options)
            codes, measures = np.empty(x.shape, np.uint8), np.empty((len(x), 2))
            for i, r in enumerate(x):
                codes[i], measures[i] = _lattice(r, bits)
            heads = np.concatenate(([0], np.cumsum([len(e) for e in edges]))).astype(np.int64)
            flat = np.concatenate(edges).astype(np.int32) if edges else np.zeros(0, np.int32)
            row = [int(key[0].as_py()), len(x), ids[order].astype(np.int64).tobytes(), x.astype(np.float32).tobytes(), codes.tobytes(), measures.tobytes(), start, heads.tobytes(), flat.tobytes()]
            return pa.table([pa.array([v]) for v in row], names=[c.split()[0] for c in SHARD.split(", ")])

        dealt.groupBy("shard").applyInArrow(run, SHARD).write.parquet(path)

    def _shards(self) -> DataFrame:
        return store.read_seqs(self.spark, f"{self.root}/shards", SHARD + ", seq int")

    def _members(self) -> DataFrame:
        """(shard, seq, row_id) of all rows, deleted ones too."""
        return self._shards().select("shard", "seq", F.explode(_longs(F.col("ids"))).alias("row_id"))

    def _dead(self) -> DataFrame | None:
        """(row_id, seq): the last delete of an id, which hides the shards before it."""
        path = f"{self.root}/tombstones"
        return store.read_seqs(self.spark, path, "row_id long, seq int").groupBy("row_id").agg(F.max("seq").alias("seq")) if store.children(self.spark, path) else None

    def known_ids(self) -> DataFrame:
        """(row_id) of live rows."""
        return store.live(self._members(), self.spark, f"{self.root}/tombstones").select("row_id").distinct()

    def search(self, query, k: int | None = 10, table: DataFrame | None = None, where: Column | str | None = None, radius: float | None = None, **scan) -> DataFrame:
        """(row_id, distance): the k nearest that the shards' walks find. A null query has no rows.

        Walks count only rows that pass ``where``, so they go on past ef until enough do or nothing waits; a radius or no
        ``k`` lifts the bound of ef. ``max_scan_tuples`` counts rows before the filter.
        """
        opts = scan_options(self.spark, "graph", scan, self.meta["scan"])
        if query is None:
            return self.spark.createDataFrame([], "row_id long, distance double")
        if not opts["enable_scan"]:
            from vecskein.operators import search

            rows = self._rows(table if where is None else table.where(where), self.meta["vector_col"], self.meta["id_col"])
            found = search.scored(rows, list(map(float, query)), self.meta["metric"], "vector").where("distance IS NOT NULL").select("row_id", "distance").orderBy("distance", "row_id")
            return found if k is None else found.limit(k)
        asked = self.spark.createDataFrame([(0, [float(v) for v in query])], "query_id long, query array<double>")
        most = opts["max_scan_tuples"]
        ef = ALL_NODES if radius is not None or k is None else max(opts["ef_search"], k, most)
        passing = None if where is None else table.where(where).select(F.col(self.meta["id_col"]).cast("long").alias("row_id"))
        found = self._walked(asked, ef, opts["beam_search"], None if radius is not None or most >= 0 else k, passing if most < 0 else None).select("row_id", "distance")
        if radius is not None:
            found = found.where(F.col("distance") < float(radius))
        if most >= 0:
            found = found.orderBy("distance", "row_id").limit(most)
            if passing is not None:
                found = found.join(passing, "row_id", "left_semi")
        found = found.orderBy("distance", "row_id")
        return found if k is None else found.limit(k)

    def search_many(self, queries: DataFrame, k: int, **scan) -> DataFrame:
        """(query_id, rank, row_id, distance) for queries (query_id, query): each visits every shard."""
        opts = scan_options(self.spark, "graph", scan, self.meta["scan"])
        found = self._walked(queries, max(opts["ef_search"], k), opts["beam_search"], k)
        order = W.partitionBy("query_id").orderBy("distance", "row_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "row_id", "distance")

    def _walked(self, queries: DataFrame, ef: int, beam: int, k: int | None = None, passing: DataFrame | None = None) -> DataFrame:
        """(query_id, row_id, distance) of what the walks find; with ``k``, at least the k nearest of each query.

        A few queries are sent with the search to where the shards are read. More are dealt to the cells of a grid, lines of queries by groups
        of shards: a task holds its line, and its shards pass by one at a time. A shard is sent once a line, a query once a group.
        """
        inner, metric, dim, bits = self.inner, self.meta["metric"], self.meta["dim"], self.options.bits
        filtered = passing is not None
        asked = queries.where("query IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query"))
        n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("query") * 8 + 16), F.lit(0))).first()
        shards = self._shards()
        held = shards.count()
        if not n or not held:
            return self.spark.createDataFrame([], FOUND)
        dead = self._dead()
        if dead is None:
            shards = shards.withColumn("gone", F.lit(None).cast("array<bigint>"))
        else:  # tombstones go to the shards that may hold their rows; each shard checks its own
            hidden = self._members().join(dead.withColumnRenamed("seq", "_gone"), "row_id").where("seq < _gone").groupBy("shard", "seq").agg(F.collect_set("row_id").alias("gone"))
            shards = shards.join(hidden, ["shard", "seq"], "left")
        if passing is not None:  # so do the rows that a filter lets pass
            let = self._members().join(passing, "row_id", "left_semi").groupBy("shard", "seq").agg(F.collect_set("row_id").alias("passing"))
            shards = shards.join(let, ["shard", "seq"])

        def turned(q: np.ndarray) -> np.ndarray:
            if q.shape[1] != dim:
                raise ValueError("vectors of unequal dimensions")
            if metric == "cosine":
                length = np.linalg.norm(q, axis=1, keepdims=True)
                q = q / np.where(length > 0, length, 1)
            return rotate(q)

        def met(row: dict, qids: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
            """What each query's walk of one shard finds."""
            raw = {c: row[c].as_buffer() for c in ("ids", "vectors", "codes", "measures", "heads", "edges")}  # read in place
            ids = np.frombuffer(raw["ids"], np.int64)
            x = np.frombuffer(raw["vectors"], np.float32).reshape(-1, dim)
            codes = np.frombuffer(raw["codes"], np.uint8).reshape(-1, dim)
            measures = np.frombuffer(raw["measures"], np.float64).reshape(-1, 2)
            heads, flat = np.frombuffer(raw["heads"], np.int64), np.frombuffer(raw["edges"], np.int32)
            alive = ~np.isin(ids, np.array(row["gone"].as_py() or [], np.int64))
            if filtered:
                alive &= np.isin(ids, np.array(row["passing"].as_py(), np.int64))
            edges, parts, rows = lambda u: flat[heads[u] : heads[u + 1]], [], 0
            for i in range(len(q)):
                coarse = lambda at: _coarse(inner, q[i], codes[at], measures[at], bits)  # noqa: B023, E731
                found = walk(q[i], x, coarse, row["start"].as_py(), edges, inner, ef, beam, alive)
                if found:
                    d, u = np.array([d for d, _ in found]), np.array([u for _, u in found])
                    d = np.sqrt(np.maximum(d, 0)) if metric == "l2" else 1 + d if metric == "cosine" else d
                    if k is not None and len(d) > k > 0:
                        near = ~(d > d[k - 1])
                        d, u = d[near], u[near]
                    parts.append((np.full(len(d), qids[i]), ids[u], d))
                    rows += len(d)
                if parts and (rows >= PART or i == len(q) - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["query_id", "row_id", "distance"])
                    parts, rows = [], 0

        def run(batches: Iterator[pa.RecordBatch], sent: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
            cell, line, best = None, [], None if k is None else KBest(k)
            qids, q = sent or (None, None)
            for b in batches:
                col = {c: b.column(i) for i, c in enumerate(b.schema.names)}
                cells = np.zeros(b.num_rows, int) if sent else col["cell"].to_numpy()
                asks = np.zeros(b.num_rows, bool) if sent else col["query_id"].is_valid().to_numpy(zero_copy_only=False)
                at = 0
                while at < b.num_rows:
                    if cell != cells[at]:
                        if best is not None:
                            yield from _named(best.found())
                            best = KBest(k)
                        cell, line = cells[at], []
                        qids, q = sent or (None, None)
                    if asks[at]:  # a run of queries of this cell, before its shards
                        stop = at + int(np.argmin(np.append(asks[at:] & (cells[at:] == cell), False)))
                        line.append((col["query_id"].slice(at, stop - at).to_numpy(), _rows_of(col["query"].slice(at, stop - at))))
                        at = stop
                        continue
                    if line:
                        qids, q = np.concatenate([i for i, _ in line]), turned(np.concatenate([v for _, v in line]))
                        line = []
                    if q is not None:
                        found = met({c: v[at] for c, v in col.items()}, qids, q)
                        if best is None:
                            yield from found
                        else:
                            best.add(found)
                    at += 1
            if best is not None:
                yield from _named(best.found())

        if n <= FEW:
            few = asked.collect()
            sent = (np.array([r[0] for r in few]), turned(np.array([r[1] for r in few], np.float64)))
            return shards.mapInArrow(lambda batches: run(batches, sent), FOUND)
        groups, lines = _cells(held, n, size, self.spark.sparkContext.defaultParallelism)
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        asked = asked.withColumn("_l", F.pmod(F.xxhash64("query_id"), F.lit(lines)).cast("int")).withColumn("_g", every(groups))
        shards = shards.withColumn("_g", F.pmod(F.col("shard") + F.col("seq"), F.lit(groups)).cast("int")).withColumn("_l", every(lines))
        asked, shards = (df.withColumn("cell", F.col("_l") * groups + F.col("_g")).drop("_l", "_g") for df in (asked, shards))
        dealt = shards.unionByName(asked, allowMissingColumns=True).repartitionById(groups * lines, F.col("cell")).sortWithinPartitions("cell", F.col("query_id").isNull())
        return dealt.mapInArrow(run, FOUND)

    def _next(self) -> int:
        return store.next_seq(self.spark, self.root, ("shards", "tombstones"))

    def insert(self, df: DataFrame) -> None:
        """New rows become shards of their own, which deletes before them don't touch; vacuum evens them out."""
        rows = self._rows(df if self.meta["where"] is None else df.where(self.meta["where"]), self.meta["vector_col"], self.meta["id_col"])
        self._write(rows, rows.count(), self.meta["metric"], self.options, self.meta["shard_rows"], f"{self.root}/shards/seq={self._next()}")

    def delete(self, ids: DataFrame, id_col: str = "row_id") -> None:
        """Hide the rows that the index has of these ids now."""
        ids.select(F.col(id_col).cast("long").alias("row_id")).distinct().write.parquet(f"{self.root}/tombstones/seq={self._next()}")

    def vacuum(self, table: DataFrame) -> GraphIndex:
        """Rebuild from those rows of ``table`` that are live, which repairs every edge that led through deleted ones."""
        key = F.col(self.meta["id_col"]).cast("long")
        kept = table.join(self.known_ids().withColumnRenamed("row_id", "_known"), key == F.col("_known"), "left_semi")
        m = self.meta
        return GraphIndex.build(kept, self.path, m["metric"], m["options"], m["vector_col"], m["id_col"], m["where"], m["shard_rows"], m["scan"])

    def drop(self) -> None:
        store.remove(self.spark, self.path)

    def prewarm(self) -> str:
        n, rows = self._shards().cache().agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        return json.dumps({"shards": n, "rows": rows, "dim": self.meta["dim"], "metric": self.meta["metric"]})


def _cells(shards: int, queries: int, size: int, cores: int) -> tuple[int, int]:
    """(groups of shards, lines of queries of ``size`` bytes in all) of a search: a line is held by a task, and no core is left without a cell."""
    groups = min(shards, max(64, 4 * cores))
    return groups, min(queries, max(-(-size // LINE), -(-cores // groups)))


def _named(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in found:
        yield pa.RecordBatch.from_arrays(b.columns, ["query_id", "row_id", "distance"])


def _rows_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of vectors as a matrix of doubles."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    if len({n for c in chunks for n in np.unique(np.diff(c.offsets.to_numpy())).tolist()}) > 1:
        raise ValueError("vectors of unequal dimensions")
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks]).astype(np.float64).reshape(len(column), -1)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _longs(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: np.frombuffer(b, np.int64))


def _lattice(x: np.ndarray, bits: int) -> tuple[np.ndarray, tuple[float, float]]:
    """Code and (squared norm, norm of the lattice point) of a rotated row, at the best scale."""
    length = float(np.linalg.norm(x))
    u = x / length if length else x
    half = 1 << (bits - 1)
    code = np.clip(np.floor(Q.best_scale(np.abs(u), bits) * u), -half, half - 1) + half
    return code, (length * length, float(np.linalg.norm(code - ((1 << bits) - 1) / 2)))
