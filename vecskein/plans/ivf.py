"""The inverted-list index: k-means lists, one-bit codes with error bounds, exact rerank.

On disk: ``current.json`` names a version folder, with ``meta.json``, ``centroids``, ``codes``, ``vectors`` and ``tombstones``. Codes and
vectors are files of their own, in a sub-folder per part (``seq=N``) and group of lists (``grp=G``), rows sorted by list and id, so
that partitions and Parquet statistics skip what a scan doesn't need. A tombstone hides the parts before it. Versions are
immutable but for added parts; a rebuild or vacuum writes a new version and then moves the pointer.

A scan probes the centroid tree on the driver and reads the codes of the chosen lists. Rows leave in order of greatest(lower
bound, exact distance), the order in which a lazy rerank lets them go: so the exact distances of a few times k rows of least
bound limit what can be among the k first, and only vectors of rows whose bound lies within that limit are read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecskein.functions import quantized as Q
from vecskein.functions import vectors as V
from vecskein.functions.rotation import rotate
from vecskein.operators import kmeans
from vecskein.operators.search import KBest, Nearest
from vecskein.plans.options import MAX_DIM, METRICS, ExternalBuild, InternalBuild, IvfOptions, scan_options
from vecskein.sources import store

CODES = "list_id int, row_id long, extra int, signs binary, measures array<double>, delta double"
VECTORS = "list_id int, row_id long, extra int, vector array<float>"
PART = ", seq int, grp int"
#: Folders that the lists of a part are dealt to, rows of a page of vectors, and rows of a block of a batched search.
GROUPS, PAGE_ROWS, BLOCK_ROWS, BLOCK_QUERIES = 1024, 256, 512, 1024
#: Rows whose ids a scan names to the reader of vectors; more are joined.
NAMED = 10_000
#: Bytes of training sample, and of centroids, that the driver holds; above it training runs over the DataFrame.
DRIVER_BYTES = 512 << 20
ALL = 65535


def external_tree(table: DataFrame, dim: int) -> list[tuple[np.ndarray, list[list[int]]]]:
    """Levels (centroids, children), leaves first, of a table (id, parent, vector); its faults are errors."""
    parents: dict[int, int | None] = {}
    vectors: dict[int, np.ndarray] = {}
    for r in table.select("id", "parent", F.col("vector").cast("array<double>").alias("vector")).orderBy("id").collect():
        if r["id"] is None or r["vector"] is None:
            raise ValueError("external build: id and vector must not be null")
        if r["id"] in parents:
            raise ValueError(f"external build: id {r['id']} occurs more than once")
        if len(r["vector"]) != dim:
            raise ValueError(f"external build: wrong dimension at id {r['id']}")
        parents[r["id"]], vectors[r["id"]] = r["parent"], np.array(r["vector"])
    ids = list(parents)
    if len(ids) >= 2 and all(p is None for p in parents.values()):
        leaves = np.stack(list(vectors.values()))
        return [(leaves, [[] for _ in ids]), (leaves.mean(axis=0, keepdims=True), [list(range(len(ids)))])]
    children: dict[int, list[int]] = {i: [] for i in ids}
    roots = [i for i, p in parents.items() if p is None]
    for i, p in parents.items():
        if p is not None and p not in children:
            raise ValueError(f"external build: id {i} has parent {p}, which does not exist")
        if p is not None:
            children[p].append(i)
    if len(roots) > 1:
        raise ValueError(f"external build: more than one root: {roots[0]} and {roots[1]}")
    if not roots:
        raise ValueError("external build: there is no root")
    height: dict[int, int] = {}
    order, seen = [roots[0]], {roots[0]}
    for i in order:
        order += children[i]
        seen.update(children[i])
    if len(seen) != len(ids):
        raise ValueError(f"external build: a cycle, at id {next(i for i in ids if i not in seen)}")
    for i in reversed(order):
        below = {height[c] + 1 for c in children[i]}
        if len(below) > 1:
            raise ValueError(f"external build: branches of unequal height below id {i}")
        height[i] = below.pop() if below else 1
    top = height[roots[0]]
    if not 2 <= top <= 9:
        raise ValueError(f"external build: a tree of height {top}; 2 to 9 are possible")
    levels = [[i for i in ids if height[i] == h] for h in range(1, top + 1)]
    place = {i: k for level in levels for k, i in enumerate(level)}
    return [(np.stack([vectors[i] for i in level]), [[place[c] for c in children[i]] for i in level]) for level in levels]


def link(levels: list[np.ndarray]) -> list[tuple[np.ndarray, list[list[int]]]]:
    """Levels, leaves first, each child below its nearest parent; parents without children go."""
    out = [(levels[0], [[] for _ in levels[0]])]
    for above in levels[1:]:
        to = kmeans.assign(out[-1][0], above)
        used = np.flatnonzero(np.bincount(to, minlength=len(above)))
        out.append((above[used], [np.flatnonzero(to == k).tolist() for k in used]))
    return out


def _shortened(sample: DataFrame, dim: int) -> DataFrame:
    """``sample`` (vector) with its vectors rotated and cut to ``dim`` dimensions in column short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = rotate(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))[:, :dim]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["vector", "short"])

    return sample.mapInArrow(run, "vector array<float>, short array<double>")


def internal_tree(rows: DataFrame, options: InternalBuild, dim: int, n: int, scratch: str) -> list[tuple[np.ndarray, list[list[int]]]]:
    """K-means lists per level, from a sample of about sampling_factor rows per list, drawn by a hash and written once.

    A sample of up to ``DRIVER_BYTES`` is clustered on the driver, a larger one where it lies: what comes to the driver is centroids.
    """
    if not options.lists:
        return [(np.zeros((1, dim)), [[]])]
    spark, lists = rows.sparkSession, options.lists[-1]
    want, small = lists * options.sampling_factor, min(dim, options.kmeans_dimension or dim)
    share = min(1.0, 1.02 * want / max(n, 1))
    drawn = rows.select("vector") if share >= 1 else rows.where(F.xxhash64("row_id", "extra") < F.lit(int(share * 2.0**64) - 2**63)).select("vector")
    given = (lists, options.kmeans_iterations, options.spherical_centroids)
    if min(n, 1.1 * want) * dim * 8 <= DRIVER_BYTES:
        fit = kmeans.hierarchical if options.kmeans_algorithm == "hierarchical" else kmeans.lloyd
        picked = drawn.toPandas()["vector"]
        x = np.stack(picked.to_list()).astype(np.float64) if len(picked) else np.zeros((0, dim))
        x = x[np.lexsort(x.T[::-1])]  # tasks answer in any order
        if small < dim and len(x):
            # lists are found in fewer rotated dimensions, then averaged over all of them
            y = rotate(x)[:, :small]
            to = kmeans.assign(y, fit(y, *given))
            leaves = np.stack([x[to == k].mean(axis=0) for k in np.unique(to)])
        else:
            leaves = fit(x, *given)
    else:
        drawn.write.parquet(scratch)
        sample = spark.read.schema("vector array<float>").parquet(scratch)
        spread = kmeans.hierarchical_distributed if options.kmeans_algorithm == "hierarchical" else kmeans.lloyd_distributed
        if small < dim:
            short = _shortened(sample, small)
            leaves = kmeans.averaged(short, spread(short, *given, vector_col="short"), "short", "vector", dim)
        else:
            leaves = spread(sample, *given, vector_col="vector")
        store.remove(spark, scratch)
    fit = kmeans.hierarchical if options.kmeans_algorithm == "hierarchical" else kmeans.lloyd
    levels = [leaves]
    for above in reversed(options.lists[:-1]):
        levels.append(fit(levels[-1], above, options.kmeans_iterations, options.spherical_centroids))
    # one root above all, so that a scan takes as many probes as there are levels of lists
    levels.append(levels[-1].mean(axis=0, keepdims=True))
    return link(levels)


class Tree:
    """Rotated centroids, leaves first, with children; the last level is the root."""

    def __init__(self, levels: list[tuple[np.ndarray, list[list[int]]]]) -> None:
        self.levels = levels

    @property
    def leaves(self) -> np.ndarray:
        return self.levels[0][0]

    @property
    def heights(self) -> list[int]:
        """Lists per probed level, from the root down, without the root."""
        return [len(c) for c, _ in reversed(self.levels[:-1])]

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The list of each rotated row: the nearest child at every level."""
        at = np.zeros(len(x), np.int64)
        for k in range(len(self.levels) - 1, 0, -1):
            below, children = self.levels[k - 1][0], self.levels[k][1]
            new = np.empty(len(x), np.int64)
            for p in np.unique(at):
                rows, kids = at == p, np.array(children[p])
                new[rows] = kids[kmeans.assign(x[rows], below[kids])]
            at = new
        return at

    def probe(self, q: np.ndarray, metric: str, probes: Sequence[int]) -> list[int]:
        """The lists that a rotated query visits: the best probes[i] children at each level."""
        need = len(self.levels) - 1
        if len(probes) != need:
            raise ValueError(f"need {need} probes, but {len(probes)} probes provided")
        at = [0]
        for n, k in zip(probes, range(len(self.levels) - 1, 0, -1), strict=True):
            below, children = self.levels[k - 1][0], self.levels[k][1]
            kids = np.array(sorted(c for p in at for c in children[p]), int)
            if n < len(kids):
                far = ((below[kids] - q) ** 2).sum(axis=1) if metric == "l2" else -(below[kids] @ q)
                kids = kids[np.argsort(far, kind="stable")[:n]]
            at = kids.tolist()
        return at


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


class IvfIndex:
    """One index; open it with its path, or build it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._log: tuple | None = None
        self.version = store.read_json(spark, f"{self.path}/current.json")["version"]
        self.meta = store.read_json(spark, f"{self.root}/meta.json")
        self.options = IvfOptions.parse({k: v for k, v in self.meta["options"].items() if v is not None})
        levels = {}
        for r in spark.read.parquet(f"{self.root}/centroids").orderBy("level", "id").collect():
            levels.setdefault(r["level"], []).append((np.array(r["centroid"]), list(r["children"])))
        self.tree = Tree([(np.stack([c for c, _ in levels[k]]), [x for _, x in levels[k]]) for k in sorted(levels)])

    @property
    def root(self) -> str:
        return f"{self.path}/{self.version}"

    @property
    def metric(self) -> str:
        return self.meta["metric"]

    @property
    def inner(self) -> str:
        """The metric of stored rows: cosine is ip of unit vectors."""
        return "l2" if self.metric == "l2" else "ip"

    # Building.

    @classmethod
    def build(cls, df: DataFrame, path: str, metric: str = "l2", options: str | dict | None = None, vector_col: str = "embedding", id_col: str = "id", multivector: bool = False, where: str | None = None, scan_defaults: dict | None = None, on_phase: Callable[[str], None] | None = None) -> IvfIndex:
        """Build over a column or expression; null vectors are left out, ``where`` makes a partial index.

        With ``multivector`` the column holds arrays of vectors, ranked by late interaction. ``on_phase`` is told each
        phase as it begins; Spark's jobs carry it as their description.
        """
        with store.phases(df.sparkSession, on_phase) as phase:
            return cls._build(df, path, metric, options, vector_col, id_col, multivector, where, scan_defaults, phase)

    @classmethod
    def _build(cls, df, path, metric, options, vector_col, id_col, multivector, where, scan_defaults, phase) -> IvfIndex:
        phase("checking rows")
        spark = df.sparkSession
        opts = IvfOptions.parse(options)
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}")
        scan_options(spark, "ivf", None, scan_defaults)
        rows = cls._rows(df if where is None else df.where(where), vector_col, id_col, multivector)
        n, least, most = rows.select(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
        dim, most = (least or 1), (most or 1)
        if dim != most:
            raise ValueError("vectors of unequal dimensions")
        Q.check_dim(dim, MAX_DIM["ivf"])
        version = f"v-{uuid.uuid4().hex}"
        meta = {"metric": metric, "dim": dim, "options": opts.as_dict(), "vector_col": vector_col, "id_col": id_col, "multivector": multivector, "where": where, "scan": scan_defaults or {}}
        if metric == "cosine":
            rows = rows.withColumn("vector", _normal(F.col("vector")))
        phase("finding lists")
        root = f"{path.rstrip('/')}/{version}"
        if opts.external is not None:
            levels = external_tree(spark.table(opts.external.table), dim)
        else:
            levels = internal_tree(rows, opts.internal or InternalBuild(), dim, n, f"{root}/sample")
        levels = [(rotate(c), kids) for c, kids in levels]
        phase("writing lists")
        flat = [(k, i, c.tolist(), kids[i]) for k, (cs, kids) in enumerate(levels) for i, c in enumerate(cs)]
        spark.createDataFrame(flat, "level int, id int, centroid array<double>, children array<int>").coalesce(1).write.parquet(f"{root}/centroids")
        store.write_json(spark, f"{root}/meta.json", meta)
        phase("writing rows")
        cls._encode(rows, Tree(levels), metric, opts, root, 1)
        old = store.read_json(spark, f"{path.rstrip('/')}/current.json")["version"] if store.exists(spark, f"{path.rstrip('/')}/current.json") else None
        store.write_json(spark, f"{path.rstrip('/')}/current.json", {"version": version})
        if old:
            store.remove(spark, f"{path.rstrip('/')}/{old}")
        return cls(spark, path)

    @staticmethod
    def _rows(df: DataFrame, vector_col: str, id_col: str, multivector: bool) -> DataFrame:
        """(row_id, extra, vector): one row per vector that isn't null."""
        v = F.expr(vector_col) if vector_col not in df.columns else F.col(f"`{vector_col}`")
        ident = F.col(id_col).cast("long").alias("row_id")
        if multivector:
            bad = F.when(F.exists(v, lambda x: x.isNull()), F.raise_error(F.lit("a multivector must not hold nulls")).cast("array<array<float>>")).otherwise(v.cast("array<array<float>>"))
            return df.where(v.isNotNull()).select(ident, F.posexplode(bad).alias("extra", "vector"))
        return df.where(v.isNotNull()).select(ident, F.lit(0).alias("extra"), v.cast("array<float>").alias("vector"))

    @staticmethod
    def _encode(rows: DataFrame, tree: Tree, metric: str, options: IvfOptions, root: str, seq: int) -> None:
        """Assign and code one part: vectors first, then the codes that make its rows visible."""
        spark = rows.sparkSession
        shared = spark.sparkContext.broadcast(tree)
        inner, residual = ("l2" if metric == "l2" else "ip"), options.residual_quantization
        groups = min(len(tree.leaves), GROUPS)

        def matrix(b: pa.RecordBatch) -> np.ndarray:
            return rotate(b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(shared.value.descend(matrix(b)).astype(np.int32)), b.column(0), b.column(1).cast(pa.int32()), b.column(2)], ["list_id", "row_id", "extra", "vector"])

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x, to = matrix(b), b.column("list_id").to_numpy(zero_copy_only=False)
                coded = x - shared.value.leaves[to] if residual else x
                sign, m = Q.bit_codes(coded)
                delta = Q.residual_delta(inner, coded, shared.value.leaves[to], sign, m[:, 2]) if residual else np.zeros(len(x))
                bits = [r.tobytes() for r in np.packbits(sign > 0, axis=1)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(bits), pa.array(list(m), pa.list_(pa.float64())), pa.array(delta)], ["list_id", "row_id", "extra", "signs", "measures", "delta"])

        def write(df: DataFrame, path: str) -> None:
            df = df.withColumn("grp", F.col("list_id") % groups)
            # a group of lists with many rows is split where they are dealt
            df = df.hint("rebalance", "grp") if groups > 1 else df
            df.sortWithinPartitions("grp", "list_id", "row_id").write.option("parquet.page.row.count.limit", str(PAGE_ROWS)).partitionBy("grp").parquet(path)

        placed = rows.select("row_id", "extra", "vector").mapInArrow(assign, VECTORS)
        if not options.rerank_in_table:
            write(placed, f"{root}/vectors/seq={seq}")
            placed = spark.read.schema(VECTORS).parquet(f"{root}/vectors/seq={seq}")
        write(placed.mapInArrow(code, CODES), f"{root}/codes/seq={seq}")

    # Reading.

    def _of_lists(self, df: DataFrame, lists: Sequence[int] | None) -> DataFrame:
        if lists is None or len(lists) >= len(self.tree.leaves):
            return df
        groups = min(len(self.tree.leaves), GROUPS)
        return df.where(F.col("grp").isin(sorted({k % groups for k in lists})) & F.col("list_id").isin(list(lists)))

    def postings(self, lists: Sequence[int] | None = None) -> DataFrame:
        """Codes of live rows of all parts, or of some lists."""
        codes = store.read_seqs(self.spark, f"{self.root}/codes", CODES + PART)
        return store.live(self._of_lists(codes, lists), self.spark, f"{self.root}/tombstones")

    def vectors(self, lists: Sequence[int] | None = None, table: DataFrame | None = None) -> DataFrame:
        """(list_id, row_id, extra, seq, vector) of live rows: the index's own, or those of the table."""
        if not self.options.rerank_in_table:
            own = store.read_seqs(self.spark, f"{self.root}/vectors", VECTORS + PART)
            return store.live(self._of_lists(own, lists), self.spark, f"{self.root}/tombstones").select("list_id", "row_id", "extra", "seq", "vector")
        if table is None:
            raise ValueError("an index that reranks in the table needs it")
        rows = self._rows(table, self.meta["vector_col"], self.meta["id_col"], False).select("row_id", "vector")
        rows = rows.withColumn("vector", _normal(F.col("vector")) if self.metric == "cosine" else F.col("vector"))
        return self.postings(lists).select("list_id", "row_id", "extra", "seq").join(rows, "row_id").select("list_id", "row_id", "extra", "seq", "vector")

    def known_ids(self) -> DataFrame:
        """(row_id) of live rows."""
        return self.postings().select("row_id").distinct()

    def _probes(self, opts: dict) -> list[int]:
        return opts["probes"]

    def _prepared(self, q) -> np.ndarray:
        q = np.array(q, np.float64, ndmin=2)
        if q.shape[1] != self.meta["dim"]:
            raise ValueError("vectors of unequal dimensions")
        return rotate(_unit(q) if self.metric == "cosine" else q)

    def _estimated(self, q: np.ndarray, rows: DataFrame) -> DataFrame:
        """(row_id, extra, seq, list_id, rough, err) of codes ``rows`` for one rotated query."""
        leaves = self.spark.sparkContext.broadcast(self.tree.leaves)
        inner, residual, dim = self.inner, self.options.residual_quantization, self.meta["dim"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                raw = np.frombuffer(b"".join(b.column("signs").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                sign = np.unpackbits(raw, axis=1)[:, :dim] * 2.0 - 1.0
                m = b.column("measures").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, 4)
                rough, err = np.empty(b.num_rows), np.empty(b.num_rows)
                if residual:
                    to, delta = b.column("list_id").to_numpy(zero_copy_only=False), b.column("delta").to_numpy(zero_copy_only=False)
                    for k in np.unique(to):
                        at = to == k
                        rough[at], err[at] = Q.estimate(inner, q, sign[at], m[at], leaves.value[k], delta[at])
                else:
                    rough, err = Q.estimate(inner, q, sign, m)
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("row_id", "extra", "seq", "list_id")), pa.array(rough), pa.array(err)], ["row_id", "extra", "seq", "list_id", "rough", "err"])

        rows = rows.select("row_id", "extra", "seq", "list_id", "signs", "measures", "delta")
        return rows.mapInArrow(run, "row_id long, extra int, seq int, list_id int, rough double, err double")

    def _exact(self, query: Sequence[float]) -> Column:
        """Inner distance (squared l2, or negative inner product) of the stored vectors to a query."""
        q = np.array(query, np.float64)
        q = V.vector((_unit(q[None, :])[0] if self.metric == "cosine" else q).tolist())
        return V.l2_squared(F.col("vector"), q) if self.inner == "l2" else V.distance("ip", F.col("vector"), q)

    def _emitted(self, query: Sequence[float], seen: DataFrame, lists: Sequence[int], first: int | None, epsilon: float, table: DataFrame | None, inside: Column | None = None) -> DataFrame:
        """(row_id, extra, exact, emitted) of rows ``seen`` (estimates): all, or enough of them to hold the ``first`` by emitted.

        ``inside`` (of ``exact``) says which rows count. Only vectors of rows that may be among the first are read.
        """
        exact, keys = self._exact(query), ["row_id", "extra", "seq"]
        low = seen.select(*keys, (F.col("rough") - F.lit(float(epsilon)) * F.col("err")).alias("low"))
        vectors = self.vectors(lists, table)

        def finished(bounds: DataFrame, ids: list[int] | None) -> DataFrame:
            some = vectors if ids is None else vectors.where(F.col("row_id").isin(ids))
            done = some.withColumn("exact", exact).join(F.broadcast(bounds) if ids is not None else bounds, keys)
            done = done.select("row_id", "extra", "exact", F.greatest("low", "exact").alias("emitted"))
            return done if inside is None else done.where(inside)

        if first is None or not 0 < first <= NAMED // 4:
            return finished(low, None)
        low = low.persist()
        try:
            kind = "row_id long, extra int, seq int, low double"
            head = low.orderBy("low", "row_id").limit(4 * first + 60).collect()
            found = [r["emitted"] for r in finished(self.spark.createDataFrame(head, kind), [r["row_id"] for r in head]).select("emitted").collect()] if head else []
            # so many leave no later than this; what has its bound beyond can't be among the first
            rest = low.where(F.col("low") <= sorted(found)[first - 1]) if len(found) >= first else low
            rows = rest.limit(NAMED + 1).collect()
        finally:
            low.unpersist()
        if len(rows) > NAMED:
            return finished(rest, None)
        return finished(self.spark.createDataFrame(rows, kind), [r["row_id"] for r in rows])

    def _outer(self, d: Column) -> Column:
        if self.metric == "l2":
            return F.sqrt(F.greatest(d, F.lit(0.0)))
        return d + 1 if self.metric == "cosine" else d

    def search(self, query, k: int | None = 10, table: DataFrame | None = None, where: Column | str | None = None, radius: float | None = None, **scan) -> DataFrame:
        """(row_id, distance, emitted): rows in the order in which the scan lets them go.

        ``where`` filters rows of ``table``: before the rerank with ``prefilter``, else after the scan; without max_scan_tuples
        both give the same rows. ``radius`` keeps rows strictly inside it. A null query has no rows.
        """
        opts = scan_options(self.spark, "ivf", scan, self.meta["scan"])
        empty = self.spark.createDataFrame([], "row_id long, distance double, emitted double")
        if self.meta["multivector"]:
            raise ValueError("a multivector index is searched with maxsim")
        if query is None:
            return empty
        if self._log is not None:
            log, name, table_name = self._log
            log.record(name, table_name, self.meta["vector_col"], self.metric, query)
        if not opts["enable_scan"]:
            return self._sequential(query, k, table, where, radius)
        q = self._prepared(query)
        lists = self.tree.probe(q[0], self.inner, self._probes(opts))
        if not lists:
            return empty
        rows, wanted, most = self.postings(lists), None, opts["max_scan_tuples"]
        if where is not None:
            if table is None:
                raise ValueError("a filter needs the table")
            wanted = table.where(where).select(F.col(self.meta["id_col"]).cast("long").alias("row_id"))
            if opts["prefilter"] or most < 0:  # before the rerank; without a bound on tuples the rows are the same
                rows, wanted = rows.join(wanted, "row_id", "left_semi"), None
        inside = None if radius is None else self._outer(F.col("exact")) < float(radius)
        found = self._emitted(query, self._estimated(q[0], rows), lists, k if most < 0 else most, opts["epsilon"], table, inside)
        found = found.select("row_id", self._outer(F.col("exact")).alias("distance"), "emitted")
        if most >= 0:
            found = found.orderBy("emitted", "row_id").limit(most)
        if wanted is not None:
            found = found.join(wanted, "row_id", "left_semi")
        found = found.orderBy("emitted", "row_id")
        return found if k is None else found.limit(k)

    def _sequential(self, query, k, table, where, radius) -> DataFrame:
        from vecskein.operators import search

        if table is None:
            raise ValueError("with the scan off, a search needs the table")
        rows = self._rows(table if where is None else table.where(where), self.meta["vector_col"], self.meta["id_col"], False)
        found = search.scored(rows, list(map(float, query)), self.metric, "vector").where("distance IS NOT NULL")
        if radius is not None:
            found = found.where(F.col("distance") < float(radius))
        found = found.select("row_id", "distance", F.col("distance").alias("emitted")).orderBy("distance", "row_id")
        return found if k is None else found.limit(k)

    def search_many(self, queries: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "query", table: DataFrame | None = None, **scan) -> DataFrame:
        """(query_id, rank, row_id, distance) for a set of queries: blocks of rows meet blocks of the queries that probe their list.

        A query set opens most rows for some query, so vectors are read once for all of them and scored as matrices: codes would
        be read on top and spare nothing.
        """
        opts = scan_options(self.spark, "ivf", scan, self.meta["scan"])
        tree = self.spark.sparkContext.broadcast(self.tree)
        inner, cosine, probes, dim = self.inner, self.metric == "cosine", self._probes(opts), self.meta["dim"]
        self.tree.probe(np.zeros(dim), inner, probes)  # its faults show here

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, dim)
                x = rotate(_unit(x) if cosine else x)
                lists = [tree.value.probe(r, inner, probes) for r in x]
                n = [len(v) for v in lists]
                at = pa.array(np.repeat(np.arange(len(x)), n))
                raw = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([v for r in lists for v in r], pa.int32()), raw.take(at)], ["query_id", "list_id", "q"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = rotate(b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)).astype(np.float64)
                to, ids = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                order = np.argsort(to, kind="stable")
                out = []
                for k in np.unique(to).tolist():
                    mine = order[np.searchsorted(to, k, "left", order) : np.searchsorted(to, k, "right", order)]
                    out += [(k, ids[part].tobytes(), x[part].tobytes()) for part in np.split(mine, range(BLOCK_ROWS, len(mine), BLOCK_ROWS))]
                lists, idents, data = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(idents, pa.binary()), pa.array(data, pa.binary())], ["list_id", "ids", "data"])

        asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vector).cast("array<double>").alias("q"))
        groups = max(1, -(-asked.count() // BLOCK_QUERIES))
        dealt = asked.mapInArrow(probe, "query_id long, list_id int, q binary")
        dealt = dealt.groupBy("list_id", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("g")).agg(F.collect_list("query_id").alias("qids"), F.collect_list("q").alias("qs"))
        blocks = self.vectors(None, table).select("list_id", "row_id", "vector").mapInArrow(pack, "list_id int, ids binary, data binary")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # queries of a list meet its blocks one after another; a task sends k rows a query, however many lists and blocks it has
            best, at, kept = None, None, KBest(k)
            for b in batches:
                key, (qids, qs, ids, data) = list(zip(*(b.column(n).to_pylist() for n in (0, 1)), strict=True)), b.columns[2:]
                for r in range(b.num_rows):
                    if key[r] != at:
                        if best is not None:
                            kept.add(best.found())
                        q = np.frombuffer(b"".join(qs[r].values.to_pylist())).reshape(-1, dim)
                        at, best = key[r], Nearest(inner, qids[r].values.to_numpy(), q, k)
                    best.add(np.frombuffer(ids[r].as_buffer(), np.int64), np.frombuffer(data[r].as_buffer()).reshape(-1, dim))
            if best is not None:
                kept.add(best.found())
            yield from kept.found()

        found = dealt.join(blocks, "list_id").select("list_id", "g", "qids", "qs", "ids", "data").mapInArrow(score, "query_id long, id long, distance double")
        order = W.partitionBy("query_id").orderBy("distance", "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("row_id"), F.col("distance") if inner == "l2" else self._outer(F.col("distance")).alias("distance"))

    def _unseen(self, q: np.ndarray, lists: list[int], threshold: int, sizes: dict[int, int]) -> float | None:
        """The distance of the list at which the rows of nearer lists come to ``threshold``; None if the probed ones do."""
        left, said = threshold - sum(sizes.get(k, 0) for k in lists), None
        others = np.array([k for k in range(len(self.tree.leaves)) if k not in set(lists)], int)
        far = ((self.tree.leaves[others] - q) ** 2).sum(axis=1) if self.inner == "l2" else -(self.tree.leaves[others] @ q)
        for j in np.argsort(far, kind="stable").tolist():
            if left <= 0:
                break
            left -= sizes.get(int(others[j]), 0)
            said = float(far[j])
        return said

    def maxsim(self, queries: Sequence[Sequence[float]], k: int | None = 10, **scan) -> DataFrame:
        """(row_id, distance) by late interaction from codes; the first maxsim_refine rows of each token are exact.

        A row that a token's lists don't hold gets that token's estimate: the greater of the greatest exact distance seen and the
        distance of the list at which the rows of nearer lists come to maxsim_threshold; zero where there is neither.
        """
        opts = scan_options(self.spark, "ivf", scan, self.meta["scan"])
        if not self.meta["multivector"]:
            raise ValueError("maxsim needs a multivector index")
        if opts["max_scan_tuples"] >= 0:
            raise ValueError("maxsim does not go with max_scan_tuples")
        if self.options.rerank_in_table:
            raise ValueError("maxsim does not go with rerank_in_table")
        refine, threshold, parts, fill = opts["maxsim_refine"], opts["maxsim_threshold"], [], []
        sizes = {r["list_id"]: r["rows"] for r in self.list_counts().collect()} if threshold else {}
        for t, (raw, q) in enumerate(zip(queries, self._prepared(queries), strict=True)):
            lists = self.tree.probe(q, self.inner, self._probes(opts))
            seen = self._estimated(q, self.postings(lists))
            if refine > 0:
                exact = self._emitted(raw, seen, lists, refine, opts["epsilon"], None).orderBy("emitted", "row_id", "extra").limit(refine)
                seen = seen.join(exact.select("row_id", "extra", F.col("exact").alias("true")), ["row_id", "extra"], "left").select("row_id", F.coalesce("true", "rough").alias("d"), "true")
            else:
                seen = seen.select("row_id", F.col("rough").alias("d"), F.lit(None).cast("double").alias("true"))
            beyond = self._unseen(q, lists, threshold, sizes) if threshold else None
            parts.append(seen.groupBy("row_id").agg(F.min("d").alias("d"), F.max("true").alias("true")).withColumn("t", F.lit(t)))
            fill.append((t, beyond))
        if not parts:
            return self.spark.createDataFrame([], "row_id long, distance double")
        best = parts[0]
        for p in parts[1:]:
            best = best.unionByName(p)
        # one row a token: the estimate of rows that it lacks
        told = self.spark.createDataFrame(fill, "t int, beyond double")
        scope = best.groupBy("t").agg(F.max("true").alias("scope"))
        fills = told.join(scope, "t", "left").select("t", F.when(F.col("scope").isNull() & F.col("beyond").isNull(), 0.0).otherwise(F.greatest("scope", "beyond")).alias("fill"))
        # a row's sum: what its tokens have, and the estimates of those that it lacks
        total = fills.agg(F.sum("fill").alias("all"))
        own = best.join(F.broadcast(fills), "t").groupBy("row_id").agg(F.sum(F.col("d") - F.col("fill")).alias("over"))
        out = own.join(F.broadcast(total)).select("row_id", (F.col("over") + F.col("all")).alias("distance")).orderBy("distance", "row_id")
        return out if k is None else out.limit(k)

    # Maintenance.

    def _next(self) -> int:
        return store.next_seq(self.spark, self.root, ("codes", "vectors", "tombstones"))

    def insert(self, df: DataFrame) -> None:
        """Add rows as a new part. Deletes before it don't touch it: an id that is deleted and inserted again is there once."""
        meta = self.meta
        rows = self._rows(df if meta["where"] is None else df.where(meta["where"]), meta["vector_col"], meta["id_col"], meta["multivector"])
        rows = rows.withColumn("vector", F.when(F.size("vector") == meta["dim"], F.col("vector")).otherwise(F.raise_error(F.lit("vectors of unequal dimensions")).cast("array<float>")))
        if self.metric == "cosine":
            rows = rows.withColumn("vector", _normal(F.col("vector")))
        self._encode(rows, self.tree, self.metric, self.options, self.root, self._next())

    def delete(self, ids: DataFrame, id_col: str = "row_id") -> None:
        """Hide the rows that the index has of these ids now."""
        ids.select(F.col(id_col).cast("long").alias("row_id")).distinct().write.parquet(f"{self.root}/tombstones/seq={self._next()}")

    def vacuum(self) -> None:
        """Write the live rows as one part of a new version without tombstones, and move the pointer to it."""
        version = f"v-{uuid.uuid4().hex}"
        new, groups = f"{self.path}/{version}", min(len(self.tree.leaves), GROUPS)
        self.spark.read.parquet(f"{self.root}/centroids").coalesce(1).write.parquet(f"{new}/centroids")
        store.write_json(self.spark, f"{new}/meta.json", self.meta)
        kept = [("codes", self.postings().drop("seq"))]
        if not self.options.rerank_in_table:
            kept.append(("vectors", self.vectors().select("list_id", "row_id", "extra", "vector").withColumn("grp", F.col("list_id") % groups)))
        for kind, rows in kept:
            rows = rows.hint("rebalance", "grp") if groups > 1 else rows
            rows.sortWithinPartitions("grp", "list_id", "row_id").write.option("parquet.page.row.count.limit", str(PAGE_ROWS)).partitionBy("grp").parquet(f"{new}/{kind}/seq=1")
        old = self.root
        store.write_json(self.spark, f"{self.path}/current.json", {"version": version})
        self.version = version
        store.remove(self.spark, old)

    def reindex(self, df: DataFrame) -> IvfIndex:
        m = self.meta
        return IvfIndex.build(df, self.path, m["metric"], {k: v for k, v in m["options"].items() if v is not None}, m["vector_col"], m["id_col"], m["multivector"], m["where"], m["scan"])

    def sampled_by(self, log, name: str, table_name: str = "") -> IvfIndex:
        """Offer the query of every search to ``log``, under the session's sampling options, and forget them with the index."""
        self._log = (log, name, table_name)
        return self

    def drop(self) -> None:
        store.remove(self.spark, self.path)
        if self._log is not None:
            self._log[0].drop(self._log[1])

    def list_counts(self) -> DataFrame:
        return self.postings().groupBy("list_id").agg(F.count("*").alias("rows"))

    def prewarm(self, height: int = 0) -> str:
        """Read what a scan reads, and say how much that is; above height 0 only the centroids."""
        said = {"lists": self.tree.heights or [1], "dim": self.meta["dim"], "metric": self.metric}
        if height == 0:
            said["rows"] = self.postings().cache().count()
        return json.dumps(said)

    def cost(self, probes: Sequence[int]) -> float:
        """Rows a scan is expected to look at, centroids included, for the choice between scan and exact search."""
        rows, seen, share = self.postings().count(), 0.0, 1.0
        for n, have in zip(probes, self.tree.heights, strict=True):
            seen += have * share
            share *= min(1.0, n / have)
        return seen + rows * share


def _normal(v: Column) -> Column:
    n = F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: (x / n).cast("float")))


def evaluate_recall(index: IvfIndex, query, k: int = 10, table: DataFrame | None = None, exact_search: bool | None = False, accurate_probes: Sequence[int] | None = None, accurate_epsilon: float | None = 1.9, where=None, **scan) -> float | None:
    """Share of the accurate rows that a scan finds; None for null arguments, NaN if there are no accurate rows."""
    from vecskein.operators.search import recall

    if query is None or exact_search is None or accurate_epsilon is None:
        return None
    if index.meta["multivector"] and not exact_search:
        raise ValueError("the recall of maxsim needs an exact search")
    rough = index.search(query, k, table, where, **scan)
    if exact_search:
        truth = index.search(query, k, table, where, enable_scan=False)
    else:
        truth = index.search(query, k, table, where, probes=accurate_probes or [ALL] * len(index.tree.heights), epsilon=accurate_epsilon, max_scan_tuples=-1)
    return recall(rough, truth, "row_id")


__all__ = ["ExternalBuild", "IvfIndex", "Tree", "evaluate_recall", "external_tree", "internal_tree", "link"]
