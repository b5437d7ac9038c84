"""K-means for index lists: Lloyd on a sample in memory or over a DataFrame, in one level or two."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 7
#: Relative nudge by which a split centroid and its copy are parted.
NUDGE = 2.0**-10


def _unit(c: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(c, axis=1, keepdims=True)
    return np.divide(c, n, out=c.copy(), where=n > 0)


def quick(x: np.ndarray, c: int, dim: int, rng: np.random.Generator, spherical: bool = False) -> np.ndarray:
    """With no more samples than lists, the samples are the centroids, filled up with random ones."""
    if not len(x) and c == 1:
        return np.zeros((1, dim))
    out = np.concatenate([x[:c], rng.uniform(-1, 1, (max(0, c - len(x)), dim))])
    return _unit(out) if spherical else out


def assign(x: np.ndarray, centroids: np.ndarray, block: int = 4096) -> np.ndarray:
    """Nearest centroid of each row, ties to the later one."""
    out = np.empty(len(x), np.int64)
    half = (centroids * centroids).sum(axis=1) / 2
    for i in range(0, len(x), block):
        far = half[None, :] - x[i : i + block] @ centroids.T
        out[i : i + block] = len(centroids) - 1 - np.argmin(far[:, ::-1], axis=1)
    return out


def update(sums: np.ndarray, counts: np.ndarray, old: np.ndarray, rng: np.random.Generator, spherical: bool = False) -> np.ndarray:
    """New centroids of summed clusters; an empty one splits a donor drawn by size."""
    counts = counts.astype(np.int64).copy()
    out = np.divide(sums, counts[:, None], out=old.copy(), where=counts[:, None] > 0)
    total, c = counts.sum(), len(counts)
    for k in np.flatnonzero(counts == 0):
        if total <= c:
            continue
        weight = np.maximum(counts - 1, 0).astype(float)
        if not weight.sum():
            break
        donor = int(rng.choice(c, p=weight / weight.sum()))
        flip = np.where(np.arange(out.shape[1]) % 2 == 0, 1 + NUDGE, 1 - NUDGE)
        out[k], out[donor] = out[donor] * flip, out[donor] * (2 - flip)
        counts[k] = counts[donor] // 2
        counts[donor] -= counts[k]
    return _unit(out) if spherical else out


def two_nearest(x: np.ndarray, centroids: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, distance to it, distance to the next) of each row, ties to the later one."""
    to, near, far = assign(x, centroids, block), np.empty(len(x)), np.full(len(x), np.inf)
    for i in range(0, len(x), block):
        part, mine = x[i : i + block], to[i : i + block]
        d = np.maximum((part * part).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1)[None, :] - 2 * part @ centroids.T, 0)
        rows = np.arange(len(part))
        near[i : i + block] = np.sqrt(d[rows, mine])
        if len(centroids) > 1:
            d[rows, mine] = np.inf
            far[i : i + block] = np.sqrt(d.min(axis=1))
    return to, near, far


def lloyd(x: np.ndarray, c: int, iterations: int = 10, spherical: bool = False, seed: int = SEED, told: list[int] | None = None) -> np.ndarray:
    """Centroids of a sample in memory.

    A row is compared with all centroids only while it may have changed sides: by the triangle inequality it has not as long as
    its own centroid is nearer than the bound on the next one, both moved by what the centroids moved. ``told``
    takes the number of rows that each round compared.
    """
    x, rng = np.asarray(x, np.float64), np.random.default_rng(seed)
    if spherical and len(x):
        x = _unit(x)
    if len(x) <= c:
        return quick(x, c, x.shape[1], rng, spherical)
    now = x[np.sort(rng.choice(len(x), c, replace=False))].copy()
    to, near, far = None, None, None
    for _ in range(iterations):
        if to is None:
            open_ = np.arange(len(x))
            to, near, far = two_nearest(x, now)
            changed = True
        else:
            # a hair of slack, so that rounding never counts a row out
            open_ = np.flatnonzero(near * (1 + 1e-9) + 1e-12 >= far * (1 - 1e-9))
            fresh, near[open_], far[open_] = two_nearest(x[open_], now)
            changed = (fresh != to[open_]).any()
            to[open_] = fresh
        if told is not None:
            told.append(len(open_))
        if not changed:
            break
        sums = np.zeros_like(now)
        np.add.at(sums, to, x)
        new = update(sums, np.bincount(to, minlength=c), now, rng, spherical)
        moved = np.sqrt(((new - now) ** 2).sum(axis=1))
        near, far, now = near + moved[to], far - moved.max(), new
    return now


def seats(total: int, votes: list[int]) -> list[int]:
    """Lists per coarse cluster by odd divisors (Sainte-Lague), each cluster with one at least."""
    out = [1] * len(votes)
    waiting = [(-v / 3, k) for k, v in enumerate(votes)]
    heapq.heapify(waiting)
    for _ in range(total - len(votes)):
        _, k = waiting[0]
        out[k] += 1
        heapq.heapreplace(waiting, (-votes[k] / (2 * out[k] + 1), k))
    return out


def hierarchical(x: np.ndarray, c: int, iterations: int = 10, spherical: bool = False, seed: int = SEED) -> np.ndarray:
    """About sqrt(c) coarse clusters, then Lloyd within each for its share of the lists."""
    x = np.asarray(x, np.float64)
    coarse = max(1, int(round(np.sqrt(c))))
    if coarse < 2 or len(x) <= c:
        return lloyd(x, c, iterations, spherical, seed)
    rng = np.random.default_rng(seed)
    top = lloyd(x[np.sort(rng.choice(len(x), min(len(x), 256 * coarse), replace=False))], coarse, 10, spherical, seed)
    to = assign(_unit(x) if spherical else x, top)
    votes = np.bincount(to, minlength=coarse)
    used = np.flatnonzero(votes)
    return np.concatenate([lloyd(x[to == k], n, iterations, spherical, seed + 1 + int(k)) for k, n in zip(used.tolist(), seats(c, votes[used].tolist()), strict=True)])


def lloyd_distributed(df: DataFrame, c: int, iterations: int = 10, spherical: bool = False, seed: int = SEED, vector_col: str = "embedding", start: np.ndarray | None = None) -> np.ndarray:
    """Lloyd over all rows of a DataFrame: centroids go out, one sum and count per cluster and task come back.

    What moves is ``c`` centroids a task and round, whatever the number of rows.
    """
    spark = df.sparkSession
    rng = np.random.default_rng(seed)
    rows = df.where(df[vector_col].isNotNull()).select(df[vector_col].cast("array<double>").alias("v"))
    if start is None:
        first = [r[0] for r in rows.orderBy(F.xxhash64("v", F.lit(seed))).limit(c).collect()]
        x = np.array(first, np.float64)
        if len(x) < c:
            return quick(x, c, x.shape[1] if len(x) else 1, rng, spherical)
        start = _unit(x) if spherical else x
    now = start
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(now)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            centroids = shared.value
            sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
            for b in batches:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                if spherical:
                    x = _unit(x)
                to = assign(x, centroids)
                np.add.at(sums, to, x)
                counts += np.bincount(to, minlength=len(counts))
            used = np.flatnonzero(counts)
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.float64()))], ["k", "n", "s"])

        parts = rows.mapInArrow(run, "k long, n long, s array<double>")
        added = parts.groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(j))).alias(f"s{j}") for j in range(now.shape[1])]).collect()
        shared.unpersist()
        sums, counts = np.zeros_like(now), np.zeros(len(now), np.int64)
        for r in added:
            counts[r[0]], sums[r[0]] = r[1], r[2:]
        new = update(sums, counts, now, rng, spherical)
        if np.allclose(new, now, rtol=0, atol=1e-12):
            break
        now = new
    return now


#: Bytes of sample that one task, or the driver, clusters by itself.
TASK_BYTES = 256 << 20


def hierarchical_distributed(df: DataFrame, c: int, iterations: int = 10, spherical: bool = False, seed: int = SEED, vector_col: str = "embedding") -> np.ndarray:
    """As ``hierarchical``, over a DataFrame: coarse clusters from part of the rows, then every cluster in a task of its own.

    A cluster over ``TASK_BYTES`` is clustered by distributed rounds in place of one task. What comes to the driver is centroids, and the
    part for the coarse ones, at most ``TASK_BYTES``.
    """
    rows = df.where(df[vector_col].isNotNull()).select(df[vector_col].cast("array<double>").alias("v"))
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    coarse = max(1, int(round(np.sqrt(c))))
    if coarse < 2 or n <= c:
        return lloyd_distributed(df, c, iterations, spherical, seed, vector_col)
    share = min(1.0, 256 * coarse / n, TASK_BYTES / (8 * dim * n))
    part = rows if share >= 1 else rows.where(F.xxhash64("v", F.lit(seed)) < F.lit(int(share * 2.0**64) - 2**63))
    x = np.stack(part.toPandas()["v"].to_list())
    top = lloyd(x[np.lexsort(x.T[::-1])], coarse, 10, spherical, seed)
    shared = df.sparkSession.sparkContext.broadcast(top)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array(assign(_unit(y) if spherical else y, shared.value).astype(np.int32)), b.column(0)], ["k", "v"])

    dealt = rows.mapInArrow(nearest, "k int, v array<double>")
    votes = {r["k"]: r["count"] for r in dealt.groupBy("k").count().collect()}
    used = sorted(votes)
    lists = dict(zip(used, seats(c, [votes[k] for k in used]), strict=True))
    large = [k for k in used if votes[k] * dim * 8 > TASK_BYTES and lists[k] > 1]

    def own(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        k, y = key[0].as_py(), np.array(table["v"].to_pylist(), np.float64)
        found = lloyd(y[np.lexsort(y.T[::-1])], lists[k], iterations, spherical, seed + 1 + k)
        return pa.table({"k": pa.array([k] * len(found), pa.int32()), "j": pa.array(np.arange(len(found), dtype=np.int32)), "c": pa.array(list(found), pa.list_(pa.float64()))})

    small = dealt.where(~F.col("k").isin(large)) if large else dealt
    out = [np.array(r["c"]) for r in sorted(small.groupBy("k").applyInArrow(own, "k int, j int, c array<double>").collect(), key=lambda r: (r["k"], r["j"]))]
    for k in large:
        out += list(lloyd_distributed(dealt.where(F.col("k") == k), lists[k], iterations, spherical, seed + 1 + k, "v"))
    return np.stack(out)


def averaged(df: DataFrame, centroids: np.ndarray, by: str, of: str, dim: int) -> np.ndarray:
    """The mean of column ``of`` over the rows nearest to each of ``centroids`` in column ``by``; one partial sum a task and cluster."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(shared.value), dim)), np.zeros(len(shared.value), np.int64)
        for b in batches:
            if b.num_rows:
                y, x = (b.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1) for i in (0, 1))
                to = assign(y, shared.value)
                np.add.at(sums, to, x)
                counts += np.bincount(to, minlength=len(counts))
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.float64()))], ["k", "n", "s"])

    parts = df.select(by, of).mapInArrow(run, "k long, n long, s array<double>")
    rows = parts.groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(j))).alias(f"s{j}") for j in range(dim)]).orderBy("k").collect()
    return np.array([np.array(r[2:]) / r[1] for r in rows])
