"""SimHash fingerprints and near-duplicate groups by tiled exact comparison.

Fingerprints that differ in at most four bits are linked; the result is a class per row, never a list
of pairs. Comparison is exact and has no cap:

* ``fingerprints``: one Arrow pass; equal fingerprints are merged before anything is compared.
* ``links``: two fingerprints within radius 4 agree on at least two of six bit blocks, so each is
  dealt to the fifteen tiles that its pairs of blocks name (more rows: more and narrower choices of blocks, so that tiles stay small). A tile is compared with numpy exclusive-or
  and bit counts, in blocks sorted by population count; a block pair whose counts differ by more than
  the radius is skipped. A tile over ``tile_rows`` is dealt out as pairs of sub-tiles, so that a hot group
  becomes many tasks. Each task emits a spanning forest, at most one link per row, not its pairs.
* ``components``: hooking and pointer jumping over tables written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LAST_ID, id_or_last, join_unique, materialize, release, spread, text_bytes

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Rows that a tile should hold at most, if fingerprints were spread evenly; and rows from which on a tile is split.
EVEN_ROWS, TILE_ROWS = 64, 2048
_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is set when over half of the shingle hashes have it set; no words: zero."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        part = hashes[i : i + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "_fp", **shape) -> DataFrame:
    """All columns of ``docs`` and the fingerprint as a signed long under ``name``."""
    docs = spread(docs)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, **shape) for t in text_bytes(b.column(at))), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _forest(pairs_a: np.ndarray, pairs_b: np.ndarray, parent: np.ndarray) -> None:
    """Union by smaller index, in place."""
    for a, b in zip(pairs_a.tolist(), pairs_b.tolist(), strict=True):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)


def compare_tile(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between fingerprints within ``radius``: of ``left`` alone, or also across to ``right``.

    Values are sorted by population count and compared in blocks; blocks out of reach are skipped.
    """
    own = left if right is None else np.concatenate([left, right])
    side = np.zeros(len(own), bool)
    side[len(left) :] = True
    count = np.bitwise_count(own).astype(np.int64)
    order = np.argsort(count, kind="stable")
    own, count, side = own[order], count[order], side[order]
    parent = list(range(len(own)))
    for i in range(0, len(own), block):
        a = own[i : i + block]
        last = np.searchsorted(count, count[min(i + block, len(own)) - 1] + radius, "right")
        for j in range(i, last, block):
            b = own[j : j + block]
            near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
            if right is not None:
                near &= side[i : i + block][:, None] != side[j : j + block][None, :]
            x, y = np.nonzero(near)
            x, y = x + i, y + j
            ahead = x < y
            _forest(x[ahead], y[ahead], parent)
    links = [(k, p) for k, p in enumerate(parent) if k != p]
    if not links:
        return own[:0], own[:0]
    k, p = np.array(links).T
    return own[k], own[p]


def blocks_of(n: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``n`` blocks of a fingerprint, as even as can be."""
    edges = [round(64 * k / n) for k in range(n + 1)]
    return [(a, b - a) for a, b in pairwise(edges)]


def n_blocks(rows: int, radius: int = RADIUS) -> int:
    """The least number of blocks whose tiles, each of all blocks but ``radius``, hold ``EVEN_ROWS`` of ``rows`` even fingerprints."""
    n = radius + 2
    while n < radius + 5 and rows >> int(64 * (n - radius) / n) > EVEN_ROWS:
        n += 1
    return n


def links(fps: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS, blocks: int | None = None) -> DataFrame:
    """(a, b) links that join all distinct fingerprints ``fp`` within ``radius`` into their groups.

    ``fps`` has one long column fp, distinct. Empty in, empty out. ``blocks`` is the number of bit blocks: by the rows unless given.
    """
    keys, blocks = [], blocks or n_blocks(fps.count(), radius)
    for n, chosen in enumerate(combinations(blocks_of(blocks), blocks - radius)):
        key = F.lit(n).cast("long")
        for s, w in chosen:
            key = F.shiftleft(key, w).bitwiseOR(F.shiftrightunsigned(F.col("fp"), s).bitwiseAND(F.lit((1 << w) - 1)))
        keys.append(key)
    dealt = fps.select("fp", F.explode(F.array(*keys)).alias("tile"))
    # Sub-tile of a row within its tile: hash dealt, as many as the tile's size asks for.
    sizes = dealt.groupBy("tile").agg(F.count("*").alias("n")).where("n > 1")
    hot = materialize(sizes.where(F.col("n") > tile_rows).select("tile", F.ceil(F.col("n") / F.lit(tile_rows / 2)).alias("parts")), "hot-tiles")
    cool = materialize(dealt.join(hot, "tile", "left_anti"), "tiles") if _any(hot) else dealt
    plain = cool.select("tile", F.lit(0).cast("long").alias("pair"), F.lit(0).alias("side"), "fp")
    if _any(hot):
        sub = dealt.join(hot, "tile").withColumn("s", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))
        spread_out = sub.select("tile", "fp", "s", other.alias("o"))
        both = F.shiftleft(F.least("s", "o").cast("long"), 32).bitwiseOR(F.greatest("s", "o").cast("long"))
        hot_rows = spread_out.select("tile", both.alias("pair"), F.when(F.col("s") <= F.col("o"), 0).otherwise(1).alias("side"), "fp")
        plain = plain.unionByName(hot_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(tiles, pairs, fps_, sides):
            edges = np.flatnonzero((tiles[1:] != tiles[:-1]) | (pairs[1:] != pairs[:-1])) + 1
            outa, outb = [], []
            for s, e in zip([0, *edges], [*edges, len(tiles)], strict=True):
                if e - s < 2:
                    continue
                g, side = fps_[s:e], sides[s:e]
                a, b = compare_tile(g[side == 0], g[side == 1] if side.any() else None, radius)
                if len(a):
                    outa.append(a)
                    outb.append(b)
            return outa, outb

        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            t = tuple(b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            t = (t[0], t[1], t[2].view(np.uint64), t[3])
            if rest is not None:
                t = tuple(np.concatenate(x) for x in zip(rest, t, strict=True))
            done = np.flatnonzero((t[0] != t[0][-1]) | (t[1] != t[1][-1]))
            cut = done[-1] + 1 if len(done) else 0
            rest = tuple(x[cut:] for x in t)
            if cut:
                held = flush(*(x[:cut] for x in t))
                if held[0]:
                    yield _pairs(held)
        if rest is not None:
            held = flush(*rest)
            if held[0]:
                yield _pairs(held)

    # Rows arrive sorted by tile and pair of sub-tiles, so a task holds one such pair at a time.
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return plain.select("tile", "pair", "fp", "side").repartition(n, "tile", "pair").sortWithinPartitions("tile", "pair").mapInArrow(run, "a long, b long")


def _pairs(held) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in held], ["a", "b"])


def _any(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node it can reach.

    Each round hooks every root to its smallest neighbouring root and flattens the trees by pointer
    jumping. All joins have a unique side, so that a hot root can be split by the adaptive skew join,
    and every round starts from written tables. A few rounds do: every root with a smaller neighbour
    goes in each. Nulls are not nodes; an edge to itself makes a lone node.
    """
    spark = edges.sparkSession
    work = materialize(edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}-edges")
    tree = materialize(work.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), f"{tag}-tree")
    while True:
        live = work.where("a <> b")
        hooks = materialize(live.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("to")), f"{tag}-hooks")
        if not _any(hooks):
            for x in (work, hooks):
                release(x)
            return tree
        while True:  # a -> b -> c becomes a -> c until every hook ends at a root
            nxt = hooks.alias("h").join(hooks.select(F.col("root").alias("to"), F.col("to").alias("far")), "to", "left")
            jumped = materialize(nxt.select(F.col("root"), F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), f"{tag}-hooks")
            moved = _any(jumped.where("moved"))
            release(hooks)
            hooks = jumped
            if not moved:
                break
        pick = hooks.select("root", "to")
        new_tree = materialize(tree.join(pick, "root", "left").select("node", F.coalesce("to", "root").alias("root")), f"{tag}-tree")
        x = work.where("a <> b").join(pick.withColumnRenamed("root", "a").withColumnRenamed("to", "ta"), "a", "left")
        x = x.join(pick.withColumnRenamed("root", "b").withColumnRenamed("to", "tb"), "b", "left")
        x = x.select(F.coalesce("ta", "a").alias("p"), F.coalesce("tb", "b").alias("q"))
        new_work = materialize(x.where("p <> q").select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct(), f"{tag}-edges")
        for old in (tree, work, hooks):
            release(old)
        tree, work = new_tree, new_work


def groups(marked: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(_fp, component, n) for every distinct fingerprint of ``marked`` (_id, _fp), with its rows: component is the smallest id reachable."""
    firsts = materialize(marked.groupBy("_fp").agg(F.min("_id").alias("first"), F.count("*").alias("n")), "firsts")
    found = links(firsts.select(F.col("_fp").alias("fp")), radius, tile_rows)
    tree = components(found, "simhash")
    # the root of a group is its smallest fingerprint; its class is its smallest id
    named = materialize(firsts.join(tree.withColumnRenamed("node", "_fp"), "_fp", "left").select("_fp", "first", "n", F.coalesce("root", "_fp").alias("root")), "named")
    least = materialize(named.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("n")), "least")
    out = materialize(join_unique(named, least.drop("n"), ["root"], least.select("root", "n")).select("_fp", "component", "n"), "groups")
    for old in (firsts, tree, named, least):
        release(old)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row.

    Null and wordless texts have fingerprint zero and link like any other. A null id sorts last: it is
    the class of a group only if every row of that group has none, and then the class is null. Repeated
    rows each get a row. Other columns are not read.
    """
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    marked = materialize(with_fingerprint(picked).select("doc_id", id_or_last("doc_id").alias("_id"), "_fp"), "fingerprints")
    classes = groups(marked, radius, tile_rows)
    joined = join_unique(marked, classes.drop("n"), ["_fp"], classes.select("_fp", "n"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.when(F.col("component") < LAST_ID, F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row of each near-duplicate group, with its columns as they are: the row with the smallest id.

    Of rows that share that id, the first by a digest of all their values stays. Null ids sort last.
    """
    cols = docs.columns
    # a hash of values alone passes over nulls, so where they stand is hashed too
    row = F.xxhash64(*[x for c in cols for x in (docs[c].isNull(), docs[c].cast("string"))])
    narrow = docs.select(id_or_last(id_col).alias("_id"), row.alias("_row"), docs[text_col].cast("string").alias("text"))
    small = materialize(with_fingerprint(narrow).select("_id", "_fp", "_row"), "fingerprints")
    classes = groups(small, radius, tile_rows)
    placed = join_unique(small, classes.drop("n"), ["_fp"], classes.select("_fp", "n")).select("component", "_id", "_fp", "_row")
    chosen = placed.where("_id = component").groupBy(F.col("component").alias("_id")).agg(F.min(F.struct("_row", "_fp")).alias("m"))
    chosen = materialize(chosen.select(F.col("_id").alias("__vs_id"), F.col("m._row").alias("__vs_row")), "chosen")
    kept = docs.withColumns({"__vs_id": id_or_last(id_col), "__vs_row": row})
    out = kept.join(chosen, ["__vs_id", "__vs_row"], "left_semi")
    # rows equal in every value share the pair above: one of them stays
    twice = small.groupBy("_id", "_row").count().where("count > 1")
    if _any(twice):
        out = out.dropDuplicates(["__vs_id", "__vs_row"])
    return out.select(*cols)
