"""Exact substring dedup: remove every byte of a 100-byte string that also starts earlier.

Merged Burrows-Wheeler transforms give the repeated intervals. They can't be built over a whole corpus in one
place, so the corpus is cut into collections that no repeat leaves:

1. Equal texts are one unit; only its first copy is searched, and later copies go whole.
2. Every window of 100 bytes names an anchor, the least hash among its 24-byte strings (so equal windows
   name equal anchors, at equal offsets). A stretch of windows that share an anchor is a segment, about one
   per 39 bytes. Texts are read once: equal segments are counted where they are found, and the counts, without their
   bytes, meet by anchor. Segments whose anchor occurs once hold no repeat and are dropped.
3. The segments of one anchor are a collection. Equal ones enter the transform once, with their number as its run length.
4. Tasks build the transforms of a collection's shards and merge them by interleave refinement. Rows that share 100
   symbols are a repeated interval; what is not the first in its interval goes, and so do the later
   copies of a segment whose windows all lie in intervals of two or more.
5. A collection over ``hot`` different segments is dealt anew, by the bytes that twenty, then four neighbouring windows have
   in common, and at last by single windows, which are equal: each is merged in the same way, so no group meets in one task.

Counts are partial sums before a shuffle, joins have a unique side, and every stage starts from a written table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt
from .common import id_or_last, join_unique, materialize, release, spread

LENGTH, GRAM, RANGE = 100, 24, 20
#: Offsets of the anchor that windows of one collection may have, from one dealing to the next.
RANGES = (RANGE, 4, 1)
#: Different segments of a collection that one task merges, and bytes of collections that it takes together.
HOT, TOGETHER = 256, 1 << 16
#: Rows that go back to Spark in one batch, about.
SENT = 1 << 16
#: Bits of an anchor that give way to bits of the digest in a key: one number, by which Spark sorts without comparing rows.
LOW = 20
#: Rows of one anchor that wait for its number of different segments, at most about; beyond, it has over ``hot``.
WAIT = 1 << 20
#: A segment on its way to its anchor: ``c`` copies at the first one, none at later ones. One value of a row, as rows are many.
SEGMENT = np.dtype([("h", "<i8"), ("d", "<i8"), ("uid", "<i8"), ("a", "<i4"), ("c", "<i4"), ("n", "<i2"), ("o", "<i2")])
#: A part on its way to its collection.
PART = (("h", pa.int64()), ("d", pa.int64()), ("w", pa.int64()), ("big", pa.bool_()), ("uid", pa.int64()), ("a", pa.int32()), ("n", pa.int16()), ("o", pa.int16()), ("bytes", pa.binary()))
#: Bytes of texts that anchors are sought in at once, and of those that fit a core's cache with their hashes.
PIECE, NEAR = 1 << 18, 1 << 14
#: Digests are sums of gram hashes times powers of this.
BASE = 0x9E3779B97F4A7C15


def _grams(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 24 bytes at every place."""
    x = b.astype(np.uint64)
    for s in (1, 2, 4):
        x = x[:-s] | (x[s:] << np.uint64(8 * s))
    n = len(b) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for k, (c, r) in enumerate(((0x9E3779B97F4A7C15, 29), (0xBF58476D1CE4E5B9, 32), (0x94D049BB133111EB, 31))):
        h += x[8 * k : 8 * k + n]
        h *= np.uint64(c)
        h ^= h >> np.uint64(r)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _places(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every gram, and the place of the anchor of every window."""
    grams, windows = length - GRAM + 1, len(b) - length + 1
    hashes, place = np.empty(len(b) - GRAM + 1, np.uint64), np.empty(windows, np.int64)
    for at in range(0, windows, NEAR):
        h = _grams(b[at : at + NEAR + length - 1])
        hashes[at : at + len(h)] = h
        # high bits order by hash, low bits by place: ties go to the left
        least = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= grams:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < grams:
            least = np.minimum(least[: -(grams - width)], least[grams - width :])
        np.add((least & np.uint64(0xFFFFFF)).view(np.int64), at, out=place[at : at + len(least)])
    return hashes, place


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse, modulo 2^64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return tuple(out)


def anchored(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments of many texts: number of the text, anchor hash, digest, first window, number of windows, offset of the anchor in it."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def found():
        data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
        lens = np.fromiter((len(x) for _, _, x in held), np.int64, len(held))
        starts = np.cumsum(lens) - lens
        h, place = _places(data, length)
        new = np.append(True, place[1:] != place[:-1])
        new[starts] = True
        first = np.flatnonzero(new)
        own = np.searchsorted(starts, first, "right") - 1
        # windows that reach into the next text are none
        end = np.minimum(np.append(first[1:], len(place)), (starts + lens - length + 1)[own])
        real = end > first
        first, end, own = first[real], end[real], own[real]
        up, down = _powers(2 * PIECE + length)
        sums = np.append(np.uint64(0), (h * up[: len(h)]).cumsum())
        d = (sums[end + length - GRAM] - sums[first]) * down[first]
        whose, at = (np.array([x[k] for x in held], np.int64)[own] for k in (0, 1))
        return whose, h[place[first]], d, first - starts[own] + at, end - first, place[first] - first

    for k, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, PIECE):
            held.append((k, at, text[at : at + PIECE + length - 1]))
            size += len(held[-1][2])
            if size >= PIECE:
                yield found()
                held, size = [], 0
    if held:
        yield found()


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a text: anchor hash, first window, number of windows, offset of the anchor in the first window."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    _, h, _, *rest = (np.concatenate(x) for x in zip(none, *anchored([text], length), strict=True))
    return h, *rest


def _counted(h: np.ndarray, d: np.ndarray, uid: np.ndarray, a: np.ndarray) -> np.ndarray:
    """How often the string (h, d) of each row is among the rows, told at its first copy; zero at later ones."""
    c = np.ones(len(h), np.int64)
    both = h ^ (d * np.uint64(BASE))
    by = np.argsort(both)
    same = both[by[1:]] == both[by[:-1]]
    rows = by[np.append(same, False) | np.append(False, same)]
    rows = rows[np.lexsort((a[rows], uid[rows], d[rows], h[rows]))]
    if len(rows):
        new = np.flatnonzero(np.append(True, (h[rows[1:]] != h[rows[:-1]]) | (d[rows[1:]] != d[rows[:-1]])))
        c[rows] = 0
        c[rows[new]] = np.diff(np.append(new, len(rows)))
    return c


def split(text: bytes, a: int, n: int, o: int, length: int = LENGTH, width: int = RANGE) -> Iterator[tuple[int, int, int, int]]:
    """(core hash, digest, first window, windows) of the parts of a segment by ranges of ``width`` anchor offsets.

    The core is what all windows of a range have in common, whether or not the segment has them all.
    """
    p, top = a + o, length - GRAM
    for low in range((o - n + 1) // width * width, o + 1, width):
        high = min(low + width - 1, top)
        lo, hi = max(low, o - n + 1), min(high, o)
        start, k = p - hi, hi - lo + 1
        yield xxhash.xxh3_64_intdigest(text[p - low : p - high + length], low + 1), xxhash.xxh3_64_intdigest(text[start : start + k + length - 1], lo + 1), start, k


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _verdicts(first: np.ndarray, windows: np.ndarray, weights: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the merged transform of ``texts`` says: (text, first window, windows) of the runs that also start earlier, and the
    texts whose windows all lie in intervals of two suffixes or more, so that their later copies go.

    first: (unit, place) of each text's first copy; windows: how many it has; weights: its copies.
    """
    group, string, offset = bwt.repeats(texts, length, weights=weights)
    covered = np.bincount(string, minlength=len(texts)) == windows
    # texts hold windows of their own, so that their order and the offset order windows; offsets of two texts are never neighbours
    by = np.lexsort((first[:, 1], first[:, 0]))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    low = (int(offset.max(initial=0)) + 1).bit_length()
    high = low + len(by).bit_length()
    key = np.sort((group << high) | (rank[string] << low) | offset)
    later = np.append(False, key[1:] >> high == key[:-1] >> high)[: len(key)]
    key = np.sort(key[later] & ((1 << high) - 1))
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1] + 1)[: len(key)])
    return by[key[new] >> low], key[new] & ((1 << low) - 1), np.diff(np.append(new, len(key))), np.flatnonzero(covered & (weights > 1))


def _collections(parts: DataFrame, hot: int) -> DataFrame:
    """``parts`` (h, d, w, ...) with ``big``: whether over ``hot`` different parts share the key h."""
    sizes = parts.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > hot).select("h", F.lit(True).alias("big"))
    return parts.join(sizes, "h", "left").withColumn("big", F.coalesce("big", F.lit(False)))


def find(units: DataFrame, lists: Callable[[DataFrame], DataFrame], length: int = LENGTH, hot: int = HOT, told: Callable[[int, DataFrame, DataFrame], None] | None = None) -> list[DataFrame]:
    """Tables (uid, a, n) of runs of windows of ``units`` (uid, text) that also start earlier.

    ``lists`` joins a table of uid and anything onto the texts: it gives (uid, text, and the rest). ``told`` is given
    each dealing's number, what its merged intervals took from first copies, and what from later ones.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def send():
            uid, h, d, a, n, o = (np.concatenate(x) for x in zip(*held, strict=True))
            out = np.empty(len(h), SEGMENT)
            for f, x in zip(SEGMENT.names, (h.view(np.int64), d.view(np.int64), uid, a, _counted(h, d, uid, a), n, o), strict=True):
                out[f] = x
            # later copies of a string that is here more than once are known to stay, and need not meet their anchor
            key = np.where(out["c"] > 0, (out["h"] >> LOW << LOW) | (out["d"] & ((1 << LOW) - 1)), out["d"] ^ (uid * 31 + a) * (BASE >> 1))
            places = np.arange(len(h) + 1, dtype=np.int32) * SEGMENT.itemsize
            rows = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(places), pa.py_buffer(out.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(key), rows], ["key", "segment"])

        for b in batches:
            uid = b.column(0).to_numpy(zero_copy_only=False)
            for whose, *rest in anchored(b.column(1).to_pylist(), length):
                held.append((uid[whose], *rest))
                size += len(whose)
                if size >= SENT:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    def told_by_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in the order of their keys those whose anchor occurs twice, with the number of copies at the first of each string."""
        held = np.zeros(0, SEGMENT)
        wide = None  # high bits of an anchor that is big already

        def send(x, w, big):
            cols = (x["h"], x["d"], w, big, x["uid"], x["a"], x["n"], x["o"])
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["h", "d", "w", "big", "uid", "a", "n", "o"])

        def settled(x):
            high = x["h"] >> LOW
            same = high[1:] == high[:-1]
            x = x[np.append(False, same) | np.append(same, False) | (x["c"] > 1) | (high == wide)]
            x = x[np.lexsort((x["a"], x["uid"], x["d"], x["h"]))]
            h, d, c = (x[f] for f in ("h", "d", "c"))
            new = np.append(True, h[1:] != h[:-1])[: len(x)]
            kind = new | np.append(True, d[1:] != d[:-1])[: len(x)]
            at, starts, stay = np.flatnonzero(new), np.flatnonzero(kind), h >> LOW == wide
            w, big, each = np.zeros(len(x), np.int64), stay.copy(), np.diff(np.append(at, len(x)))
            if len(x):
                w[starts] = np.add.reduceat(c, starts)
                big |= np.repeat(np.add.reduceat(kind.astype(np.int64), at) > hot, each)
                stay |= np.repeat(np.add.reduceat(c, at) > 1, each)
            return send(x[stay], w[stay], big[stay])

        for b in batches:
            rows = b.column(1).cast(pa.binary())
            places = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1]
            x = np.frombuffer(rows.buffers()[2], np.uint8)[places[0] : places[-1]].view(SEGMENT) if len(rows) else held[:0]
            first = x["c"] > 0
            if not first.all():
                copies = x[~first]
                yield send(copies, np.zeros(len(copies), np.int64), np.zeros(len(copies), bool))
            held = np.append(held, x[first])
            high = held["h"] >> LOW
            at = int(np.append(0, np.flatnonzero(high[1:] != high[:-1]) + 1)[-1])
            if len(held) - at > WAIT:  # equal strings stand together by the low bits of their digests
                low = held["d"][at:] & ((1 << LOW) - 1)
                cuts = np.flatnonzero(low[1:] != low[:-1]) + 1
                if len(cuts) > hot and len(np.unique(held["h"][at:])) == 1:
                    if at:
                        yield settled(held[:at])
                    wide, at = high[-1], at + int(cuts[-1])
                    yield settled(held[at - int(cuts[-1]) : at])
                    held = held[at:]
                    continue
            if at:
                yield settled(held[:at])
                held = held[at:]
        if len(held):
            yield settled(held)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, segs = b.column(1).to_pylist(), b.column(2).flatten()
            own = np.repeat(np.arange(len(texts)), b.column(2).value_lengths().to_numpy(zero_copy_only=False))
            cols = {f: segs.field(f) for f in ("h", "d", "w", "big", "a", "n", "o")} | {"uid": b.column(0).take(pa.array(own))}
            start = cols["a"].to_numpy(zero_copy_only=False).astype(np.int64)
            end = start + cols["n"].to_numpy(zero_copy_only=False) + length - 1
            sent = np.cumsum(end - start) // (SENT * 32)
            edges = [0, *(np.flatnonzero(sent[1:] != sent[:-1]) + 1).tolist(), len(own)]
            for x, y in zip(edges, edges[1:], strict=False):
                cut_out = b"".join([texts[k][i:j] for k, i, j in zip(own[x:y].tolist(), start[x:y].tolist(), end[x:y].tolist(), strict=True)])
                offsets = np.append(0, np.cumsum(end[x:y] - start[x:y])).astype(np.int32)
                cols["bytes"] = pa.Array.from_buffers(pa.binary(), y - x, [None, pa.py_buffer(offsets), pa.py_buffer(cut_out)])
                yield pa.RecordBatch.from_arrays([cols[f] if f == "bytes" else cols[f].slice(x, y - x) for f, _ in PART], [f for f, _ in PART])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        size, last = 0, None

        def flush():
            h, d, w, uid, a, n, text = ([x for c in col for x in c] if k == 6 else np.concatenate(col) for k, col in enumerate(zip(*held, strict=True)))
            s, at, run, copied = _verdicts(np.stack([uid, a], 1), n, w, text, length)
            who = np.concatenate([s, copied])
            cols = (h[who], d[who], uid[who], np.concatenate([a[s] + at, a[copied]]).astype(np.int32), np.concatenate([run, n[copied]]).astype(np.int16), np.arange(len(who)) >= len(s))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "d", "uid", "a", "n", "copies"])

        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            cols = [b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(1, 7)]
            texts = b.column(7).to_pylist()
            sizes = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))
            # a collection is never parted: cut where the key changes and enough has come together
            edges = np.flatnonzero(np.append(last is None or key[:1] != last, key[1:] != key[:-1])[: len(key)])
            at = 0
            while (k := int(np.searchsorted(sizes[edges], sizes[at] + TOGETHER - size))) < len(edges):
                e = int(edges[k])
                held.append([*(c[at:e] for c in cols), texts[at:e]])
                yield flush()
                held, size, at = [], 0, e
            if at < len(key):
                held.append([*(c[at:] for c in cols), texts[at:]])
                size += int(sizes[-1] - sizes[at])
                last = key[-1]
        if held:
            yield flush()

    def dealt(width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for uid, a, n, o, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    rows += [(c, d, uid, a + s, k, o - s, text[s : s + k + length - 1]) for c, d, s, k in split(text, 0, n, o, length, width)]
                c, d, *rest = list(zip(*rows, strict=True)) or [()] * 7
                types = (pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.binary())
                yield pa.RecordBatch.from_arrays([_signed(c), _signed(d), *(pa.array(x, t) for x, t in zip(rest, types, strict=True))], ["h", "d", "uid", "a", "n", "o", "bytes"])

        return run

    all_segments = units.select("uid", "text").mapInArrow(segments, "key long, segment binary")
    by_anchor = all_segments.repartition(F.shiftright("key", LOW)).sortWithinPartitions("key").mapInArrow(told_by_anchor, "h long, d long, w long, big boolean, uid long, a int, n short, o short")
    found = materialize(by_anchor, "segments", "zstd", SENT)
    asked = found.where("w > 0").select("uid", F.struct("h", "d", "w", "big", "a", "n", "o").alias("s"))
    with_text = lists(asked.groupBy("uid").agg(F.collect_list("s").alias("segs"))).select("uid", "text", "segs")
    strings_ = materialize(with_text.mapInArrow(strings, "h long, d long, w long, big boolean, uid long, a int, n short, o short, bytes binary"), "strings")
    out = []
    for level, width in enumerate((*RANGES, 0)):
        # of a collection that is dealt anew, only copies are settled here, each kind by itself
        key = F.when(F.col("big"), F.xxhash64("h", "d")).otherwise(F.col("h"))
        here = strings_.where("NOT big OR w > 1").select(key.alias("key"), "h", "d", "w", "uid", "a", "n", "bytes")
        # no number of partitions: later dealings are small, and Spark joins theirs into fewer tasks and files
        verdicts = materialize(here.repartition("key").sortWithinPartitions("key").mapInArrow(merged, "h long, d long, uid long, a int, n short, copies boolean"), "verdicts")
        firsts = verdicts.where("NOT copies").select("uid", "a", "n")
        firsts._vecskein_path = verdicts._vecskein_path
        kinds = verdicts.where("copies").select("h", "d", F.col("uid").alias("fu"), F.col("a").alias("fa"))
        copies = found if level else found.where("w = 0").select("h", "d", "uid", "a", "n")
        later = materialize(join_unique(copies, kinds, ["h", "d"], strings_.select("h", "d", F.col("w").alias("n"))).where("uid <> fu OR a <> fa").select("uid", "a", "n"), "runs")
        release(found)
        out += [firsts, later]
        if told is not None:
            told(level, firsts, later)
        if not width or strings_.where("big").isEmpty():
            release(strings_)
            break
        found = materialize(strings_.where("big").select("uid", "a", "n", "o", "bytes").mapInArrow(dealt(width), "h long, d long, uid long, a int, n short, o short, bytes binary"), "parts")
        release(strings_)
        kinds = found.groupBy("h", "d").agg(F.min(F.struct("uid", "a", "n", "o", "bytes")).alias("f"), F.count("*").alias("w")).select("h", "d", "w", "f.*")
        strings_ = materialize(_collections(materialize(kinds, "kinds"), hot), "strings")
    return out


def cut(text: bytes, at: np.ndarray, n: np.ndarray, length: int = LENGTH) -> tuple[int, int, str]:
    """Bytes removed, removed spans and digest of what is left, for runs (at, n) of repeated windows."""
    order = np.argsort(at)
    start = at[order]
    end = np.maximum.accumulate(start + n[order] + length - 1)
    new = np.append(True, start[1:] > end[:-1])
    start, end = start[new], end[np.append(new[1:], True)]
    kept = b"".join([text[x:y] for x, y in zip([0, *end.tolist()], [*start.tolist(), len(text)], strict=True)])
    return int((end - start).sum()), len(start), hashlib.sha256(kept).hexdigest()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT, told=None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    Earlier means a smaller id, or the same document and an earlier start. Rows without an id come after all others.
    Rows equal in id and text share their result. Unequal texts under one id are ordered by their digests.
    Null texts are empty; texts shorter than ``length`` lose nothing. Other columns are not read.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    base = spread(docs.select(docs[id_col].cast("long").alias("doc_id"), id_or_last(id_col).alias("doc"), text.cast("binary").alias("text")))
    rows = materialize(base.select("doc_id", "doc", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")), "rows")
    firsts = rows.where(F.col("n_bytes") >= length).groupBy("sha").agg(F.min("doc").alias("doc"), F.count("*").alias("n"))
    firsts = materialize(firsts.orderBy("doc", "sha").withColumn("uid", F.monotonically_increasing_id()), "units")
    long_ = base.where(F.octet_length("text") >= length).select("doc", "text", F.sha2("text", 256).alias("sha"))
    # a row repeated under its id gives its unit twice; one is enough
    twins = rows.where(F.col("n_bytes") >= length).groupBy("sha", "doc").count().where("count > 1")
    texts = long_.join(firsts, ["sha", "doc"]).select("uid", "text")
    units = materialize(texts if twins.isEmpty() else texts.dropDuplicates(["uid"]), "texts")
    lists = lambda t: units.join(t, "uid")

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = b.column(2).flatten()
            at, n = (runs.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("a", "n"))
            ends = np.cumsum(b.column(2).value_lengths().to_numpy(zero_copy_only=False)).tolist()
            done = [cut(t, at[x:y], n[x:y], length) for t, x, y in zip(b.column(1).to_pylist(), [0, *ends], ends, strict=False)]
            cols = list(zip(*done, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["uid", "n_removed", "n_spans", "kept"])

    runs = find(units, lists, length, hot, told)
    flagged = runs[0]
    for r in runs[1:]:
        flagged = flagged.unionByName(r)
    listed = lists(flagged.groupBy("uid").agg(F.collect_list(F.struct("a", "n")).alias("runs"))).select("uid", "text", "runs")
    part = materialize(listed.mapInArrow(results, "uid long, n_removed long, n_spans long, kept string"), "results")
    release(units)
    known = materialize(firsts.select("uid", "sha", F.col("doc").alias("first"), "n").join(part, "uid", "left").drop("uid"), "known")
    for r in (*runs, part, firsts):
        release(r)
    # shorter texts have no unit and lose nothing
    joined = join_unique(rows.where(F.col("n_bytes") >= length), known.drop("n"), ["sha"], known.select("sha", "n"))
    joined = joined.unionByName(rows.where(F.col("n_bytes") < length), allowMissingColumns=True)
    whole = F.col("doc") > F.col("first")
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
