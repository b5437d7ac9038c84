"""Token counts by a separator scan over flat token files without an index.

A token file is nothing but token ids, little-endian, each document closed by an end-of-document id. Files are cut
into blocks at fixed offsets, wherever those fall. Each block is one vectorised search for the separator;
a prefix scan over the blocks of a file then carries the last separator seen, and the number of them, across
block edges, so that a document that spans many blocks is counted once and whole.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe, files
from .common import materialize, remove, scratch_path, spread

#: Tokens in one scanned block, and about how many go to one file.
BLOCK = 1 << 20
FILE_TOKENS = 1 << 24
EOD = 50256
#: Longer texts are encoded by dynamic programming, which is linear in any text.
LONG = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_encoders: dict = {}


def _encoder(shared):
    """Text to ids, one a worker."""
    value = shared.value
    if id(value) not in _encoders:
        import tiktoken

        _encoders.clear()
        quick = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=value["ranks"], special_tokens={}).encode_ordinary
        slow: list = []

        def encode(text: str) -> np.ndarray:
            if len(text) <= LONG:
                return np.array(quick(text), np.int64)
            if not slow:
                slow.append(bpe.Codec(value["vocabulary"] | {"special": {}}))
            return np.frombuffer(slow[0].encode(text), "<u4").astype(np.int64)

        _encoders[id(value)] = (value, encode)
    return _encoders[id(value)][1]


def write_tokens(docs: DataFrame, ranks: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", eod: int = EOD, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write flat token files; (file, n_bytes, ordinal, doc_id) says which document is where in which.

    A file belongs to the attempt that reports it: a retried task writes files of its own, and those of
    the lost attempt are in no row. A null text is empty and writes its separator alone.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({"ranks": load_ranks(ranks), "vocabulary": bpe.load_vocabulary(vocabulary)})
    folder = scratch_path(spark, "tokens")
    files.make_dir(folder)
    width = 2 if max(eod, max(shared.value["ranks"].values())) < 1 << 16 else 4
    picked = spread(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = _encoder(shared), f"<u{width}"
        path, out, ids, written = "", None, [], 0

        def close():
            out.close()
            n = len(ids)
            return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([written * width] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(ids, pa.int64())], ["file", "n_bytes", "ordinal", "doc_id"])

        for b in batches:
            for ident, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.bin"
                    out, ids, written = files.write(path), [], 0
                tokens = encode(text or "")
                out.write(np.append(tokens, eod).astype(kind).tobytes())
                ids.append(ident)
                written += len(tokens) + 1
                if written >= file_tokens:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    placed = materialize(picked.mapInArrow(run, "file string, n_bytes long, ordinal long, doc_id long"), "placed")
    return placed.withColumn("width", F.lit(width))


def scan_block(tokens: np.ndarray, first: int, eod: int, last_block: bool) -> tuple[np.ndarray, np.ndarray]:
    """Absolute positions of the separators of a block, and the distance of each from the one before it in the block (-1: none).

    Tokens after the last separator of a file are a document that isn't closed: its end counts as one.
    """
    at = np.flatnonzero(tokens == eod) + first
    if last_block and len(tokens) and tokens[-1] != eod:
        at = np.append(at, first + len(tokens))
    return at, np.diff(at, prepend=at[:1]) if len(at) else at


def count(token_files: DataFrame, eod: int = EOD, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in ``token_files`` (file, n_bytes, width); separators do not count.

    An empty file has no documents; two separators in a row close an empty one.
    """
    size = F.col("width") * F.lit(block)
    blocks = token_files.where("n_bytes > 0").select("file", "n_bytes", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / size))).alias("block"))
    spark = token_files.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, n_bytes, width, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                start = k * block * width
                with files.read(path) as f:
                    raw = files.read_range(f, start, min(block * width, n_bytes - start))
                at, gap = scan_block(np.frombuffer(raw, f"<u{width}"), k * block, eod, start + len(raw) >= n_bytes)
                m = len(at)
                yield pa.RecordBatch.from_arrays([pa.array([path] * m, pa.string()), pa.array(np.full(m, k)), pa.array(np.arange(m)), pa.array(at.astype(np.int64)), pa.array(gap.astype(np.int64))], ["file", "block", "k", "at", "gap"])

    found = materialize(blocks.repartition(n, "file", "block").mapInArrow(run, "file string, block long, k long, at long, gap long"), "separators")
    sums = found.groupBy("file", "block").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    scan = sums.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"))
    joined = found.join(scan, ["file", "block"])
    return joined.select("file", (F.col("base") + F.col("k")).alias("ordinal"), F.when(F.col("k") == 0, F.col("at") - F.col("carry") - 1).otherwise(F.col("gap") - 1).alias("n_tokens"))


def token_counts(docs: DataFrame, ranks: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", eod: int = EOD, block: int = BLOCK, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """doc_id and n_tokens of every row, counted from the flat files that hold the encoded texts.

    Repeated rows are written, and counted, as often as they occur; null ids are carried through.
    """
    placed = write_tokens(docs, ranks, vocabulary, id_col, text_col, eod, file_tokens)
    first = placed.select("file").first()
    counted = count(placed.select("file", "n_bytes", "width").distinct(), eod, block)
    if first is not None:  # the separators are written by now: nothing reads the token files again
        remove(docs.sparkSession, first[0].rpartition("/")[0])
    return placed.select("file", "ordinal", "doc_id").join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")
