"""Byte-level BPE encoding by per-prefix dynamic programming, and decoding.

For a byte-level BPE every prefix of a text has one last token: the token t ending there whose
predecessor (the last token of the shorter prefix) is compatible with it, that is, merging the bytes of
the two yields just these two tokens. A suffix automaton of the vocabulary gives all tokens that end at each byte; one
compatibility test a candidate picks the one that holds; back-pointers then emit the ids. No merge queue,
linear in the text for a fixed vocabulary, and the ids are exactly those of greedy merging by rank.

The work is per row in Arrow batches, with no shuffle. Pieces (words) repeat, so each worker remembers
those it has solved, up to a bound.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .automaton import SuffixAutomaton
from .common import materialize, spread

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points that Unicode made letters or numbers after version 16, which the tokenizer's pattern follows.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A "
    "11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 16FF4-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 "
    "18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 "
    "1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: Pieces and token pairs a worker remembers, and the longest piece that is.
REMEMBER = 400_000
LONGEST = 48


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file, turned back to the byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in kept}
    for k, b in enumerate(sorted(set(range(256)) - set(kept))):
        out[chr(256 + k)] = b
    return out


def load_vocabulary(path: str) -> dict:
    """Tokens, ranked merges and special tokens of a byte-level BPE file, as plain values for a broadcast."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = _byte_chars()
    raw = lambda s: bytes(byte_of[c] for c in s)
    tokens = {i: raw(t) for t, i in spec["model"]["vocab"].items()}
    merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
    return {"tokens": {i: t for i, t in tokens.items() if i not in special.values()}, "merges": [(raw(a), raw(b)) for a, b in merges], "special": special}


class Codec:
    """Encodes texts to ids and decodes ids to texts under one vocabulary."""

    def __init__(self, vocabulary: dict) -> None:
        self.bytes_of: dict[int, bytes] = dict(vocabulary["tokens"])
        self.id_of = {t: i for i, t in self.bytes_of.items()}
        self.rank = {m: r for r, m in enumerate(vocabulary["merges"])}
        self.special = vocabulary["special"]
        newer = "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in NEWER.split())
        old = PATTERN.replace(r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|[{newer}])+").replace(r"?\p{L}+", rf"?[^\P{{L}}{newer}]+").replace(r"?\p{N}+", rf"?[^\P{{N}}{newer}]+")
        self.usual, self.careful = regex.compile(PATTERN), regex.compile(old)
        self.newer = regex.compile(f"[{newer}]").search
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # A token that merging its own bytes doesn't give back can never be emitted.
        self.automaton = SuffixAutomaton((t, i) for t, i in self.id_of.items() if len(t) == 1 or self._merged(t) == [t])
        self.pairs: dict[int, bool] = {}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.pieces: dict[str, bytes] = {}

    def _merged(self, text: bytes) -> list[bytes]:
        """Plain merging by rank; for short strings only."""
        parts = [text[i : i + 1] for i in range(len(text))]
        rank, none = self.rank, len(self.rank)
        while len(parts) > 1:
            best, at = none, -1
            for k in range(len(parts) - 1):
                r = rank.get((parts[k], parts[k + 1]), none)
                if r < best:
                    best, at = r, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= 2 * REMEMBER:
                self.pairs.clear()
            a, b = self.bytes_of[left], self.bytes_of[right]
            found = self.pairs[key] = self._merged(a + b) == [a, b]
        return found

    def solve(self, piece: bytes) -> list[int]:
        """Ids of one piece: the last token of every prefix, then the back-pointers."""
        n = len(piece)
        last, size = [0] * (n + 1), [0] * (n + 1)
        known = self.pairs.get
        for end, matched, candidates in self.automaton.iter(piece):
            for length, token in candidates:
                if length > matched:
                    continue
                start = end - length
                if start:
                    if not size[start]:
                        continue
                    fits = known(last[start] << 32 | token)
                    if not (self.compatible(last[start], token) if fits is None else fits):
                        continue
                last[end], size[end] = token, length
                break
        out = []
        at = n
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; strings of special tokens become their ids."""
        if self.at_special is None:
            return self._plain(text)
        out = []
        for k, part in enumerate(self.at_special.split(text)):
            out.append(self._plain(part) if k % 2 == 0 else np.uint32(self.special[part]).tobytes())
        return b"".join(out)

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = np.array(self.solve(piece.encode()), "<u4").tobytes()
            if len(piece) <= LONGEST:
                if len(self.pieces) >= REMEMBER:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def _join(self, pieces: list[str]) -> bytes:
        found = list(map(self.pieces.get, pieces))
        if None in found:
            found = [self._piece(p) if f is None else f for p, f in zip(pieces, found, strict=True)]
        return b"".join(found)

    def _plain(self, text: str) -> bytes:
        pattern = self.usual
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.newer(text):
                pattern = self.careful
        if len(text) < 2_000_000:
            return self._join(pattern.findall(text))
        out, walk = [], pattern.finditer(text)
        while part := [m.group() for m in islice(walk, 200_000)]:
            out.append(self._join(part))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_codecs: dict = {}


def _codec(broadcast) -> Codec:
    """One codec a worker and vocabulary."""
    value = broadcast.value
    if id(value) not in _codecs:
        _codecs.clear()
        _codecs[id(value)] = (value, Codec(value))
    return _codecs[id(value)][1]


def _per_text(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, fields, work) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    picked = spread(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, t) for n, t, _ in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in batches:
            rows = [work(codec, x or "") for x in b.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, (_, _, t) in zip(cols, fields, strict=True))], ["doc_id", *(n for n, _, _ in fields)])

    return materialize(picked.mapInArrow(run, schema), "codes")


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (array of int) for every row; a null text is empty and has no ids.

    Rows are independent: repeated rows and ids each get their row, null ids are carried through, other
    columns are not read.
    """

    def work(codec: Codec, text: str):
        ids = np.frombuffer(codec.encode(text), "<u4")
        return len(ids), ids.astype(np.int32)

    return _per_text(docs, id_col, text_col, vocabulary, (("n_tokens", T.LongType(), pa.int64()), ("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))), work)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column text in place of its ids; null ids decode to the empty text."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary))
    at = encoded.columns.index(ids_col)
    fields = [T.StructField("text", T.StringType()) if k == at else f for k, f in enumerate(encoded.schema.fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in batches:
            texts = pa.array([codec.decode(np.array(x or [], np.int64)) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(b.columns)], [f.name for f in fields])

    return materialize(encoded.mapInArrow(run, T.StructType(fields)), "decoded")


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: what ``encode`` and then ``decode`` give, digested in one pass."""

    def work(codec: Codec, text: str):
        raw = codec.encode(text)
        back = codec.decode(np.frombuffer(raw, "<u4"))
        return len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    return _per_text(docs, id_col, text_col, vocabulary, (("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())), work)
