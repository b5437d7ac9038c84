"""Quality classifier: a generalised additive model with pairwise interactions.

Features of form are computed from the text alone. Each is cut into bins at quantiles, and cyclic boosting
fits shallow trees to one feature after another, then to the pairs that still explain most, on the gradient of
the logistic loss. The trees add up to one lookup table per feature and one per pair, so a score is the sum of
a few table entries: vectorised bin searches and additions.

Training takes a bounded sample of labelled rows (``max_rows``), by a hash of the id; scoring is one pass over
all rows, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread, text_bytes

#: Labelled rows the model is fitted on, at most.
MAX_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 48, 12, 8
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.08
FEATURES = (
    "log_bytes", "log_words", "word_len", "long_words", "distinct", "top_word", "ratio", "symbols", "upper", "digits",
    "stops", "commas", "bangs", "bars", "other_marks", "high_bytes", "lines_per_word", "dup_lines", "line_len", "log_repeat", "caps_start", "ends_stop",
)
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"#*$%&<>^~@", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!", b"|", b";:?'\"()[]{}-_/\\=+`", bytes(range(128, 256))), 1):
    _CLASS[list(_chars)] = _k


def features(text: bytes, squeeze) -> list[float]:
    """A fixed number of finite values for any text, empty ones included."""
    words = text.split()
    n, m = max(1, len(text)), max(1, len(words))
    counts = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=10) / n
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    packed = len(squeeze(text)) if text else 1
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(map(len, seen)) / max(1, len(seen)), sum(len(w) > 15 for w in seen) / max(1, len(seen)),
        len(seen) / m, max(seen.values(), default=0) / m, n / packed, *counts[1:4],
        counts[4], counts[5], counts[6], counts[7], counts[8], counts[9], len(lines) / m, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        np.log1p(m / max(1, len(seen))) , sum(w[:1].isupper() for w in seen) / max(1, len(seen)), float(text.rstrip()[-1:] in (b".", b"!", b"?")),
    ]


class Model:
    """Lookup tables: ``score`` is the logistic of their sum."""

    def __init__(self, intercept: float, cuts: list[np.ndarray], tables: list[np.ndarray], pair_cuts: list[np.ndarray], pairs: dict[tuple[int, int], np.ndarray]) -> None:
        self.intercept, self.cuts, self.tables, self.pair_cuts, self.pairs = intercept, cuts, tables, pair_cuts, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += table[np.searchsorted(cut, x[:, j], "right")]
        for (i, j), table in self.pairs.items():
            out += table[np.searchsorted(self.pair_cuts[i], x[:, i], "right"), np.searchsorted(self.pair_cuts[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Bin edges at quantiles of the distinct values, so that one common value doesn't use up the bins."""
    values = np.unique(column)
    if len(values) < 2:
        return np.zeros(0)
    q = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))
    return q[(q > values[0])]


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int = 3, ridge: float = 1.0) -> np.ndarray:
    """Values per bin of a shallow regression tree on bin sums: the best cut, then the best cut of a side."""
    value = lambda a, b: grad[a:b].sum() / (hess[a:b].sum() + ridge)
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            g, h = np.cumsum(grad[a:b]), np.cumsum(hess[a:b])
            if b - a < 2:
                continue
            left, right = g[:-1] ** 2 / (h[:-1] + ridge), (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge)
            gain = left + right - g[-1] ** 2 / (h[-1] + ridge)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (a, b), a + k + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = value(a, b)
    return out


def _cross(grad: np.ndarray, hess: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut on either axis, on the sums of a two-way table."""
    g, h = (np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for t in (grad, hess))
    i, j = np.arange(1, grad.shape[0])[:, None], np.arange(1, grad.shape[1])[None, :]
    if not i.size or not j.size:
        return 0.0, np.zeros_like(grad)
    quads = lambda t: (t[i, j], t[i, -1:].reshape(-1, 1) - t[i, j], t[-1:, j].reshape(1, -1) - t[i, j], t[-1, -1] - t[i, -1:].reshape(-1, 1) - t[-1:, j].reshape(1, -1) + t[i, j])
    gain = sum(a**2 / (b + ridge) for a, b in zip(quads(g), quads(h), strict=True)) - g[-1, -1] ** 2 / (h[-1, -1] + ridge)
    a, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros_like(grad)
    for s, t in ((slice(0, a + 1), slice(0, b + 1)), (slice(0, a + 1), slice(b + 1, None)), (slice(a + 1, None), slice(0, b + 1)), (slice(a + 1, None), slice(b + 1, None))):
        out[s, t] = grad[s, t].sum() / (hess[s, t].sum() + ridge)
    return float(gain[a, b]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS, rate: float = RATE) -> Model:
    """Cyclic boosting. No rows, or one class only, give a constant model."""
    d = x.shape[1]
    cuts, small = [_cuts(x[:, j], BINS) if len(x) else np.zeros(0) for j in range(d)], [_cuts(x[:, j], PAIR_BINS) if len(x) else np.zeros(0) for j in range(d)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    p = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(p / (1 - p)))
    if not len(x) or y.min() == y.max():
        return Model(base, cuts, tables, small, {})
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    total = np.full(len(x), base)
    step = lambda: (lambda q: (y - q, q * (1 - q)))(1 / (1 + np.exp(-total)))
    for _ in range(rounds):
        for j in range(d):
            if not len(cuts[j]):
                continue
            g, h = step()
            add = rate * _tree(np.bincount(bins[j], g, len(tables[j])), np.bincount(bins[j], h, len(tables[j])))
            tables[j] += add
            total += add[bins[j]]
    wide = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(small)]
    flat = lambda i, j: wide[i] * (len(small[j]) + 1) + wide[j]
    sums = lambda i, j, v: np.bincount(flat(i, j), v, (len(small[i]) + 1) * (len(small[j]) + 1)).reshape(len(small[i]) + 1, -1)
    g, h = step()
    ranked = sorted(((_cross(sums(i, j, g), sums(i, j, h))[0], i, j) for i, j in combinations(range(d), 2) if len(small[i]) and len(small[j])), reverse=True)[:pairs]
    crossed = {(i, j): np.zeros((len(small[i]) + 1, len(small[j]) + 1)) for _, i, j in ranked}
    for _ in range(pair_rounds):
        for (i, j), table in crossed.items():
            g, h = step()
            add = rate * _cross(sums(i, j, g), sums(i, j, h))[1]
            table += add
            total += add[wide[i], wide[j]]
    return Model(base, cuts, tables, small, crossed)


def held_out(ident: Column) -> Column:
    """True for the ids of the test fold; a null id is in the other."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _featured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the features of column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            x = np.array([features(t, squeeze) for t in text_bytes(b.column(b.num_columns - 1))], np.float64).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(x[:, j]) for j in range(len(FEATURES)))], [*keep, *FEATURES])

    kinds = ", ".join([f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} double" for c in FEATURES])
    return docs.select(*keep, "text").mapInArrow(run, kinds)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Model:
    """Fit on labelled rows outside the test fold; at most ``max_rows`` labels, by a hash of their ids.

    Rows without an id or label, and labels without a document, count for nothing.
    """
    ident = labels[id_col].cast("long")
    chosen = labels.where(ident.isNotNull() & labels[label].isNotNull() & ~held_out(ident)).select(ident.alias("doc_id"), labels[label].cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    # the sample's size is bounded by max_rows, so it may be broadcast and its features gathered
    rows = materialize(_featured(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text"), ["doc_id", "y"]), "features").toPandas()
    rows = rows.sort_values(["doc_id", "y", *FEATURES], kind="stable")
    return fit(rows[list(FEATURES)].to_numpy(np.float64), rows["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    A null text is empty, and empty texts get a score like any other. Repeated rows each get one.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    ident = docs[id_col].cast("long")
    picked = spread(docs.select(ident.alias("doc_id"), held_out(ident).alias("held_out"), docs[text_col].cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            x = np.array([features(t, squeeze) for t in text_bytes(b.column(2))], np.float64).reshape(b.num_rows, len(FEATURES))
            s = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return materialize(picked.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int"), "scores")
