"""RaBitQ codes: 8- and 4-bit vectors as values, and the 1-bit codes with error bounds of the indexes.

A quantised vector is a struct: dim, sum_of_x2, norm_of_lattice, sum_of_code, sum_of_abs_x and the packed code
(a byte per component, or two components a byte, low half first). Codes live in rotated space. The numeric work is numpy on
matrices; the columns are pandas UDFs around it, batch by batch.
"""

from __future__ import annotations

import re
import struct
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rotation import rotate, unrotate

KIND = "struct<dim:int,sum_of_x2:float,norm_of_lattice:float,sum_of_code:float,sum_of_abs_x:float,code:binary>"
FIELDS = ("dim", "sum_of_x2", "norm_of_lattice", "sum_of_code", "sum_of_abs_x", "code")
EPSILON = 1.9


def check_dim(dim: int, most: int = 65535) -> int:
    """Bounds of a declared dimension."""
    if dim < 1:
        raise ValueError("a vector has at least 1 dimension")
    if dim > most:
        raise ValueError(f"a vector has at most {most} dimensions")
    return dim


def pack(codes: np.ndarray, bits: int) -> list[bytes]:
    if bits == 8:
        return [r.tobytes() for r in codes.astype(np.uint8)]
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return [r.tobytes() for r in (codes[:, 0::2] | (codes[:, 1::2] << 4)).astype(np.uint8)]


def unpack(code: bytes, dim: int, bits: int) -> np.ndarray:
    raw = np.frombuffer(code, np.uint8)
    if bits == 8:
        return raw[:dim]
    return np.stack([raw & 15, raw >> 4], 1).reshape(-1)[:dim]


def best_scale(o: np.ndarray, bits: int) -> float:
    """The scale at which the lattice point lies closest in angle to ``o`` (absolute values).

    Between two scales where a component steps up, the point stays; so only those are tried.
    """
    o = np.asarray(o, np.float64)
    top = (1 << (bits - 1)) - 1
    steps = np.repeat(np.arange(1, top + 1), len(o))
    who = np.tile(np.arange(len(o)), top)
    with np.errstate(divide="ignore"):
        at = steps / o[who]
    order = np.argsort(at, kind="stable")
    top_sum = np.concatenate(([0.5 * o.sum()], 0.5 * o.sum() + np.cumsum(o[who[order]])))
    squares = np.concatenate(([0.25 * len(o)], 0.25 * len(o) + np.cumsum(2.0 * steps[order])))
    value = top_sum / np.sqrt(squares)
    k = int(np.argmax(value))
    return float((0.0 if k == 0 else at[order[k - 1]]) + np.finfo(np.float32).eps)


def encode(x: np.ndarray, bits: int, rotated: bool = False, exact_scale: bool = False) -> list[dict]:
    """Codes of the rows of ``x``; ``exact_scale`` searches the best scale instead of filling the range."""
    x = np.array(x, np.float64, ndmin=2)
    if not rotated:
        x = rotate(x)
    half = 1 << (bits - 1)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.nan_to_num(x / length)
        scale = np.array([[best_scale(np.abs(r), bits)] for r in u]) if exact_scale else half / np.abs(u).max(axis=1, keepdims=True, initial=0)
        code = np.clip(np.floor(np.nan_to_num(scale * u)), -half, half - 1) + half
    centre = ((1 << bits) - 1) / 2
    lattice = np.linalg.norm(code - centre, axis=1)
    packed = pack(code.astype(np.int64), bits)
    f = lambda v: float(np.float32(v))
    return [dict(zip(FIELDS, (x.shape[1], f(length[i, 0] ** 2), f(lattice[i]), f(code[i].sum()), f(np.abs(x[i]).sum()), packed[i]), strict=True)) for i in range(len(x))]


def decode_rotated(q: dict, bits: int) -> np.ndarray:
    code = unpack(q["code"], q["dim"], bits).astype(np.float64)
    return (code - ((1 << bits) - 1) / 2) * (np.sqrt(q["sum_of_x2"]) / q["norm_of_lattice"])


def decode(q: dict, bits: int) -> np.ndarray:
    return unrotate(decode_rotated(q, bits))[0].astype(np.float32)


def distance(metric: str, a: dict, b: dict, bits: int) -> float:
    """l2, ip (negative inner product) or cosine (1 - cos) between codes."""
    if a["dim"] != b["dim"]:
        raise ValueError("vectors of unequal dimensions")
    c, dim = ((1 << bits) - 1) / 2, a["dim"]
    total = int(unpack(a["code"], dim, bits).astype(np.int64) @ unpack(b["code"], dim, bits).astype(np.int64))
    ip = total - c * (a["sum_of_code"] + b["sum_of_code"]) + dim * c * c
    cos = ip / a["norm_of_lattice"] / b["norm_of_lattice"]
    if metric == "cosine":
        return 1.0 - cos
    dot = cos * np.sqrt(a["sum_of_x2"]) * np.sqrt(b["sum_of_x2"])
    if metric == "ip":
        return -dot
    return float(np.sqrt(max(0.0, a["sum_of_x2"] + b["sum_of_x2"] - 2 * dot)))


def unpack_all(codes: list[bytes], dim: int, bits: int) -> np.ndarray:
    """The components of codes of one dimension, as a matrix."""
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    if bits == 8:
        return raw[:, :dim]
    return np.stack([raw & 15, raw >> 4], 2).reshape(len(codes), -1)[:, :dim]


def _shaped(metric: str, ip: np.ndarray, a, b) -> np.ndarray:
    """Distances from centred inner products of lattice points; a, b: (norm of lattice point, squared norm) of the sides."""
    cos = ip / a[0] / b[0]
    if metric == "cosine":
        return 1.0 - cos
    dot = cos * np.sqrt(a[1]) * np.sqrt(b[1])
    return -dot if metric == "ip" else np.sqrt(np.maximum(0.0, a[1] + b[1] - 2 * dot))


def distances(metric: str, a: pd.DataFrame, b: pd.DataFrame, bits: int) -> np.ndarray:
    """``distance`` of the rows of two frames of codes, a matrix at a time; NaN where a code is null."""
    out = np.full(len(a), np.nan)
    ok = np.flatnonzero(a["code"].notna().to_numpy() & b["code"].notna().to_numpy())
    if (a["dim"].iloc[ok].to_numpy(np.int64) != b["dim"].iloc[ok].to_numpy(np.int64)).any():
        raise ValueError("vectors of unequal dimensions")
    centre = ((1 << bits) - 1) / 2
    dims = a["dim"].iloc[ok].to_numpy(np.int64)
    for dim in np.unique(dims).tolist():
        at = ok[dims == dim]
        x, y = (unpack_all(t["code"].iloc[at].map(bytes).tolist(), dim, bits).astype(np.float64) - centre for t in (a, b))
        sides = [tuple(t[n].iloc[at].to_numpy(np.float64) for n in ("norm_of_lattice", "sum_of_x2")) for t in (a, b)]
        with np.errstate(divide="ignore", invalid="ignore"):
            out[at] = _shaped(metric, np.einsum("ij,ij->i", x, y), *sides)
    return out


def normalized(q: dict) -> dict:
    """The code of q / |q|: the lattice point is the same, only its measures change."""
    n = float(np.sqrt(q["sum_of_x2"]))
    return q | {"sum_of_x2": 1.0, "sum_of_abs_x": q["sum_of_abs_x"] / n} if n else q


def maxsim(documents: list, queries: list, bits: int) -> float:
    """Late interaction on codes: one matrix product of all document codes and all query codes."""
    docs, asked = ([q for q in side if q is not None] for side in (documents, queries))
    if not asked:
        return 0.0
    if not docs:
        return float("inf")
    dim = asked[0]["dim"]
    if any(q["dim"] != dim for q in (*docs, *asked)):
        raise ValueError("vectors of unequal dimensions")
    centre = ((1 << bits) - 1) / 2
    (x, xs), (y, ys) = ((unpack_all([bytes(q["code"]) for q in side], dim, bits).astype(np.float64) - centre, [np.array([q[n] for q in side]) for n in ("norm_of_lattice", "sum_of_x2")]) for side in (docs, asked))
    far = _shaped("ip", x @ y.T, [v[:, None] for v in xs], [v[None, :] for v in ys])
    return float(far.min(axis=0).sum())


# Text and binary forms.


def to_text(q: dict, bits: int) -> str:
    n = lambda v: np.format_float_positional(np.float32(v), trim="-")
    return f"({', '.join(n(q[f]) for f in FIELDS[1:5])})[{', '.join(map(str, unpack(q['code'], q['dim'], bits).tolist()))}]"


def from_text(text: str, bits: int) -> dict:
    m = re.fullmatch(r" *\(([^()]*)\) *\[([^\[\]]*)\] *", text)
    if not m:
        raise ValueError("incorrect vector")
    try:
        head = [float(np.float32(x)) for x in m[1].replace(" ", "").split(",")]
        code = [int(x) for x in m[2].replace(" ", "").split(",")] if m[2].strip() else []
    except ValueError:
        raise ValueError("incorrect vector") from None
    if len(head) != 4:
        raise ValueError("incorrect vector")
    check_dim(len(code))
    if not all(0 <= c < 1 << bits for c in code):
        raise ValueError("incorrect vector")
    return dict(zip(FIELDS, (len(code), *head, pack(np.array([code]), bits)[0]), strict=True))


def to_bytes(q: dict) -> bytes:
    """Big-endian: dimension, the four measures, the code."""
    return struct.pack(">I4f", q["dim"], *(q[f] for f in FIELDS[1:5])) + q["code"]


def from_bytes(raw: bytes, bits: int) -> dict:
    dim, *head = struct.unpack_from(">I4f", raw)
    code = raw[20:]
    if len(code) != (dim if bits == 8 else -(-dim // 2)) or not 1 <= dim <= 65535 or (bits == 4 and dim % 2 and code[-1] >> 4):
        raise ValueError("damaged vector")
    return dict(zip(FIELDS, (dim, *head, code), strict=True))


# Columns.


def _plain(v):
    if v is None:
        return None
    d = v if isinstance(v, dict) else v.asDict()
    return d | {"code": bytes(d["code"])}


@cache
def _quantizer(bits: int):
    @F.pandas_udf(KIND)
    def quantize(v: pd.Series) -> pd.DataFrame:
        rows: list = [None] * len(v)
        by_dim: dict[int, list[int]] = {}
        for i, x in enumerate(v):
            if x is not None:
                by_dim.setdefault(len(x), []).append(i)
        for dim, at in by_dim.items():
            check_dim(dim)
            for i, q in zip(at, encode(np.stack([np.asarray(v.iloc[i], np.float64) for i in at]), bits), strict=True):
                rows[i] = q
        return pd.DataFrame([q or dict.fromkeys(FIELDS) for q in rows], columns=list(FIELDS)).astype({"dim": "Int32"})

    return quantize


def quantize(v: Column, bits: int = 8) -> Column:
    """The 8- or 4-bit code of a dense vector; null stays null."""
    if bits not in (4, 8):
        raise ValueError("bits is 4 or 8")
    return F.when(v.isNotNull(), _quantizer(bits)(v))


@cache
def _dequantizer(bits: int, half: bool):
    @F.pandas_udf("array<float>")
    def dequantize(q: pd.DataFrame) -> pd.Series:
        out: list = [None] * len(q)
        ok = np.flatnonzero(q["code"].notna().to_numpy())
        dims = q["dim"].iloc[ok].to_numpy(np.int64)
        for dim in np.unique(dims).tolist():
            at = ok[dims == dim]
            norm, lattice = (q[n].iloc[at].to_numpy(np.float64) for n in ("sum_of_x2", "norm_of_lattice"))
            x = unpack_all(q["code"].iloc[at].map(bytes).tolist(), dim, bits).astype(np.float64) - ((1 << bits) - 1) / 2
            x = unrotate(x * (np.sqrt(norm) / lattice)[:, None]).astype(np.float32)
            if half:
                x = x.astype(np.float16).astype(np.float32)
            for i, row in zip(at.tolist(), x, strict=True):
                out[i] = row
        return pd.Series(out)

    return dequantize


def dequantize(q: Column, bits: int = 8, half: bool = False) -> Column:
    """The dense vector near a code, in single or half precision."""
    return F.when(q.isNotNull(), _dequantizer(bits, half)(q))


@cache
def _distancer(metric: str, bits: int):
    @F.pandas_udf("double")
    def measure(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        return pd.Series(distances(metric, a, b, bits)).where(a["code"].notna() & b["code"].notna())

    return measure


def quantized_distance(metric: str, a: Column, b: Column, bits: int = 8) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), _distancer(metric, bits)(a, b))


def error_bound(metric: str, v: Column, query: list[float], bits: int = 8) -> Column:
    """How much the distance of the code ``v``, as ``quantize`` makes it, to the code of ``query`` differs from that of their vectors at most.

    A scaled component lies within a half of its lattice point's, so the angle of a vector to its point has at most the sine
    sqrt(dim) / 2 over the point's norm; the query's own error is known. NaN where lengths are beyond single precision.
    """
    q = np.array(query, np.float64)
    length = float(np.linalg.norm(q))
    own = float(np.linalg.norm(rotate(q)[0] - decode_rotated(encode(q, bits)[0], bits))) if length else 0.0
    x = F.when(v["sum_of_x2"].between(1e-30, 1e38), F.sqrt(v["sum_of_x2"].cast("double"))).when(v["sum_of_x2"] == 0, 0.0).otherwise(float("nan"))
    sine = F.least(F.sqrt(v["dim"].cast("double")) / 2 / v["norm_of_lattice"], F.lit(1.0))
    turn, slack = F.sqrt(2 - 2 * F.sqrt(1 - sine * sine)) + 1e-6, 1e-6
    if metric == "l2":
        return x * turn + F.lit(own + slack * length)
    if metric == "ip":
        return x * (turn * length + own + slack * length)
    return turn + (own / length if length else float("nan")) + slack


def quantized_within(metric: str, v: Column, ball: Column, bits: int = 8) -> Column:
    """Sphere predicate on codes, strict; a sphere without centre or radius is an error."""
    gap = F.when(ball["center"].isNull(), F.raise_error(F.lit("a sphere needs a center")).cast("double")).when(ball["radius"].isNull(), F.raise_error(F.lit("a sphere needs a radius")).cast("double")).otherwise(quantized_distance(metric, v, ball["center"], bits))
    return F.when(ball.isNotNull() & v.isNotNull(), gap < ball["radius"])


@cache
def _maxsimmer(bits: int):
    @F.pandas_udf("double")
    def measure(docs: pd.Series, queries: pd.Series) -> pd.Series:
        return pd.Series([None if d is None or q is None else maxsim([_plain(x) for x in d], [_plain(x) for x in q], bits) for d, q in zip(docs, queries, strict=True)], dtype="float64")

    return measure


def quantized_maxsim(documents: Column, queries: Column, bits: int = 8) -> Column:
    return _maxsimmer(bits)(documents, queries)


@cache
def _formatter(bits: int):
    @F.pandas_udf("string")
    def fmt(q: pd.DataFrame) -> pd.Series:
        return pd.Series([None if r["code"] is None else to_text(r | {"dim": int(r["dim"])}, bits) for r in q.to_dict("records")])

    return fmt


def format_code(q: Column, bits: int = 8) -> Column:
    return F.when(q.isNotNull(), _formatter(bits)(q))


@cache
def _parser(bits: int):
    @F.pandas_udf(KIND)
    def parse(t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dict.fromkeys(FIELDS) if x is None else from_text(x, bits) for x in t], columns=list(FIELDS)).astype({"dim": "Int32"})

    return parse


def parse_code(text: Column, bits: int = 8) -> Column:
    return F.when(text.isNotNull(), _parser(bits)(text))


@cache
def _sender(bits: int):
    @F.pandas_udf("binary")
    def send(q: pd.DataFrame) -> pd.Series:
        return pd.Series([None if r["code"] is None else to_bytes(r | {"dim": int(r["dim"])}) for r in q.to_dict("records")])

    return send


def send_code(q: Column, bits: int = 8) -> Column:
    return F.when(q.isNotNull(), _sender(bits)(q))


@cache
def _receiver(bits: int):
    @F.pandas_udf(KIND)
    def receive(b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dict.fromkeys(FIELDS) if x is None else from_bytes(bytes(x), bits) for x in b], columns=list(FIELDS)).astype({"dim": "Int32"})

    return receive


def receive_code(raw: Column, bits: int = 8) -> Column:
    return F.when(raw.isNotNull(), _receiver(bits)(raw))


# One-bit codes with bounds.


def bit_codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signs as +-1, measures) of rotated rows; measures: squared norm, sum of signs, ip factor, error factor."""
    n = x.shape[1]
    sign = np.where(np.signbit(x), -1.0, 1.0)
    square, total = (x * x).sum(axis=1), np.abs(x).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        norm = np.sqrt(square)
        x0 = total / norm / np.sqrt(n)
        err = norm * np.sqrt(np.maximum(0, 1 / (x0 * x0) - 1)) / np.sqrt(max(n - 1, 1))
        measures = np.stack([square, sign.sum(axis=1), square / total, err], 1)
    return sign, np.nan_to_num(measures)


def residual_delta(metric: str, residual: np.ndarray, centroid: np.ndarray, sign: np.ndarray, factor_ip: np.ndarray) -> np.ndarray:
    """What the estimate of a residual code needs on top: 2 r.c for l2, r.c corrected for the estimate for ip."""
    estimate = (sign * centroid).sum(axis=1) * factor_ip
    return 2.0 * estimate if metric == "l2" else estimate - (residual * centroid).sum(axis=1)


def estimate(metric: str, q: np.ndarray, sign: np.ndarray, measures: np.ndarray, centroid: np.ndarray | None = None, delta: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rough, err) of squared l2 or negative ip between one rotated query and coded rows.

    The true value lies above rough - epsilon * err with a probability that grows with epsilon. With a centroid the
    codes are of residuals.
    """
    dot = (sign @ q) * measures[:, 2]
    qq = float(q @ q)
    if centroid is None:
        if metric == "l2":
            return measures[:, 0] + qq - 2 * dot, 2 * measures[:, 3] * np.sqrt(qq)
        return -dot, measures[:, 3] * np.sqrt(qq)
    if metric == "l2":
        far = float(((q - centroid) ** 2).sum())
        return measures[:, 0] + far - 2 * dot + delta, 2 * measures[:, 3] * np.sqrt(far)
    far = -float(q @ centroid)
    return -dot + far + delta, measures[:, 3] * np.sqrt(max(0.0, qq + float(centroid @ centroid) + 2 * far))
