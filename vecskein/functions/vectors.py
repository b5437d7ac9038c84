"""Vector functions as Spark columns.

Vectors are ``array<float>`` or ``array<double>``; all arithmetic is in doubles. Every function is null where
an argument is null. Unequal dimensions raise, as they are an error of the query, not a value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DIM = 65535
MAX_SPARSE_DIM = 1_048_575


def vector(values) -> Column:
    """A constant vector; one literal, so that Catalyst folds it."""
    return F.array(*[F.lit(float(v)) for v in values])


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def checked(a: Column, b: Column, value: Column) -> Column:
    """``value`` where the dimensions agree; else an error."""
    return F.when(F.size(a) == F.size(b), value).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors of unequal dimensions")).cast("double"))


def _fold(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), term), F.lit(0.0), lambda acc, x: acc + x)


def l2_squared(a: Column, b: Column) -> Column:
    return checked(a, b, _fold(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def inner_product(a: Column, b: Column) -> Column:
    return checked(a, b, _fold(a, b, lambda x, y: x * y))


def negative_inner_product(a: Column, b: Column) -> Column:
    return -inner_product(a, b)


def squared_norm(v: Column) -> Column:
    return F.aggregate(_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x)


def norm(v: Column) -> Column:
    return F.sqrt(squared_norm(v))


def dim(v: Column) -> Column:
    return F.when(v.isNotNull(), F.size(v))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; NaN where a vector is zero."""
    length = F.sqrt(squared_norm(a) * squared_norm(b))
    return F.lit(1.0) - F.when(length == 0, F.lit(float("nan"))).otherwise(F.try_divide(inner_product(a, b), length))


DISTANCES = {"l2": l2, "ip": negative_inner_product, "cosine": cosine_distance}


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric not in DISTANCES:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(DISTANCES)}")
    return DISTANCES[metric](a, b)


def sphere(center: Column, radius: Column) -> Column:
    """(center, radius), the right side of a sphere predicate."""
    return F.struct(center.alias("center"), radius.cast("float").alias("radius"))


def within(metric: str, v: Column, ball: Column) -> Column:
    """distance(v, center) < radius, strictly; a sphere without centre or radius is an error."""
    center, radius = ball["center"], ball["radius"].cast("double")
    gap = F.when(center.isNull(), F.raise_error(F.lit("a sphere needs a center")).cast("double")).when(radius.isNull(), F.raise_error(F.lit("a sphere needs a radius")).cast("double")).otherwise(distance(metric, v, center))
    return F.when(ball.isNotNull(), gap < radius)


def within_l2(v: Column, ball: Column) -> Column:
    return within("l2", v, ball)


def within_ip(v: Column, ball: Column) -> Column:
    return within("ip", v, ball)


def within_cosine(v: Column, ball: Column) -> Column:
    return within("cosine", v, ball)


def maxsim(documents: Column, queries: Column) -> Column:
    """Late interaction: over the query vectors, the sum of the least negative inner product with a document vector.

    Lower is better. No query vectors give 0, no document vectors infinity; null elements are skipped.
    """
    docs = F.filter(documents, lambda d: d.isNotNull())
    asked = F.filter(queries, lambda q: q.isNotNull())
    best = lambda q: F.coalesce(F.array_min(F.transform(docs, lambda d: -inner_product(d, q))), F.lit(float("inf")))
    return F.aggregate(F.transform(asked, best), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(v: Column) -> Column:
    """v / |v|; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, _doubles(v)).otherwise(F.transform(_doubles(v), lambda x: x / n))


def _pairwise(a: Column, b: Column, term) -> Column:
    return F.when(F.size(a) == F.size(b), F.zip_with(_doubles(a), _doubles(b), term)).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors of unequal dimensions")).cast("array<double>"))


def add(a: Column, b: Column) -> Column:
    return _pairwise(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return _pairwise(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return _pairwise(a, b, lambda x, y: x * y)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the first component that differs; null for unequal dimensions, which have no order."""
    x, y = _doubles(a), _doubles(b)
    return F.when(F.size(a) == F.size(b), F.when(x < y, -1).when(x > y, 1).otherwise(0))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def to_half(v: pd.Series) -> pd.Series:
    """Components rounded to half precision (kept as floats, since Spark has no such type)."""
    with np.errstate(over="ignore"):
        return v.map(lambda x: None if x is None else np.asarray(x, np.float32).astype(np.float16).astype(np.float32))


@F.pandas_udf(T.BinaryType())
def half_bytes(v: pd.Series) -> pd.Series:
    """Two bytes a component, little-endian, for storage."""
    with np.errstate(over="ignore"):
        return v.map(lambda x: None if x is None else np.asarray(x, np.float32).astype("<f2").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_half_bytes(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None else np.frombuffer(x, "<f2").astype(np.float32))


def as_text(v: Column) -> Column:
    """[0.5,0.25,1]: shortest digits, whole numbers without a point."""
    return F.when(v.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")), ","), F.lit("]")))


def from_text(text: Column) -> Column:
    """The vector of such a text; an error where it isn't one."""
    inner = F.regexp_extract(text, r"^\s*\[(.*)\]\s*$", 1)
    return F.when(F.length(inner) > 0, F.transform(F.split(inner, ","), lambda x: F.trim(x).cast("float"))).when(text.isNotNull(), F.raise_error(F.lit("incorrect vector text")).cast("array<float>"))


# Sparse vectors: struct<dim int, indexes array<int>, values array<float>>, indexes ascending from 0, no zero values.


def sparse(dimension: Column, indexes: Column, values: Column) -> Column:
    """A checked sparse vector."""
    n = F.size(indexes)
    rising = F.forall(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i >= n) | (F.get(indexes, i - 1) < F.get(indexes, i)))
    inside = (n == 0) | ((F.get(indexes, F.lit(0)) >= 0) & (F.get(indexes, n - 1) < dimension))
    ok = dimension.between(1, MAX_SPARSE_DIM) & (n == F.size(values)) & rising & inside & ~F.exists(values, lambda x: x == 0)
    built = F.struct(dimension.cast("int").alias("dim"), indexes.cast("array<int>").alias("indexes"), values.cast("array<double>").alias("values"))
    return F.when(ok, built).otherwise(F.raise_error(F.lit("incorrect sparse vector")).cast("struct<dim:int,indexes:array<int>,values:array<double>>"))


def _as_map(s: Column) -> Column:
    return F.map_from_arrays(s["indexes"], s["values"])


def _sparse_checked(a: Column, b: Column, value: Column, kind: str = "double") -> Column:
    return F.when(a["dim"] == b["dim"], value).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors of unequal dimensions")).cast(kind))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _zipped(a: Column, b: Column, term) -> Column:
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return F.map_zip_with(_as_map(a), _as_map(b), lambda k, x, y: term(zero(x), zero(y)))


def sparse_dot(a: Column, b: Column) -> Column:
    return _sparse_checked(a, b, _sum(F.map_values(_zipped(a, b, lambda x, y: x * y))))


def sparse_l2_squared(a: Column, b: Column) -> Column:
    return _sparse_checked(a, b, _sum(F.map_values(_zipped(a, b, lambda x, y: (x - y) * (x - y)))))


def sparse_l2(a: Column, b: Column) -> Column:
    return F.sqrt(sparse_l2_squared(a, b))


def sparse_norm(a: Column) -> Column:
    return norm(a["values"])


def sparse_cosine_distance(a: Column, b: Column) -> Column:
    length = sparse_norm(a) * sparse_norm(b)
    return F.lit(1.0) - F.when(length == 0, F.lit(float("nan"))).otherwise(F.try_divide(sparse_dot(a, b), length))


def _sparse_from(a: Column, pairs: Column) -> Column:
    """Back from a map: ascending, without zeros."""
    rows = F.array_sort(F.filter(F.map_entries(pairs), lambda e: e["value"] != 0))
    return F.struct(a["dim"].alias("dim"), F.transform(rows, lambda e: e["key"]).alias("indexes"), F.transform(rows, lambda e: e["value"]).alias("values"))


def sparse_add(a: Column, b: Column) -> Column:
    return F.when(a["dim"] == b["dim"], _sparse_from(a, _zipped(a, b, lambda x, y: x + y)))


def sparse_subtract(a: Column, b: Column) -> Column:
    return F.when(a["dim"] == b["dim"], _sparse_from(a, _zipped(a, b, lambda x, y: x - y)))


def sparse_multiply(a: Column, b: Column) -> Column:
    return F.when(a["dim"] == b["dim"], _sparse_from(a, _zipped(a, b, lambda x, y: x * y)))


def sparse_normalize(a: Column) -> Column:
    n = sparse_norm(a)
    return F.when(n == 0, a).otherwise(F.struct(a["dim"].alias("dim"), a["indexes"].alias("indexes"), F.transform(a["values"], lambda x: x / n).alias("values")))


# Bit vectors: array<long>, 64 bits a word, the last word padded with zeros.


def _words(a: Column, b: Column, term) -> Column:
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, term)).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors of unequal dimensions")).cast("array<bigint>"))


def bit_and(a: Column, b: Column) -> Column:
    return _words(a, b, lambda x, y: x.bitwiseAND(y))


def bit_or(a: Column, b: Column) -> Column:
    return _words(a, b, lambda x, y: x.bitwiseOR(y))


def bit_xor(a: Column, b: Column) -> Column:
    return _words(a, b, lambda x, y: x.bitwiseXOR(y))


def _ones(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, x: acc + F.bit_count(x))


def bit_dot(a: Column, b: Column) -> Column:
    return _ones(bit_and(a, b))


def bit_hamming(a: Column, b: Column) -> Column:
    return _ones(bit_xor(a, b))


def bit_jaccard(a: Column, b: Column) -> Column:
    """1 - |and| / |or|; NaN for two zero vectors."""
    union = _ones(bit_or(a, b))
    return F.lit(1.0) - F.when(union == 0, F.lit(float("nan"))).otherwise(F.try_divide(_ones(bit_and(a, b)).cast("double"), union.cast("double")))

