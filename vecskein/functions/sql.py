"""SQL names for the functions: built from SQL expressions where possible, so that Catalyst sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .quantized import _dequantizer, _distancer, _formatter, _maxsimmer, _parser, _quantizer

_DOT = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
_ARGS = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
_SAME = "CASE WHEN size(a) = size(b) THEN {} WHEN a IS NOT NULL AND b IS NOT NULL THEN CAST(raise_error('vectors of unequal dimensions') AS DOUBLE) END"
_NORM = "sqrt(aggregate({0}, 0D, (s, x) -> s + x * x))"
SCALARS = {
    "l2_distance": (_ARGS, "DOUBLE", _SAME.format("sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))")),
    "inner_product": (_ARGS, "DOUBLE", _SAME.format(_DOT)),
    "negative_inner_product": (_ARGS, "DOUBLE", _SAME.format(f"-{_DOT}")),
    "cosine_distance": (_ARGS, "DOUBLE", _SAME.format(f"1 - coalesce(try_divide({_DOT}, {_NORM.format('a')} * {_NORM.format('b')}), double('NaN'))")),
    "vector_norm": ("a ARRAY<DOUBLE>", "DOUBLE", _NORM.format("a")),
    "vector_dims": ("a ARRAY<DOUBLE>", "INT", "CASE WHEN a IS NOT NULL THEN size(a) END"),
    "l2_normalize": ("a ARRAY<DOUBLE>", "ARRAY<DOUBLE>", f"CASE WHEN {_NORM.format('a')} = 0 THEN a ELSE transform(a, x -> x / {_NORM.format('a')}) END"),
    "sphere": ("c ARRAY<DOUBLE>, r FLOAT", "STRUCT<center: ARRAY<DOUBLE>, radius: FLOAT>", "named_struct('center', c, 'radius', r)"),
    "maxsim": ("a ARRAY<ARRAY<DOUBLE>>, b ARRAY<ARRAY<DOUBLE>>", "DOUBLE", "aggregate(transform(filter(b, q -> q IS NOT NULL), q -> coalesce(array_min(transform(filter(a, d -> d IS NOT NULL), d -> -aggregate(zip_with(d, q, (x, y) -> x * y), 0D, (s, x) -> s + x))), double('Infinity'))), 0D, (s, x) -> s + x)"),
}


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to SQL in this session; their names."""
    for name, (args, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    made = list(SCALARS)
    for bits in (8, 4):
        for name, f in (
            (f"quantize_to_rabitq{bits}", _quantizer(bits)),
            (f"dequantize_rabitq{bits}_to_vector", _dequantizer(bits, False)),
            (f"dequantize_rabitq{bits}_to_halfvec", _dequantizer(bits, True)),
            (f"rabitq{bits}_l2_distance", _distancer("l2", bits)),
            (f"rabitq{bits}_negative_inner_product", _distancer("ip", bits)),
            (f"rabitq{bits}_cosine_distance", _distancer("cosine", bits)),
            (f"rabitq{bits}_maxsim", _maxsimmer(bits)),
            (f"rabitq{bits}_to_text", _formatter(bits)),
            (f"rabitq{bits}_from_text", _parser(bits)),
        ):
            spark.udf.register(name, f)
            made.append(name)
    return made
