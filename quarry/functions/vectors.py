"""Vector functions over array<float> columns (V2, V10): dot, norms, distances, sign bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is all zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def sign_words(v: Column, dim: int) -> Column:
    """One bit per entry (set if positive), packed into 32-bit words held as longs, first entry lowest."""
    words = []
    for start in range(0, dim, 32):
        part = F.slice(v, start + 1, min(32, dim - start))
        values = F.array(*[F.lit(1 << i).cast("long") for i in range(min(32, dim - start))])
        weighted = F.zip_with(part, values, lambda x, b: F.when(x > 0, b).otherwise(F.lit(0).cast("long")))
        words.append(F.aggregate(weighted, F.lit(0).cast("long"), lambda s, x: s + x))
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)
