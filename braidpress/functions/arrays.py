"""Integer layer operators over array columns (one row per vector); the auditable counterparts of the kernels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .integer import big, clamp, clamp_i8, divide_unsigned_rne, isqrt32, shift_right_rne, shift_right_rne_i32

Q_SHIFT = 2


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    """Exact dot product of two integer arrays."""
    return total(F.zip_with(a, b, lambda x, y: big(x) * big(y)))


def inverse_rms_q15(mean_sq: Column) -> Column:
    """1 / sqrt(mean square) in Q15, 1 to 32768."""
    root = isqrt32(F.greatest(mean_sq, F.lit(1).cast("bigint")) * F.lit(65536).cast("bigint"))
    return clamp(divide_unsigned_rne(F.lit(8388608).cast("bigint"), root), 1, 32768)


def mean_square(sum_sq: Column, d: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.call_function("div", sum_sq, d) + 1)


def rms_norm(x: Column, weight: Column) -> Column:
    """Normalised array, clamped to 8 bits."""
    inv = F.transform(F.array(inverse_rms_q15(mean_square(dot(x, x), F.size(x).cast("bigint")))), lambda v: v)
    return F.flatten(F.transform(inv, lambda r: F.zip_with(x, weight, lambda a, w: clamp_i8(shift_right_rne(big(a) * big(w) * r, 15)))))


def rms_norm_q14(x: Column, weight: Column) -> Column:
    """The variant for Q1.14 weights: rounded mean, and rounding after each of two shifts."""
    d = F.size(x).cast("bigint")
    ms = F.greatest(F.lit(1).cast("bigint"), F.call_function("div", dot(x, x) + F.call_function("div", d, F.lit(2).cast("bigint")), d) + 1)
    return F.flatten(F.transform(F.array(inverse_rms_q15(ms)), lambda r: F.zip_with(x, weight, lambda a, w: clamp_i8(shift_right_rne(shift_right_rne(big(a) * r, 15) * big(w), 14)))))


def reglu(gate: Column, value: Column) -> Column:
    """Rectified gate times value, in Q0.7."""
    return F.zip_with(gate, value, lambda g, v: clamp_i8(shift_right_rne(F.greatest(big(g), F.lit(0).cast("bigint")) * big(v), 7)))


def rope_keys(x: Column, cos: Column, sin: Column) -> Column:
    """Rotation of a 64-entry array: entry i pairs with i + 32."""
    low, high = F.slice(x, 1, 32), F.slice(x, 33, 32)
    zipped = F.arrays_zip(low.alias("x"), high.alias("y"), cos.alias("c"), sin.alias("s"))
    first = F.transform(zipped, lambda z: clamp_i8(shift_right_rne(big(z.x) * big(z.c) - big(z.y) * big(z.s), 15)))
    second = F.transform(zipped, lambda z: clamp_i8(shift_right_rne(big(z.x) * big(z.s) + big(z.y) * big(z.c), 15)))
    return F.concat(first, second)


def rope_queries(x: Column, cos: Column, sin: Column) -> Column:
    """Rotation of a query: the key rotation before its clamp, rounded once more by one bit, then clamped."""
    low, high = F.slice(x, 1, 32), F.slice(x, 33, 32)
    zipped = F.arrays_zip(low.alias("x"), high.alias("y"), cos.alias("c"), sin.alias("s"))
    first = F.transform(zipped, lambda z: clamp_i8(shift_right_rne(shift_right_rne(big(z.x) * big(z.c) - big(z.y) * big(z.s), 15), 1)))
    second = F.transform(zipped, lambda z: clamp_i8(shift_right_rne(shift_right_rne(big(z.x) * big(z.s) + big(z.y) * big(z.c), 15), 1)))
    return F.concat(first, second)


def attention_score(dots: Column, multiplier: Column | int) -> Column:
    """Scaled score of a query-key dot product."""
    return shift_right_rne_i32(shift_right_rne(dots, Q_SHIFT) * big(multiplier), 15)
