"""Exact integer arithmetic as Spark columns.

All columns are BIGINT: the session runs in ANSI mode, where narrow types would raise on overflow.
Rounding is half-to-even throughout ("rne").
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

I32_LOW, I32_HIGH = -(1 << 31), (1 << 31) - 1


def big(x: Column | int | str) -> Column:
    """A column or literal as BIGINT."""
    c = x if isinstance(x, Column) else F.lit(x) if isinstance(x, int) else F.col(x)
    return c.cast("bigint")


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low).cast("bigint"), F.least(F.lit(high).cast("bigint"), x))


def clamp_i8(x: Column) -> Column:
    """Clamp to the symmetric range -127..127."""
    return clamp(x, -127, 127)


def shift_right_rne(x: Column, shift: int | Column) -> Column:
    """x / 2**shift, rounded half to even. A shift of 32 or more gives 0, as 32-bit values have no bits left."""
    if isinstance(shift, int):
        if shift <= 0:
            return x
        if shift >= 32:
            return F.lit(0).cast("bigint")
    n = big(shift) if isinstance(shift, int) else shift.cast("int")
    n = n.cast("int")
    safe = F.greatest(F.lit(1), F.least(n, F.lit(31)))
    floor = F.call_function("shiftright", x, safe)
    unit = F.call_function("shiftleft", F.lit(1).cast("bigint"), safe)
    rest = x.bitwiseAND(unit - 1)
    half = F.call_function("shiftright", unit, F.lit(1))
    rounded = floor + F.when(rest > half, F.lit(1)).when(rest == half, floor.bitwiseAND(F.lit(1).cast("bigint"))).otherwise(F.lit(0))
    if isinstance(shift, int):
        return rounded
    return F.when(n <= 0, x).when(n >= 32, F.lit(0).cast("bigint")).otherwise(rounded)


def shift_right_rne_i32(x: Column, shift: int | Column) -> Column:
    """:func:`shift_right_rne` of a 64-bit value, clamped to 32 bits."""
    return clamp(shift_right_rne(x, shift), I32_LOW, I32_HIGH)


def divide_unsigned_rne(n: Column, d: Column) -> Column:
    """n / d for n, d >= 0, rounded half to even; 0 where d is 0."""
    safe = F.nullif(d, F.lit(0).cast("bigint"))
    q = F.call_function("div", n, safe)
    twice = (n % safe) * 2
    return F.coalesce(q + F.when(twice > d, F.lit(1)).when(twice == d, q.bitwiseAND(F.lit(1).cast("bigint"))).otherwise(F.lit(0)), F.lit(0).cast("bigint"))


def divide_rne(n: Column, d: Column) -> Column:
    """Signed n / d, rounded half to even; 0 where d is 0."""
    q = divide_unsigned_rne(F.abs(n), F.abs(d))
    return F.when((n < 0) != (d < 0), -q).otherwise(q)


def divide_rne_i32(n: Column, d: Column) -> Column:
    """:func:`divide_rne` clamped to 32 bits."""
    return clamp(divide_rne(n, d), I32_LOW, I32_HIGH)


def isqrt32(x: Column) -> Column:
    """Floor of the square root of an unsigned 32-bit value; a double has bits to spare for it."""
    return F.floor(F.sqrt(x.cast("double"))).cast("bigint")


def argmax_array(a: Column) -> Column:
    """Index of the greatest entry of an array, the lowest among ties; 0 for an empty array."""
    return F.coalesce(F.array_position(a, F.array_max(a)) - 1, F.lit(0).cast("bigint"))


def quantize_q07(x: Column, clip: float = 1.0) -> Column:
    """Double -> Q0.7: clip, scale by 128, round half to even, clamp."""
    return clamp_i8(F.rint(F.greatest(F.lit(-clip), F.least(F.lit(clip), x)) * 128).cast("bigint"))


def dequantize_q07(x: Column) -> Column:
    return x.cast("double") / F.lit(128.0)


def round_half_even(x: Column) -> Column:
    """Nearest integer of a double, as BIGINT, ties to even."""
    return F.rint(x).cast("bigint")


def requantize(x: Column, mult: int | Column, shift: int | Column) -> Column:
    """32-bit accumulator -> 8 bits: times mult, shifted with rounding, clamped; no shift where it is 0 or less."""
    product = x * big(mult)
    return clamp_i8(shift_right_rne_i32(product, shift))


def register_sql(spark: SparkSession) -> None:
    """SQL functions ``sra_rne(x, shift)``, ``udiv_rne(n, d)`` and ``isqrt32(x)``, as SQL expressions without Python."""
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION sra_rne(x BIGINT, s INT) RETURNS BIGINT RETURN
        CASE WHEN s <= 0 THEN x WHEN s >= 32 THEN 0 ELSE shiftright(x, s) +
          CASE WHEN (x & (shiftleft(1L, s) - 1)) > shiftleft(1L, s - 1) THEN 1
               WHEN (x & (shiftleft(1L, s) - 1)) = shiftleft(1L, s - 1) THEN shiftright(x, s) & 1 ELSE 0 END END"""
    )
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION udiv_rne(n BIGINT, d BIGINT) RETURNS BIGINT RETURN
        CASE WHEN d = 0 THEN 0 ELSE n div nullif(d, 0) + CASE WHEN 2 * (n % nullif(d, 0)) > d THEN 1
          WHEN 2 * (n % nullif(d, 0)) = d THEN (n div nullif(d, 0)) & 1 ELSE 0 END END"""
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION isqrt32(x BIGINT) RETURNS BIGINT RETURN CAST(floor(sqrt(CAST(x AS DOUBLE))) AS BIGINT)")
