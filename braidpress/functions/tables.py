"""Lookup tables and the fixed-point exponentials that read them."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .integer import clamp

EXP2_SIZE = 256
HALF_DIM = 32
MAX_POSITIONS = 4096
#: log2(e) scaled to 24 bits, for the softmax over logits and for attention scores.
SOFTMAX_COEF, ATTENTION_COEF = 37819, 378194


def exp2_table(spark: SparkSession) -> DataFrame:
    """i, v: 2**(-i / 256) in Q16."""
    v = F.rint(F.pow(F.lit(2.0), -F.col("id") / 256.0) * 65536).cast("bigint")
    return spark.range(EXP2_SIZE).select(F.col("id").alias("i"), clamp(v, 1, 65535).alias("v"))


def rope_table(spark: SparkSession, positions: int = 64) -> DataFrame:
    """pos, i, cos, sin: rotary factors in Q1.15."""
    if not 0 < positions <= MAX_POSITIONS:
        raise ValueError(f"positions must be 1 to {MAX_POSITIONS}")
    pos, i = F.expr(f"id div {HALF_DIM}"), F.col("id") % HALF_DIM
    angle = F.col("pos") / F.pow(F.lit(10000.0), F.col("i") * 2.0 / (2 * HALF_DIM))

    def fixed(x: Column) -> Column:
        return clamp(F.rint(x * 32768).cast("bigint"), -32768, 32767)

    grid = spark.range(positions * HALF_DIM).select(pos.alias("pos"), i.alias("i"))
    return grid.select("pos", "i", fixed(F.cos(angle)).alias("cos"), fixed(F.sin(angle)).alias("sin"))


@functools.lru_cache(maxsize=1)
def exp2_values() -> np.ndarray:
    return np.clip(np.rint(np.exp2(-np.arange(EXP2_SIZE) / EXP2_SIZE) * 65536), 1, 65535).astype(np.int64)


@functools.lru_cache(maxsize=8)
def rope_values(positions: int) -> tuple[np.ndarray, np.ndarray]:
    """cos and sin of shape (positions, 32)."""
    angle = np.arange(positions)[:, None] / np.power(10000.0, np.arange(HALF_DIM) * 2.0 / (2 * HALF_DIM))
    return tuple(np.clip(np.rint(f(angle) * 32768), -32768, 32767).astype(np.int64) for f in (np.cos, np.sin))


def check_exp2(values: np.ndarray) -> np.ndarray:
    """A table from a file, checked for size."""
    if len(values) != EXP2_SIZE:
        raise ValueError(f"an exponential table has {EXP2_SIZE} entries, not {len(values)}")
    return np.asarray(values, np.int64)


def check_rope(cos: np.ndarray, sin: np.ndarray, positions: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotary tables from a file, checked for size and shaped (positions, 32)."""
    if cos.size != positions * HALF_DIM or sin.size != cos.size:
        raise ValueError(f"rotary tables need {positions} x {HALF_DIM} entries")
    return np.asarray(cos, np.int64).reshape(positions, HALF_DIM), np.asarray(sin, np.int64).reshape(positions, HALF_DIM)


def exp2_literal() -> Column:
    """The table as an array constant, which is folded into the plan."""
    return F.array(*[F.lit(int(v)).cast("bigint") for v in exp2_values()])


def exp2_lookup(i: Column) -> Column:
    return F.get(exp2_literal(), i.bitwiseAND(F.lit(EXP2_SIZE - 1).cast("bigint")).cast("int"))


def exp2_negative_q8(x: Column) -> Column:
    """2**-x for x in Q8: 0 from 16 on; negative x counts as 0."""
    x = F.greatest(F.lit(0).cast("bigint"), x)
    whole = F.call_function("shiftright", x, F.lit(8)).cast("int")
    return F.when(whole >= 16, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftright", exp2_lookup(x), F.least(whole, F.lit(16))))


def exp_q16(diff: Column, coef: int = SOFTMAX_COEF) -> Column:
    """exp(diff) in Q16 for diff <= 0, at least 1; 65535 for diff >= 0."""
    t = F.call_function("shiftright", -diff * F.lit(coef).cast("bigint") + F.lit(1 << 23).cast("bigint"), F.lit(24))
    whole = F.call_function("shiftright", t, F.lit(8)).cast("int")
    unit = F.call_function("shiftright", F.lit(65536).cast("bigint"), F.least(whole, F.lit(31)))
    value = F.call_function("shiftright", unit * exp2_lookup(t) + F.lit(32768).cast("bigint"), F.lit(16))
    return F.when(diff >= 0, F.lit(65535).cast("bigint")).when(whole >= 31, F.lit(1).cast("bigint")).otherwise(clamp(value, 1, 65535))


@functools.lru_cache(maxsize=1)
def _exp_by_step() -> np.ndarray:
    """The exponential for every step of 1 / 256 bit; the last entry serves all beyond."""
    t = np.arange(31 * 256 + 1)
    out = np.clip(((65536 >> (t >> 8)) * exp2_values()[t & 255] + 32768) >> 16, 1, 65535)
    out[-1] = 1
    return out


@functools.lru_cache(maxsize=1)
def _exp_in_float() -> np.ndarray:
    return _exp_by_step().astype(np.float64)


def exp_by_float(drop: np.ndarray, coef: int) -> np.ndarray:
    """:func:`exp_q16` of -drop, for whole numbers drop >= 0 in float64 whose product with coef is exact; as float64."""
    step = drop * (coef * 2.0**-24)
    step += 0.5
    return np.take(_exp_in_float(), step.astype(np.intp), mode="clip")


def exp_q16_values(diff: np.ndarray, coef: int) -> np.ndarray:
    """:func:`exp_q16` over int64 arrays."""
    step = (-diff * coef + (1 << 23)) >> 24
    return _exp_by_step()[np.clip(step, 0, 31 * 256)]
