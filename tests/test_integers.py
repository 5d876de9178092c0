import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidpress.functions import arrays, integer, tables
from braidpress.operators import kernels


def exact_rne(x, s):
    q, r = divmod(x, 1 << s)
    return q + (2 * r > 1 << s or (2 * r == 1 << s and q & 1))


@settings(deadline=None)
@given(st.lists(st.integers(-(1 << 31), (1 << 31) - 1), min_size=1, max_size=50), st.integers(1, 31))
def test_kernel_rounding(xs, s):
    assert kernels.rne(np.array(xs, np.int64), s).tolist() == [exact_rne(x, s) for x in xs]


VALUES = [7, 5, 3, 1, -7, -5, 1234567, 9, 11, 0, -1, 2147483647, -2147483648, 12345]


def test_shift_columns(spark):
    rows = [(x, s) for x in VALUES for s in (0, 1, 2, 10, 31, 32, 40)]
    df = spark.createDataFrame(rows, "x bigint, s int").select("x", "s", integer.shift_right_rne(F.col("x"), F.col("s")).alias("y"), integer.shift_right_rne(F.col("x"), 2).alias("y2"))
    for r in df.collect():
        assert r.y == (r.x if r.s == 0 else 0 if r.s >= 32 else exact_rne(r.x, r.s))
        assert r.y2 == exact_rne(r.x, 2)


@pytest.mark.parametrize("n, d, q", [(7, 2, 4), (5, 2, 2), (10, 4, 2), (14, 4, 4), (11, 4, 3), (10, 3, 3), (1000000, 3, 333333), (5, 0, 0)])
def test_division(spark, n, d, q):
    df = spark.createDataFrame([(n, d)], "n bigint, d bigint")
    r = df.select(integer.divide_unsigned_rne(F.col("n"), F.col("d")).alias("u"), integer.divide_rne(-F.col("n"), F.col("d")).alias("s")).first()
    assert (r.u, r.s) == (q, -q)


def test_scalars(spark):
    df = spark.createDataFrame([(0, 0), (15, 3), (16, 4), (1000000, 1000), (2147483647, 46340), (4294967295, 65535)], "x bigint, want bigint")
    assert df.where(integer.isqrt32(F.col("x")) != F.col("want")).count() == 0
    one = spark.range(1).select(
        integer.clamp_i8(F.lit(-128).cast("bigint")).alias("low"), integer.argmax_array(F.array(*map(F.lit, [1, 5, 5, 2]))).alias("tie"), integer.argmax_array(F.array().cast("array<int>")).alias("none"),
        integer.quantize_q07(F.lit(0.5)).alias("q"), integer.round_half_even(F.lit(2.5)).alias("even"), integer.requantize(F.lit(123456).cast("bigint"), 77, 12).alias("r"), integer.requantize(F.lit(-300).cast("bigint"), 1, 0).alias("r0"),
    ).first()
    assert tuple(one) == (-127, 1, 0, 64, 2, 127, -127)


def test_tables(spark):
    assert tables.exp2_table(spark).agg(F.sum("v")).first()[0] == 12118595 == int(tables.exp2_values().sum())
    cos, sin = tables.rope_values(4096)
    weights = (np.arange(4096)[:, None] + 1) * (np.arange(32)[None] + 1)
    assert int((cos * weights).sum()) == 20708146425744
    assert int((sin * weights).sum()) == 34680287254953
    diffs = [0, -1, -50, -100, -500, -1000, -5000, -10000, -100000, -4000000, 5]
    want = [65535, 65535, 65535, 65535, 65359, 65182, 63613, 61579, 35637, 1, 65535]
    assert tables.exp_q16_values(np.array(diffs), 37819).tolist() == want
    df = spark.createDataFrame([(d,) for d in diffs], "d bigint").select("d", tables.exp_q16(F.col("d")).alias("e"))
    assert {r.d: r.e for r in df.collect()} == dict(zip(diffs, want))
    low = spark.createDataFrame([(0,), (256,), (512,), (768,), (4096,), (-3,)], "x bigint").select("x", tables.exp2_negative_q8(F.col("x")).alias("e"))
    assert {r.x: r.e for r in low.collect()} == {0: 65535, 256: 32767, 512: 16383, 768: 8191, 4096: 0, -3: 65535}
    with pytest.raises(ValueError):
        tables.check_exp2(np.zeros(10))
    with pytest.raises(ValueError):
        tables.check_rope(np.zeros(10), np.zeros(10), 64)
    with pytest.raises(ValueError):
        tables.rope_table(spark, 5000)


def test_norms(spark):
    for ms, inv in [(1, 32768), (2, 23173), (3, 18936), (4, 16384), (16, 8192), (9483, 336), (16130, 258)]:
        assert spark.range(1).select(arrays.inverse_rms_q15(F.lit(ms).cast("bigint"))).first()[0] == inv
    assert kernels.rms_norm(np.array([64] * 4), np.array([127] * 4)).tolist() == [127] * 4
    assert kernels.rms_norm(np.array([1, -2, 3, -4]), np.array([127, 64, -127, 10])).tolist() == [45, -45, -127, -14]
    assert kernels.reglu(np.array([64, 32, -64, 32, 96]), np.array([64, 64, 5, 2, 2])).tolist() == [32, 16, 0, 0, 2]
