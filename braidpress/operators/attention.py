"""Relational and array forms of the layer operators, for auditing the kernels with plain Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import attention_score, dot
from ..functions.integer import big, clamp_i8, divide_rne_i32
from ..functions.tables import ATTENTION_COEF, exp_q16
from .buffers import flat_lists, lists_of

#: Bytes of an embedding table that travels with a function.
TABLE_BYTES = 1 << 26


def embedding_lookup(tokens: DataFrame, embedding: DataFrame, token: str = "token") -> DataFrame:
    """Token rows joined to (token, i, value) rows of the embedding."""
    return tokens.join(embedding, token)


def embedding_gather(tokens: Column, values: np.ndarray) -> Column:
    """Arrays of tokens as arrays of their values, gathered in place; ``values`` has a number, or a row, for each token.

    The table travels with the function, so it is held to TABLE_BYTES; :func:`embedding_lookup` takes larger ones.
    """
    if values.nbytes > TABLE_BYTES:
        raise ValueError(f"a table of {values.nbytes} bytes is too large to be sent along")
    wide = values.ndim == 2

    @F.arrow_udf("array<array<long>>" if wide else "array<long>")
    def run(s: pa.Array) -> pa.Array:
        ids, offs = flat_lists(s)
        if not wide:
            return lists_of(values[ids], offs, pa.int64(), s)
        rows = pa.FixedSizeListArray.from_arrays(pa.array(values[ids].ravel(), pa.int64()), values.shape[1]).cast(pa.list_(pa.int64()))
        return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), rows, mask=s.is_null() if s.null_count else None)

    return run(tokens)


def gemm_relational(x: DataFrame, w: DataFrame, row: str = "row_id") -> DataFrame:
    """(row, i, x) times (o, i, w) -> (row, o, y): one equi-join on i, partial sums before the shuffle."""
    return x.join(w, "i").groupBy(row, "o").agg(F.sum(big("x") * big("w")).alias("y"))


def with_bias(y: DataFrame, bias: DataFrame) -> DataFrame:
    """Adds (o, b) to the sums of :func:`gemm_relational`."""
    return y.join(bias, "o").withColumn("y", F.col("y") + big("b")).drop("b")


def causal_pairs(df: DataFrame, group: str, pos: str, q: str, k: str, v: str) -> DataFrame:
    """Pairs of a query and each key at or before it, within a group: equi-join on the group, range on the position."""
    a = df.select(group, F.col(pos).alias("pos"), F.col(q).alias("q"))
    b = df.select(group, F.col(pos).alias("t"), F.col(k).alias("k"), F.col(v).alias("v"))
    return a.join(b, group).where("t <= pos")


def scored(pairs: DataFrame, mult: int) -> DataFrame:
    """Adds the integer attention score of each pair."""
    return pairs.withColumn("score", attention_score(dot(F.col("q"), F.col("k")), mult))


def fold(steps: Column, sink_score: Column | None = None, width: int = 64) -> Column:
    """The ordered softmax fold of an array of struct<t, score, v> -> array of 8-bit outputs.

    Order counts, since every new maximum rounds the sums: the steps are sorted by t first.
    """
    zero = F.lit(0).cast("bigint")
    empty = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda _: F.lit(0).cast("bigint"))
    start = F.struct((F.lit(None).cast("bigint") if sink_score is None else sink_score.cast("bigint")).alias("m"), (zero if sink_score is None else F.lit(65535).cast("bigint")).alias("s"), empty.alias("acc"))

    def rescaled(p: Column) -> Column:
        return F.call_function("shiftright", p + F.when(p >= 0, F.lit(1 << 15)).otherwise(F.lit(-(1 << 15))), F.lit(16))

    def step(state: Column, x: Column) -> Column:
        top = F.greatest(F.coalesce(state.m, x.score), x.score)
        factor = F.when(state.m.isNotNull() & (x.score > state.m), exp_q16(state.m - x.score, ATTENTION_COEF))
        weight = exp_q16(x.score - top, ATTENTION_COEF)

        def next_state(c: Column) -> Column:
            s = F.when(c.f.isNull(), state.s).otherwise(F.call_function("shiftright", state.s * c.f + F.lit(0x8000), F.lit(16))) + c.w
            acc = F.zip_with(state.acc, x.v, lambda a, v: F.when(c.f.isNull(), a).otherwise(rescaled(a * c.f)) + c.w * big(v))
            return F.struct(top.alias("m"), s.alias("s"), acc.alias("acc"))

        return F.transform(F.array(F.struct(factor.alias("f"), weight.alias("w"))), next_state)[0]

    return F.aggregate(F.sort_array(steps), start, step, lambda r: F.transform(r.acc, lambda a: clamp_i8(divide_rne_i32(a, F.greatest(r.s, F.lit(1).cast("bigint"))))))
