"""Fixed-size chunks of token arrays and their positional relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the token that stands before the first of each chunk.
BOS = 1022
LOWEST_LOG2, HIGHEST_LOG2 = 6, 12


def level_context(level: int | None, limit: int | None = None) -> int:
    """Tokens of context of a level (1 to 5: 64 to 1024, else 64), at most what a model allows."""
    context = 64 << (level - 1) if level is not None and 1 <= level <= 5 else 64
    return min(context, limit) if limit else context


def level_context_column(level: Column) -> Column:
    return F.when(level.between(1, 5), F.call_function("shiftleft", F.lit(64).cast("bigint"), (level - 1).cast("int"))).otherwise(F.lit(64).cast("bigint"))


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def from_log2(log2: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), log2.cast("int"))


def to_log2(n: int) -> int:
    """log2 of a context; only powers of two from 64 to 4096 can be stored."""
    if n <= 0 or n & (n - 1) or not LOWEST_LOG2 <= n.bit_length() - 1 <= HIGHEST_LOG2:
        raise ValueError(f"a context must be a power of two from {1 << LOWEST_LOG2} to {1 << HIGHEST_LOG2}, not {n}")
    return n.bit_length() - 1


def chunk(df: DataFrame, tokens: str = "tokens", size: int = 64, outer: bool = False) -> DataFrame:
    """One row per chunk: the other columns, ``chunk_idx``, ``chunk`` and ``n_tokens``.

    Rows without tokens have no chunk: they go, or with ``outer`` stay with nulls and no tokens.
    """
    n = F.size(tokens)
    pieces = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)), lambda s: F.slice(tokens, s + 1, size)))
    others = [c for c in df.columns if c != tokens]
    rows = (df if outer else df.where(n > 0)).select(*others, (F.posexplode_outer if outer else F.posexplode)(pieces).alias("chunk_idx", "chunk"))
    return rows.withColumn("n_tokens", F.when(F.col("chunk").isNull(), F.lit(0)).otherwise(F.size("chunk")))


def positions(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """The relational form: one row per token with ``pos`` and ``token``."""
    others = [c for c in df.columns if c != tokens]
    return df.select(*others, F.posexplode(tokens).alias("pos", "token"))


def previous_tokens(chunks: DataFrame, column: str = "chunk", bos: int = BOS) -> DataFrame:
    """Adds ``prev`` to chunk rows: for each token the one before it within the chunk (BOS at its start).

    A chunk holds all that is asked for, so nothing is exploded or shuffled.
    """
    return chunks.withColumn("prev", F.concat(F.array(F.lit(bos)), F.slice(column, 1, F.size(column) - 1)))


def reassemble(df: DataFrame, keys: list[str], index: str, value: str, alias: str) -> DataFrame:
    """Arrays of ``value`` by key, ordered by ``index``; for array values, their concatenation."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(index, value))), lambda s: s[value])
    kind = dict(df.dtypes)[value]
    return df.groupBy(*keys).agg((F.flatten(ordered) if kind.startswith("array") else ordered).alias(alias))
