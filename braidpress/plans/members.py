"""A membership filter of fixed size, to drop rows before a shuffle that a join would drop after it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each id, and in all: 8 MB are broadcast at most. Beyond some ten million ids it
#: lets more and more rows pass, which costs shuffle but no correctness.
BITS_PER_ID, MOST_BITS = 32, 1 << 26


def maybe_among(ids: DataFrame, column: str, tested: Column) -> Column:
    """Whether ``tested`` may be among the ids: True for all that are, and for few that are not."""
    bits = min(MOST_BITS, 1 << max(10, (BITS_PER_ID * ids.count()).bit_length()))
    slot = F.pmod(F.xxhash64(column), F.lit(bits))
    found = ids.select(F.shiftright(slot, 3).alias("byte"), F.call_function("shiftleft", F.lit(1), (slot % 8).cast("int")).alias("bit"))
    got = found.groupBy("byte").agg(F.bit_or("bit").alias("bit")).toArrow()  # bits / 8 short rows at most
    table = np.zeros(bits >> 3, np.uint8)
    table[np.asarray(got["byte"])] = np.asarray(got["bit"]).astype(np.uint8)
    sent = ids.sparkSession.sparkContext.broadcast(table.tobytes())

    @F.pandas_udf("boolean")
    def test(s: pd.Series) -> pd.Series:
        at = s.to_numpy()
        return pd.Series((np.frombuffer(sent.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return test(F.pmod(F.xxhash64(tested), F.lit(bits)))
