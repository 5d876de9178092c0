"""Token counts without materialising ids.

Arrow batches are dealt into groups of about equal bytes. Long texts are split at safe boundaries, so no
call ever holds more than a bounded piece of text; only lengths leave the worker. Byte-level vocabularies
(tokenizers ``.json``) split at forced pairs, as for encoding; for sentencepiece ``.model`` files long texts are
split at single spaces between plain letters or digits, if the vocabulary has no piece that goes on after a space.

Results by case: null and empty texts count 0 bytes and 0 tokens; texts of any length are counted whole;
each input row gives one row; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import tidy
from .bpe import MEMO_CHARS, MEMO_FRAGMENTS, _narrow, byte_slices, codec

GROUP_BYTES = 1 << 20
#: Characters of a part of a long text, at least, for vocabularies of the second kind.
PART_CHARS = 1 << 16
_SAFE_SPACE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


class Counter:
    """Counts by fragment; one per worker process."""

    def __init__(self, path: str) -> None:
        self.sizes: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            self.pieces, self.codec = sentencepiece.SentencePieceProcessor(model_file=path), None
        else:
            self.pieces, self.codec = None, codec(path)

    @functools.cached_property
    def words_apart(self) -> bool:
        """Whether no piece goes from one word into the next, and a word alone reads as it does after a space."""
        p = self.pieces
        inside = any("\u2581" in p.id_to_piece(i).lstrip("\u2581") for i in range(p.get_piece_size()))
        return not inside and p.encode("a b 1") == p.encode("a") + p.encode("b") + p.encode("1")

    def parts(self, text: str) -> list[str]:
        """A long text in parts, cut at single spaces between plain letters or digits, which go; others whole."""
        if len(text) < GROUP_BYTES or not self.words_apart:
            return [text]
        out, at = [], 0
        while (m := _SAFE_SPACE.search(text, at + PART_CHARS)) is not None:
            out.append(text[at : m.start()])
            at = m.end()
        return [*out, text[at:]]

    def count(self, texts: list[str]) -> list[int]:
        if self.codec is None:
            parts = [self.parts(t) for t in texts]
            sizes = iter([len(x) for x in self.pieces.encode([p for x in parts for p in x], num_threads=1)] if texts else [])
            return [sum(next(sizes) for _ in p) for p in parts]
        sizes, c = self.sizes, self.codec
        parts = [c.split(t, sizes) for t in texts]
        missing = list({f for p in parts for f in p} - sizes.keys())
        if len(sizes) + len(missing) > MEMO_FRAGMENTS * 2:
            sizes.clear()
            missing = list({f for p in parts for f in p})
        for k in range(0, len(missing), 4096):
            chunk = missing[k : k + 4096]
            sizes.update(zip(chunk, [len(ids) // 4 for ids in c.encode_fragments(chunk)]))
        out = [sum(map(sizes.__getitem__, p)) for p in parts]
        for f in missing:
            if len(f) > MEMO_CHARS:
                del sizes[f]
        return out


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            body = b.column(1).fill_null("")
            lengths = np.asarray(pc.binary_length(body)).astype(np.int64)
            found = [n for s in byte_slices(lengths, GROUP_BYTES) for n in c.count(body[s.start : s.stop].to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int64()), pa.array(found, pa.int64())], ["key", "n_bytes", "n_tokens"])
        c.sizes.clear()

    return _narrow(df, key, text).mapInArrow(tidy(run), f"key {kind}, n_bytes long, n_tokens long").withColumnRenamed("key", key)


def with_limit(counts: DataFrame, limit: int = 1024) -> DataFrame:
    """Adds ``over_limit``: more tokens than the limit."""
    return counts.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
