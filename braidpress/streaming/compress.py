"""Streaming compression: stateless, since chunks are independent and a row holds its whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.buffers import by_bytes, flat_bytes
from ..operators.chunking import level_context, to_log2
from ..operators.container import Container
from ..operators.kernels import Weights
from ..plans.compress import MODEL_BYTES, decode_chunks, encode_chunks, model_bytes
from ..plans.session import ship_package
from ..sources.model import vocabulary_of

#: Bytes of texts or containers that go through the model together.
BATCH_BYTES = 1 << 20


def _shared(df: DataFrame, w: Weights):
    if model_bytes(w) > MODEL_BYTES:
        raise ValueError("the model is too large to be broadcast")
    ship_package(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast((w, vocabulary_of(w)))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut by the bytes of their second column, so that what is held for a text or two has a bound."""
    for b in batches:
        for s in by_bytes(np.diff(flat_bytes(b.column(1))[1]), BATCH_BYTES):
            yield b.slice(s.start, s.stop - s.start)


def compress_stream(df: DataFrame, w: Weights, key: str = "doc_id", text: str = "text", level: int = 1, codec_level: int | None = None) -> DataFrame:
    """key and ``container`` for a streaming (or static) frame; append mode, no state and no watermark."""
    size = level_context(level, w.config["context_length"])
    log2, sent, kind = to_log2(size), _shared(df, w), dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vocab = sent.value
        for b in pieces(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            tokens = [vocab.encode_with_special_tokens(t) for t in texts]
            cuts = [[t[i : i + size] for i in range(0, len(t), size)] for t in tokens]
            coded = iter(encode_chunks(model, [c for cut in cuts for c in cut]))
            out = []
            for t, cut in zip(texts, cuts):
                box = Container(context_log2=log2, uncompressed_len=len(t.encode()))
                for i, c in enumerate(cut):
                    box.add_chunk(next(coded), len(c), i == len(cut) - 1)
                out.append(box.to_bytes(codec_level))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], [key, "container"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, container binary")


def decompress_stream(df: DataFrame, w: Weights, key: str = "doc_id", container: str = "container") -> DataFrame:
    """key and ``text`` of a streaming (or static) frame of containers."""
    sent, kind = _shared(df, w), dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vocab = sent.value
        for b in pieces(batches):
            boxes = [Container.from_bytes(x) for x in b.column(1).to_pylist()]
            ids = iter(decode_chunks(model, [c for x in boxes for c in x.chunks], [x.chunk_tokens(i) for x in boxes for i in range(len(x.chunks))]))
            out = [vocab.decode_bytes(t for _ in x.chunks for t in next(ids)).decode() for x in boxes]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], [key, "text"])

    return df.select(F.col(key), F.col(container)).mapInArrow(run, f"`{key}` {kind}, text string")
