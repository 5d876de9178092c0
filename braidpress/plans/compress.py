"""Compression and decompression of text columns, end to end.

tokenise -> chunk -> (spread chunks) -> predict and code each chunk -> assemble containers, and back. Chunks
are independent, so they, not documents, are the unit of work: a long document spreads over all executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import container as box
from ..operators.chunking import BOS, chunk, level_context, reassemble, to_log2
from ..operators.coder import Decoders, Lanes, batches_of, encode_spans
from ..operators.kernels import Runner, Weights
from ..operators.vocabulary import Vocabulary, byte_counts, tokenize, token_bytes
from ..sources.model import vocabulary_of
from .session import ship_package, spread, tidy

#: Weights are sent to every executor; a model beyond this has to be loaded by the workers from shared storage.
MODEL_BYTES = 1 << 30
#: Positions that one NumPy batch holds; a batch's tables take this many times the vocabulary times 8 bytes.
BATCH_POSITIONS = 512


def model_bytes(w: Weights) -> int:
    total = w.embed.nbytes + w.head.nbytes + w.cos.nbytes + w.sin.nbytes
    return total + sum(getattr(x, n).nbytes for x in w.layers for n in ("qkv", "out", "up", "down"))


def _send(spark: SparkSession, w: Weights):
    if model_bytes(w) > MODEL_BYTES:
        raise ValueError(f"a model of {model_bytes(w)} bytes is too large to be broadcast")
    return spark.sparkContext.broadcast(w)


def encode_chunks(w: Weights, chunks: list[list[int]], bos: int = BOS) -> list[bytes]:
    """Coded bytes of chunks of any lengths; batches pad with the start token, which causality keeps harmless."""
    out: list[bytes] = [b""] * len(chunks)
    order = sorted(range(len(chunks)), key=lambda i: len(chunks[i]))
    at = 0
    while at < len(order):
        longest = len(chunks[order[min(at + max(1, BATCH_POSITIONS // max(len(chunks[order[at]]), 1)), len(order)) - 1]])
        part = order[at : at + max(1, BATCH_POSITIONS // max(longest, 1))]
        n = max(len(chunks[i]) for i in part)
        symbols = np.zeros((len(part), n), np.int64)
        for k, i in enumerate(part):
            symbols[k, : len(chunks[i])] = chunks[i]
        inputs = np.concatenate([np.full((len(part), min(n, 1)), bos), symbols[:, :-1]], axis=1)
        below, upto, total = Runner(w, len(part), n).spans(inputs, symbols) if n else (symbols, symbols, 1)
        for k, i in enumerate(part):
            size = len(chunks[i])
            out[i] = encode_spans(below[k, :size].tolist(), upto[k, :size].tolist(), total)
        at += len(part)
    return out


def decode_chunks(w: Weights, coded: list[bytes], lengths: list[int], bos: int = BOS) -> list[list[int]]:
    """Tokens of coded chunks; all chunks of a batch advance together, one position at a time."""
    out: list[list[int]] = [[] for _ in coded]
    order = sorted(range(len(coded)), key=lambda i: -lengths[i])
    for at in range(0, len(order), 256):
        part = order[at : at + 256]
        n = lengths[part[0]]
        runner, decoders = Runner(w, len(part), n), Decoders([coded[i] for i in part])
        found = np.zeros((len(part), n), np.int64)
        tokens = np.full((len(part), 1), bos)
        for pos in range(n):
            # the batch is sorted by length, so the chunks that go on are a prefix
            live = sum(lengths[i] > pos for i in part)
            if live < len(tokens):
                tokens = tokens[:live]
                decoders.keep(live)
                runner.keys = [k[:live] for k in runner.keys]
                runner.values = [v[:live] for v in runner.values]
            found[:live, pos], below, upto = runner.find(tokens, pos, decoders.values(runner.total))
            decoders.narrow(below, upto, runner.total)
            tokens = found[:live, pos : pos + 1]
        for i, row in zip(part, found.tolist()):
            out[i] = row[: lengths[i]]
    return out


def coded_chunks(chunks: DataFrame, w: Weights, keys: list[str]) -> DataFrame:
    """Adds ``coded`` to chunk rows (keys, chunk_idx, chunk, n_tokens, and others)."""
    spark = chunks.sparkSession
    ship_package(spark)
    sent = _send(spark, w)
    kept = [c for c in chunks.columns if c != "chunk"]
    schema = T.StructType([*[chunks.schema[c] for c in kept], T.StructField("coded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in batches_of(whole, 512):
                at = b.schema.get_field_index("chunk")
                chunks = b.column(at).to_pylist()
                found = iter(encode_chunks(sent.value, [c for c in chunks if c is not None]))
                coded = [None if c is None else next(found) for c in chunks]
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], pa.array(coded, pa.binary())], [*kept, "coded"])

    # chunks of a text spread over all tasks before the costly step
    return spread(chunks, *keys, "chunk_idx").mapInArrow(tidy(run), schema)


def compress_documents(df: DataFrame, w: Weights, key: str = "doc_id", text: str = "text", level: int | None = 1, codec: str = "zstd", codec_level: int | None = None, vocab: Vocabulary | None = None) -> DataFrame:
    """key, ``container``, n_chunks, n_tokens, n_bytes (of text) and payload_bytes for every row; keys are unique."""
    vocab = vocab or vocabulary_of(w)
    size = level_context(level, w.config["context_length"])
    log2 = to_log2(size)
    src = df.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = tokenize(src, vocab).select(key, F.octet_length("text").cast("bigint").alias("n_bytes"), "tokens")
    # a text without tokens keeps one row, without a chunk
    pieces = coded_chunks(chunk(rows, "tokens", size, outer=True), w, [key])
    return box.assemble(pieces.select(key, "n_bytes", "chunk_idx", "n_tokens", "coded"), [key], log2=log2, codec=codec, level=codec_level)


def decompress_documents(df: DataFrame, w: Weights, key: str = "doc_id", container: str = "container", vocab: Vocabulary | None = None) -> DataFrame:
    """key and ``text`` of containers."""
    spark = df.sparkSession
    ship_package(spark)
    vocab = vocab or vocabulary_of(w)
    sent = _send(spark, w)
    kind = dict(df.dtypes)[key]
    pieces = box.split_chunks(df, [key], container).select(key, "chunk_idx", "n_tokens", "coded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in batches_of(whole, 512):
                found = decode_chunks(sent.value, b.column(3).to_pylist(), b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], [key, "chunk_idx", "ids"])

    tokens = reassemble(spread(pieces, key, "chunk_idx").mapInArrow(tidy(run), f"`{key}` {kind}, chunk_idx int, ids array<int>"), [key], "chunk_idx", "ids", "ids")

    texts = F.decode(token_bytes(F.coalesce("ids", F.array().cast("array<int>")), vocab, spark), "UTF-8")
    return df.select(key).join(tokens, key, "left").select(key, F.coalesce(texts, F.lit("")).alias("text"))


def compression_report(compressed: DataFrame, by: list[str]) -> DataFrame:
    """Sizes by group: texts, bytes, tokens, container bytes, ratio, percent and bits per token (null without any)."""
    sums = compressed.groupBy(*by).agg(
        F.count("*").alias("texts"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_chunks").alias("n_chunks"), F.sum(F.octet_length("container")).cast("bigint").alias("container_bytes"),
    )
    ratio = lambda a, b: a / F.nullif(b, F.lit(0).cast("bigint"))
    return sums.select(
        *by, "texts", "n_bytes", "n_tokens", "n_chunks", "container_bytes",
        ratio(F.col("n_bytes").cast("double"), F.col("container_bytes")).alias("ratio"),
        ratio(F.col("container_bytes") * 100.0, F.col("n_bytes")).alias("percent"),
        ratio(F.col("container_bytes") * 8.0, F.col("n_tokens")).alias("bits_per_token"),
    )


# --- the static model: one table for all --------------------------------------------------------------


def byte_frequencies(df: DataFrame, text: str = "text") -> DataFrame:
    """byte, n: counts over all texts; partial counts are made before the shuffle."""
    rows = byte_counts(df, text)
    every = df.sparkSession.range(256).select(F.col("id").cast("int").alias("byte"))
    return every.join(rows, "byte", "left").select("byte", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def static_table(freqs: DataFrame, total: int = 1 << 20) -> list[int]:
    """Inclusive table of 256 entries scaled to about ``total``, each at least 1; 256 rows reach the driver."""
    counts = [r["n"] for r in freqs.orderBy("byte").collect()]
    whole = max(sum(counts), 1)
    return np.cumsum([1 + c * (total - 256) // whole for c in counts]).tolist()


def static_roundtrip(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4096) -> DataFrame:
    """key, text, coded_bytes: every text coded byte by byte under the corpus's own static table, and decoded."""
    ship_package(df.sparkSession)
    table = static_table(byte_frequencies(df, text))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = Lanes(table)
        for b in batches:
            texts = [t.encode() for t in b.column(1).to_pylist()]
            counts = [-(-len(raw) // size) for raw in texts]
            parts = [raw[i : i + size] for raw in texts for i in range(0, len(raw), size)]
            codes = lanes.encode(parts)
            pieces, sizes = iter(lanes.decode(codes, [len(p) for p in parts])), iter(map(len, codes))
            back = [b"".join(islice(pieces, n)).decode() for n in counts]
            coded = [sum(islice(sizes, n)) for n in counts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(back, pa.string()), pa.array(coded, pa.int64())], ["key", "text", "coded_bytes"])

    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return spread(rows, "key").mapInArrow(run, f"key {kind}, text string, coded_bytes long").withColumnRenamed("key", key)

