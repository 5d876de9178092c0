"""The two-level binary container: outer header, compressed payload, inner header, chunk bytes.

Headers are packed and parsed with Spark expressions over BINARY; only the outer codec needs Python.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import ship_package, tidy
from ..sources.model import brotli
from .buffers import by_bytes
from .chunking import HIGHEST_LOG2, LOWEST_LOG2

#: Bytes of chunks that leave a worker at once.
PIECE_BYTES = 1 << 22
#: Fixed values of the format.
MAGIC = b"CZIPv1"
OUTER_BYTES, INNER_FIXED = 16, 12
CODECS = {"zstd": 0, "brotli": 1}
MULTIFILE, TRAINING_MARKER, RESERVED = 1, 2, 4
MAX_CHUNK, MAX_LENGTH = (1 << 16) - 1, (1 << 32) - 1


class ContainerError(ValueError):
    """Bytes that are no container."""


# --- codecs ----------------------------------------------------------------------------------------


def codec_id(name: str) -> int:
    if name not in CODECS:
        raise ContainerError(f"unknown codec {name}")
    return CODECS[name]


def codec_name(i: int) -> str:
    for k, v in CODECS.items():
        if v == i:
            return k
    raise ContainerError(f"unknown codec {i}")


def outer_compress(raw: bytes, codec: str = "zstd", level: int | None = None) -> bytes:
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=22 if level is None else level).compress(raw)
    codec_id(codec)
    return brotli().compress(raw, quality=11 if level is None else level, lgwin=22)


def outer_decompress(raw: bytes, codec: str) -> bytes:
    if codec == "zstd":
        import zstandard

        try:
            with zstandard.ZstdDecompressor().stream_reader(raw) as r:
                return r.read()
        except zstandard.ZstdError as e:
            raise ContainerError(f"broken payload: {e}") from None
    codec_id(codec)
    return brotli().decompress(raw)


# --- one container in memory -----------------------------------------------------------------------


@dataclass
class Container:
    model_id_hash: int = 0
    tokenizer_id: int = 0
    context_log2: int = 6
    flags: int = 0
    codec: str = "zstd"
    uncompressed_len: int = 0
    chunks: list[bytes] = field(default_factory=list)
    last_chunk_tokens: int = 0

    def __post_init__(self) -> None:
        if not LOWEST_LOG2 <= self.context_log2 <= HIGHEST_LOG2:
            raise ContainerError(f"context 2**{self.context_log2} cannot be stored")

    def add_chunk(self, data: bytes, tokens: int, last: bool = False) -> None:
        if len(data) > MAX_CHUNK:
            raise ContainerError("a chunk has more than 65,535 bytes")
        self.chunks.append(data)
        if last:
            self.last_chunk_tokens = tokens

    @property
    def multifile(self) -> bool:
        return bool(self.flags & MULTIFILE)

    @multifile.setter
    def multifile(self, on: bool) -> None:
        self.flags = self.flags | MULTIFILE if on else self.flags & ~MULTIFILE

    @property
    def total_tokens(self) -> int:
        return ((len(self.chunks) - 1) << self.context_log2) + self.last_chunk_tokens if self.chunks else 0

    def chunk_tokens(self, i: int) -> int:
        return self.last_chunk_tokens if i == len(self.chunks) - 1 else 1 << self.context_log2

    def inner_header(self) -> bytes:
        n = len(self.chunks)
        return struct.pack("<IIHBB", self.model_id_hash, n, self.last_chunk_tokens, self.tokenizer_id, self.context_log2) + struct.pack(f"<{n}H", *map(len, self.chunks))

    def payload(self) -> bytes:
        return self.inner_header() + b"".join(self.chunks)

    def to_bytes(self, level: int | None = None, compressed: bool = True) -> bytes:
        """File bytes; uncompressed ones carry the payload as it is (for tests)."""
        if self.uncompressed_len > MAX_LENGTH:
            raise ContainerError("texts of 4 GiB or more do not fit the header")
        payload = self.payload()
        head = MAGIC + struct.pack("<BBII", self.flags, codec_id(self.codec), self.uncompressed_len, INNER_FIXED + 2 * len(self.chunks))
        return head + (outer_compress(payload, self.codec, level) if compressed else payload)

    def compressed_size(self, level: int | None = None) -> int:
        return len(self.to_bytes(level))

    @classmethod
    def from_bytes(cls, raw: bytes, compressed: bool = True) -> Container:
        if len(raw) < OUTER_BYTES:
            raise ContainerError("short outer header")
        if raw[:6] != MAGIC:
            raise ContainerError("bad magic")
        flags, codec, length, header_len = struct.unpack_from("<BBII", raw, 6)
        name = codec_name(codec)
        out = cls.from_payload(outer_decompress(raw[OUTER_BYTES:], name) if compressed else raw[OUTER_BYTES:])
        if header_len != INNER_FIXED + 2 * len(out.chunks):
            raise ContainerError("the stated header length is not the header's")
        out.flags, out.codec, out.uncompressed_len = flags, name, length
        return out

    @classmethod
    def from_payload(cls, payload: bytes) -> Container:
        if len(payload) < INNER_FIXED:
            raise ContainerError("short inner header")
        model, n, last, tokenizer, log2 = struct.unpack_from("<IIHBB", payload)
        if len(payload) < INNER_FIXED + 2 * n:
            raise ContainerError("short inner header")
        lengths = struct.unpack_from(f"<{n}H", payload, INNER_FIXED)
        at = INNER_FIXED + 2 * n
        if at + sum(lengths) > len(payload):
            raise ContainerError("truncated chunk")
        out = cls(model, tokenizer, log2 or 6)
        for size in lengths:
            out.chunks.append(payload[at : at + size])
            at += size
        out.last_chunk_tokens = last
        return out


# --- expressions -----------------------------------------------------------------------------------


def little_endian(value: Column, width: int) -> Column:
    """A non-negative integer as that many bytes, least first."""
    h = F.lpad(F.hex(value.cast("bigint")), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * (width - 1 - k) + 1, 2) for k in range(width)]))


def read_little_endian(data: Column, at: int | Column, width: int) -> Column:
    """The unsigned integer of that many bytes from byte ``at`` (from 0) on, as BIGINT."""
    at = F.lit(at) if isinstance(at, int) else at
    h = F.hex(F.substr(data, at + 1, F.lit(width)))
    return F.conv(F.concat(*[F.substring(h, 2 * (width - 1 - k) + 1, 2) for k in range(width)]), 16, 10).cast("bigint")


def joined_bytes(parts: Column) -> Column:
    """An array of BINARY as one BINARY, in order."""
    return F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p)), ""))


def model_hash(path: Column) -> Column:
    """First 32 bits of the MD5 of a model's name."""
    return F.conv(F.substring(F.md5(path.cast("binary")), 1, 8), 16, 10).cast("bigint")


def pack_outer(flags: Column, codec: Column, length: Column, header_len: Column) -> Column:
    return F.concat(F.unhex(F.lit(MAGIC.hex())), little_endian(flags, 1), little_endian(checked_codec(codec), 1), little_endian(length, 4), little_endian(header_len, 4))


def checked_codec(codec: Column) -> Column:
    return F.when(codec.isin(*CODECS.values()), codec).otherwise(F.raise_error(F.concat(F.lit("unknown codec "), codec.cast("string"))).cast("int"))


def inner_size(n: Column) -> Column:
    return F.lit(INNER_FIXED) + 2 * n


def pack_inner(model: Column, last: Column, tokenizer: Column, log2: Column, lengths: Column) -> Column:
    ok = F.when(log2.between(LOWEST_LOG2, HIGHEST_LOG2), log2).otherwise(F.raise_error(F.lit("context cannot be stored")).cast("int"))
    fixed = F.concat(little_endian(model, 4), little_endian(F.size(lengths), 4), little_endian(last, 2), little_endian(tokenizer, 1), little_endian(ok, 1))
    return F.concat(fixed, F.coalesce(joined_bytes(F.transform(lengths, lambda n: little_endian(n, 2))), F.unhex(F.lit(""))))


def parse_outer(data: Column) -> Column:
    """struct<flags, codec_id, uncompressed_len, header_len>; other bytes raise."""
    magic = F.hex(F.substr(data, F.lit(1), F.lit(6)))
    codec = read_little_endian(data, 7, 1)
    good = F.struct(read_little_endian(data, 6, 1).alias("flags"), codec.alias("codec_id"), read_little_endian(data, 8, 4).alias("uncompressed_len"), read_little_endian(data, 12, 4).alias("header_len"))
    kind = "struct<flags:bigint,codec_id:bigint,uncompressed_len:bigint,header_len:bigint>"
    fail = lambda why: F.raise_error(F.lit(why)).cast(kind)
    return F.when(F.octet_length(data) < OUTER_BYTES, fail("short outer header")).when(magic != MAGIC.hex().upper(), fail("bad magic")).when(~codec.isin(*CODECS.values()), fail("unknown codec")).otherwise(good)


def parse_inner(payload: Column) -> Column:
    """struct<model_id_hash, chunk_count, last_chunk_tokens, tokenizer_id, context_length_log2, chunk_byte_lens>."""
    n = read_little_endian(payload, 4, 4).cast("int")
    log2 = read_little_endian(payload, 11, 1)
    lengths = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: read_little_endian(payload, INNER_FIXED + 2 * i, 2))).otherwise(F.array().cast("array<bigint>"))
    good = F.struct(
        read_little_endian(payload, 0, 4).alias("model_id_hash"), n.cast("bigint").alias("chunk_count"), read_little_endian(payload, 8, 2).alias("last_chunk_tokens"),
        read_little_endian(payload, 10, 1).alias("tokenizer_id"), F.when(log2 == 0, F.lit(6).cast("bigint")).otherwise(log2).alias("context_length_log2"), lengths.alias("chunk_byte_lens"),
    )
    kind = "struct<model_id_hash:bigint,chunk_count:bigint,last_chunk_tokens:bigint,tokenizer_id:bigint,context_length_log2:bigint,chunk_byte_lens:array<bigint>>"
    short = F.octet_length(payload) < INNER_FIXED
    return F.when(short, F.raise_error(F.lit("short inner header")).cast(kind)).when(F.octet_length(payload) < INNER_FIXED + 2 * n, F.raise_error(F.lit("short inner header")).cast(kind)).otherwise(good)


def total_tokens(inner: Column) -> Column:
    return F.when(inner.chunk_count == 0, F.lit(0).cast("bigint")).otherwise((inner.chunk_count - 1) * F.call_function("shiftleft", F.lit(1).cast("bigint"), inner.context_length_log2.cast("int")) + inner.last_chunk_tokens)


def chunk_tokens(inner: Column, i: Column) -> Column:
    return F.when(i == inner.chunk_count - 1, inner.last_chunk_tokens).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), inner.context_length_log2.cast("int")))


def set_flag(flags: Column, flag: int, on: bool) -> Column:
    return flags.bitwiseOR(F.lit(flag)) if on else flags.bitwiseAND(F.lit(~flag))


def has_flag(flags: Column, flag: int) -> Column:
    return flags.bitwiseAND(F.lit(flag)) != 0


def compress_payload(payload: Column, codec: str = "zstd", level: int | None = None) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda p: None if p is None else outer_compress(bytes(p), codec, level))

    return run(payload)


def decompress_payload(data: Column, codec: Column) -> Column:
    """Payload of whole container bytes."""

    @F.pandas_udf("binary")
    def run(d: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else outer_decompress(bytes(x)[OUTER_BYTES:], codec_name(int(k))) for x, k in zip(d, c)], dtype=object)

    return run(data, codec)


def assemble(chunks: DataFrame, keys: list[str], model: int = 0, tokenizer: int = 0, log2: int = 6, flags: int = 0, codec: str = "zstd", level: int | None = None, compressed: bool = True) -> DataFrame:
    """Containers from chunk rows (keys, chunk_idx, n_tokens, coded, n_bytes): keys, container, n_chunks, n_tokens, payload_bytes.

    Rows with a null chunk_idx stand for texts without tokens. Without ``compressed`` the payload stays as it is.
    """
    ship_package(chunks.sparkSession)
    rows = chunks.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("chunk_idx").isNotNull(), F.struct("chunk_idx", "coded")))).alias("c"),
        F.coalesce(F.max_by("n_tokens", "chunk_idx"), F.lit(0)).alias("last"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("bigint").alias("n_tokens"), F.max("n_bytes").alias("n_bytes"),
        F.coalesce(F.max("chunk_idx") + 1, F.lit(0)).alias("chunks"), F.count_if(F.col("chunk_idx").isNull()).alias("bare"),
    )
    # two texts under one key would make a container of both
    one = (F.size("c") == F.col("chunks")) & (F.col("bare") == F.when(F.col("chunks") > 0, 0).otherwise(1))
    rows = rows.withColumn("c", F.when(one, F.col("c")).otherwise(F.raise_error(F.lit("a key has several texts")).cast(rows.schema["c"].dataType)))
    lengths = F.transform("c", lambda s: F.when(F.octet_length(s.coded) <= MAX_CHUNK, F.octet_length(s.coded)).otherwise(F.raise_error(F.lit("a chunk has more than 65,535 bytes")).cast("int")))
    inner = pack_inner(F.lit(model), F.col("last"), F.lit(tokenizer), F.lit(log2), lengths)
    body = F.coalesce(joined_bytes(F.transform("c", lambda s: s.coded)), F.unhex(F.lit("")))
    built = rows.select(*keys, "n_tokens", "n_bytes", F.size("c").cast("bigint").alias("n_chunks"), F.concat(inner, body).alias("payload"))
    fits = F.when(F.col("n_bytes") <= MAX_LENGTH, F.col("n_bytes")).otherwise(F.raise_error(F.lit("texts of 4 GiB or more do not fit the header")).cast("bigint"))
    outer = pack_outer(F.lit(flags), F.lit(codec_id(codec)), fits, inner_size(F.col("n_chunks")))
    return built.select(*keys, F.concat(outer, compress_payload(F.col("payload"), codec, level) if compressed else F.col("payload")).alias("container"), "n_chunks", "n_tokens", "n_bytes", F.octet_length("payload").cast("bigint").alias("payload_bytes"))


def split_chunks(df: DataFrame, keys: list[str], container: str = "container") -> DataFrame:
    """keys, chunk_idx, coded, n_tokens, context_log2, uncompressed_len: one row per chunk, headers checked."""
    ship_package(df.sparkSession)
    schema = T.StructType([*[df.schema[k] for k in keys], *T._parse_datatype_string("chunk_idx int, coded binary, n_tokens long, context_log2 long, uncompressed_len long").fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, raw in enumerate(b.column(len(keys)).to_pylist()):
                box = Container.from_bytes(raw)
                # the pieces of a long payload leave in batches of a bound size
                for part in by_bytes(np.fromiter(map(len, box.chunks), np.int64, len(box.chunks)), PIECE_BYTES):
                    at = range(part.start, part.stop)
                    own = [b.column(k).take(pa.array([i] * len(at))) for k in range(len(keys))]
                    made = [pa.array(at, pa.int32()), pa.array(box.chunks[part], pa.binary()), pa.array([box.chunk_tokens(k) for k in at], pa.int64())]
                    made += [pa.array([v] * len(at), pa.int64()) for v in (box.context_log2, box.uncompressed_len)]
                    yield pa.RecordBatch.from_arrays([*own, *made], names)

    return df.select(*keys, F.col(container).alias("raw")).where("raw IS NOT NULL").mapInArrow(tidy(run), schema)
