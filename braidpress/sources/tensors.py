"""Tensor files: a length, a JSON header, raw little-endian data."""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass

import numpy as np

MAX_BYTES, MAX_TENSORS, MAX_DIMS, MAX_NAME = 2 << 40, 2048, 8, 2048
#: Type names and their widths in bytes.
WIDTHS = {"I8": 1, "U8": 1, "BOOL": 1, "I16": 2, "U16": 2, "F16": 2, "BF16": 2, "I32": 4, "U32": 4, "F32": 4, "I64": 8}
VIEWS = {"I8": "<i1", "U8": "<u1", "BOOL": "<u1", "I16": "<i2", "U16": "<u2", "I32": "<i4", "U32": "<u4", "I64": "<i8", "F16": "<f2", "F32": "<f4"}


class TensorFileError(ValueError):
    """A tensor file that does not hold together."""


@dataclass
class Tensor:
    name: str
    dtype: str
    shape: tuple[int, ...]
    data: bytes

    @property
    def elements(self) -> int:
        n = 1
        for s in self.shape:
            n *= s
        return n

    def array(self, *kinds: str) -> np.ndarray:
        """The values, checked to be of one of the given types (any, if none is given)."""
        if kinds and self.dtype not in kinds:
            raise TensorFileError(f"{self.name} is {self.dtype}, not {' or '.join(kinds)}")
        if self.dtype == "BF16":
            return (np.frombuffer(self.data, "<u2").astype(np.uint32) << 16).view(np.float32).reshape(self.shape)
        return np.frombuffer(self.data, VIEWS[self.dtype]).reshape(self.shape)


def of_array(name: str, values: np.ndarray) -> Tensor:
    kind = {"i1": "I8", "u1": "U8", "i2": "I16", "u2": "U16", "i4": "I32", "u4": "U32", "i8": "I64", "f2": "F16", "f4": "F32"}[np.asarray(values).dtype.str[1:]]
    values = np.ascontiguousarray(values)
    return Tensor(name, kind, values.shape, values.astype(VIEWS[kind]).tobytes())


def parse(raw: bytes) -> tuple[dict[str, Tensor], dict[str, str]]:
    """Tensors by name, and metadata, with sizes, types and offsets checked."""
    if len(raw) < 8 or len(raw) > MAX_BYTES:
        raise TensorFileError("no header")
    n = struct.unpack_from("<Q", raw)[0]
    if n > len(raw) - 8:
        raise TensorFileError("header beyond the file")
    try:
        header = json.loads(raw[8 : 8 + n])
    except ValueError as e:
        raise TensorFileError(f"header is no JSON: {e}") from None
    metadata = {k: str(v) for k, v in (header.pop("__metadata__", None) or {}).items()}
    if len(header) > MAX_TENSORS:
        raise TensorFileError("too many tensors")
    out, body = {}, memoryview(raw)[8 + n :]
    for name, spec in header.items():
        dtype, shape, (a, b) = spec["dtype"], tuple(spec["shape"]), spec["data_offsets"]
        if dtype not in WIDTHS:
            raise TensorFileError(f"{name}: unknown type {dtype}")
        t = Tensor(name, dtype, shape, bytes(body[a:b]))
        if len(shape) > MAX_DIMS or len(name.encode()) > MAX_NAME or min(shape, default=1) < 0:
            raise TensorFileError(f"{name}: bad shape or name")
        if not 0 <= a <= b <= len(body) or b - a != t.elements * WIDTHS[dtype]:
            raise TensorFileError(f"{name}: offsets do not fit the shape")
        out[name] = t
    return out, metadata


def build(tensors: list[Tensor], metadata: dict[str, str] | None = None) -> bytes:
    """File bytes, tensors in order of name."""
    header: dict = {"__metadata__": metadata} if metadata else {}
    body = bytearray()
    for t in sorted(tensors, key=lambda t: t.name):
        header[t.name] = {"dtype": t.dtype, "shape": list(t.shape), "data_offsets": [len(body), len(body) + len(t.data)]}
        body += t.data
    head = json.dumps(header, separators=(",", ":")).encode()
    head += b" " * (-len(head) % 8)
    return struct.pack("<Q", len(head)) + head + bytes(body)
