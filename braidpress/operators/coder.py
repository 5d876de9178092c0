"""Arithmetic coding with 32-bit intervals and integer cumulative tables.

The state is the interval [low, high] and a count of straddled bits. Tables are inclusive prefix sums; a
symbol's interval is [table[s-1], table[s]) of table[-1]. The end is one 1 bit, padded with zeros; straddled bits
are not flushed, as the decoder reads zeros past the end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TOP, HALF, QUARTER = (1 << 32) - 1, 1 << 31, 1 << 30
MAX_CHUNK_BYTES = (1 << 16) - 1


class Encoder:
    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.low, self.high, self.straddled = 0, TOP, 0
        self.value, self.bits = 0, 0  # output bits as one integer, most significant first
        self.out = bytearray()

    def _emit(self, bit: int) -> None:
        n = self.straddled
        # the bit, then as many opposite bits
        self.value = (self.value << (n + 1)) | ((bit << n) | ((0 if bit else (1 << n) - 1)))
        self.bits += n + 1
        self.straddled = 0
        if self.bits >= 64:
            spare = self.bits & 7
            self.out += (self.value >> spare).to_bytes(self.bits >> 3, "big")
            self.value &= (1 << spare) - 1
            self.bits = spare

    def encode(self, below: int, upto: int, total: int) -> None:
        """Narrow the interval to [below, upto) of total."""
        span = self.high - self.low + 1
        low = self.low + span * below // total
        high = self.low + span * upto // total - 1
        while True:
            if high < HALF or low >= HALF:
                self._emit(low >> 31)
            elif low >= QUARTER and high < HALF + QUARTER:
                self.straddled += 1
                low -= QUARTER
                high -= QUARTER
            else:
                break
            low = (low << 1) & TOP
            high = ((high << 1) & TOP) | 1
        self.low, self.high = low, high

    def symbol(self, table: Sequence[int], s: int) -> None:
        self.encode(int(table[s - 1]) if s else 0, int(table[s]), int(table[-1]))

    def finish(self) -> bytes:
        value, bits = (self.value << 1) | 1, self.bits + 1
        pad = -bits % 8
        return bytes(self.out) + (value << pad).to_bytes((bits + pad) >> 3, "big")


class Decoder:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 32
        self.low, self.high = 0, TOP
        self.code = int.from_bytes(data[:4].ljust(4, b"\0"), "big")

    def _bit(self) -> int:
        i = self.at >> 3
        bit = (self.data[i] >> (7 - (self.at & 7))) & 1 if i < len(self.data) else 0
        self.at += 1
        return bit

    def symbol(self, table: np.ndarray) -> int:
        """The next symbol under an inclusive table."""
        total, span = int(table[-1]), self.high - self.low + 1
        value = ((self.code - self.low + 1) * total - 1) // span
        s = min(int(np.searchsorted(table, value, "right")), len(table) - 1)
        below = int(table[s - 1]) if s else 0
        low = self.low + span * below // total
        high = self.low + span * int(table[s]) // total - 1
        code = self.code
        while True:
            if high < HALF or low >= HALF:
                drop = 0
            elif low >= QUARTER and high < HALF + QUARTER:
                drop = QUARTER
            else:
                break
            low = ((low - drop) << 1) & TOP
            high = (((high - drop) << 1) & TOP) | 1
            code = (((code - drop) << 1) & TOP) | self._bit()
        self.low, self.high, self.code = low, high, code
        return s


def bit_lengths(x: np.ndarray) -> np.ndarray:
    """Bits of whole numbers from 0 to 2**53."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


class Decoders:
    """Many decoders that take a symbol each at a step: :class:`Decoder`'s arithmetic over int64 arrays."""

    def __init__(self, coded: Sequence[bytes]) -> None:
        # zeros stand past the end of each, as far as a window of five bytes may look
        most = max(map(len, coded), default=0)
        self.data = np.zeros((len(coded), most + 8), np.int64)
        for k, c in enumerate(coded):
            self.data[k, : len(c)] = np.frombuffer(c, np.uint8)
        self.at = np.full(len(coded), 32)
        self.low, self.high = np.zeros(len(coded), np.int64), np.full(len(coded), TOP)
        self.code = (self.data[:, :4] << np.array([24, 16, 8, 0])).sum(axis=1)

    def keep(self, n: int) -> None:
        """Go on with the first n alone."""
        self.data, self.at, self.low, self.high, self.code = (x[:n] for x in (self.data, self.at, self.low, self.high, self.code))

    def _bits(self, n: np.ndarray) -> np.ndarray:
        """The next n bits of each (32 at most)."""
        first = np.minimum(self.at >> 3, self.data.shape[1] - 5)
        rows = np.arange(len(self.data))
        window = np.zeros(len(rows), np.int64)
        for k in range(5):
            window = (window << 8) | self.data[rows, first + k]
        window = np.where(self.at >> 3 == first, window, 0)
        found = (window >> (40 - (self.at & 7) - n)) & ((1 << n) - 1)
        self.at = self.at + n
        return found

    def symbols(self, tables: np.ndarray) -> np.ndarray:
        """The next symbol of each under the inclusive table in its row."""
        rows = np.arange(len(tables))
        s = np.minimum(np.count_nonzero(tables <= self.values(tables[:, -1])[:, None], axis=1), tables.shape[1] - 1)
        self.narrow(np.where(s > 0, tables[rows, s - 1], 0), tables[rows, s], tables[:, -1])
        return s

    def values(self, total: np.ndarray | int) -> np.ndarray:
        """What of each total the next symbol's span holds."""
        return ((self.code - self.low + 1) * total - 1) // (self.high - self.low + 1)

    def narrow(self, below: np.ndarray, upto: np.ndarray, total: np.ndarray | int) -> None:
        """Go on in the span [below, upto) of each total."""
        span = self.high - self.low + 1
        low, high = self.low + span * below // total, self.low + span * upto // total - 1
        # the leading bits that both ends share leave at once
        n = 32 - bit_lengths(low ^ high)
        low, high = (low << n) & TOP, ((high << n) & TOP) | ((1 << n) - 1)
        code = ((self.code << n) & TOP) | self._bits(n)
        # then all straddled ones: after the first bit, ones of low over zeros of high
        m = 32 - bit_lengths(~((low & ~high) << 1) & TOP)
        self.low = (low << m) & (HALF - 1)
        self.high = ((high << m) & (HALF - 1)) | HALF | ((1 << m) - 1)
        self.code = (code << m) - HALF * ((1 << m) - 1) + self._bits(m)


def encode_symbols(table: Sequence[int], symbols: Iterable[int]) -> bytes:
    """Code symbols under one static table."""
    e = Encoder()
    for s in symbols:
        e.symbol(table, s)
    return e.finish()


def decode_symbols(table: Sequence[int], data: bytes, n: int) -> list[int]:
    d, t = Decoder(data), np.asarray(table, np.int64)
    return [d.symbol(t) for _ in range(n)]


#: Parts coded side by side, and the largest total of a table for which float64 divides exactly: products stay
#: below 2**53, and a quotient that is not whole lies further from the next whole number than it is rounded.
LANES, LANE_TOTAL = 2048, 1 << 20


class Lanes:
    """Byte strings under one static table, a symbol of each at a step: :class:`Encoder`'s and :class:`Decoder`'s results.

    ``low`` and the interval's width are kept for each lane. A step's leading and straddled bits leave together.
    """

    def __init__(self, table: Sequence[int]) -> None:
        upto = np.asarray(table, np.int64)
        freq = np.diff(upto, prepend=0)
        if len(upto) > 256 or upto[-1] > LANE_TOTAL or freq.min() < 1:
            raise ValueError(f"a table of bytes has frequencies from 1 and a total of {LANE_TOTAL} at most")
        self.upto, self.below, self.total = upto.astype(np.float64), (upto - freq).astype(np.float64), float(upto[-1])
        self.cost = np.log2(self.total / freq)
        self.symbol_of = np.repeat(np.arange(len(upto), dtype=np.uint8), freq)

    def _step(self, low: np.ndarray, span: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
        """low and span after the symbols s, what low grew by, and the numbers of leading and of straddled bits."""
        first = np.floor(span * self.below[s] / self.total)
        width = (np.floor(span * self.upto[s] / self.total) - first).astype(np.int64)
        grown = first.astype(np.int64)
        low = low + grown
        high = low + (width - 1)
        # the exponent of a whole number in float64 tells its bits
        n = 1054 - ((low ^ high).astype(np.float64).view(np.int64) >> 52)
        m = 1054 - ((~((low & ~high) << (n + 1)) & TOP).astype(np.float64).view(np.int64) >> 52)
        k = n + m
        return (low << k) & (HALF - 1), (width << k).astype(np.float64), grown, n, m

    def encode(self, parts: Sequence[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(parts)
        order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
        for at in range(0, len(order), LANES):
            own = order[at : at + LANES]
            for i, c in zip(own, self._encode([parts[i] for i in own])):
                out[i] = c
        return out

    def _encode(self, parts: list[bytes]) -> list[bytes]:
        lanes, sizes = len(parts), np.array([len(p) for p in parts])
        steps = int(sizes[0])
        symbols = np.zeros((lanes, steps), np.uint8)
        for row, p in zip(symbols, parts):
            row[: len(p)] = np.frombuffer(p, np.uint8)
        # an interval is rounded by less than 2**-10 of itself, that is 0.002 bits a step
        bits = max((float(self.cost[row[:n]].sum()) for row, n in zip(symbols, sizes)), default=0.0) + 0.002 * steps
        symbols = np.ascontiguousarray(symbols.T)
        # the code is the sum of all that low grew by, each at its place: digits of 32 bits, carried at the end
        digits = np.zeros((int(bits) // 32 + 5, lanes), np.int64)
        flat, place = digits.reshape(-1), np.arange(lanes)
        shifted, straddled = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        low, span = np.zeros(lanes, np.int64), np.full(lanes, float(TOP + 1))
        live = np.searchsorted(-sizes, -np.arange(steps), "left")
        for s, go in zip(symbols, live.tolist()):
            low, span, grown, n, m = self._step(low[:go], span[:go], s[:go])
            done, late = shifted[:go], straddled[:go]
            rest = done & 31
            at = (done >> 5) * lanes + place[:go]
            flat[at] += grown >> rest
            at += lanes
            flat[at] += (grown << (32 - rest)) & TOP
            late *= n == 0
            late += m
            done += n + m
        for k in range(len(digits) - 1, 0, -1):
            digits[k - 1] += digits[k] >> 32
        # straddled bits are not flushed: a 1 bit follows what is decided
        ends = shifted - straddled
        raw = np.ascontiguousarray((digits & TOP).T.astype(">u4")).view(np.uint8).reshape(lanes, -1)
        last, spare = ends >> 3, ends & 7
        rows = np.arange(lanes)
        raw[rows, last] = (raw[rows, last] & (0xFF00 >> spare) & 0xFF) | (0x80 >> spare)
        return [r[: n + 1].tobytes() for r, n in zip(raw, last.tolist())]

    def decode(self, coded: Sequence[bytes], sizes: Sequence[int]) -> list[bytes]:
        out: list[bytes] = [b""] * len(coded)
        order = sorted(range(len(coded)), key=lambda i: -sizes[i])
        for at in range(0, len(order), LANES):
            own = order[at : at + LANES]
            for i, p in zip(own, self._decode([coded[i] for i in own], np.array([sizes[i] for i in own]))):
                out[i] = p
        return out

    def _decode(self, coded: list[bytes], sizes: np.ndarray) -> list[bytes]:
        lanes, steps = len(coded), int(sizes[0])
        # zeros stand past the end of each, as far as a window of eight bytes may look
        wide = max(map(len, coded)) + 16
        data = np.frombuffer(b"".join(c.ljust(wide, b"\0") for c in coded), np.uint8)
        words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        place, most = np.arange(lanes) * wide, wide - 8
        at = np.full(lanes, 32)
        low, span = np.zeros(lanes, np.int64), np.full(lanes, float(TOP + 1))
        # the code is kept as its distance from low
        code = (words[place].byteswap() >> np.uint64(32)).astype(np.int64)
        found = np.zeros((steps, lanes), np.uint8)
        live = np.searchsorted(-sizes, -np.arange(steps), "left")
        for s, go in zip(found, live.tolist()):
            s, span = s[:go], span[:go]
            s[:] = self.symbol_of[np.floor(((code[:go] + 1) * self.total - 1) / span).astype(np.int64)]
            low, span, grown, n, m = self._step(low[:go], span, s)
            k, at = n + m, at[:go]
            window = words[place[:go] + np.minimum(at >> 3, most)].byteswap() << (at & 7).view(np.uint64)
            code = ((code[:go] - grown) << k) | (window >> (64 - k).view(np.uint64)).view(np.int64)
            at = at + k
        return [r[:n].tobytes() for r, n in zip(np.ascontiguousarray(found.T), sizes.tolist())]


def encode_column(symbols: Column, table: Column) -> Column:
    """Column of symbol arrays and inclusive tables -> coded bytes."""

    @F.pandas_udf("binary")
    def run(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([encode_symbols(np.asarray(b).tolist(), np.asarray(a).tolist()) for a, b in zip(s, t)], dtype=object)

    return run(symbols, table)


def decode_column(data: Column, table: Column, n: Column) -> Column:
    @F.pandas_udf("array<int>")
    def run(d: pd.Series, t: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([decode_symbols(np.asarray(b), bytes(a), int(c)) for a, b, c in zip(d, t, k)], dtype=object)

    return run(data, table, n)


def encode_spans(below: list[int], upto: list[int], total: int) -> bytes:
    """Coded bytes of symbols given as spans of one total: :class:`Encoder`'s arithmetic in one loop.

    All leading bits that low and high share leave at once, and so do all straddled ones.
    """
    low, high, straddled = 0, TOP, 0
    value, bits, out = 0, 0, bytearray()
    for b, u in zip(below, upto):
        span = high - low + 1
        high = low + span * u // total - 1
        low += span * b // total
        n = 32 - (low ^ high).bit_length()
        if n:
            top = low >> (32 - n)
            if straddled:
                # the first bit, as many opposite bits, and the rest
                first = top >> (n - 1)
                value = (((value << 1) | first) << straddled) | (0 if first else (1 << straddled) - 1)
                value = (value << (n - 1)) | (top & ((1 << (n - 1)) - 1))
                bits += straddled + n
                straddled = 0
            else:
                value = (value << n) | top
                bits += n
            low = (low << n) & TOP
            high = ((high << n) & TOP) | ((1 << n) - 1)
            if bits >= 256:
                spare = bits & 7
                out += (value >> spare).to_bytes(bits >> 3, "big")
                value &= (1 << spare) - 1
                bits = spare
        # low begins 01..., high 10...: as many bits straddle as low's ones and high's zeros go on after the first
        while low >= QUARTER and high < HALF + QUARTER:
            straddled += 1
            low = (low - QUARTER) << 1
            high = ((high - QUARTER) << 1) | 1
    value, bits = (value << 1) | 1, bits + 1
    pad = -bits % 8
    return bytes(out) + (value << pad).to_bytes((bits + pad) >> 3, "big")


def batches_of(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, most):
        yield batch.slice(k, most)
