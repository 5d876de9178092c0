"""The integer transformer as vectorised NumPy over batches of chunks.

Encoding knows all inputs, so a whole batch of chunks goes through each layer at once; decoding advances all
chunks of a batch by one position per step, with cached keys and values. Both give the same integers.

Values are whole numbers held in floating types, which vector units handle best: float32 for 8-bit vectors and their
products, float64 for scores and the fold over keys. Sums are exact, ``rint`` rounds half to even, and a quotient of
two of them is rounded by far less than its distance from a tie or a whole number. A product beyond 2**24 may be
rounded in float32 only where it is clamped afterwards either way. Large multipliers go through int64.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..functions.tables import ATTENTION_COEF, SOFTMAX_COEF, exp_by_float
from .distribution import cumulative_values, symbol_spans, symbols_at, target_total

HEAD_DIM = 64
#: A float32 product sum is exact below 2**24, that is up to this many terms of two 8-bit factors.
EXACT_TERMS = 1040
EXACT = 1 << 53
#: Rows of a chunk (heads by queries) that attention takes at once, so that early queries leave late keys out.
FEW_ROWS = 64
#: Multipliers and shifts with which float32 requantises: beyond 2**24 a product is clamped after any such shift.
FLOAT_MULT, FLOAT_SHIFT = 1 << 24, 16
#: Scores that attention takes at once: their arrays stay in the caches.
FOLD_SCORES = 1 << 14
#: Places of a table of all groups by all keys up to which one product sums them (8 bytes each).
FOLD_ENTRIES = 1 << 21


def rne(x: np.ndarray, shift: int) -> np.ndarray:
    """x / 2**shift, half to even, for int64 or whole numbers in float64."""
    if shift <= 0:
        return x
    if shift >= 32:
        return np.zeros_like(x)
    if x.dtype.kind == "f":
        out = x * x.dtype.type(2.0**-shift)
        return np.rint(out, out=out)
    # just under a half is added, and one more where the result would be odd
    return (x + ((x >> shift) & 1) + ((1 << (shift - 1)) - 1)) >> shift


def clamp8(x: np.ndarray) -> np.ndarray:
    out = np.maximum(x, -127)
    return np.minimum(out, 127, out=out)


def clamp32(x: np.ndarray) -> np.ndarray:
    out = np.maximum(x, -(1 << 31))
    return np.minimum(out, (1 << 31) - 1, out=out)


def float_matrix(w: np.ndarray) -> np.ndarray:
    """The transpose of an 8-bit matrix in a floating type whose product sums are exact."""
    return np.ascontiguousarray(w.T, np.float32 if w.shape[1] <= EXACT_TERMS else np.float64)


def requantize(x: np.ndarray, mult: int, shift: int) -> np.ndarray:
    return clamp8(x * mult if shift <= 0 else clamp32(rne(x * mult, shift)))


def product(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """x times a :func:`float_matrix`: whole numbers in its floating type."""
    return (x.reshape(-1, x.shape[-1]).astype(table.dtype, copy=False) @ table).reshape(*x.shape[:-1], table.shape[1])


def _rounded8(x: np.ndarray) -> np.ndarray:
    """x itself, rounded and clamped in place."""
    np.rint(x, out=x)
    return np.clip(x, -127, 127, out=x)


def rms_norm(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Rows of 8-bit values, normalised, in their floating type."""
    x = np.asarray(x, x.dtype if x.dtype.kind == "f" else np.float64)
    squares = np.einsum("...i,...i->...", x, x).astype(np.float64)[..., None] if x.shape[-1] <= EXACT_TERMS else (x.astype(np.float64) ** 2).sum(axis=-1, keepdims=True)
    ms = np.maximum(1, np.floor(squares / x.shape[-1]) + 1)
    inv = np.clip(np.rint(8388608 / np.floor(np.sqrt(ms * 65536))), 1, 32768)
    out = x * weight.astype(x.dtype)
    out *= (inv * 2.0**-15).astype(x.dtype)
    return _rounded8(out)


def reglu(gate: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = np.maximum(gate, 0) * value
    return _rounded8(out * out.dtype.type(2.0**-7)) if out.dtype.kind == "f" else clamp8(rne(out, 7))


def rotate(x: np.ndarray, cos: np.ndarray, sin: np.ndarray, again: int) -> np.ndarray:
    """Rotary positions over the last axis of 64 floating values; ``again`` more bits are rounded off (1 for queries)."""
    a, b, cos, sin = x[..., :32], x[..., 32:], cos.astype(x.dtype), sin.astype(x.dtype)
    out = np.empty(x.shape, x.dtype)
    np.subtract(a * cos, b * sin, out=out[..., :32])
    np.add(a * sin, b * cos, out=out[..., 32:])
    out *= out.dtype.type(2.0**-15)
    np.rint(out, out=out)
    if again:
        out *= out.dtype.type(2.0**-again)
    return _rounded8(out)


def _rescale(acc: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """acc * factor / 2**16, in place: half a unit away from zero, then down."""
    acc *= factor * 2.0**-16
    acc += 0.0  # a negative zero counts as zero
    acc += np.copysign(0.5, acc)
    return np.floor(acc, out=acc)


def _fold_at_once(total: np.ndarray, weight: np.ndarray, scale: np.ndarray, fresh: np.ndarray, group: np.ndarray, v: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_fold` with each group of a row as an entry of its chunk: one product sums all entries, which are then folded."""
    chunks, rows, keys = weight.shape
    # what stands before the first key is a sum of no values: where that key is fresh, only the total is rescaled
    begun = fresh[..., 0]
    total[begun] = np.floor((total[begun] * scale[begun, 0] + 32768) * 2.0**-16)
    most = group[..., -1] - begun + 1
    base = np.cumsum(most, axis=1) - most
    n = int((base[:, -1] + most[:, -1]).max(initial=1))
    # the place of every key's group among all entries
    base += n * np.arange(chunks)[:, None]
    entry = group + (base - begun)[..., None]
    parts = np.zeros((chunks, n, keys))
    parts.reshape(-1)[entry * keys + np.arange(keys)] = weight
    sums = parts.sum(axis=-1).reshape(-1)
    values = (parts @ v).reshape(-1, HEAD_DIM)
    factors = np.zeros(chunks * n)
    factors[entry[fresh]] = scale[fresh] * 2.0**-16
    most, base = most.reshape(-1), base.reshape(-1)
    # rows stand in order of how many groups they have, so that each step takes the first ones
    order = np.argsort(-most, kind="stable")
    counts, at = most[order], base[order]
    total, acc = total.reshape(-1)[order] + sums[at], values[at]
    acc += 0.0  # a negative zero counts as zero, and none comes up later
    spare = np.empty_like(acc)
    for g in range(1, int(counts[0]) if len(counts) else 0):
        live = int(np.searchsorted(-counts, -g, "left"))
        now, own, more = at[:live] + g, acc[:live], spare[:live]
        f = factors[now]
        total[:live] = np.floor(total[:live] * f + 0.5) + sums[now]
        own *= f[:, None]
        own += np.copysign(0.5, own, out=more)
        np.floor(own, out=own)
        own += np.take(values, now, axis=0, out=more, mode="clip")
    whole, out = np.empty_like(total), np.empty_like(acc)
    whole[order], out[order] = total, acc
    return whole.reshape(chunks, rows), out.reshape(chunks, rows, HEAD_DIM)


def _fold(total: np.ndarray, weight: np.ndarray, scale: np.ndarray, fresh: np.ndarray, group: np.ndarray, v: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weights (chunk, row) and of weighted values (chunk, row, 64), group by group from ``first`` on.

    Rows stand in order of how many groups they have, so that each group takes a slice of all chunks.
    """
    most = group[..., -1]
    order = np.argsort(-most, axis=1, kind="stable")
    live = np.take_along_axis(most, order, 1)
    weight, group = (np.take_along_axis(x, order[..., None], 1) for x in (weight, group))
    total = np.take_along_axis(total, order, 1)
    acc = np.zeros((*total.shape, HEAD_DIM))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None], 1)
    factors = np.zeros((*total.shape, int(live.max(initial=0)) + 1))
    c, row, key = np.nonzero(fresh)
    sorted_row = place[c, row]
    factors[c, sorted_row, group[c, sorted_row, key]] = scale[c, row, key]
    for g in range(first, factors.shape[2]):
        n = int((live >= g).sum(axis=1).max(initial=0))
        if g > first:
            f = factors[:, :n, g]
            has = f > 0
            total[:, :n] = np.where(has, np.floor((total[:, :n] * f + 32768) * 2.0**-16), total[:, :n])
            acc[:, :n] = np.where(has[..., None], _rescale(acc[:, :n].copy(), f[..., None]), acc[:, :n])
        part = np.where(group[:, :n] == g, weight[:, :n], 0.0)
        total[:, :n] += part.sum(axis=-1)
        acc[:, :n] += part @ v
    return np.take_along_axis(total, place, 1), np.take_along_axis(acc, place[..., None], 1)


def attend(q: np.ndarray, k: np.ndarray, v: np.ndarray, mult: np.ndarray, first: int, sink: np.ndarray | None) -> np.ndarray:
    """Causal attention with one key-value head.

    q is (chunk, head, query, 64), k and v (chunk, key, 64); query j stands at position first + j. The fold over
    keys rounds whenever a new maximum appears and is a plain sum between: keys are grouped by the maximum
    in force, and the groups are folded in order, so the roundings are those of the key-by-key fold.
    """
    chunks, heads, queries, _ = q.shape
    out = np.empty(q.shape, np.float32)
    step = max(1, FEW_ROWS // heads)
    for at in range(0, queries, step):
        # a query needs no keys beyond its block's
        stop = min(at + step, queries)
        keys = first + stop
        size = max(1, FOLD_SCORES // (heads * (stop - at) * keys))
        for c in range(0, chunks, size):
            part = slice(c, c + size)
            out[part, :, at:stop] = _attend(q[part, :, at:stop], k[part, :keys], v[part, :keys], mult, first + at, sink)
    return out


def _attend(q: np.ndarray, k: np.ndarray, v: np.ndarray, mult: np.ndarray, first: int, sink: np.ndarray | None) -> np.ndarray:
    """:func:`attend` for chunks whose scores stay in the caches."""
    chunks, heads, queries, _ = q.shape
    keys = k.shape[1]
    rows = heads * queries
    m = np.repeat(np.asarray(mult, np.float64) * 2.0**-15, queries)[:, None]
    flat = q.reshape(chunks, rows, HEAD_DIM).astype(np.float32, copy=False)
    # the running maximum before each key and after the last
    running = np.empty((chunks, rows, keys + 1))
    score = (flat @ k.astype(np.float32, copy=False).transpose(0, 2, 1)).astype(np.float64)
    score *= 0.25
    np.rint(score, out=score)
    score *= m
    np.rint(score, out=score)
    np.clip(score, -(1 << 31), (1 << 31) - 1, out=score)
    lowest = -float(1 << 40)
    unseen = None
    if queries > 1:
        unseen = np.tile(np.arange(keys)[None, :] > first + np.arange(queries)[:, None], (heads, 1))
        np.copyto(score, lowest, where=unseen)
    if sink is None:
        running[..., 0] = lowest
        total = np.zeros((chunks, rows))
    else:
        own = (flat @ np.asarray(sink, np.float32)).astype(np.float64)
        running[..., 0] = clamp32(np.rint(np.rint(own * 0.25) * m[:, 0]))
        total = np.full((chunks, rows), 65535.0)
    running[..., 1:] = score
    np.maximum.accumulate(running, axis=-1, out=running)
    before, now = running[..., :-1], running[..., 1:]
    fresh = now > before
    group = np.cumsum(fresh, axis=-1, dtype=np.int64)
    weight = exp_by_float(np.subtract(now, score, out=score), ATTENTION_COEF)
    if unseen is not None:
        np.copyto(weight, 0.0, where=unseen)
    # the factor that each new maximum puts on what is summed so far
    scale = np.zeros(fresh.shape)
    scale[fresh] = exp_by_float(now[fresh] - before[fresh], ATTENTION_COEF)
    start = 0 if sink is not None else 1
    entries = int((group[..., -1] + 1).sum(axis=1).max(initial=0)) * chunks * keys
    fold = _fold_at_once if rows <= FEW_ROWS and entries <= FOLD_ENTRIES else _fold
    total, acc = fold(total, weight, scale, fresh, group, v.astype(np.float64, copy=False), start)
    acc /= np.maximum(total, 1.0)[..., None]
    return _rounded8(acc).reshape(chunks, heads, queries, HEAD_DIM)


@dataclass
class Layer:
    """Weights of one layer; each matrix has its (mult, shift)."""

    attn_norm: np.ndarray
    post_attn_norm: np.ndarray
    ffn_norm: np.ndarray
    post_ffn_norm: np.ndarray
    qkv: np.ndarray
    out: np.ndarray
    up: np.ndarray
    down: np.ndarray
    scales: dict[str, tuple[int, int]]
    score_mult: np.ndarray
    sink_key: np.ndarray | None = None
    extra: dict = field(default_factory=dict)

    def times(self, x: np.ndarray, name: str) -> np.ndarray:
        """x through the matrix of a name, requantised; the floating form of the matrix is made once."""
        if name not in self.extra:
            self.extra[name] = float_matrix(getattr(self, name))
        mult, shift = self.scales[name]
        sums = product(x, self.extra[name])
        if sums.dtype == np.float32 and abs(mult) < FLOAT_MULT and 0 < shift <= FLOAT_SHIFT:
            sums *= np.float32(mult * 2.0**-shift)
            return _rounded8(sums)
        small = len(self.extra[name]) * 127 * 127 * abs(mult) < EXACT
        return requantize(sums.astype(np.float64 if small else np.int64), mult, shift).astype(np.float32)


@dataclass
class Weights:
    config: dict
    embed: np.ndarray
    layers: list[Layer]
    norm: np.ndarray
    head: np.ndarray
    cos: np.ndarray
    sin: np.ndarray
    coef: int = SOFTMAX_COEF
    total: int | None = None
    tokenizer: bytes | None = None
    extra: dict = field(default_factory=dict)

    def logits(self, x: np.ndarray) -> np.ndarray:
        if "head" not in self.extra:
            self.extra["head"] = float_matrix(self.head)
        return product(x, self.extra["head"])

    @property
    def vocab(self) -> int:
        return self.head.shape[0]

    @property
    def width(self) -> int:
        return self.embed.shape[1]


class Runner:
    """Runs a batch of chunks through the layers, keeping keys and values between calls."""

    def __init__(self, w: Weights, chunks: int, length: int) -> None:
        self.w = w
        self.keys = [np.zeros((chunks, length, HEAD_DIM), np.float32) for _ in w.layers]
        self.values = [np.zeros((chunks, length, HEAD_DIM)) for _ in w.layers]

    def first_qkv(self) -> np.ndarray:
        """The first layer's qkv of every token: before any attention they are the token's own."""
        if "first_qkv" not in self.w.extra:
            layer = self.w.layers[0]
            self.w.extra["first_qkv"] = layer.times(rms_norm(clamp8(self.w.embed.astype(np.float32)), layer.attn_norm), "qkv")
        return self.w.extra["first_qkv"]

    def forward(self, tokens: np.ndarray, first: int = 0) -> np.ndarray:
        """Logits (chunk, position, vocabulary), whole numbers of a floating type, for tokens (chunk, position) at positions from ``first`` on."""
        w = self.w
        chunks, n = tokens.shape
        d, heads = w.width, w.width // HEAD_DIM
        cos, sin = w.cos[first : first + n], w.sin[first : first + n]
        x = w.embed[tokens].astype(np.float32)
        for i, layer in enumerate(w.layers):
            qkv = layer.times(rms_norm(clamp8(x), layer.attn_norm), "qkv") if i else self.first_qkv()[tokens]
            q = qkv[..., :d].reshape(chunks, n, heads, HEAD_DIM).transpose(0, 2, 1, 3)
            self.keys[i][:, first : first + n] = rotate(qkv[..., d : d + HEAD_DIM], cos, sin, 0)
            self.values[i][:, first : first + n] = qkv[..., d + HEAD_DIM : d + 2 * HEAD_DIM]
            a = attend(rotate(q, cos, sin, 1), self.keys[i][:, : first + n], self.values[i][:, : first + n], layer.score_mult, first, layer.sink_key)
            a = a.transpose(0, 2, 1, 3).reshape(chunks, n, d)
            x = x + rms_norm(layer.times(a, "out"), layer.ffn_norm)
            up = layer.times(rms_norm(clamp8(x), layer.post_attn_norm), "up")
            half = up.shape[-1] // 2
            down = layer.times(reglu(up[..., :half], up[..., half:]), "down")
            x = x + rms_norm(down, layer.post_ffn_norm)
        return w.logits(rms_norm(clamp8(x), w.norm))

    def tables(self, tokens: np.ndarray, first: int = 0) -> np.ndarray:
        """Inclusive cumulative tables (chunk, position, vocabulary)."""
        logits = self.forward(tokens, first)
        flat = cumulative_values(logits.reshape(-1, logits.shape[-1]), self.w.coef, self.w.total)
        return flat.reshape(logits.shape)

    def spans(self, tokens: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """What an encoder needs of the tables: sums below and up to each symbol (chunk, position), and the total."""
        logits = self.forward(tokens)
        below, upto, total = symbol_spans(logits.reshape(-1, logits.shape[-1]), symbols.ravel(), self.w.coef, self.w.total)
        return below.reshape(symbols.shape), upto.reshape(symbols.shape), total

    def find(self, tokens: np.ndarray, first: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a decoder needs of one position's tables: the symbol that holds each chunk's value, and the sums below and up to it."""
        return symbols_at(self.forward(tokens, first)[:, 0], values, self.w.coef, self.total)

    @property
    def total(self) -> int:
        """The last entry of every table."""
        return target_total(self.w.vocab) if self.w.total is None else self.w.total
