"""Model files: configuration, loading and export."""

from __future__ import annotations

import json

import numpy as np

from ..functions.tables import SOFTMAX_COEF, check_exp2, check_rope, exp2_values, rope_values
from ..operators.distribution import target_total
from ..operators.kernels import HEAD_DIM, Layer, Weights
from ..operators.vocabulary import Vocabulary
from .tensors import Tensor, TensorFileError, build, of_array, parse

FORMAT = "czip-model-v1"
#: What a file's metadata need not say.
DEFAULTS = {"vocab_size": 1024, "n_layers": 1, "n_heads": 6, "n_kv_heads": 1, "d_model": 384, "d_ff": 1024, "head_dim": 64, "max_seq_len": 64, "rope_theta_q16": 655360000}
NORMS = ("attn_norm", "post_attn_norm", "ffn_norm", "post_ffn_norm")
MATRICES = {"qkv": "attn.qkv", "out": "attn.out", "up": "ffn.up", "down": "ffn.down"}


def config_of(metadata: dict[str, str]) -> dict:
    """Configuration from metadata: flat keys, or one JSON text under ``config``; unreadable numbers count as unset."""
    flat = dict(metadata)
    if "config" in flat:
        flat = {**{k: str(v) for k, v in json.loads(flat["config"]).items()}, **flat}

    def number(key: str) -> int | None:
        try:
            return int(flat[key])
        except (KeyError, ValueError):
            return None

    out = {k: v if (n := number(k)) is None else n for k, v in DEFAULTS.items()}
    log2 = number("context_length_log2")
    explicit = number("context_length")
    out["context_length"] = explicit if explicit is not None else 1 << log2 if log2 is not None else out["max_seq_len"]
    out["tokenizer_codec"] = flat.get("tokenizer_codec", "zstd").strip('"')
    out["format"] = flat.get("format", "")
    return out


def decompress(raw: bytes, codec: str) -> bytes:
    """A compressed blob; zstd frames need not state their size."""
    if codec in ("zstd", ""):
        import zstandard

        with zstandard.ZstdDecompressor().stream_reader(raw) as r:
            return r.read()
    if codec in ("brotli", "br"):
        return brotli().decompress(raw)
    if codec in ("none", "raw"):
        return raw
    raise ValueError(f"unknown codec {codec}")


def brotli():
    try:
        import brotli as found
    except ImportError:
        raise RuntimeError("the brotli codec needs the brotli package, which is not installed") from None
    return found


def load(raw: bytes) -> Weights:
    """Weights from a tensor file's bytes."""
    tensors, metadata = parse(raw)
    c = config_of(metadata)

    def need(name: str, *kinds: str) -> np.ndarray:
        if name not in tensors:
            raise TensorFileError(f"tensor {name} is missing")
        return tensors[name].array(*kinds)

    def scalar(name: str, default: int) -> int:
        return int(tensors[name].array().reshape(-1)[0]) if name in tensors else default

    embed = need("embed.weight", "I8")
    vocab = c["vocab_size"]
    if c["d_model"] == 0:
        c["d_model"] = embed.size // vocab
    d = c["d_model"]
    if c["head_dim"] != HEAD_DIM or d % HEAD_DIM or d // HEAD_DIM not in (4, 6, 8):
        raise TensorFileError(f"{d} entries do not make 4, 6 or 8 heads of {HEAD_DIM}")
    layers = []
    for i in range(c["n_layers"]):
        p = f"layers.{i}."
        sink = tensors.get(f"{p}attn.sink_key")
        layers.append(
            Layer(
                **{n: need(f"{p}{n}.weight", "I8").astype(np.int64) for n in NORMS},
                **{n: need(f"{p}{m}.weight", "I8").reshape(rows, -1) for (n, m), rows in zip(MATRICES.items(), (d + 2 * HEAD_DIM, d, 2 * c["d_ff"], d))},
                scales={n: (scalar(f"{p}{m}.mult", 1), scalar(f"{p}{m}.shift", 0)) for n, m in MATRICES.items()},
                score_mult=need(f"{p}attn.score_mult", "I32").astype(np.int64),
                sink_key=None if sink is None else sink.array("I8").astype(np.int64),
                extra={"score_shift": scalar(f"{p}attn.score_shift", 15)},
            )
        )
    check_exp2(need("lut.exp2", "U16"))
    if not np.array_equal(need("lut.exp2", "U16"), exp2_values()):
        raise TensorFileError("the exponential table differs from the one that is built in")
    cos, sin = check_rope(need("lut.rope_cos", "I16"), need("lut.rope_sin", "I16"), c["context_length"])
    blob = tensors.get("tokenizer.data")
    return Weights(
        c, embed.reshape(vocab, d).astype(np.int64), layers, need("norm.weight", "I8").astype(np.int64), need("head.weight", "I8").reshape(vocab, d), cos, sin,
        scalar("softmax.coef_q24", SOFTMAX_COEF), scalar("softmax.target_total", target_total(vocab)), None if blob is None else decompress(blob.data, c["tokenizer_codec"]),
    )


def vocabulary_of(w: Weights) -> Vocabulary:
    """The embedded vocabulary."""
    if w.tokenizer is None:
        raise ValueError("the model has no embedded vocabulary")
    return Vocabulary.from_json(w.tokenizer)


def export(w: Weights, compress_vocabulary: bool = True) -> bytes:
    """A tensor file with flat metadata, which :func:`load` reads back."""
    c = w.config
    tensors = [of_array("embed.weight", w.embed.astype(np.int8)), of_array("norm.weight", w.norm.astype(np.int8)), of_array("head.weight", w.head.astype(np.int8))]
    for i, layer in enumerate(w.layers):
        p = f"layers.{i}."
        tensors += [of_array(f"{p}{n}.weight", getattr(layer, n).astype(np.int8)) for n in NORMS]
        for n, m in MATRICES.items():
            mult, shift = layer.scales[n]
            tensors += [of_array(f"{p}{m}.weight", getattr(layer, n).astype(np.int8)), of_array(f"{p}{m}.mult", np.array([mult], np.int32)), of_array(f"{p}{m}.shift", np.array([shift], np.int8))]
        tensors += [of_array(f"{p}attn.score_mult", layer.score_mult.astype(np.int32)), of_array(f"{p}attn.score_shift", np.array([15], np.int8))]
        if layer.sink_key is not None:
            tensors.append(of_array(f"{p}attn.sink_key", layer.sink_key.astype(np.int8)))
    tensors += [of_array("lut.exp2", exp2_values().astype(np.uint16)), of_array("lut.rope_cos", w.cos.astype(np.int16)), of_array("lut.rope_sin", w.sin.astype(np.int16))]
    tensors += [of_array("softmax.coef_q24", np.array([w.coef], np.uint32)), of_array("softmax.target_total", np.array([w.total or target_total(w.vocab)], np.uint32))]
    metadata = {"format": FORMAT, "tokenizer_codec": "zstd" if compress_vocabulary else "none"} | {k: str(v) for k, v in c.items() if k in DEFAULTS or k == "context_length"}
    if w.tokenizer is not None:
        blob = w.tokenizer
        if compress_vocabulary:
            import zstandard

            blob = zstandard.ZstdCompressor(level=19).compress(blob)
        tensors.append(Tensor("tokenizer.data", "U8", (len(blob),), blob))
    return build(tensors, metadata)


def verify(raw: bytes) -> dict:
    """What a file holds: configuration, number of tensors, elements in all, and whether it loads."""
    tensors, metadata = parse(raw)
    w = load(raw)
    return {"config": config_of(metadata), "tensors": len(tensors), "elements": sum(t.elements for t in tensors.values()), "vocabulary": w.tokenizer is not None}


def integers(n: int, seed: int, low: int, high: int) -> np.ndarray:
    """n integers from low to high of a linear congruential sequence, the same on every machine."""
    state = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(6364136223846793005) + np.uint64(seed * 1442695040888963407 % (1 << 64))
    for _ in range(2):
        state ^= state >> np.uint64(33)
        state *= np.uint64(0xFF51AFD7ED558CCD)
    state ^= state >> np.uint64(29)
    return low + ((state >> np.uint64(11)) % np.uint64(high - low + 1)).astype(np.int64)


def small_vocabulary(size: int = 1022, bos: int = 1022) -> Vocabulary:
    """All bytes, then pairs and triples of frequent letters in a fixed order; two special tokens."""
    ranks = {bytes([b]): b for b in range(256)}
    letters = b" etaoinshrdlucmfwygpbvk"
    pairs = [bytes([a, b]) for a in letters for b in letters if b != 0x20]
    triples = [p + bytes([c]) for p in (b"th", b" t", b"he", b"in", b"er", b"on", b"an", b"re", b"at", b"en", b"nd", b" a", b" o") for c in letters[1:]]
    for t in [*pairs, *triples]:
        if len(ranks) < size:
            ranks.setdefault(t, len(ranks))
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return Vocabulary(ranks, {"<|bos|>": bos, "<|endoftext|>": bos + 1}, pattern, "small")


def fixture(vocab: int = 1024, heads: int = 4, d_ff: int = 128, context: int = 1024, layers: int = 1, sink: bool = True, seed: int = 7) -> Weights:
    """A model of seeded integers whose activations neither vanish nor saturate."""
    d = heads * HEAD_DIM

    def matrix(rows: int, cols: int, k: int) -> np.ndarray:
        return integers(rows * cols, seed * 1000 + k, -20, 20).reshape(rows, cols).astype(np.int8)

    def norm(k: int) -> np.ndarray:
        return integers(d, seed * 1000 + k, 30, 60)

    made = [
        Layer(
            *[norm(100 * i + 10 + j) for j in range(4)],
            qkv=matrix(d + 2 * HEAD_DIM, d, 100 * i + 1), out=matrix(d, d, 100 * i + 2), up=matrix(2 * d_ff, d, 100 * i + 3), down=matrix(d, d_ff, 100 * i + 4),
            scales={"qkv": (77, 12), "out": (61, 10), "up": (77, 12), "down": (101, 12)},
            score_mult=integers(heads, seed * 1000 + 100 * i + 5, 8000, 30000), sink_key=integers(HEAD_DIM, seed * 1000 + 100 * i + 6, -40, 40) if sink else None,
        )
        for i in range(layers)
    ]
    cos, sin = rope_values(context)
    config = DEFAULTS | {"vocab_size": vocab, "n_layers": layers, "n_heads": heads, "d_model": d, "d_ff": d_ff, "context_length": context, "max_seq_len": context}
    embed = integers(vocab * d, seed * 1000 + 900, -90, 90).reshape(vocab, d)
    return Weights(config, embed, made, norm(901), matrix(vocab, d, 902), cos, sin, SOFTMAX_COEF, target_total(vocab), small_vocabulary(min(1022, vocab - 2), min(1022, vocab - 2)).to_json().encode())
