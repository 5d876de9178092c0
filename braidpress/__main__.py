"""Command line: compress, decompress, export a fixture model, verify a model file.

Whole files are read and written as bytes, so line ends and all else stay as they are.
"""

from __future__ import annotations

import argparse
import sys
import time

from .functions.tables import SOFTMAX_COEF
from .operators.chunking import level_context, to_log2
from .operators.container import Container
from .operators.vocabulary import Vocabulary
from .plans.compress import decode_chunks, encode_chunks
from .sources import model as files


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _write(path: str, data: bytes) -> None:
    with open(path, "wb") as f:
        f.write(data)


def compress(text: bytes, weights: files.Weights, vocab: Vocabulary, level: int | None = 1, codec: str = "zstd", codec_level: int | None = None, model_name: str = "") -> tuple[bytes, dict]:
    """Container bytes and figures of one text."""
    import hashlib

    began = time.time()
    size = level_context(level, weights.config["context_length"])
    ids = vocab.encode_with_special_tokens(text.decode())
    cuts = [ids[i : i + size] for i in range(0, len(ids), size)]
    box = Container(int(hashlib.md5(model_name.encode()).hexdigest()[:8], 16), context_log2=to_log2(size), codec=codec, uncompressed_len=len(text))
    for i, data in enumerate(encode_chunks(weights, cuts)):
        box.add_chunk(data, len(cuts[i]), i == len(cuts) - 1)
    out = box.to_bytes(codec_level)
    seconds = time.time() - began
    figures = {"bytes": len(text), "tokens": len(ids), "chunks": len(cuts), "compressed": len(out), "ratio": len(text) / len(out) if text else None, "bits_per_token": 8 * len(out) / len(ids) if ids else None, "seconds": seconds, "tokens_per_second": len(ids) / seconds}
    return out, figures


def decompress(raw: bytes, weights: files.Weights, vocab: Vocabulary) -> bytes:
    box = Container.from_bytes(raw)
    ids = decode_chunks(weights, box.chunks, [box.chunk_tokens(i) for i in range(len(box.chunks))])
    out = vocab.decode_bytes(t for c in ids for t in c)
    if len(out) != box.uncompressed_len:
        raise ValueError(f"{len(out)} bytes came out, but {box.uncompressed_len} went in: the model may be another one")
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="braidpress")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("compress", "decompress"):
        s = sub.add_parser(name)
        s.add_argument("input")
        s.add_argument("output")
        s.add_argument("-m", "--model", required=True)
        s.add_argument("-t", "--tokenizer")
        if name == "compress":
            s.add_argument("-L", "--level", type=int)
            s.add_argument("-c", "--codec", default="zstd", choices=["zstd", "brotli"])
            s.add_argument("--codec-level", type=int)
    s = sub.add_parser("export")
    s.add_argument("--output", required=True)
    s.add_argument("--tokenizer")
    s = sub.add_parser("verify")
    s.add_argument("model")
    a = p.parse_args(argv)
    if a.command == "export":
        w = files.fixture()
        if a.tokenizer:
            w.tokenizer = Vocabulary.load(a.tokenizer).to_json().encode()
        _write(a.output, files.export(w))
        print(f"wrote {a.output}, coefficient {SOFTMAX_COEF}")
        return 0
    if a.command == "verify":
        print(files.verify(_read(a.model)))
        return 0
    w = files.load(_read(a.model))
    vocab = Vocabulary.load(a.tokenizer) if a.tokenizer else files.vocabulary_of(w)
    if a.command == "compress":
        out, figures = compress(_read(a.input), w, vocab, a.level, a.codec, a.codec_level, a.model)
        _write(a.output, out)
        for k, v in figures.items():
            print(f"{k}: {v}")
    else:
        _write(a.output, decompress(_read(a.input), w, vocab))
    return 0


if __name__ == "__main__":
    sys.exit(main())
