"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be joined by a merge, so the place between
the two bytes is a certain cut, provided that the pre-tokenizer reads both sides alike when they stand alone:
text on either side is encoded independently and the ids are concatenated. Texts are cut before spaces that
follow no white space, since no token has such a pair. What is long even so (text without spaces, such as code,
addresses or Chinese) is cut at every forced pair of the table, so that fragments stay short whatever the text.
Fragments repeat heavily, so each worker keeps a bounded memo of fragment -> packed ids, and only
fragments that are not in it are encoded.

Results by case: null text is encoded as the empty text (no ids); empty text has no ids and decodes to
the empty text; a text of any length is cut into fragments and never truncated; every input row gives one
output row, so repeated rows repeat; extra input columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import ship_package, tidy

#: Fragments kept in a worker's memo, and the longest fragment that is kept.
MEMO_FRAGMENTS = 150_000
MEMO_CHARS = 48
#: Characters from which a fragment is cut at all its forced pairs.
FINE_CHARS = 24

_SPACED = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S)(?= )")


def byte_of_char() -> dict[str, int]:
    """The printable stand-in characters of byte-level vocabularies, built from their rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def forced_pairs(token_bytes: list[bytes]) -> np.ndarray:
    """forced[a, b] is True where byte a directly before byte b occurs inside no token.

    A pair whose left byte ends a white-space character of two or three bytes is not counted: cuts are made
    after characters that are no white space only, where such a byte pair cannot be the one at hand.
    """
    forced = np.ones((256, 256), bool)
    for t in token_bytes:
        for k, (a, b) in enumerate(zip(t, t[1:])):
            wide = [t[max(0, k + 1 - w) : k + 1].decode("utf-8", "ignore") for w in (2, 3)]
            if a < 0x80 or not any(len(w) == 1 and w.isspace() for w in wide):
                forced[a, b] = False
    return forced


def pack(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class FragmentCodec:
    """Encoder and decoder of one byte-level vocabulary file; one per worker process."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        char = byte_of_char()
        vocab = {i: bytes(char[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        forced = forced_pairs(list(vocab.values()))
        # the cut used everywhere: before a space that follows a byte of no white space
        solid = [b for b in range(256) if b not in (0x20, *range(0x09, 0x0E))]
        self.space_is_certain = bool(forced[solid, 0x20].all()) and not spec.get("normalizer")
        # what is said of both sides of a cut holds for the usual pattern of byte-level files
        split = spec.get("pre_tokenizer") or {}
        usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.forced = forced if self.space_is_certain and usual else None
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special_has_space = any(" " in s for s in self.specials)
        for t in spec.get("added_tokens", []):
            vocab[t["id"]] = t["content"].encode()
        self.merge = self._rank_encoder(spec, vocab) if self.space_is_certain else None
        self.bytes_of = [vocab.get(i, b"") for i in range(max(vocab) + 1)]
        self.memo: dict[str, bytes] = {}

    @functools.cached_property
    def tokenizer(self):
        """The library's tokenizer, which many workers never need."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    def _rank_encoder(self, spec: dict, vocab: dict[int, bytes]):
        """A merge engine driven by ranks, where the file's merges are in the order of its ids.

        It then merges the same pairs in the same order as the library, several times faster on short
        fragments. Only plain Latin fragments go to it, where Unicode versions cannot differ.
        """
        merges = spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        ids = spec["model"]["vocab"]
        if any(ids[a + b] <= ids[p[0] + p[1]] for (a, b), p in zip(pairs[1:], pairs)):
            return None
        import public_tokenizers
        import tiktoken

        special = {t["id"] for t in spec.get("added_tokens", [])}
        ranks = {b: i for i, b in vocab.items() if i not in special}
        return tiktoken.Encoding("fragments", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def fragments(self, text: str) -> list[str]:
        """Pieces whose concatenation is the text and whose encodings concatenate to its encoding."""
        if not text:
            return []
        if not self.space_is_certain or self.special_has_space:
            return [text]
        if _SPACED.search(text):
            return _CUT.split(text)
        head, *rest = text.split(" ")
        return [head, *[" " + w for w in rest]]

    def split(self, text: str, known: dict) -> list[str]:
        """Fragments of a text: cut before spaces, and long ones that are not known finely."""
        return [p for f in self.fragments(text) for p in (self.fine(f) if len(f) >= FINE_CHARS and f not in known else (f,))]

    def encode_fragments(self, wanted: list[str]) -> list[bytes]:
        """Packed ids of each fragment, which is taken for a text of its own."""
        if self.merge is None:
            return [pack(e.ids) for e in self.tokenizer.encode_batch_fast(wanted, add_special_tokens=False)]
        merge, odd = self.merge, [f for f in wanted if self.odd(f)]
        hard = {}
        for s in byte_slices(np.array([len(f) for f in odd])):
            hard.update((f, pack(e.ids)) for f, e in zip(odd[s], self.tokenizer.encode_batch_fast(odd[s], add_special_tokens=False)))
        return [hard[f] if f in hard else pack(merge(f)) for f in wanted]

    def fine(self, fragment: str) -> list[str]:
        """A long fragment, cut at every forced pair where the pre-tokenizer sees no difference.

        It sees none after a character that is no white space (only white space looks ahead), unless the
        right side starts with an apostrophe or the cut is in reach of one (contractions are read as a whole).
        """
        if len(fragment) < FINE_CHARS or self.forced is None or any(s in fragment for s in self.specials):
            return [fragment]
        raw = np.frombuffer(fragment.encode(), np.uint8)
        head = (raw & 0xC0) != 0x80
        at = np.flatnonzero(self.forced[raw[:-1], raw[1:]] & head[1:]) + 1
        if len(raw) > len(fragment):
            at = (np.cumsum(head) - 1)[at]
        cuts = [k for k in at.tolist() if not fragment[k - 1].isspace() and fragment[k] != "'" and "'" not in fragment[max(0, k - 3) : k]]
        return [fragment[a:z] for a, z in zip([0, *cuts], [*cuts, len(fragment)])]

    def odd(self, fragment: str) -> bool:
        """Holds a special token's text, or characters whose class could depend on the Unicode version."""
        return max(fragment, default="") > "\u024f" or any(s in fragment for s in self.specials)

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian 32-bit ids of each text."""
        memo = self.memo
        parts = [self.split(t, memo) for t in texts]
        missing = list({f for p in parts for f in p} - memo.keys())
        if len(memo) + len(missing) > MEMO_FRAGMENTS:
            memo.clear()
            missing = list({f for p in parts for f in p})
        local: dict[str, bytes] = {}
        for k in range(0, len(missing), 4096):
            chunk = missing[k : k + 4096]
            for f, ids in zip(chunk, self.encode_fragments(chunk)):
                (memo if len(f) <= MEMO_CHARS else local)[f] = ids
        if local:
            return [b"".join([local[f] if f in local else memo[f] for f in p]) for p in parts]
        return [b"".join(map(memo.__getitem__, p)) for p in parts]

    def decode_packed(self, packed: bytes) -> str:
        """Text of packed ids; ids outside the vocabulary are an error, broken UTF-8 is replaced."""
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(packed, "<u4").tolist()]).decode("utf-8", "replace")


_CODECS: dict[str, FragmentCodec] = {}


def codec(path: str) -> FragmentCodec:
    if path not in _CODECS:
        _CODECS[path] = FragmentCodec(path)
    return _CODECS[path]


def byte_slices(lengths: np.ndarray, most_bytes: int = 1 << 20, most_rows: int = 1024) -> Iterator[slice]:
    """Row ranges of about equal bytes; a row above the limit stands alone."""
    k, n = 0, len(lengths)
    total = np.concatenate([[0], np.cumsum(lengths)])
    while k < n:
        stop = int(np.searchsorted(total, total[k] + most_bytes, "right")) - 1
        stop = min(max(stop, k + 1), k + most_rows, n)
        yield slice(k, stop)
        k = stop


def _narrow(df: DataFrame, key: str, text: str) -> DataFrame:
    ship_package(df.sparkSession)
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("body"))


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: the key and ``ids``, packed little-endian unsigned 32-bit integers."""
    return roundtrip(df, path, key, text, decoded=False)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row for each input row: the key and ``text`` of the packed ids (null: empty)."""
    ship_package(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            out = [c.decode_packed(x or b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["key", "text"])

    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(tidy(run), f"key {kind}, text string").withColumnRenamed("key", key)


def roundtrip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: bool = True) -> DataFrame:
    """Encode and, with ``decoded``, decode again in the same pass: key, ``ids``, ``decoded``."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            body = b.column(1).fill_null("")
            for s in byte_slices(np.asarray(pc.binary_length(body))):
                ids = c.encode_texts(body[s.start : s.stop].to_pylist())
                cols = [b.column(0)[s.start : s.stop], pa.array(ids, pa.binary())]
                if decoded:
                    cols.append(pa.array([c.decode_packed(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names)
        c.memo.clear()

    names = ["key", "ids", "decoded"][: 2 + decoded]
    schema = f"key {kind}, ids binary" + ", decoded string" * decoded
    return _narrow(df, key, text).mapInArrow(tidy(run), schema).withColumnRenamed("key", key)


def unpack_ids(packed):
    """Column of packed ids -> array<int>, with DataFrame functions only."""
    h = F.hex(packed)
    n = (F.octet_length(packed) / 4).cast("int")

    def one(i):
        at = i * 8 + 1
        return F.conv(F.concat(*[F.substr(h, at + 6 - 2 * k, F.lit(2)) for k in range(4)]), 16, 10).cast("int")

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<int>"))
