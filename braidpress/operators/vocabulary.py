"""Byte-pair vocabularies: loading, encoding with special tokens, decoding, unstable completions, and the
relational forms that join pieces to a vocabulary table."""

from __future__ import annotations

import bisect
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import ship_package, tidy
from .buffers import by_bytes, flat_bytes, flat_lists, gathered, lists_of

#: Pieces of more bytes than this are merged with a heap; shorter ones by looking at all pairs. Pieces that the memo keeps.
HEAP_BYTES, MEMO_BYTES, MEMO_PIECES = 96, 64, 200_000
#: Bytes of texts that are tokenised at once.
BATCH_BYTES = 1 << 22
#: A vocabulary above this many entries is joined by shuffle instead of being sent to all executors.
BROADCAST_ENTRIES = 1_000_000


class UnknownToken(KeyError):
    """An id outside the vocabulary."""


class _Memo(dict):
    """Ids of pieces (text to ids); emptied when it is full, since later texts have other pieces."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab

    def __missing__(self, piece: str) -> list[int]:
        raw = piece.encode()
        found = self.vocab.encode_piece(raw)
        if len(raw) <= MEMO_BYTES:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = found
        return found


@dataclass
class Vocabulary:
    """Ranks of byte strings, special strings, and the pattern that parts text into pieces."""

    ranks: dict[bytes, int]
    specials: dict[str, int] = field(default_factory=dict)
    pattern: str = r"(?s)."
    name: str = ""

    def __post_init__(self) -> None:
        self.of_id = {i: b for b, i in self.ranks.items()}
        if len(self.of_id) != len(self.ranks):
            raise ValueError("two byte strings share a rank")
        self.special_of_id = {i: s.encode() for s, i in self.specials.items()}
        if self.special_of_id.keys() & self.of_id.keys() or len(self.special_of_id) != len(self.specials):
            raise ValueError("a special token shares its id")
        self.in_order = sorted(self.ranks)
        self._pieces = self._special = None
        self._memo = _Memo(self)

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("ranks", "specials", "pattern", "name")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    # --- files ---------------------------------------------------------------------------------

    @classmethod
    def from_json(cls, text: str | bytes) -> Vocabulary:
        """From the JSON form, whose keys hold one character per byte."""
        spec = json.loads(text)
        ranks = {k.encode("latin-1"): v for k, v in spec["mergeable_ranks"].items()}
        out = cls(ranks, dict(spec.get("special_tokens") or {}), spec["pat_str"], spec.get("name", ""))
        want = spec.get("explicit_n_vocab")
        if want is not None and want != len(out.ranks) + len(out.specials):
            raise ValueError(f"{len(out.ranks) + len(out.specials)} tokens, but {want} are declared")
        return out

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls.from_json(f.read())

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "pat_str": self.pattern, "mergeable_ranks": {b.decode("latin-1"): i for b, i in self.ranks.items()}, "special_tokens": self.specials, "explicit_n_vocab": len(self.ranks) + len(self.specials)})

    # --- encoding --------------------------------------------------------------------------------

    def pieces(self, text: str) -> list[str]:
        if self._pieces is None:
            import regex

            self._pieces = regex.compile(self.pattern)
        if not self._pieces.groups:
            return self._pieces.findall(text)
        return [m.group() for m in self._pieces.finditer(text)]

    def merge(self, piece: bytes) -> list[bytes]:
        """Parts after joining the adjacent pair of least rank, leftmost first, until no pair has a rank."""
        if len(piece) > HEAP_BYTES:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(self.ranks) + (1 << 40)
        score = [self.ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while score:
            best = min(score)
            if best >= none:
                break
            i = score.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del score[i]
            if i < len(score):
                score[i] = self.ranks.get(parts[i] + parts[i + 1], none)
            if i:
                score[i - 1] = self.ranks.get(parts[i - 1] + parts[i], none)
        return parts

    def _merge_long(self, piece: bytes) -> list[bytes]:
        """The same with a heap of pairs, so that a long piece without a boundary costs n log n."""
        n = len(piece)
        # a part is named by its first byte; stop is where it ends, and head finds it from its end
        stop, head = list(range(1, n + 1)), list(range(-1, n))
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            b = stop[a]
            if b < n and (rank := self.ranks.get(piece[a : stop[b]])) is not None:
                heapq.heappush(heap, (rank, a, b, stop[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            # stale unless both parts are as they were
            if stop[a] != b or stop[b] != c:
                continue
            stop[a], stop[b], head[c] = c, -1, a
            offer(a)
            if a:
                offer(head[a])
        out, a = [], 0
        while a < n:
            out.append(piece[a : stop[a]])
            a = stop[a]
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        try:
            return [self.ranks[p] for p in self.merge(piece)]
        except KeyError as e:
            raise UnknownToken(f"no token for byte {e.args[0]!r}") from None

    def split_piece(self, piece: bytes) -> list[bytes]:
        """A piece as the byte strings of its tokens."""
        return [piece] if piece in self.ranks else self.merge(piece)

    def encode_ordinary(self, text: str) -> list[int]:
        """Special strings are ordinary text."""
        return list(chain.from_iterable(map(self._memo.__getitem__, self.pieces(text))))

    def special_spans(self, text: str, allowed: Iterable[str]) -> Iterator[tuple[str, str | None]]:
        """Stretches of ordinary text, each with the allowed special string that follows it."""
        import regex

        allowed = sorted(allowed, key=len, reverse=True)
        if not allowed:
            yield text, None
            return
        at = 0
        for m in regex.finditer("|".join(map(regex.escape, allowed)), text):
            yield text[at : m.start()], m.group()
            at = m.end()
        yield text[at:], None

    def encode(self, text: str, allowed: Iterable[str] = ()) -> tuple[list[int], int]:
        """Ids, and how many of them the last piece of ordinary text has (0 after a special token)."""
        ids: list[int] = []
        last = 0
        for plain, special in self.special_spans(text, [s for s in allowed if s in self.specials]):
            pieces = self.pieces(plain)
            ids.extend(chain.from_iterable(map(self._memo.__getitem__, pieces)))
            last = len(self._memo[pieces[-1]]) if pieces else last
            if special is not None:
                ids.append(self.specials[special])
                last = 0
        return ids, last

    def encode_with_special_tokens(self, text: str) -> list[int]:
        if not any(s in text for s in self.specials):
            return self.encode_ordinary(text)
        return self.encode(text, self.specials)[0]

    # --- decoding --------------------------------------------------------------------------------

    def token_bytes(self, i: int) -> bytes:
        found = self.of_id.get(i)
        found = self.special_of_id.get(i) if found is None else found
        if found is None:
            raise UnknownToken(i)
        return found

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token_bytes, ids))

    def byte_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' bytes on end, and by id where each starts and how long it is (-1: no such id)."""
        every = self.of_id | self.special_of_id
        size = np.full(max(every, default=-1) + 1, -1, np.int64)
        size[list(every)] = [len(b) for b in every.values()]
        start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        return np.frombuffer(b"".join(every[i] for i in sorted(every)), np.uint8), start, size

    # --- unstable encoding -----------------------------------------------------------------------

    def starting_with(self, prefix: bytes) -> list[bytes]:
        """All tokens with a prefix: a range of the sorted byte strings."""
        a = bisect.bisect_left(self.in_order, prefix)
        b = a
        while b < len(self.in_order) and self.in_order[b].startswith(prefix):
            b += 1
        return self.in_order[a:b]

    def encode_unstable(self, text: str, allowed: Iterable[str] = ()) -> tuple[list[int], set[tuple[int, ...]]]:
        """Ids that further text cannot change, and the token sequences that may cover the rest."""
        ids, last = self.encode(text, allowed)
        if not last:
            return ids, set()
        blank = lambda i: not self.token_bytes(i).strip(b" \n\t")
        # a run of blank tokens before a blank last piece is as unstable as the piece
        if blank(ids[-last]):
            while last < len(ids) and blank(ids[-last - 1]):
                last += 1
        rest = self.decode_bytes(ids[len(ids) - last :])
        ids = ids[: len(ids) - last]
        found: set[tuple[int, ...]] = set()
        if not rest:
            return ids, found
        found.update((self.ranks[t],) for t in self.starting_with(rest))
        # a token may straddle the end: it begins at any later byte and brings bytes of its own
        for cut in range(1, len(rest)):
            for t in self.starting_with(rest[cut:]):
                whole = rest[:cut] + t
                try:
                    tokens = self.encode_ordinary(whole.decode())
                except UnicodeDecodeError:
                    tokens = self.encode_piece(whole)
                covered, n = 0, 0
                while n < len(tokens) and covered < len(rest):
                    covered += len(self.of_id[tokens[n]])
                    n += 1
                found.add(tuple(tokens[:n]))
        # a white-space character at the end may come to stand in a piece of its own
        for width in range(1, min(4, len(rest) - 1) + 1):
            try:
                tail = rest[-width:].decode()
            except UnicodeDecodeError:
                continue
            if len(tail) == 1 and tail.isspace():
                found.add((*self.encode_piece(rest[:-width]), *self.encode_piece(rest[-width:])))
            break
        return ids, found


# --- DataFrame forms -------------------------------------------------------------------------------


def vocabulary_table(spark: SparkSession, vocab: Vocabulary) -> DataFrame:
    """token, bytes, is_special."""
    rows = [(i, b, False) for b, i in vocab.ranks.items()] + [(i, b, True) for i, b in vocab.special_of_id.items()]
    return spark.createDataFrame(pa.table({"token": pa.array([r[0] for r in rows], pa.int32()), "bytes": pa.array([r[1] for r in rows], pa.binary()), "is_special": [r[2] for r in rows]}))


def vocabulary_from_json(df: DataFrame, column: str = "value") -> DataFrame:
    """token and bytes from rows of vocabulary JSON, with Spark functions only."""
    spec = F.from_json(F.col(column), "mergeable_ranks map<string,int>")
    return df.select(F.explode(spec["mergeable_ranks"]).alias("k", "token")).select("token", F.encode("k", "ISO-8859-1").alias("bytes"))


def check_vocabulary(table: DataFrame) -> DataFrame:
    """One row: entries, and whether ids and byte strings are one to one."""
    return table.agg(F.count("*").alias("entries"), ((F.count_distinct("token") == F.count("*")) & (F.count_distinct("bytes") == F.count("*"))).alias("one_to_one"))


def _small(table: DataFrame, entries: int) -> DataFrame:
    return F.broadcast(table) if entries <= BROADCAST_ENTRIES else table


def pieces_of(text: Column, pattern: str) -> Column:
    """Pieces of a text by the JVM's matcher, with Unicode classes."""
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def piece_hits(df: DataFrame, vocab: Vocabulary, keys: list[str], text: str = "text") -> DataFrame:
    """keys, pos, piece and token: the id of pieces that are tokens as a whole, null for the others."""
    table = vocabulary_table(df.sparkSession, vocab).where(~F.col("is_special")).select("token", "bytes")
    rows = df.select(*keys, F.posexplode(pieces_of(F.col(text), vocab.pattern)).alias("pos", "piece"))
    return rows.withColumn("bytes", F.col("piece").cast("binary")).join(_small(table, len(vocab.ranks)), "bytes", "left").select(*keys, "pos", "piece", "token")


def tokenize_relational(df: DataFrame, vocab: Vocabulary, keys: list[str], text: str = "text") -> DataFrame:
    """keys and ``tokens`` (no special tokens): pieces join the vocabulary, and each distinct miss is merged once."""
    ship_package(df.sparkSession)
    hits = piece_hits(df, vocab, keys, text)
    sent = df.sparkSession.sparkContext.broadcast(vocab)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sent.value.encode_piece(p.encode()) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], ["piece", "merged"])

    misses = hits.where("token IS NULL").select("piece").distinct().mapInArrow(merge, "piece string, merged array<int>")
    both = hits.join(misses, "piece", "left").withColumn("ids", F.coalesce("merged", F.array("token")))
    tokens = both.groupBy(*keys).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ids"))), lambda s: s.ids)).alias("tokens"))
    return df.select(*keys).join(tokens, keys, "left").select(*keys, F.coalesce("tokens", F.array().cast("array<int>")).alias("tokens"))


def tokenize(df: DataFrame, vocab: Vocabulary, text: str = "text", special: bool = True, output: str = "tokens") -> DataFrame:
    """Adds the ids of ``text`` (null: none); with ``special``, special strings become their ids. No shuffle."""
    ship_package(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(vocab)

    @F.arrow_udf("array<int>")
    def run(s: pa.Array) -> pa.Array:
        v = sent.value
        encode = v.encode_with_special_tokens if special else v.encode_ordinary
        ids, offs = array("i"), [0]
        for part in by_bytes(np.diff(flat_bytes(s)[1]), BATCH_BYTES):
            for x in s[part.start : part.stop].to_pylist():
                if x:
                    ids.extend(encode(x))
                offs.append(len(ids))
        return lists_of(np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32), np.asarray(offs), pa.int32())

    return df.withColumn(output, run(F.col(text)))


def token_bytes(tokens: Column, vocab: Vocabulary, spark: SparkSession) -> Column:
    """Arrays of ids as the bytes of their tokens, row by row (null: none); unknown ids raise."""
    ship_package(spark)
    sent = spark.sparkContext.broadcast(vocab.byte_table())

    @F.arrow_udf("binary")
    def run(s: pa.Array) -> pa.Array:
        data, start, size = sent.value
        ids, offs = flat_lists(s)
        wrong = (ids < 0) | (ids >= len(size))
        wrong |= size[np.where(wrong, 0, ids)] < 0 if len(size) else True
        if wrong.any():
            raise UnknownToken(f"unknown token {ids[wrong][0]}")
        n = size[ids] if len(ids) else np.zeros(0, np.int64)
        out = data[gathered(start[ids], n)] if len(ids) else data[:0]
        ends = np.concatenate([[0], np.cumsum(n)])[offs]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out.tobytes())]).cast(pa.binary())

    return run(tokens)


def detokenize(df: DataFrame, vocab: Vocabulary, keys: list[str], tokens: str = "tokens") -> DataFrame:
    """keys and ``bytes`` of the tokens in order, in place: nothing is joined or shuffled; unknown ids raise."""
    return df.select(*keys, token_bytes(F.col(tokens), vocab, df.sparkSession).alias("bytes"))


def starting_with(prefixes: DataFrame, vocab: Vocabulary, column: str = "prefix") -> DataFrame:
    """The rows of ``prefixes`` with each ``token`` whose bytes start with the prefix: joined on the first byte, then told apart."""
    table = vocabulary_table(prefixes.sparkSession, vocab).where(~F.col("is_special")).select("token", "bytes", F.hex(F.substring("bytes", 1, 1)).alias("first"))
    rows = prefixes.withColumn("raw", F.col(column).cast("binary")).withColumn("first", F.hex(F.substring("raw", 1, 1)))
    return rows.join(_small(table, len(vocab.ranks)), "first").where(F.startswith("bytes", "raw")).drop("first", "raw", "bytes")


def unknown_tokens(df: DataFrame, vocab: Vocabulary, tokens: str = "tokens") -> DataFrame:
    """Distinct ids that the vocabulary lacks."""
    table = vocabulary_table(df.sparkSession, vocab).select("token")
    return df.select(F.explode(tokens).alias("token")).distinct().join(_small(table, len(vocab.ranks)), "token", "left_anti")


def byte_tokens(text: Column) -> Column:
    """A text as ids 0 to 255, one for each UTF-8 byte; null stays null. The Arrow buffer is the answer already."""

    @F.arrow_udf("array<int>")
    def run(s: pa.Array) -> pa.Array:
        data, offs = flat_bytes(s)
        return lists_of(data.astype(np.int32), offs, pa.int32(), s)

    return run(text)


def byte_counts(df: DataFrame, text: str = "text", by: str | None = None) -> DataFrame:
    """(``by``,) byte and n: occurrences of each byte that occurs; a batch is counted before anything is shuffled."""
    ship_package(df.sparkSession)
    group = F.col(by) if by else F.lit(None).cast("string")
    kind = dict(df.dtypes)[by] if by else "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(0).dictionary_encode()
            data, offs = flat_bytes(b.column(1))
            place = np.asarray(codes.indices.fill_null(len(codes.dictionary)), np.int64)
            n = np.bincount(np.repeat(place, np.diff(offs)) * 256 + data)
            seen = np.flatnonzero(n)
            own = codes.dictionary.take(pa.array(seen >> 8, mask=(seen >> 8) == len(codes.dictionary)))
            yield pa.RecordBatch.from_arrays([own, pa.array((seen & 255).astype(np.int32)), pa.array(n[seen])], ["by", "byte", "n"])

    parts = df.select(group.alias("by"), F.col(text).alias("text")).mapInArrow(tidy(run), f"by {kind}, byte int, n long")
    sums = parts.groupBy("by", "byte").agg(F.sum("n").alias("n"))
    return sums.withColumnRenamed("by", by) if by else sums.select("byte", "n")


def unstable_completions(df: DataFrame, vocab: Vocabulary, text: str = "text", special: bool = True) -> DataFrame:
    """Adds ``stable`` (ids) and ``completions`` (sorted id sequences)."""
    ship_package(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(vocab)

    @F.pandas_udf("stable array<int>, completions array<array<int>>")
    def run(s):
        import pandas as pd

        v = sent.value
        out = [v.encode_unstable(x or "", v.specials if special else ()) for x in s]
        return pd.DataFrame({"stable": [o[0] for o in out], "completions": [sorted(map(list, o[1])) for o in out]})

    return df.withColumn("unstable", run(F.col(text))).select(*df.columns, "unstable.stable", "unstable.completions")
