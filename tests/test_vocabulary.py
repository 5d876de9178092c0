import base64
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from braidpress.operators import buffers, chunking
from braidpress.operators import vocabulary as V
from braidpress.operators.attention import embedding_gather
from braidpress.sources import model


def test_small_cases():
    v = V.Vocabulary({b"a": 0, b"b": 1, b"ab": 2}, {}, r".+")
    assert v.encode_ordinary("ab") == [2]
    assert V.Vocabulary({b"a": 0, b"b": 1}, {}, r".+").encode_ordinary("ab") == [0, 1]
    with pytest.raises(V.UnknownToken):
        v.encode_ordinary("c")
    with pytest.raises(V.UnknownToken):
        v.decode_bytes([9])
    with pytest.raises(ValueError):
        V.Vocabulary({b"a": 0, b"b": 0})
    with pytest.raises(ValueError):
        V.Vocabulary({b"a": 0}, {"<x>": 0})
    assert v.split_piece(b"aab") == [b"a", b"ab"]


def test_specials():
    v = model.small_vocabulary()
    text = "on <|endoftext|> and <|bos|>on"
    ids = v.encode_with_special_tokens(text)
    assert 1023 in ids and 1022 in ids and v.decode_bytes(ids).decode() == text
    plain = v.encode_ordinary(text)
    assert 1023 not in plain and v.decode_bytes(plain).decode() == text
    some, last = v.encode(text, ["<|bos|>"])
    assert 1023 not in some and 1022 in some and last > 0
    assert v.encode("on<|bos|>", v.specials)[1] == 0
    assert V.Vocabulary.from_json(v.to_json()).ranks == v.ranks
    with pytest.raises(ValueError):
        V.Vocabulary.from_json(v.to_json().replace('"explicit_n_vocab": 1024', '"explicit_n_vocab": 9'))


def public():
    P = pytest.importorskip("public_tokenizers")
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return V.Vocabulary(ranks, {"<|endoftext|>": 50256}, P.PATTERN)


def test_against_a_public_library():
    tiktoken = pytest.importorskip("tiktoken")
    v = public()
    other = tiktoken.Encoding("other", pat_str=v.pattern, mergeable_ranks=v.ranks, special_tokens=v.specials)
    for text in ("Hello, world!  It's\n\n 12 o'clock <|endoftext|> naïve 日本語 😀", "", "   ", "\r\n\t x"):
        assert v.encode_ordinary(text) == other.encode_ordinary(text)
        assert v.encode_with_special_tokens(text) == other.encode(text, allowed_special="all")
    for text in ("hello f", "he", "a\n\n", " tok", "x  "):
        stable, completions = other.encode_with_unstable(text)
        own, found = v.encode_unstable(text)
        assert own == stable and found == set(map(tuple, completions))


def test_frames(spark):
    v = model.small_vocabulary()
    df = spark.createDataFrame([(1, "the tin on a hat 12"), (2, ""), (3, None), (4, "é😀\r\n  x")], "id int, text string")
    tokens = V.tokenize(df, v, special=False)
    back = {r.id: bytes(r.bytes).decode() for r in V.detokenize(tokens, v, ["id"]).collect()}
    assert back == {1: "the tin on a hat 12", 2: "", 3: "", 4: "é😀\r\n  x"}
    a = {r.id: r.tokens for r in V.tokenize_relational(df.na.fill(""), v, ["id"]).collect()}
    assert a == {r.id: r.tokens for r in tokens.collect()}
    assert [r.token for r in V.unknown_tokens(spark.createDataFrame([([1, 5000],)], "tokens array<int>"), v).collect()] == [5000]
    with pytest.raises(Exception, match="unknown token"):
        V.detokenize(spark.createDataFrame([(1, [5000])], "id int, tokens array<int>"), v, ["id"]).collect()


def test_long_pieces_merge_like_short_ones(monkeypatch):
    r = random.Random(5)
    v = model.small_vocabulary()
    pieces = ["".join(r.choice("abent hirs") for _ in range(r.randint(1, 300))).encode() for _ in range(200)] + [b"a" * 257, b"ab" * 400, b"e", b""]
    want = []
    monkeypatch.setattr(V, "HEAP_BYTES", 10**9)
    want = [v.merge(p) for p in pieces]
    monkeypatch.setattr(V, "HEAP_BYTES", 0)
    assert [v.merge(p) for p in pieces] == want
    monkeypatch.undo()
    long = ("the" * 400_000).encode()
    assert b"".join(v.merge(long)) == long


def test_buffers_with_nulls_and_slices(spark):
    column = pa.array(["ab", None, "", "é\n", "x" * 300])
    for c in (column, column[1:], column.cast(pa.large_string()), column.slice(1, 3), column.slice(0, 0)):
        data, offs = buffers.flat_bytes(c)
        assert [bytes(data[a:b]).decode() for a, b in zip(offs, offs[1:])] == [t or "" for t in c.to_pylist()]
    lists = pa.array([[1, 2], None, [], [3]], pa.list_(pa.int32()))
    values, offs = buffers.flat_lists(lists[1:])
    assert values.tolist() == [3] and offs.tolist() == [0, 0, 0, 1]
    assert buffers.lists_of(np.array([1, 2, 3]), np.array([0, 2, 2, 2, 3]), pa.int32(), lists).to_pylist() == lists.to_pylist()
    assert [(s.start, s.stop) for s in buffers.by_bytes(np.array([5, 1, 1, 90, 1]), 7)] == [(0, 3), (3, 4), (4, 5)]
    df = spark.createDataFrame([("a", "xy"), (None, "x"), ("a", None), ("b", "")], "lang string, text string")
    assert sorted(map(tuple, V.byte_counts(df, "text", "lang").collect()), key=str) == [("a", 120, 1), ("a", 121, 1), (None, 120, 1)]
    assert sorted(map(tuple, V.byte_counts(df).collect())) == [(120, 2), (121, 1)]
    assert [r.t for r in df.select(V.byte_tokens(F.col("text")).alias("t")).collect()] == [[120, 121], [120], None, []]


def test_gathered_embeddings(spark):
    df = spark.createDataFrame([(1, [0, 2]), (2, []), (3, None)], "id int, t array<int>")
    flat = {r.id: r.v for r in df.select("id", embedding_gather(F.col("t"), np.array([5, 6, 7])).alias("v")).collect()}
    assert flat == {1: [5, 7], 2: [], 3: None}
    wide = {r.id: r.v for r in df.select("id", embedding_gather(F.col("t"), np.array([[5, 1], [6, 2], [7, 3]])).alias("v")).collect()}
    assert wide == {1: [[5, 1], [7, 3]], 2: [], 3: None}
    with pytest.raises(ValueError):
        embedding_gather(F.col("t"), np.zeros((1 << 24, 1)))


def test_previous_tokens_equal_a_window(spark):
    df = spark.createDataFrame([(k, list(range(k, k + n))) for k, n in enumerate((0, 1, 63, 64, 65, 200))], "id int, tokens array<int>")
    own = chunking.previous_tokens(chunking.chunk(df, size=64)).select("id", "chunk_idx", F.posexplode("prev").alias("at", "prev"))
    place = chunking.positions(df).withColumn("chunk_idx", F.expr("pos div 64").cast("int")).withColumn("at", (F.col("pos") % 64).cast("int"))
    lagged = place.withColumn("prev", F.lag("token", 1, chunking.BOS).over(Window.partitionBy("id", "chunk_idx").orderBy("at")))
    assert sorted(own.collect()) == sorted(lagged.select("id", "chunk_idx", "at", "prev").collect()) and own.count() == 393
