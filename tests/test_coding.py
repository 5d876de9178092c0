import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidpress.operators import coder, distribution

EIGHT = list(range(1000, 9000, 1000))
KNOWN = [
    ([1, 3, 6, 10], [0, 1, 2, 3, 3, 2, 1, 0], "0578"),
    ([1, 2, 3, 4], [0, 1, 2, 3], "1b80"),
    ([10, 11, 12, 13], [0, 0, 0, 1, 2, 3], "61e0"),
    (EIGHT, [0, 3, 7, 2, 5, 1], "0faa60"),
    (EIGHT, [*range(8), *range(8)], "05397705397780"),
    ([10000, 10001, 10002, 10003], [0] * 1000, "80"),
    ([5], [], "80"),
]


@pytest.mark.parametrize("table, symbols, want", KNOWN)
def test_known_bytes(table, symbols, want):
    assert coder.encode_symbols(table, symbols).hex() == want
    assert coder.decode_symbols(table, bytes.fromhex(want), len(symbols)) == symbols


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 1 << 20), min_size=1, max_size=60), st.data())
def test_round_trip(freqs, data):
    table = np.cumsum(freqs).tolist()
    symbols = data.draw(st.lists(st.integers(0, len(freqs) - 1), max_size=200))
    assert coder.decode_symbols(table, coder.encode_symbols(table, symbols), len(symbols)) == symbols


def test_columns(spark):
    df = spark.createDataFrame([(s, t) for t, s, _ in KNOWN], "s array<int>, t array<bigint>")
    got = df.withColumn("c", coder.encode_column(F.col("s"), F.col("t"))).withColumn("back", coder.decode_column(F.col("c"), F.col("t"), F.size("s")))
    assert sorted(bytes(r.c).hex() for r in got.collect()) == sorted(k[2] for k in KNOWN)
    assert got.where("back != s").count() == 0


LOGITS = [
    ([1000, 1000, 1000, 1000], [268435199, 536870398, 805305597, 1073740796]),
    ([1000, 2000, 3000, 4000], [265898442, 533239961, 802760569, 1073740796]),
    ([10000, -10000, -10000, -10000], [293701310, 553714472, 813727634, 1073740796]),
]


@pytest.mark.parametrize("logits, want", LOGITS)
def test_tables_from_logits(spark, logits, want):
    assert distribution.cumulative_values(np.array([logits]))[0].tolist() == want
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(logits)], "row_id int, token int, logit bigint")
    assert [r.cum for r in distribution.cumulative_table(df).orderBy("token").collect()] == want
    one = spark.createDataFrame([(logits,)], "l array<bigint>").select(distribution.cumulative_array(F.col("l")).alias("c")).first()
    assert one.c == want


def test_total():
    assert distribution.target_total(1024) == (1 << 30) - 2048
    assert distribution.target_total(1 << 30) == (1 << 30) + 1


def test_span_encoder_and_step_decoders_equal_the_coder():
    """The forms that work by whole runs of bits, against the one that works bit by bit."""
    r = np.random.default_rng(1)
    for k in range(300):
        size = int(r.integers(2, 40))
        freqs = r.integers(1, (5, 1 << 24)[k % 2], size)
        if k % 3 == 0:
            freqs[r.integers(size)] = 1 << 28
        table = np.cumsum(freqs)
        runs = [r.integers(0, size, n) if k % 5 else np.full(n, int(np.argmax(freqs))) for n in (0, 1, int(r.integers(1, 90)), 400)]
        coded = [coder.encode_symbols(table.tolist(), x.tolist()) for x in runs]
        for x, c in zip(runs, coded):
            assert coder.encode_spans([int(table[s - 1]) if s else 0 for s in x], [int(table[s]) for s in x], int(table[-1])) == c
        order = sorted(range(len(runs)), key=lambda i: -len(runs[i]))
        d, out = coder.Decoders([coded[i] for i in order]), [[] for _ in order]
        for pos in range(len(runs[order[0]])):
            live = sum(len(runs[i]) > pos for i in order)
            d.keep(live)
            for j, s in enumerate(d.symbols(np.tile(table, (live, 1)))):
                out[j].append(int(s))
        assert [o for o in out] == [runs[i].tolist() for i in order]


def test_lanes_equal_the_coder(monkeypatch):
    """Many parts side by side, against the coder that works bit by bit; also where bits straddle for long."""
    r = np.random.default_rng(2)
    skewed = np.ones(256, np.int64)
    skewed[[7, 200]] = (1 << 19) - 200, (1 << 19) - 54
    for k, freqs in enumerate([r.integers(1, 4000, 256), skewed, np.array([1, (1 << 20) - 2, 1]), np.array([1, 1]), np.array([1 << 20])]):
        monkeypatch.setattr(coder, "LANES", (2048, 3)[k % 2])
        table = np.cumsum(freqs).tolist()
        p = freqs / freqs.sum()
        runs = [r.choice(len(freqs), int(n), p=p).astype(np.uint8).tobytes() for n in (0, 1, 2, 4096, *r.integers(0, 700, 20))]
        runs += [r.integers(0, len(freqs), 500, np.uint8).tobytes(), bytes([len(freqs) // 2]) * 4096, bytes(600), bytes([len(freqs) - 1]) * 600]
        coded = coder.Lanes(table).encode(runs)
        assert coded == [coder.encode_symbols(table, x) for x in runs]
        assert coder.Lanes(table).decode(coded, [len(x) for x in runs]) == runs
    assert coder.Lanes(table).encode([]) == [] == coder.Lanes(table).decode([], [])


def test_lanes_do_not_work_symbol_by_symbol(spark, monkeypatch):
    """The static round trip codes whole batches, not single symbols, in Python."""
    from braidpress.plans import compress

    assert not {"encode_symbols", "decode_symbols"} & set(vars(compress))
    texts = ["", None, "x", "grüße 😀 " * 900, "the same line\n" * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in compress.static_roundtrip(df).collect()}
    table = compress.static_table(compress.byte_frequencies(df))
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        assert got[k].text == (t or "") and got[k].coded_bytes == sum(len(coder.encode_symbols(table, raw[i : i + 4096])) for i in range(0, len(raw), 4096))
