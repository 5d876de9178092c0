import math
from fractions import Fraction

import numpy as np
import pytest

from braidpress.operators import kernels
from braidpress.operators.chunking import level_context, to_log2
from braidpress.plans import compress
from braidpress.sources import model, tensors
from braidpress.functions.tables import exp_q16_values


@pytest.fixture(scope="module")
def weights():
    return model.load(model.export(model.fixture()))


def fold_by_key(q, ks, vs, mult, sink):
    """The key-by-key fold in plain integers."""
    ex = lambda d: int(exp_q16_values(np.array([d]), 378194)[0])
    rn = lambda x, s: int(kernels.rne(np.array([x]), s)[0])
    m, s, acc = None, 0, [0] * 64
    if sink is not None:
        m, s = rn(rn(int(q @ sink), 2) * mult, 15), 65535
    for k, v in zip(ks, vs):
        score = rn(rn(int(q @ k), 2) * mult, 15)
        if m is None or score > m:
            if m is not None:
                e = ex(m - score)
                s = (s * e + 0x8000) >> 16
                acc = [(a * e + (32768 if a * e >= 0 else -32768)) >> 16 for a in acc]
            m = score
        w = ex(score - m)
        s += w
        acc = [a + w * int(b) for a, b in zip(acc, v)]
    out = []
    for a in acc:
        n, r = divmod(abs(a), max(s, 1))
        n += 2 * r > max(s, 1) or (2 * r == max(s, 1) and n & 1)
        out.append(max(-127, min(127, n if a >= 0 else -n)))
    return out


@pytest.mark.parametrize("with_sink", [False, True])
def test_grouped_fold_equals_fold_by_key(with_sink):
    r = np.random.default_rng(1)
    q, k, v = r.integers(-127, 128, (2, 3, 12, 64)), r.integers(-127, 128, (2, 12, 64)), r.integers(-127, 128, (2, 12, 64))
    mult, sink = np.array([30000, 12000, 200000]), r.integers(-127, 128, 64) if with_sink else None
    got = kernels.attend(q, k, v, mult, 0, sink)
    for c in range(2):
        for h in range(3):
            for j in range(12):
                assert got[c, h, j].tolist() == fold_by_key(q[c, h, j], k[c, : j + 1], v[c, : j + 1], int(mult[h]), sink)


def plain_rne(x, s):
    """x / 2**s, half to even, from Python's exact rounding of fractions."""
    return x if s <= 0 else round(Fraction(x, 1 << s))


def plain_div(n, d):
    return round(Fraction(n, d))


def c8(x):
    return max(-127, min(127, x))


def c32(x):
    return max(-(1 << 31), min((1 << 31) - 1, x))


def plain_norm(x, weight):
    ms = max(1, sum(v * v for v in x) // len(x) + 1)
    inv = max(1, min(32768, plain_div(8388608, math.isqrt(ms << 16))))
    return [c8(plain_rne(v * int(g) * inv, 15)) for v, g in zip(x, weight)]


def plain_matrix(x, w, scale):
    mult, shift = scale
    sums = [sum(a * int(b) for a, b in zip(x, row)) for row in w]
    return [c8(v * mult) if shift <= 0 else c8(c32(plain_rne(v * mult, shift))) for v in sums]


def plain_turn(x, cos, sin, again):
    a, b = x[:32], x[32:]
    pairs = [(p * int(c) - q * int(s), p * int(s) + q * int(c)) for p, q, c, s in zip(a, b, cos, sin)]
    return [c8(plain_rne(plain_rne(v, 15), again)) for k in (0, 1) for v in (p[k] for p in pairs)]


def plain_logits(w, tokens):
    """The whole forward pass of one chunk, a position at a time, in Python integers."""
    keys, values, out = [[] for _ in w.layers], [[] for _ in w.layers], []
    heads, d = w.width // 64, w.width
    for pos, t in enumerate(tokens):
        x = [int(v) for v in w.embed[t]]
        for i, layer in enumerate(w.layers):
            qkv = plain_matrix(plain_norm([c8(v) for v in x], layer.attn_norm), layer.qkv, layer.scales["qkv"])
            keys[i].append(plain_turn(qkv[d : d + 64], w.cos[pos], w.sin[pos], 0))
            values[i].append(qkv[d + 64 : d + 128])
            a = []
            for h in range(heads):
                q = np.array(plain_turn(qkv[64 * h : 64 * h + 64], w.cos[pos], w.sin[pos], 1))
                a += fold_by_key(q, np.array(keys[i]), values[i], int(layer.score_mult[h]), layer.sink_key)
            x = [p + q for p, q in zip(x, plain_norm(plain_matrix(a, layer.out, layer.scales["out"]), layer.ffn_norm))]
            up = plain_matrix(plain_norm([c8(v) for v in x], layer.post_attn_norm), layer.up, layer.scales["up"])
            half = len(up) // 2
            gated = [c8(plain_rne(max(g, 0) * v, 7)) for g, v in zip(up[:half], up[half:])]
            x = [p + q for p, q in zip(x, plain_norm(plain_matrix(gated, layer.down, layer.scales["down"]), layer.post_ffn_norm))]
        last = plain_norm([c8(v) for v in x], w.norm)
        out.append([sum(a * int(b) for a, b in zip(last, row)) for row in w.head])
    return out


@pytest.mark.parametrize("layers, sink", [(1, True), (2, False)])
def test_forward_pass_equals_plain_integers(layers, sink):
    w = model.fixture(layers=layers, sink=sink)
    tokens = np.random.default_rng(7).integers(0, 1024, 6)
    got = kernels.Runner(w, 1, 6).forward(tokens[None])[0]
    assert got.astype(np.int64).tolist() == plain_logits(w, tokens.tolist())
    # and the tables that follow from the logits
    total = (1 << 30) - 1024 - 1024
    for row, table in zip(plain_logits(w, tokens[:2].tolist()), kernels.Runner(w, 1, 2).tables(tokens[None, :2])[0]):
        e = [int(exp_q16_values(np.array([v - max(row)]), w.coef)[0]) for v in row]
        freq = [1 + x * (total - 1024) // sum(e) for x in e]
        freq[row.index(max(row))] += total - sum(freq)
        assert np.cumsum(freq).tolist() == table.tolist()


@pytest.mark.parametrize("layers, sink", [(1, True), (2, False)])
def test_steps_equal_whole_and_batches_do_not_matter(layers, sink):
    w = model.fixture(layers=layers, sink=sink)
    tokens = np.random.default_rng(2).integers(0, 1024, (3, 40))
    whole = kernels.Runner(w, 3, 40).forward(tokens)
    stepped = kernels.Runner(w, 3, 40)
    assert (np.concatenate([stepped.forward(tokens[:, i : i + 1], i) for i in range(40)], axis=1) == whole).all()
    assert (kernels.Runner(w, 1, 25).forward(tokens[1:2, :25]) == whole[1:2, :25]).all()
    assert whole.std() > 100 and np.abs(whole).max() < 127 * 127 * 256


@pytest.mark.parametrize("size", [64, 128, 256])
def test_chunks_round_trip(weights, size):
    r = np.random.default_rng(3)
    chunks = [r.integers(0, 1024, n).tolist() for n in (0, 1, size - 1, size, 63, 64, 5)]
    coded = compress.encode_chunks(weights, chunks)
    assert compress.decode_chunks(weights, coded, [len(c) for c in chunks]) == chunks


def test_model_file(weights):
    raw = model.export(weights)
    assert model.export(model.load(raw)) == raw
    info = model.verify(raw)
    assert info["vocabulary"] and info["config"]["vocab_size"] == 1024
    parsed, meta = tensors.parse(raw)
    assert meta["format"] == model.FORMAT
    assert parsed["embed.weight"].array("I8").shape == (1024, 256)
    with pytest.raises(tensors.TensorFileError):
        parsed["embed.weight"].array("F32")
    for bad in (raw[:4], raw[:100], raw[:-1]):
        with pytest.raises(tensors.TensorFileError):
            tensors.parse(bad)
    del parsed["norm.weight"]
    with pytest.raises(tensors.TensorFileError):
        model.load(tensors.build(list(parsed.values()), meta))


def test_config_defaults():
    c = model.config_of({})
    assert (c["vocab_size"], c["context_length"], c["tokenizer_codec"]) == (1024, 64, "zstd")
    assert model.config_of({"context_length_log2": "8", "tokenizer_codec": '"none"'})["context_length"] == 256
    assert model.config_of({"context_length": "512", "context_length_log2": "8"})["context_length"] == 512
    assert model.config_of({"vocab_size": "x"})["vocab_size"] == 1024


def test_levels():
    assert [level_context(n) for n in (None, 0, 1, 2, 3, 4, 5, 9)] == [64, 64, 64, 128, 256, 512, 1024, 64]
    assert level_context(5, 128) == 128
    assert to_log2(1024) == 10
    for bad in (32, 100, 8192, 0):
        with pytest.raises(ValueError):
            to_log2(bad)


@pytest.mark.parametrize("with_sink", [False, True])
def test_fold_column_equals_kernel(spark, with_sink):
    from pyspark.sql import functions as F

    from braidpress.functions.arrays import attention_score, dot
    from braidpress.operators.attention import fold

    r = np.random.default_rng(4)
    q, k, v, sink = r.integers(-127, 128, 64), r.integers(-127, 128, (9, 64)), r.integers(-127, 128, (9, 64)), r.integers(-127, 128, 64)
    df = spark.createDataFrame([(t, q.tolist(), k[t].tolist(), v[t].tolist(), sink.tolist()) for t in range(9)], "t int, q array<bigint>, k array<bigint>, v array<bigint>, sink array<bigint>")
    rows = df.withColumn("score", attention_score(dot(F.col("q"), F.col("k")), 90000)).groupBy("q", "sink").agg(F.collect_list(F.struct("t", "score", "v")).alias("steps"))
    own = attention_score(dot(F.col("q"), F.col("sink")), 90000) if with_sink else None
    got = rows.select(fold(F.col("steps"), own).alias("y")).first().y
    assert got == kernels.attend(q[None, None, None], k[None], v[None], np.array([90000]), 8, sink if with_sink else None)[0, 0, 0].tolist()


def test_folds_agree_and_few_rows_take_one_product(monkeypatch):
    """Decoding folds all groups of a position by one product a chunk; the sorted fold gives the same."""
    r = np.random.default_rng(4)
    q, k, v = r.integers(-127, 128, (5, 4, 1, 64)), r.integers(-127, 128, (5, 30, 64)), r.integers(-127, 128, (5, 30, 64))
    mult, sink = np.array([30000, 12000, 200000, 300]), r.integers(-127, 128, 64)
    with monkeypatch.context() as m:
        m.setattr(kernels, "_fold", None)
        got = [kernels.attend(q, k, v, mult, 29, s) for s in (sink, None)]
    monkeypatch.setattr(kernels, "FEW_ROWS", 0)
    for a, s in zip(got, (sink, None)):
        assert np.array_equal(a, kernels.attend(q, k, v, mult, 29, s))
        assert a[1, 2, 0].tolist() == fold_by_key(q[1, 2, 0], k[1], v[1], 200000, s)


def test_spans_equal_tables_by_blocks_of_rows(monkeypatch):
    from braidpress.operators import distribution

    r, whole, seen = np.random.default_rng(5), distribution.frequencies, []
    monkeypatch.setattr(distribution, "frequencies", lambda x, *more: seen.append(len(x)) or whole(x, *more))
    for vocab in (1, 2, 1024):
        logits, symbols = r.integers(-200000, 200000, (150, vocab)), r.integers(0, vocab, 150)
        symbols[:3] = 0, vocab - 1, min(1, vocab - 1)
        below, upto, total = distribution.symbol_spans(logits, symbols)
        tables = distribution.cumulative_values(logits)
        rows = np.arange(150)
        assert np.array_equal(upto, tables[rows, symbols]) and np.array_equal(below, np.where(symbols > 0, tables[rows, symbols - 1], 0)) and (tables[:, -1] == total).all()
    assert max(seen) <= distribution.ROWS < 150


def test_the_first_layer_comes_from_a_table_of_tokens(monkeypatch):
    """Whatever goes through a model, each layer's qkv product but the first one's sees it; the first is worked out for each token of the vocabulary once."""
    w, whole, seen = model.fixture(layers=2), kernels.Layer.times, []
    monkeypatch.setattr(kernels.Layer, "times", lambda self, x, name: seen.append((w.layers.index(self), name, x.size)) or whole(self, x, name))
    monkeypatch.setattr(kernels.Layer, "__eq__", lambda self, other: self is other)
    runner, tokens = kernels.Runner(w, 3, 40), np.random.default_rng(2).integers(0, 1024, (3, 40))
    for at in (0, 20):
        runner.forward(tokens[:, at : at + 20], at)
    assert [(layer, n) for layer, name, n in seen if name == "qkv"] == [(0, 1024 * 256), (1, 60 * 256), (1, 60 * 256)]


@pytest.mark.parametrize("scale", [(77, 12), (-77, 12), ((1 << 24) - 1, 16), (3, 1), (1, 16), (0, 5), (1 << 24, 9), (5, 17), (2, 0), (-3, 40)])
def test_requantised_products_equal_plain_integers(scale):
    """Also where a product exceeds what float32 holds, and at ties."""
    r = np.random.default_rng(6)
    layer = model.fixture().layers[0]
    layer.out, layer.scales["out"] = r.integers(-128, 128, (9, 256)).astype(np.int8), scale
    layer.out[0], layer.out[1] = 127, np.eye(1, 256, dtype=np.int8)
    x = np.concatenate([r.integers(-127, 128, (6, 256)), np.full((1, 256), 127), np.full((1, 256), -127)])
    assert layer.times(x.astype(np.float32), "out").tolist() == [plain_matrix(row, layer.out, scale) for row in x.tolist()]


@pytest.mark.parametrize("with_sink", [False, True])
def test_folds_in_blocks_equal_fold_by_key(monkeypatch, with_sink):
    """Rising, falling and equal scores, more queries than a block has, and tables of groups that are too large."""
    r = np.random.default_rng(8)
    q = r.integers(-127, 128, (1, 64))
    rise = np.sort(r.integers(-127, 128, (40, 64)) * np.sign(q), axis=0)
    k = np.stack([rise, rise[::-1], np.repeat(rise[20:21], 40, 0), r.integers(-127, 128, (40, 64))])
    v, sink = r.integers(-127, 128, (4, 40, 64)), r.integers(-60, 60, 64) if with_sink else None
    queries, mult = np.broadcast_to(q, (4, 2, 40, 64)), np.array([9000, 100])
    got = kernels.attend(queries, k, v, mult, 0, sink)
    for c in range(4):
        for h in range(2):
            for j in (0, 1, 15, 31, 32, 39):
                assert got[c, h, j].tolist() == fold_by_key(q[0], k[c, : j + 1], v[c, : j + 1], int(mult[h]), sink)
    for name in ("FOLD_ENTRIES", "FOLD_SCORES"):
        monkeypatch.setattr(kernels, name, 1)
        assert np.array_equal(kernels.attend(queries, k, v, mult, 0, sink), got)


def test_decoding_looks_only_at_the_block_that_holds_a_value(weights, monkeypatch):
    """Decoding makes no cumulative tables; a value's symbol and its span are what they would tell."""
    from braidpress.operators import distribution

    r = np.random.default_rng(9)
    for vocab in (1, 33, 1024):
        logits = r.integers(-200000, 200000, (150, vocab)).astype(np.float32)
        logits[:50] //= 100
        tables = distribution.cumulative_values(logits)
        values = r.integers(0, tables[0, -1], 150)
        values[:4] = 0, tables[0, -1] - 1, tables[2, vocab // 2] - 1, min(tables[3, vocab // 2], tables[0, -1] - 1)
        s, below, upto = distribution.symbols_at(logits, values)
        want = [int(np.searchsorted(t, x, "right")) for t, x in zip(tables, values)]
        rows = np.arange(150)
        assert s.tolist() == want and np.array_equal(upto, tables[rows, s]) and np.array_equal(below, np.where(s > 0, tables[rows, s - 1], 0))
    monkeypatch.setattr(kernels.Runner, "tables", None)
    chunks = [r.integers(0, 1024, n).tolist() for n in (3, 64)]
    assert compress.decode_chunks(weights, compress.encode_chunks(weights, chunks), [3, 64]) == chunks
