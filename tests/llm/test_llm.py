"""Each operator on small fixtures: brute force, exact round trips, held-out accuracy, and the odd cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from braidpress.llm import bpe, chat, decontam, kernels, minhash, quality, rules, suffix_dedup, token_counts, toxicity, urls
from braidpress.llm.queries import QUERIES, SQL, vocabulary
from compare import check

WORDS = [a + b for a in ("th", "er", "on", "an", "re", "he", "in") for b in ("e", "an", "or", "ing", "ed", "is", "at")]
DOCS = "doc_id long, text string, lang string"


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def odd_rows():
    """Nulls, empty texts, white space, ties, repeated rows, long texts."""
    r = random.Random(5)
    long = prose(r, 30000)
    return [(1, None, None), (2, "", "en"), (3, "  \n\t ", "en"), (4, "one two three", "xx"), (4, "one two three", "xx"), (5, "same text of five words here", "en"), (6, "same text of five words here", "en"), (7, long, "en"), (8, "x" * 20000, "fr"), (9, "日本語 テキスト 😀 é", "en"), (None, "a row without a key but words enough", "en")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).withColumn("key", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("n_bytes", F.lit(2)).withColumn("digest", F.lit(3))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 and 7 -----------------------------------------------------------------------------------------


def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(vocabulary())


HARD = ["", " ", "  ", "a  b", "a \n b\n  c", " lead", "trail  ", "x<|endoftext|> y  <|endoftext|>z", "à à  b", "tab\t \tx", "\x1c \x1c a", "don't 're 12 $% &", "\r\n\r\n  x", "日本語 テ", "😀 😀😀", "\x00 \x00", "a\u0085 b", "\u00a0 \u00a0 x", "<|endoftext|"]


def test_codec_equals_library():
    t, c = library(), bpe.codec(vocabulary())
    assert c.space_is_certain and c.merge is not None
    r = random.Random(1)
    bits = ["a", "b", " ", "\n", "é", "<|endoftext|>", "'s", "1", "!", "\t", "  ", "\u00a0", "the", "ß", "日"]
    texts = HARD + ["".join(r.choice(bits) for _ in range(r.randint(1, 16))) for _ in range(3000)]
    for x, ids in zip(texts, c.encode_texts(texts)):
        want = t.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, x
        assert c.decode_packed(ids) == t.decode(want, skip_special_tokens=False)
    assert token_counts.counter(vocabulary()).count(texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_long_texts_without_spaces():
    """Cut at forced pairs everywhere: as the library reads them, in short fragments, in time that follows the length."""
    t, c = library(), bpe.codec(vocabulary())
    r = random.Random(3)
    letters = ["abcdefghijklmnopqrstuvwxyz", "Aa1 !'\n\t,.s", "日本語のテキスト。、é", "'sdlmtrev!x1", "0123456789-_/.:?=&%", "\u3000\u00a0 x'ß😀\u200d!"]
    texts = ["".join(r.choice(r.choice(letters) if k % 3 == 0 else letters[k % 6]) for _ in range(r.randint(24, 400))) for k in range(1500)]
    for x, ids in zip(texts, c.encode_texts(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x
    big = "".join(r.choice("日本語のテキストabcxyzqj-/_.,0189") for _ in range(3_200_000))
    assert len(big.encode()) > 5_000_000
    parts = c.fine(big)
    assert "".join(parts) == big and max(map(len, parts)) < 200
    ids = c.encode_texts([big])[0]
    assert c.decode_packed(ids) == big and np.frombuffer(ids, "<u4").tolist() == t.encode(big, add_special_tokens=False).ids


def test_forced_pairs():
    forced = bpe.forced_pairs([b"ab", b"bc d"])
    assert not forced[ord("a"), ord("b")] and not forced[ord("c"), 0x20] and forced[ord("a"), 0x20] and forced[ord("d"), ord("a")]


def test_bpe_frames(spark, odd, none):
    out = bpe.roundtrip(odd, vocabulary()).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in out) == sorted((a or 0, t or "") for a, t, _ in odd_rows())
    ids = bpe.encode(odd, vocabulary())
    assert sorted(r.text for r in bpe.decode(ids, vocabulary()).collect()) == sorted(t or "" for _, t, _ in odd_rows())
    small = ids.where("doc_id = 4").select(bpe.unpack_ids(F.col("ids")).alias("a")).first().a
    assert small == library().encode("one two three", add_special_tokens=False).ids
    counts = token_counts.with_limit(token_counts.count_tokens(odd, vocabulary())).collect()
    want = {k: len(library().encode(t or "", add_special_tokens=False).ids) for k, t, _ in odd_rows()}
    assert len(counts) == len(odd_rows()) and all(r.n_tokens == want[r.doc_id] and r.over_limit == (r.n_tokens > 1024) for r in counts)
    assert bpe.roundtrip(none, vocabulary()).count() == token_counts.count_tokens(none, vocabulary()).count() == 0


def test_sentencepiece_counts(spark):
    spm = pytest.importorskip("sentencepiece")
    path = vocabulary("piece_bpe_32k.model")
    r = random.Random(4)
    texts = ["", "one two", "  x  ", "日本語", prose(r, 400_000), "  ".join(prose(r, 9) + " é1 \n" for _ in range(30_000)), "x" * 1_100_000]
    assert len(token_counts.counter(path).parts(texts[4])) > 10
    p = spm.SentencePieceProcessor(model_file=path)
    got = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(p.encode(t)) for i, t in enumerate(texts)}


# --- 2 and 8 -----------------------------------------------------------------------------------------


def labelled(r, n=600):
    docs, labels = [], []
    for i in range(n):
        text = "\n".join(prose(r, r.randint(20, 60)) + "." for _ in range(r.randint(1, 4)))
        good, toxic = r.random() > 0.3, r.random() < 0.2
        if not good:
            text = r.choice([lambda t: t.replace(" ", "%%% "), lambda t: t.upper().replace(" ", "!! "), lambda t: " ".join(t.split()[:7]) * 9, lambda t: t.replace(" ", " | ")])(text)
        if toxic:
            w = text.split(" ")
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "scum", "vequmo", "lowein", "trash"]))
            text = " ".join(w)
        docs.append((i, text, "en"))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def marked(spark):
    docs, labels = labelled(random.Random(11))
    labels += [(10**6, 1, 1), (5, None, None)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, column, cut", [(quality, "quality", 0.3), (toxicity, "toxic", 0.7)])
def test_classifier_held_out(marked, module, column, cut):
    docs, labels = marked
    got = module.classify(docs, labels).join(labels.where(f"{column} IS NOT NULL"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert 50 < len(held) < len(got)
    right = sum((r.score >= cut) == (r[column] == 1) for r in held)
    assert right >= 0.95 * len(held)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_odd_cases(spark, marked, odd, none, module):
    docs, labels = marked
    both = docs.unionByName(odd.select("doc_id", "text", "lang"))
    got = module.classify(both, labels).where("doc_id < 10 OR doc_id IS NULL").collect()
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert module.classify(none, labels).count() == 0
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert module.classify(odd, nothing).count() == len(odd_rows())


def test_quality_scores_equal_brute_force(spark, marked):
    """Means, shrunk covariances and densities by NumPy's own functions, from the statistics of the labelled rows."""
    docs, labels = marked
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.where("quality IS NOT NULL").collect() if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 5}
    ids = sorted(texts)
    x = quality.statistics(pa.array([texts[i] for i in ids]))
    rows = {k: np.array([x[ids.index(i)] for i, q in known.items() if q == k]) for k in (0, 1)}
    n = {k: len(v) for k, v in rows.items()}
    cov = {k: np.cov(v.T, bias=True) for k, v in rows.items()}
    pooled = sum(n[k] * cov[k] for k in (0, 1)) / sum(n.values())
    logs = []
    for k in (0, 1):
        own = (1 - quality.DIAGONAL) * ((1 - quality.POOLED) * cov[k] + quality.POOLED * pooled) + quality.DIAGONAL * (np.diag(np.diag(pooled)) + 1e-4 * np.eye(len(pooled)))
        d = x - rows[k].mean(axis=0)
        logs.append(np.log(n[k]) - np.linalg.slogdet(own)[1] / 2 - np.einsum("ij,ij->i", d, np.linalg.solve(own, d.T).T) / 2)
    want = dict(zip(ids, 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))))
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert all(abs(got[i] - want[i]) < 1e-6 for i in ids)


def test_quality_filter_keeps_columns(marked, odd):
    docs, labels = marked
    kept = quality.keep_good(docs.withColumn("score", F.lit(7)), labels)
    assert kept.columns == ["doc_id", "text", "lang", "score"]
    scores = quality.classify(docs, labels)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in scores.where("score >= 0.3").collect()}


def test_toxicity_of_repeated_keys(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 50)
    bad = next(i for i in range(7) if zlib.crc32(str(i).encode()) % 3 != 1)
    docs = [(i % 7, f"plain words {i} and {'scum idiot' if i % 7 == bad else 'more'} of them") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i == bad)) for i in range(7)], "doc_id long, toxic int")
    got = toxicity.classify(spark.createDataFrame(docs, "doc_id long, text string").withColumn("label", F.lit("x")), labels).collect()
    assert len(got) == 300 and min(r.score for r in got if r.doc_id == bad) > max(r.score for r in got if r.doc_id != bad)


def test_label_model_equals_brute_force():
    """One round after another, vote by vote, in plain loops."""
    r = np.random.default_rng(5)
    v = r.integers(-1, 2, (40, 4))
    logit = lambda p: np.log(p / (1 - p))
    post = [1 / (1 + np.exp(-(sum(row) + logit(0.3)))) for row in v.tolist()]
    for _ in range(toxicity.ROUNDS):
        weight = [[1 - p for p in post], post]
        table = [[[sum(w for w, row in zip(weight[k], v) if row[j] == s) + 0.1 for s in (-1, 0, 1)] for j in range(4)] for k in (0, 1)]
        table = [[[x / sum(t) for x in t] for t in side] for side in table]
        mean = [[t[2] - t[0] for t in side] for side in table]
        rest = np.array([[row[j] - sum(weight[k][i] * mean[k][j] for k in (0, 1)) for j in range(4)] for i, row in enumerate(v.tolist())])
        spread = [np.sqrt(np.mean((rest[:, j] - rest[:, j].mean()) ** 2)) + 1e-6 for j in range(4)]
        share = [1 / max(1, sum(abs(np.mean(rest[:, i] * rest[:, j])) / spread[i] / spread[j] for j in range(4))) for i in range(4)]
        prior = min(max(np.mean(post), 1e-3), 1 - 1e-3)
        new = [1 / (1 + np.exp(-(sum(share[j] * (np.log(table[1][j][row[j] + 1]) - np.log(table[0][j][row[j] + 1])) for j in range(4)) + logit(prior)))) for row in v.tolist()]
        done = max(abs(a - b) for a, b in zip(new, post)) < 1e-6
        post = post if done else new
        if done:
            break
    assert np.allclose(toxicity.label_model(v.astype(np.int8), 0.3), post, atol=1e-9)


def test_label_model_learns_who_is_right():
    r = np.random.default_rng(2)
    y = r.random(2000) < 0.3
    v = np.stack([np.where(r.random(2000) < a, y, ~y) * 2 - 1 for a in (0.95, 0.9, 0.9, 0.55)], axis=1).astype(np.int8)
    post = toxicity.label_model(v, 0.3)
    assert ((post > 0.5) == y).mean() > 0.93


def test_stems_do_not_depend_on_table_size(spark):
    """A stem in a tenth of the toxic documents and no clean one is kept, however few rows there are."""
    rows = [("plain words here vequmo" if k % 10 == 0 else "plain words here", 1) for k in range(40)] + [("plain words here lowein" if k % 20 == 0 else "plain words here", 0) for k in range(320)]
    for times in (1, 8):
        codes = set(toxicity.mine(spark.createDataFrame(rows * times, "body string, label int")).codes.tolist())
        assert toxicity.code_of("vequmo") in codes and not codes & {toxicity.code_of("plain"), toxicity.code_of("lowein")}


# --- 3 -----------------------------------------------------------------------------------------------


def covered(texts, n=400):
    seen = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                m[i : i + n] = True
        out.append(m)
    return out


def messy(seed):
    r = random.Random(seed)
    letters = b"ab" if seed % 2 else bytes(range(97, 123))
    draw = lambda n: bytes(r.choice(letters) for _ in range(n))
    texts = [draw(r.randint(0, 2500)) for _ in range(5)]
    for _ in range(18):
        x = bytearray(r.choice(texts))
        for _ in range(r.randint(0, 3)):
            if x:
                x[r.randrange(len(x))] = r.choice(letters)
        if r.random() < 0.5 and len(x) > 500:
            a = r.randrange(len(x) - 450)
            x = draw(r.randint(0, 50)) + x[a : a + r.randint(395, 700)] + draw(r.randint(0, 50))
        texts.append(bytes(x))
    return [*texts, b"a" * r.randint(300, 1500), b"xy" * r.randint(100, 900), b"", draw(10) * 120 + texts[2]]


@pytest.mark.parametrize("seed, crowd", [(1, 4096), (2, 4096), (3, 2), (4, 1)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    texts = messy(seed)
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df).collect()}
    for i, (t, m) in enumerate(zip(texts, covered(texts))):
        kept = np.frombuffer(t, np.uint8)[~m].tobytes()
        runs = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        assert (bytes(got[i].kept), got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (kept, len(t), int(m.sum()), runs)


def long_runs(t, mask, words=50):
    """Runs of a mask that touch so many words."""
    spans = [w.span() for w in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
    runs = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int), [0]]))).reshape(-1, 2).tolist()
    return [(a, z) for a, z in runs if sum(x < z and y > a for x, y in spans) >= words]


@pytest.mark.parametrize("seed, crowd", [(2, 4096), (3, 2)])
def test_repeats_and_passages_equal_brute_force(spark, monkeypatch, seed, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    r = random.Random(seed)
    passage, other = prose(r, 51), prose(r, 45)
    texts = [*messy(seed), *[f"{prose(r, 30)} {p} {prose(r, 40)}".encode() for p in (passage, other, passage, other)]]
    rows = [(i, t.decode()) for i, t in enumerate(texts)] + [(None, passage), (3, None), (2, texts[2].decode())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.lit("x")).withColumn("cuts", F.lit(1))
    got = collections.Counter((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans, r.n_passages, r.passage_bytes) for r in suffix_dedup.repeats_and_passages(df, short=150, min_words=50).collect())
    bodies = [(t or "").encode() for _, t in rows]
    want = collections.Counter()
    for (i, _), t, m, short in zip(rows, bodies, covered(bodies), covered(bodies, 150)):
        long = long_runs(t, short)
        want[i, np.frombuffer(t, np.uint8)[~m].tobytes(), len(t), int(m.sum()), len(long_runs(t, m, 0)), len(long), sum(z - a for a, z in long)] += 1
    assert got == want
    assert sum(n for k, n in want.items() if k[5]) >= 3


def test_words_that_end_before_a_run_are_not_touched():
    body = b"\n one two  three four\t"
    runs = [(a, z) for a in range(len(body)) for z in range(a + 1, len(body) + 1)]
    mask = lambda a, z: np.isin(np.arange(len(body)), range(a, z))
    for words in (2, 3, 4, 5):
        assert suffix_dedup.passages(body, runs, words) == [(a, z) for a, z in runs if long_runs(body, mask(a, z), words)]


def test_passages_leave_shorter_repeats(spark):
    r = random.Random(6)
    passage, other = prose(r, 52), prose(r, 47)
    rows = [(k, f"{prose(r, 60)} {passage if k % 2 else other} {prose(r, 60)}") for k in range(6)]
    assert all(suffix_dedup.PASSAGE <= len(x) < suffix_dedup.LENGTH for x in (passage, other))
    out = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=suffix_dedup.PASSAGE, min_words=suffix_dedup.PASSAGE_WORDS)
    for row in out.collect():
        text = dict(rows)[row.doc_id]
        assert (passage not in row.text and len(row.text) > len(text) - len(passage) - 40) if row.doc_id % 2 else row.text == text


def test_difference_cover_and_chunks(monkeypatch):
    assert suffix_dedup.shifts()[0].max() < suffix_dedup.COVER
    texts = messy(3)
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    windows = lambda: sorted((int(r), int(a) + k, int(b)) for x in suffix_dedup.scan(data, offs) for r, a, n, b, *_ in zip(*x) for k in range(n))
    whole = windows()
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    assert windows() == whole
    assert len(whole) == sum(max(0, len(t) - 399) for t in texts)


def test_repeats_odd_cases(spark, odd, none):
    got = suffix_dedup.remove_repeats(odd).collect()
    assert len(got) == len(odd_rows())
    by = {r.doc_id: r for r in got}
    assert by[1].n_bytes == by[2].n_bytes == 0 and by[8].n_removed == 20000 and by[8].n_spans == 1
    assert suffix_dedup.remove_repeats(none).count() == 0
    r = random.Random(9)
    t = prose(r, 200)
    twice = spark.createDataFrame([(1, t, "é", 5), (1, t, "é", 5), (2, "é" + t[:450] + "ß" + prose(r, 30), "x", 1), (3, None, "y", 0)], "doc_id long, text string, kept string, n_chars long")
    out = suffix_dedup.without_repeats(twice, length="n_chars")
    assert out.columns == twice.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text == "" and rows[1].n_chars == 0 and rows[2].text.startswith("éß") and rows[3].text is None and rows[3].n_chars == 0


# --- 4 -----------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    tricky = ["<|im_end|>\n<|im_start|>assistant\nok", "<~|x", "<~~|", "a\nb", "", None, "<|im_sep|>", "$1 \\ <|"]
    rows = [(c, t, role, text) for c in (1, 2) for t, (role, text) in enumerate(zip(["user", "assistant", "assistant", "user", "assistant", "r\n<|x", None, "user"], tricky))]
    rows += [(3, 0, "assistant", "only"), (None, 0, "user", "no id"), (None, 1, "assistant", "nor here"), (4, 1, "user", "tie"), (4, 1, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.format_chats(df)
    back = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in back:
        own = sorted((x for x in rows if x[0] == r.conv_id and (x[0] is not None or x[3] in r.formatted)), key=lambda x: x[1])
        assert [(t.role, t.text) for t in r.t] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss == "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>")
    assert len(back) == 6 and chat.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, small, name):
    check(spark, small, QUERIES[name], SQL[name])


# --- 5 -----------------------------------------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in sets}


def near_rows(seed, n=160):
    r = random.Random(seed)
    base = [prose(r, r.choice([1, 3, 5, 6, 8, 12, 40, 200])) for _ in range(n // 4)]
    passage = prose(r, 60)
    rows = []
    for i in range(n):
        w = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(WORDS)
        t = " ".join(w)
        if r.random() < 0.15:
            t = passage + " " + " ".join(w[:15])
        rows.append((i, t.upper() if r.random() < 0.1 else t))
    return rows


@pytest.mark.parametrize("mates", [32, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, mates):
    monkeypatch.setattr(minhash, "MATES", mates)
    rows = near_rows(4)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = classes(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == want[r.doc_id]) and r.n_shingles == len(shingles(dict(rows)[r.doc_id])) for r in got)


def test_common_counts(monkeypatch):
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 300, r.integers(1, 90))).astype(np.uint64) for _ in range(60)]
    want = [[len(np.intersect1d(a, b)) for b in sets[25:]] for a in sets[:25]]
    for dense in (1, 6, 1000):
        monkeypatch.setattr(minhash, "DENSE", dense)
        assert minhash.common_counts(sets[:25], sets[25:]).tolist() == want


def family(rows):
    """Texts round one template, each with its own words in places: similarities about 0.6 to 0.8."""
    r = np.random.default_rng(8)
    words = np.tile(np.arange(204), (rows, 1))
    for k in range(rows):
        for start in r.choice(204, r.integers(4, 8), replace=False):
            words[k, start] = 1000 + 204 * k + start
    return [(k, " ".join(map(str, w))) for k, w in enumerate(words)]


def test_family_of_one_template(spark, monkeypatch):
    """A hot bucket whose links the chains of further bands miss; here there are no chains at all."""
    monkeypatch.setattr(minhash, "SPLITS", 0)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 200)
    rows = family(600)
    sets = list(minhash.shingle_sets(pa.array([t for _, t in rows])))
    size = np.array([len(s) for s in sets])
    common = minhash.common_counts(sets, sets)
    near = 100 * common >= 75 * (size[:, None] + size[None, :] - common)
    bands = [set(minhash.keys_of(s).tolist()) for s in sets]
    want = list(range(len(rows)))
    for a, b in zip(*np.nonzero(np.triu(near, 1))):
        if bands[a] & bands[b] and want[a] != want[b]:
            low, high = sorted((want[a], want[b]))
            want = [low if x == high else x for x in want]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == dict(enumerate(want))


def test_near_duplicates_odd_cases(spark, odd, none):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows())
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == by[3].n_shingles == 0 and by[1].component_id == 1 and by[5].component_id == by[6].component_id == 5 and not by[6].kept
    assert by[None].component_id is None and by[None].kept
    assert minhash.near_duplicates(none).count() == 0
    texts = [prose(random.Random(k), 20) for k in range(3)]
    bridge = spark.createDataFrame([(1, texts[0]), (2, texts[0]), (2, texts[1]), (3, texts[1]), (4, texts[2])], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(bridge).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_signature_and_components(spark):
    for n in (1, 2, 5, 100, 2000):
        h = np.unique(kernels.mix(np.arange(n, dtype=np.uint64) * np.uint64(77)))
        s = minhash.signature(h)
        assert len(s) == minhash.BINS and set(s.tolist()) <= set(h.tolist())
    chain = [(i + 1, i) for i in range(40)] + [(100, 99), (99, 101), (7, 7)]
    got = minhash.components(spark.createDataFrame(chain, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {**{i: 0 for i in range(1, 41)}, 100: 99, 101: 99}


# --- 6 -----------------------------------------------------------------------------------------------


def judged(url, rule_list):
    u = url or ""
    rest = u.split("://", 1)[1] if "://" in u else ""
    host = re.match(r"[^/?#]*", rest).group().translate(LOWER)
    path = re.match(r"[^?#]*", rest[len(host) :]).group() if "://" in u else ""
    fits = [(len(h) + len(p), len(h), a == "block", h + p, a) for h, p, a in rule_list if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_url_rules(spark, none):
    rule_list = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.net", "", "block"), ("net", "/e", "allow")]
    found = ["http://www.EXAMPLE.com/en/x?q=/fr/#t", "https://example.com/en/", "https://example.com/en", "http://x.com", "ftp://b.a.net", "http://c.net/es/1", "http://c.net/english", "no scheme.com/en/", "", None, "http://", "http:///en/", "http://notexample.com/en/", "x://y://z.com/", "http://example.com/en/\n/b", "http://c.net/es/1", "http://" + "a." * 3000 + "net/es/" + "x/" * 3000]
    pages = spark.createDataFrame(list(enumerate(found)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = urls.judge(pages, spark.createDataFrame(rule_list, "host string, path string, action string"))
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {i: judged(u, rule_list) for i, u in enumerate(found)}
    assert urls.judge(pages.limit(0), spark.createDataFrame(rule_list, "host string, path string, action string")).count() == 0
    assert urls.judge(pages, spark.createDataFrame([], "host string, path string, action string")).where("rule IS NULL").count() == len(found)


# --- 9 -----------------------------------------------------------------------------------------------


def base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    at = {k for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(at)


def test_rules(spark, odd, none):
    r = random.Random(3)
    texts = [prose(r, n) for n in (1, 5, 9, 12, 300)] + ["a b c d e " * 3, "x\nx\n \ny\nx", "a b c d e f a b c d e", "##|| <x>", "\x0b\x0c a \x0b", "w " * 3000]
    rows = [(100 + i, t, "en") for i, t in enumerate(texts)] + odd_rows()
    got = rules.apply_rules(spark.createDataFrame(rows, DOCS).withColumn("key", F.lit(1)).withColumn("n_words", F.lit(1))).collect()
    assert len(got) == len(rows)
    want = {i: base(t) for i, t, _ in rows}
    for x in got:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want[x.doc_id]
        assert x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words)
        assert not (x.base_failed and x.kept)
    assert rules.apply_rules(none).count() == 0


def test_divergence_finds_other_distributions(spark):
    r = random.Random(8)
    the = lambda n: " ".join(r.choice(WORDS if r.random() < 0.55 else ["the", "of", "and", "is"]) for _ in range(n))
    clean = [(i, the(r.randint(200, 400)), "en") for i in range(200)]
    junk = [(1000 + i, "".join(r.choice("#%$&* 019") for _ in range(900)), "en") for i in range(4)] + [(2000 + i, " | ".join(r.choice(WORDS) for _ in range(300)), "en") for i in range(4)]
    got = rules.apply_rules(spark.createDataFrame(clean + junk, DOCS)).collect()
    assert all(x.kept == (x.doc_id < 1000) for x in got)
    d = spark.range(1).select(rules.distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("far"), rules.distance(F.array(F.lit(2.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("same")).first()
    assert d.far == pytest.approx(1) and d.same == pytest.approx(0)


# --- 10 ----------------------------------------------------------------------------------------------


def test_decontamination(spark, none):
    r = random.Random(6)
    items = [(i, prose(r, n)) for i, n in enumerate((40, 25, 14, 5, 30))] + [(8, None), (9, "")]
    text = dict(items)

    def edited(t, every):
        w = t.split(" ")
        for k in range(every // 2, len(w), every):
            w[k] = "zzz"
        return " ".join(w)

    docs = [(i, prose(r, 150), "en") for i in range(30)]
    docs += [(100 + i, prose(r, 50) + " " + text[i] + " " + prose(r, 30), "en") for i in (0, 1, 2)]
    docs += [(200, prose(r, 20) + "\n" + edited(text[0], 9).upper() + "!", "en"), (201, " ".join(text[4].split()[5:25]), "en"), (202, prose(r, 9000) + " " + text[1], "en"), (203, "xx " + text[3] + " yy", "en")]
    docs += [(300, " ".join(text[0].split()[:7]) + " " + prose(r, 60), "en"), (301, None, "en"), (302, "", "en"), (303, "..., --", "en")]
    df = spark.createDataFrame(docs + [docs[31]], DOCS).withColumn("item", F.lit(1)).withColumn("words", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(df, bench)
    assert sorted((x.doc_id, x.item_id) for x in got.collect()) == [(100, 0), (101, 1), (102, 2), (200, 0), (201, 4), (202, 1), (203, 3)]
    hit = {x.doc_id: x for x in got.collect()}
    assert hit[100].n_words == 40 and (hit[100].first_word, hit[100].end_word) == (50, 90) and hit[200].density < 1
    assert decontam.contaminated(none, bench).count() == 0
    assert decontam.contaminated(df, bench.limit(0)).count() == 0


def plain_words(t):
    w = (x.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for x in (t or "").translate(LOWER).split())
    return [x for x in w if x]


def best_placement(doc, item):
    """The best verified overlap among all placements that some mask meets, by plain loops."""
    masks = [m for m, low, high in decontam.MASKS if low <= len(item) <= (high or len(item))]
    best = None
    for shift in range(1 - len(item), len(doc)):
        at = [i for i in range(len(item)) if 0 <= i + shift < len(doc)]
        same = {i for i in at if doc[i + shift] == item[i]}
        if not any(all(i + k in same or b == "0" and i + k in at for k, b in enumerate(m)) for m in masks for i in at):
            continue
        runs = [(sum(1 if i in same else -2 for i in range(x, y)), -x, y) for x in at for y in range(x + 1, at[-1] + 2)]
        top = max(s for s, _, _ in runs)
        x, y = min((-x, y) for s, x, y in runs if s == top) if top > 0 else (0, 0)
        n = sum(i in same for i in range(x, y))
        if n < decontam.MIN_WORDS and len(same) >= decontam.MIN_DENSITY * len(item):
            x, y, n = min(same), max(same) + 1, len(same)
        if n and n >= min(decontam.MIN_WORDS, decontam.MIN_DENSITY * len(item)) and n >= decontam.MIN_DENSITY * (y - x):
            best = max(best or (0,), (n, n / (y - x), -(x + shift), y + shift))
    return best


def test_decontamination_equals_brute_force(spark):
    r = random.Random(14)
    items = [(i, prose(r, n)) for i, n in enumerate((3, 4, 5, 6, 6, 7, 9, 12, 13, 15, 15, 20, 24, 25, 40))] + [(90, "on on on on on on on on on"), (1, prose(r, 15))]
    docs = []
    for k in range(90):
        w = r.choice(items)[1].split(" ")
        a = r.choice([0, 0, 0, r.randrange(len(w))])
        w = w[a:]
        for _ in range(r.choice([0, 1, 2, 2, 4])):
            w[r.randrange(len(w))] = r.choice(WORDS)
        docs.append((k if k % 30 else None, f"{prose(r, r.randint(0, 9))} {', '.join(w).upper()} {prose(r, r.randint(0, 9))}"))
    docs += [(500, "on " * 60), (501, None), (7, "x")]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {}
    for k, t in docs:
        for i, u in items:
            if found := best_placement(plain_words(t), plain_words(u)):
                want[k, i] = max(want.get((k, i), (0,)), found)
    assert {(x.doc_id, x.item_id): (x.n_words, x.density, -x.first_word, x.end_word) for x in got} == want and len(got) == len(want) > 30


def test_short_edited_items_and_long_ones(spark):
    r = random.Random(15)
    items = [(i, prose(r, 15)) for i in range(60)] + [(100, prose(r, 20000))]
    long = items[-1][1].split(" ")
    docs = []
    for i, t in items[:-1]:
        w = t.split(" ")
        for k in r.sample(range(15), 2):
            w[k] = "zzz"
        docs.append((i, f"{prose(r, 40)} {' '.join(w)} {prose(r, 40)}"))
    docs += [(100, " ".join(long)), (101, " ".join(long[5000:9000])), (102, "an " * 20000)]
    got = {(x.doc_id, x.item_id): x.n_words for x in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum((i, i) in got for i in range(60)) >= 55 and got[100, 100] == 20000 and got[101, 100] == 4000
    assert all(k == i or {k, i} <= {100, 101} for k, i in got)


def test_leaks_of_null_and_repeated_keys(spark, monkeypatch):
    import corpus_pipeline

    r = random.Random(31)
    leak, clean = prose(r, 30), prose(r, 60)
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: spark.createDataFrame([(1, leak)], "item_id long, text string"))
    docs = spark.createDataFrame([(None, leak), (None, clean), (2, leak), (2, clean), (3, None), (4, clean)], "doc_id long, text string")
    got = corpus_pipeline.no_leaks(spark, docs, "").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter([(None, clean), (2, clean), (3, None), (4, clean)])


def test_overlap():
    doc, item = np.arange(100), np.arange(20, 50)
    assert decontam.overlap(doc, item, 20) == (20, 50, 30)
    changed = doc.copy()
    changed[30] = -1
    assert decontam.overlap(changed, item, 20) == (20, 50, 29)
    assert decontam.overlap(doc, item, 80)[2] == 0


# --- the pipeline ------------------------------------------------------------------------------------


def test_pipeline(spark, small):
    import corpus_pipeline as c

    assert len(c.STAGES) == 5
    docs = spark.read.parquet(f"{small}/documents.parquet")
    good = c.good_quality(spark, docs, small)
    scores = {r.doc_id: r.score for r in quality.classify(docs, spark.read.parquet(f"{small}/labels.parquet")).collect()}
    rows = good.collect()
    assert good.columns == docs.columns and {r.doc_id for r in rows} == {i for i, s in scores.items() if s >= 0.3}
    one = c.one_of_each(spark, good, small).collect()
    kept = classes([(r.doc_id, r.text) for r in rows])
    assert {r.doc_id for r in one} == {i for i, k in kept.items() if i == k}
    cut = c.no_repeats(spark, spark.createDataFrame(one, docs.schema), small).collect()
    bodies = [r.text.encode() for r in one]
    want = {r.doc_id: suffix_dedup.without(t, long_runs(t, m)).decode("utf-8", "ignore") for r, t, m in zip(one, bodies, covered(bodies, suffix_dedup.PASSAGE))}
    assert {r.doc_id: r.text for r in cut} == want and all(r.n_chars == len(r.text) for r in cut)
    frame = spark.createDataFrame(cut, docs.schema)
    clean = c.no_leaks(spark, frame, small).collect()
    leaks = {r.doc_id for r in decontam.contaminated(frame, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean} == {r.doc_id for r in cut} - leaks
    t = library()
    final = {r.doc_id: r for r in c.run(spark, small).collect()}
    assert final.keys() == {r.doc_id for r in clean}
    for r in clean:
        ids = t.encode(r.text, add_special_tokens=False).ids
        assert np.frombuffer(final[r.doc_id].ids, "<u4").tolist() == ids and final[r.doc_id].n_tokens == len(ids)
        assert final[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_pipeline_odd_cases(spark, monkeypatch):
    """Nulls, empty and long texts, repeated rows and keys, clashing columns and empty tables, stage by stage."""
    import corpus_pipeline as c

    r = random.Random(21)
    passage, leak = prose(r, 60), prose(r, 40)
    rows = [(i, t, lang) for i, t, lang in odd_rows()]
    rows += [(20, f"{prose(r, 80)} {passage} {prose(r, 80)}", "en"), (21, f"{prose(r, 80)} {passage} {prose(r, 80)}", None), (None, f"{prose(r, 30)} {leak}", "en"), (22, f"{leak} {prose(r, 30)}", "en"), (22, prose(r, 50), "en")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    for name in ("key", "body", "leak_row", "rid", "cuts", "score", "label", "kept", "words", "digest", "gone", "group"):
        docs = docs.withColumn(name, F.lit("clash"))
    tables = {"labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, leak), (2, None), (3, "")], "item_id long, text string")}
    monkeypatch.setattr(c, "table", lambda _, __, name: tables[name])
    count = lambda frame: collections.Counter((x.doc_id, x.text) for x in frame.collect())
    own = collections.Counter((i, t) for i, t, _ in rows)
    assert count(c.good_quality(spark, docs, "")) == own
    one = c.one_of_each(spark, docs, "")
    assert count(one) == own - collections.Counter({(6, rows[6][1]): 1})
    cut = c.no_repeats(spark, docs, "")
    left = count(cut)
    assert all(left[i, t] == n for (i, t), n in own.items() if i not in (20, 21)) and sum(left.values()) == len(rows)
    assert all(passage not in (x.text or "") and x.n_chars == (None if x.text is None else len(x.text)) for x in cut.collect())
    clean = c.no_leaks(spark, docs, "")
    assert count(clean) == own - collections.Counter({(None, rows[-3][1]): 1, (22, rows[-2][1]): 1})
    assert all(f.columns == docs.columns and {x.leak_row for x in f.collect()} == {"clash"} for f in (one, cut, clean))
    ids = c.tokens(spark, docs, "").collect()
    assert collections.Counter((x.doc_id, x.decoded_sha256) for x in ids) == collections.Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    for _, stage in c.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_kernel_words():
    texts = ["", " a", "bb\tc ", None, "x" * 5000 + " " + "x" * 5000, "é é"]
    data, offs = kernels.flat(pa.array(texts))
    starts, ends, by = kernels.word_spans(data, offs)
    found = [[bytes(data[a:b]).decode() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(by, by[1:])]
    assert found == [(t or "").split() for t in texts]
    h = kernels.word_hashes(data, starts, ends)
    w = [x for f in found for x in f]
    assert all((h[i] == h[j]) == (w[i] == w[j]) for i in range(len(w)) for j in range(len(w)))
