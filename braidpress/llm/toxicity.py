"""Toxicity by weak supervision.

Many voters look at a text: a fixed lexicon, stems and whole words that labelled rows show to be telling (parted into several
voters), the density of such stems, and patterns. A generative label model, fitted by expectation
maximisation on a bounded sample of labelled rows, estimates each voter's accuracy and how voters hang
together within a class; correlated voters share their weight. Its posterior labels train a logistic
classifier over the voters' counts, which scores every text.

The sample is the TRAIN_ROWS labelled rows of least hash; it is the only thing that is bounded. Its ids are
broadcast (at most TRAIN_ROWS of them), and its texts are written once and read where they are needed. Labels
serve to find stems and to set the class share.

Results by case: null, empty and wordless texts have no votes and get the low score of texts without any hit;
without labelled rows of both classes only the fixed lexicon votes; each input row gives one row; rows with
a null key are scored and never held out; a key whose rows repeat is learnt from in all of them, up to TRAIN_ROWS
rows in all for the label model; whole texts count, in blocks; extra columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import discard, materialize, ship_package, tidy
from .bpe import byte_slices
from .kernels import LOWER, U, flat, mix, word_hashes, word_spans
from .quality import remainder

#: Bound of the labelled sample, of the stems kept, and the number of voters the stems are dealt to.
TRAIN_ROWS, STEMS, STEM_VOTERS = 20_000, 4096, 8
#: A stem is kept when it stands in this many toxic documents, and its smoothed odds are this many times those in others.
STEM_DOCS, STEM_ODDS = 4, 40.0
#: Bytes of the stems; 0 stands for whole words, for languages whose telling words share their first bytes with plain ones.
PREFIXES, WHOLE = (4, 5, 6), 0
#: Plain insults.
LEXICON = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "imbecile", "bastard", "filthy")
ROUNDS = 50


def stem_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Code of the first n bytes of each word that has as many, and which words those are; WHOLE: of words of four bytes and more."""
    which = np.flatnonzero(ends - starts >= (n or PREFIXES[0]))
    if n == WHOLE:
        return ((word_hashes(data, starts[which], ends[which], seed=8) >> U(2)) | U(1 << 62)).view(np.int64), which
    at = starts[which]
    code = np.full(len(at), n, np.int64)
    for k in range(n):
        code = (code << 8) | data[at + k]
    return code, which


def code_of(word: str) -> int:
    raw = word.encode()[: PREFIXES[-1]]
    code = len(raw)
    for b in raw:
        code = (code << 8) | b
    return code


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offs = flat(column)
    data = LOWER[data]
    return (data, *word_spans(data, offs))


@dataclass
class Lexicon:
    """Sorted stem codes and the voter of each."""

    codes: np.ndarray
    voters: np.ndarray

    def counts(self, column: pa.Array) -> np.ndarray:
        """For each text: hits by voter, hits in all, words."""
        data, starts, ends, by = words_of(column)
        rows = len(by) - 1
        out = np.zeros((rows, STEM_VOTERS + 3))
        out[:, -1] = np.diff(by)
        gate = np.zeros(1 << 16, bool)
        gate[(mix(self.codes.astype(U)) >> U(48)).astype(np.int64)] = True
        hit = np.zeros(len(starts), bool)
        for n in (*PREFIXES, WHOLE):
            code, which = stem_codes(data, starts, ends, n)
            maybe = np.flatnonzero(gate[(mix(code.astype(U)) >> U(48)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.codes, code[maybe]), max(len(self.codes) - 1, 0))
            sure = self.codes[place] == code[maybe] if len(self.codes) else np.zeros(0, bool)
            row = np.searchsorted(by, which[maybe[sure]], "right") - 1
            np.add.at(out, (row, self.voters[place[sure]]), 1)
            hit[which[maybe[sure]]] = True
        out[:, STEM_VOTERS + 1] = np.diff(np.concatenate([[0], np.cumsum(hit)])[by])
        return out


def votes(counts: np.ndarray) -> np.ndarray:
    """1 toxic, -1 clean, 0 no vote: stem voters, the lexicon, density patterns and the pattern of no hit."""
    hits, words = counts[:, STEM_VOTERS + 1], counts[:, -1]
    density = hits / np.maximum(words, 1)
    out = [np.where(counts[:, k] > 0, 1, 0) for k in range(STEM_VOTERS + 1)]
    out.append(np.where(hits >= 2, 1, np.where(hits == 0, -1, 0)))
    out.append(np.where(density > 0.004, 1, np.where(density < 0.0005, -1, 0)))
    out.append(np.where((counts[:, : STEM_VOTERS + 1] > 0).sum(axis=1) >= 2, 1, np.where(hits == 0, -1, 0)))
    return np.stack(out, axis=1).astype(np.int8)


def label_model(v: np.ndarray, prior: float) -> np.ndarray:
    """Posterior of label 1 for each row of votes, with voter accuracies and within-class correlations estimated."""
    post = 1 / (1 + np.exp(-(v.sum(axis=1) + np.log(max(prior, 1e-3) / (1 - min(prior, 0.999))))))
    states = np.stack([v == s for s in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(ROUNDS):
        share = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        weight = np.stack([1 - post, post])
        table = np.einsum("kr,rvs->kvs", weight, states) + 0.1
        table /= table.sum(axis=2, keepdims=True)
        # correlation left within the classes: voters that say the same thing share one vote's weight
        expect = np.einsum("kvs,s->kv", table, np.array([-1.0, 0, 1]))
        rest = v - (weight.T @ expect)
        spread = rest.std(axis=0) + 1e-6
        corr = np.abs((rest.T @ rest) / len(v) / np.outer(spread, spread))
        share_of = 1 / np.maximum(corr.sum(axis=1), 1)
        logs = np.einsum("rvs,kvs,v->rk", states, np.log(table), share_of)
        margin = logs[:, 1] - logs[:, 0] + np.log(share / (1 - share))
        new = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post


def inputs(counts: np.ndarray) -> np.ndarray:
    hits, words = counts[:, STEM_VOTERS + 1], counts[:, -1]
    return np.column_stack([np.ones(len(counts)), np.minimum(hits, 1), np.log1p(hits), np.log1p(100 * hits / np.maximum(words, 1)), np.log1p(counts[:, : STEM_VOTERS + 1])])


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights for soft labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def mine(sample: DataFrame) -> Lexicon:
    """Stems that toxic rows of the sample (body, label) hold and others do not."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, starts, ends, by = words_of(b.column(0))
            labels = np.asarray(b.column(1))
            for n in (*PREFIXES, WHOLE):
                code, which = stem_codes(data, starts, ends, n)
                row = np.searchsorted(by, which, "right") - 1
                order = np.lexsort((code, row))
                code, row = code[order], row[order]
                once = np.ones(len(code), bool)
                once[1:] = (np.diff(code) != 0) | (np.diff(row) != 0)
                code, toxic = code[once], labels[row[once]] == 1
                kinds, at = np.unique(code, return_inverse=True)
                pos = np.bincount(at, weights=toxic, minlength=len(kinds)).astype(np.int64)
                neg = np.bincount(at, weights=~toxic, minlength=len(kinds)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(pos), pa.array(neg)], ["code", "pos", "neg"])

    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}  # two rows
    fixed = {code_of(w) for w in LEXICON if len(w.encode()) >= PREFIXES[0]}
    found: list[tuple[int, int]] = []
    if sizes.get(1) and sizes.get(0):
        tally = sample.select("body", "label").mapInArrow(tidy(count), "code long, pos long, neg long").groupBy("code").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        # counts of both classes enter as shares, so the same shares give the same verdict in a table of any size
        odds = (F.col("pos") + 0.5) / (sizes[1] - F.col("pos") + 0.5) * (sizes[0] - F.col("neg") + 0.5) / (F.col("neg") + 0.5)
        told = tally.where((F.col("pos") >= STEM_DOCS) & (odds >= STEM_ODDS))
        found = [(r["code"], k) for k, r in enumerate(told.orderBy(F.desc(F.col("pos") / (F.col("neg") + 0.5)), "code").limit(STEMS).collect())]
    voter = {c: k % STEM_VOTERS for c, k in found} | {c: STEM_VOTERS for c in fixed}
    codes = np.array(sorted(voter), np.int64)
    return Lexicon(codes, np.array([voter[c] for c in codes.tolist()], np.int64))


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3, held: int = 1) -> DataFrame:
    """key, ``held_out`` and ``score`` of every row; rows of remainder ``held`` give no label."""
    spark = df.sparkSession
    ship_package(spark)
    kind = dict(df.dtypes)[key]
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (remainder(F.col("key"), folds) != held))
    chosen = known.orderBy(F.xxhash64("key"), "key", "label").limit(TRAIN_ROWS)
    texts = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("body"))
    sample = materialize(texts.join(F.broadcast(chosen), "key").select("key", "body", "label"), "labelled")
    lexicon = mine(sample)
    sent = spark.sparkContext.broadcast(lexicon)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = sent.value.counts(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.tolist(), pa.list_(pa.float64())), b.column(2)], ["draw", "c", "label"])

    rows = sample.select(F.xxhash64(F.col("key").cast("string"), "body").alias("draw"), "body", "label").mapInArrow(tidy(tally), "draw long, c array<double>, label int")
    # at most TRAIN_ROWS short rows, in an order that the data fix
    seen = rows.orderBy("draw", "label").limit(TRAIN_ROWS).collect()
    counts = np.array([r["c"] for r in seen]).reshape(len(seen), STEM_VOTERS + 3) if seen else np.zeros((0, STEM_VOTERS + 3))
    # two rows of plain kind, so that the fit has both classes even without labels
    plain = np.zeros((2, STEM_VOTERS + 3))
    plain[:, -1], plain[1, [STEM_VOTERS, STEM_VOTERS + 1]] = 100, 2
    counts = np.vstack([counts, plain])
    share = float(np.mean([r["label"] for r in seen])) if seen else 0.1
    weights = fit_linear(inputs(counts), label_model(votes(counts), share))
    model = spark.sparkContext.broadcast(weights)
    discard(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in byte_slices(np.asarray(pc.binary_length(b.column(1).fill_null("")))):
                z = inputs(sent.value.counts(b.column(1)[s.start : s.stop])) @ model.value
                yield pa.RecordBatch.from_arrays([b.column(0)[s.start : s.stop], pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], ["key", "score"])

    out = texts.mapInArrow(tidy(run), f"key {kind}, score double")
    return out.select(F.col("key").alias(key), F.coalesce(remainder(F.col("key"), folds) == held, F.lit(False)).alias("held_out"), "score")
