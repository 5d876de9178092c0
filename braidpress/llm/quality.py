"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each text becomes a short vector of transformed statistics. Class means and covariances come from sums over
all labelled rows; covariances are shrunk towards the pooled one and its diagonal. A score is the logistic of
the difference of two Mahalanobis log densities, from Cholesky factors that are computed once and sent along.

Results by case: null and empty texts, and texts without words, have the statistics of no words and get a score
like others; labelled rows without a document, or with a null label, are not used; without rows of both classes
the score is the share of label 1 among the labelled rows (0.5 without any); each input row gives one row,
repeated rows repeat; rows with a null key are scored and never held out; whole texts count, in blocks of bytes; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.members import maybe_among
from ..plans.session import materialize, ship_package, tidy
from .bpe import byte_slices
from .kernels import flat, shingle_hashes, word_hashes, word_spans

FEATURES = ("log_words", "symbols", "bars", "bangs", "upper", "digits", "stops", "word_bytes", "short_words", "line_repeats", "window_repeats")
#: Shrinkage towards the pooled covariance and then towards its diagonal.
POOLED, DIAGONAL = 0.3, 0.15
LIMIT = 6.0
CLASSES = {"symbols": b"#*$%&<>", "bars": b"|", "bangs": b"!", "upper": bytes(range(65, 91)), "digits": b"0123456789", "stops": b".,;:?"}


def repeated_share(values: np.ndarray) -> float:
    """Share of entries that equal an earlier one."""
    return 1 - len(np.unique(values)) / len(values) if len(values) else 0.0


def statistics(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    data, offs = flat(column)
    starts, ends, by = word_spans(data, offs)
    words = word_hashes(data, starts, ends)
    n = np.diff(by).astype(float)
    out = np.zeros((len(offs) - 1, len(FEATURES)))
    out[:, 0] = np.log1p(n)
    for name, chars in CLASSES.items():
        lut = np.zeros(256, np.int32)
        lut[list(chars)] = 1
        total = np.concatenate([[0], np.cumsum(lut[data])])
        # about one character of each kind for every word is much, whatever the length
        out[:, FEATURES.index(name)] = np.log((np.diff(total[offs]) + 0.25) / (n + 4))
    size = ends - starts
    sums = np.concatenate([[0], np.cumsum(size)])
    out[:, 7] = np.log((np.diff(sums[by]) + 10) / (n + 2))
    short = np.concatenate([[0], np.cumsum(size <= 3)])
    out[:, 8] = np.log((np.diff(short[by]) + 0.5) / (n + 2))
    feeds = np.flatnonzero(data == 10)
    cuts = np.union1d(feeds, offs[1:][offs[1:] > offs[:-1]])
    at = np.union1d(feeds + 1, offs[:-1][offs[1:] > offs[:-1]])
    at = at[at < len(data)]
    to = cuts[np.searchsorted(cuts, at)] if len(at) else at
    full = to > at
    at, to = at[full], to[full]
    lines, line_by = word_hashes(data, at, to), np.searchsorted(at, offs)
    windows = shingle_hashes(words)
    for i in range(len(n)):
        a, b = line_by[i : i + 2]
        out[i, 9] = repeated_share(lines[a:b])
        a, b = by[i : i + 2]
        out[i, 10] = repeated_share(windows[a : max(a, b - 4)])
    out[:, 9:] = np.sqrt(out[:, 9:])
    return out


def features(df: DataFrame, key: str, text: str) -> DataFrame:
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in byte_slices(np.asarray(pc.binary_length(b.column(1).fill_null("")))):
                x = statistics(b.column(1)[s.start : s.stop])
                rows = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0)[s.start : s.stop], rows], ["key", "x"])

    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("body")).mapInArrow(tidy(run), f"key {kind}, x array<double>")


@dataclass
class Model:
    """Means, inverse Cholesky factors and log constants of both classes."""

    prior: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    constants: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        logs = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants):
            z = np.einsum("ij,kj->ik", x - mean, factor)
            logs.append(constant - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))


def fit(rows: DataFrame) -> Model:
    """Model from rows of x and label: sums by class, so the data stay where they are."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.get("x", F.lit(i)) for i in range(d)]
    sums = rows.groupBy("label").agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in x]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("p"))
    found = {r["label"]: r for r in sums.where("label IN (0, 1)").collect()}  # two rows
    total = sum(r["n"] for r in found.values())
    if len(found) < 2 or min(r["n"] for r in found.values()) < 3:
        return Model(found[1]["n"] / total if 1 in found else 0.0 if found else 0.5)
    means, covs, counts = [], [], []
    for k in (0, 1):
        n, mean = found[k]["n"], np.array(found[k]["s"]) / found[k]["n"]
        second = np.zeros((d, d))
        for (i, j), v in zip(pairs, found[k]["p"]):
            second[i, j] = second[j, i] = v / n
        means.append(mean)
        covs.append(second - np.outer(mean, mean))
        counts.append(n)
    pooled = sum(n * c for n, c in zip(counts, covs)) / total
    diagonal = np.diag(np.diag(pooled)) + 1e-4 * np.eye(d)
    factors, constants = [], []
    for n, cov in zip(counts, covs):
        mixed = (1 - DIAGONAL) * ((1 - POOLED) * cov + POOLED * pooled) + DIAGONAL * diagonal
        lower = np.linalg.cholesky(mixed)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(n / total) - np.log(np.diag(lower)).sum())
    return Model(counts[1] / total, np.array(means), np.array(factors), np.array(constants))


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of a key's text, modulo."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def known_rows(labels: DataFrame, key: str, kind: str, label: str, folds: int, held: int) -> DataFrame:
    """key and label of the labelled rows outside the held-out fold."""
    return labels.select(F.col(key).cast(kind).alias("key"), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & (remainder(F.col("key"), folds) != held))


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, held: int = 0) -> DataFrame:
    """key, ``held_out`` and ``score`` of every row; rows of remainder ``held`` give no label to the fit."""
    ship_package(df.sparkSession)
    kind = dict(df.dtypes)[key]
    rows = materialize(features(df, key, text), "quality")
    model = fit(rows.join(known_rows(labels, key, kind, label, folds, held), "key").select("x", "label"))
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.score(x))], ["key", "score"])

    out = rows.select("key", "x").mapInArrow(tidy(run), f"key {kind}, score double")
    return out.select(F.col("key").alias(key), F.coalesce(remainder(F.col("key"), folds) == held, F.lit(False)).alias("held_out"), "score")


def keep_good(df: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, held: int = 0) -> DataFrame:
    """The rows of ``df`` with a score of ``threshold`` or more, all columns as they are; no text is shuffled.

    The fit takes statistics of the texts that may have a label, so other texts are looked at once.
    """
    ship_package(df.sparkSession)
    known = known_rows(labels, key, dict(df.dtypes)[key], label, folds, held)
    rows = features(df.where(maybe_among(known, "key", F.col(key))), key, text)
    model = fit(rows.join(known, "key").select("x", "label"))
    sent = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body = b.column(at)
            for s in byte_slices(np.asarray(pc.binary_length(body.fill_null("")))):
                good = sent.value.score(statistics(body[s.start : s.stop])) >= threshold
                if good.any():
                    yield b.slice(s.start, s.stop - s.start).filter(pa.array(good))

    return df.mapInArrow(tidy(run), df.schema)
