"""Benchmark decontamination by spaced-seed hashing.

Fixed masks mark which of a run of consecutive words count; the others may differ, so a hash of the marked
words survives substitutions. The seeds of every document position are tested against a bitmap of the
benchmark's seeds (of fixed size, whatever the benchmark's), and the survivors are joined to the benchmark's
seeds on the full hash. A hit lays an item on a document. Each placement is verified on the whole words of
both: the best run of agreeing words, substitutions allowed, must be long and dense enough, or most of the
item's words must agree. Only the words under the placements travel to be verified.

Long masks serve items of a dozen words or more, short masks items below SHORT_ITEM words too, so that a short
item survives a few substitutions; items of five or six words are looked up whole.

Words are the separator-free runs of a text with A-Z lower-cased and ASCII punctuation taken off both ends.

Results by case: null, empty and wordless texts have no hits, on either side; items below five words, which
common phrases hold by chance, match nothing; repeated rows and repeated items give one row per key and item, the
best; rows with a null key report null; texts and items are covered whole, whatever their length; ties of the best
overlap go to the earliest; extra columns are ignored; an empty table, or an empty benchmark, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.members import maybe_among
from ..plans.session import discard, materialize, ship_package, tidy
from .bpe import byte_slices
from .kernels import LOWER, U, flat, mix, word_hashes, word_spans

#: Items below this many words get the short masks too.
SHORT_ITEM = 25
#: Fixed masks over consecutive words (1 counts, 0 may differ), and the sizes of the items that they serve.
MASKS = (
    ("1101100101011", 13, None),
    ("1110010110111", 13, None),
    ("111010011011", 12, None),
    ("11101011001011", 14, None),
    ("1101011", 7, SHORT_ITEM - 1),
    ("1110101", 7, SHORT_ITEM - 1),
    ("111111", 6, 6),
    ("11111", 5, 5),
)
#: A verified overlap has this many agreeing words at this density, or this share of the whole item's words.
MIN_WORDS, MIN_DENSITY = 12, 0.75
BITMAP_BITS = 1 << 26
PUNCT = np.zeros(256, bool)
PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def normal_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normalised words of all rows, and word offsets by row."""
    data, offs = flat(column)
    data = LOWER[data]
    starts, ends, by = word_spans(data, offs)
    if len(starts):
        solid = np.concatenate([[0], np.cumsum(~PUNCT[data])])
        place = np.flatnonzero(~PUNCT[data])
        has = solid[ends] > solid[starts]
        starts, ends = starts[has].copy(), ends[has].copy()
        by = np.concatenate([[0], np.cumsum(has)])[by]
        starts, ends = place[solid[starts]], place[solid[ends] - 1] + 1
    return word_hashes(data, starts, ends, seed=10), by


def seeds(words: np.ndarray, number: int) -> np.ndarray:
    """Hash of mask ``number`` at every position where it fits."""
    mask = MASKS[number][0]
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U)
    acc = np.full(n, (number + 1) * 0x9E3779B97F4A7C15 % (1 << 64), U)
    for k, bit in enumerate(mask):
        if bit == "1":
            acc = (acc ^ words[k : k + n]) * U(0xD6E8FEB86659FD93)
            acc ^= acc >> U(29)
    return mix(acc)


def masks_for(size: int) -> list[int]:
    """Numbers of the masks that serve an item of so many words."""
    return [k for k, (_, low, high) in enumerate(MASKS) if low <= size <= (high or size)]


def item_words(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """iid, item, iwords: the word hashes of each different item."""
    kind = dict(benchmark.dtypes)[item]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in byte_slices(np.asarray(pc.binary_length(b.column(1).fill_null("")))):
                words, by = normal_words(b.column(1)[s.start : s.stop])
                lists = pa.ListArray.from_arrays(by.astype(np.int32), pa.array(words.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0)[s.start : s.stop], lists], ["item", "iwords"])

    rows = benchmark.select(F.col(item).alias("item"), F.col(text).cast("string").alias("body")).mapInArrow(tidy(run), f"item {kind}, iwords array<long>")
    return rows.select(F.xxhash64(F.col("item").cast("string"), "iwords").alias("iid"), "item", "iwords").dropDuplicates(["iid"])


def item_seeds(items: DataFrame) -> DataFrame:
    """iid, ilen, ipos, mask, hash: one short row per seed of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                words = np.asarray(b.column(1)[i].values).view(U)
                for k in masks_for(len(words)):
                    h = seeds(words, k)
                    fill = lambda v, t: pa.array(np.full(len(h), v, t))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [fill(b.column(0)[i].as_py(), np.int64), fill(len(words), np.int32), pa.array(np.arange(len(h), dtype=np.int32)), fill(k, np.int32), pa.array(h.view(np.int64))],
                        ["iid", "ilen", "ipos", "mask", "hash"],
                    )

    return items.select("iid", "iwords").mapInArrow(tidy(run), "iid long, ilen int, ipos int, mask int, hash long")


def bitmap_of(rows: DataFrame) -> tuple[bytes, list[int]]:
    """A bitmap of the seeds' hashes, BITMAP_BITS long at most, and the masks that some item needs.

    It is merged from partial bitmaps of its fixed size, so what reaches the driver has a proven bound.
    """
    slot = F.pmod("hash", F.lit(BITMAP_BITS))
    parts = rows.select(F.shiftright(slot, 3).alias("byte"), F.call_function("shiftleft", F.lit(1), (slot % 8).cast("int")).alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bit"))
    table = np.zeros(BITMAP_BITS >> 3, np.uint8)
    got = parts.toArrow()  # bits / 8 rows of 12 bytes at most
    table[np.asarray(got["byte"])] = np.asarray(got["bit"]).astype(np.uint8)
    return table.tobytes(), sorted(r[0] for r in rows.select("mask").distinct().collect())  # as many rows as masks


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Best run of agreeing words when item word i lies on doc word i + shift: first and last doc word, agreeing words.

    Agreement scores 1 and a substitution -2; the run of the highest score wins, the earliest among ties. Where
    that falls short but most of the item's words agree, the run is the item's whole range.
    """
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    same = doc[low + shift : high + shift] == item[low:high]
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    floor = np.minimum.accumulate(score)
    end = int(np.argmax(score - floor))
    begin = int(np.flatnonzero(score[: end + 1] == floor[end])[0])
    n = int(same[begin:end].sum())
    if n < MIN_WORDS and len(same) and same.sum() >= MIN_DENSITY * len(item):
        hit = np.flatnonzero(same)
        begin, end, n = int(hit[0]), int(hit[-1]) + 1, len(hit)
    return low + shift + begin, low + shift + end, n


def verified(found: tuple[int, int, int], size: int) -> bool:
    """Whether an overlap with an item of ``size`` words is long and dense enough."""
    begin, end, n = found
    return end > begin and n >= min(MIN_WORDS, MIN_DENSITY * size) and n >= MIN_DENSITY * (end - begin)


def contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per key and item whose words verifiably overlap.

    Columns: the key, the item's id, ``n_words`` (agreeing words of the best overlap), ``first_word`` and
    ``end_word`` (its range among the document's words) and ``density`` (agreeing words in the range).
    """
    spark = df.sparkSession
    ship_package(spark)
    ikind, kind = dict(benchmark.dtypes)[item], dict(df.dtypes)[key]
    items = materialize(item_words(benchmark, item, item_text), "items")
    tests = materialize(item_seeds(items), "seeds")
    shared = spark.sparkContext.broadcast(bitmap_of(tests))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key).alias("key"), body.alias("body")).withColumn("rid", F.xxhash64(F.col("key").cast("string"), "body"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, used = shared.value
        bitmap = np.frombuffer(raw, np.uint8)
        for b in batches:
            for s in byte_slices(np.asarray(pc.binary_length(b.column(1)))):
                words, by = normal_words(b.column(1)[s.start : s.stop])
                for k in used:
                    h = seeds(words, k)
                    slot = h & U(BITMAP_BITS - 1)
                    hit = np.flatnonzero(bitmap[(slot >> U(3)).astype(np.int64)] >> (slot & U(7)).astype(np.uint8) & 1)
                    row = np.searchsorted(by, hit, "right") - 1
                    inside = hit + len(MASKS[k][0]) <= by[row + 1]
                    hit, row = hit[inside], row[inside]
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + s.start)), pa.array(hit - by[row]), pa.array(h[hit].view(np.int64))], ["rid", "pos", "hash"])

    hits = materialize(rows.select("rid", "body").mapInArrow(tidy(probe), "rid long, pos long, hash long"), "hits")
    placed = hits.join(tests.select("iid", "ilen", "ipos", "hash"), "hash").select("rid", "iid", "ilen", (F.col("pos") - F.col("ipos")).alias("shift")).distinct()
    want = placed.groupBy("rid", "iid", "ilen").agg(F.sort_array(F.collect_list("shift")).alias("shifts"))
    want = materialize(want.groupBy("rid").agg(F.collect_list(F.struct("iid", "ilen", "shifts")).alias("want")), "placed")
    discard(hits)
    discard(tests)
    touched = rows.where(maybe_among(want, "rid", F.col("rid"))).dropDuplicates(["rid"]).join(want, "rid").select("key", "body", "want")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                words, _ = normal_words(b.column(1)[i : i + 1])
                out: list[tuple] = []
                for w in b.column(2)[i].as_py():
                    shifts, size = np.asarray(w["shifts"]), w["ilen"]
                    # placements that overlap share one stretch of words
                    for part in np.split(shifts, np.flatnonzero(np.diff(shifts) > size) + 1):
                        low, high = max(0, int(part[0])), min(len(words), int(part[-1]) + size)
                        out.append((w["iid"], low, words[low:high].view(np.int64), part))
                columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(out), i))), *columns], ["key", "iid", "low", "words", "shifts"])

    stretches = touched.mapInArrow(tidy(cut), f"key {kind}, iid long, low long, words array<long>, shifts array<long>")
    both = materialize(stretches, "stretches").join(items, "iid").select("key", "item", "low", "words", "shifts", "iwords")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i in range(b.num_rows):
                low = b.column(2)[i].as_py()
                words, own = np.asarray(b.column(3)[i].values), np.asarray(b.column(5)[i].values)
                best: tuple = ()
                for shift in b.column(4)[i].as_py():
                    found = overlap(words, own, shift - low)
                    if verified(found, len(own)):
                        begin, end, n = found
                        best = max(best, (n, n / (end - begin), -(low + begin), low + end))
                if best:
                    out.append((i, *best))
            where = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(where), b.column(1).take(where), *[pa.array([o[k] for o in out], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]],
                ["key", "item", "n_words", "density", "first", "end_word"],
            )

    checked = both.mapInArrow(tidy(verify), f"key {kind}, item {ikind}, n_words long, density double, first long, end_word long")
    best = checked.groupBy("key", "item").agg(F.max(F.struct("n_words", "density", "first", "end_word")).alias("m"))
    return best.select(F.col("key").alias(key), F.col("item").alias(item if item != key else f"item_{item}"), "m.n_words", (-F.col("m.first")).alias("first_word"), "m.end_word", "m.density")
