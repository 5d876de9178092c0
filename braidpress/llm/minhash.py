"""Near-duplicate detection: one-permutation hashing, banded buckets, star-shaped candidate edges.

A document's set is its distinct five-word shingles (fewer words: the whole sequence as one). Equal sets are
first reduced to one representative, so groups of exact copies cost one row each. A representative's set is
hashed once; the top bits of each hash name its bin, the least hash of a bin is its value, and empty bins
borrow from a full bin found by hashing the bin number and an attempt number (optimal densification). Bands
of the bins give bucket keys. Sets too small for the bins get, besides, the keys of an exact prefix filter.

A bucket gives star edges, from each member to the bucket's least member and to a second hub drawn by hash, never all
pairs. Edges are confirmed on full sets. Then members of a bucket that confirmed links have not brought
together are compared across components; crowded buckets are first parted by further bands, and what is still
mixed after that is compared on full sets in blocks of a bound size. So every two bucket mates are in one
component or have been compared. Components are the fixed point of alternating large and small stars, all in
distributed tables.

Results by case: null or empty text, or text without words, has an empty set, linked with nothing; a row with a
null key has no component and is kept; rows that repeat a key share its component and all stay; ties go to the
least key; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.members import maybe_among
from ..plans.session import discard, materialize, ship_package, tidy
from .bpe import byte_slices
from .kernels import LOWER, U, flat, mix, shingle_hashes, short_hash, word_hashes, word_spans

BINS, BAND_ROWS = 128, 4
#: Sets up to this size also get prefix-filter keys: two sets at 0.75 of which one has at most 32 shingles.
SMALL = 43
PERCENT = 75
#: Members up to which a bucket's pairs are compared at once; chains of further bands, and bands in a chain.
MATES, CHAINS, SPLITS = 32, 4, 5
#: Rows and shingles of a block of the exact comparison, about; texts that share a shingle before it counts as a dense column.
BLOCK_ROWS, BLOCK_SHINGLES, DENSE = 1024, 1 << 18, 16
_BIN_SHIFT = U(64 - 7)


@functools.lru_cache(maxsize=1)
def probes() -> np.ndarray:
    """probes[j, t]: the bin that empty bin j asks at attempt t, drawn by hashing (j, t)."""
    j, t = np.meshgrid(np.arange(BINS, dtype=U), np.arange(512, dtype=U), indexing="ij")
    return (mix(j * U(0x9E3779B97F4A7C15) + (t + U(1)) * U(0xC2B2AE3D27D4EB4F)) >> _BIN_SHIFT).astype(np.int64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """One-permutation signature of a sorted, distinct, non-empty hash array; every bin is filled."""
    bins = (hashes >> _BIN_SHIFT).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    full = np.zeros(BINS, bool)
    value = np.zeros(BINS, U)
    full[bins[first]] = True
    value[bins[first]] = hashes[first]
    empty = np.flatnonzero(~full)
    if len(empty):
        ask = probes()[empty]
        hit = full[ask]
        source = ask[np.arange(len(empty)), hit.argmax(axis=1)]
        lost = ~hit.any(axis=1)
        if lost.any():  # 512 attempts without a full bin: the next full bin upward
            have = np.flatnonzero(full)
            source[lost] = have[np.searchsorted(have, empty[lost]) % len(have)]
        value[empty] = value[source]
    return value


def keys_of(hashes: np.ndarray) -> np.ndarray:
    """Bucket keys of a set: one for each band, and the prefix filter's for small sets."""
    rows = signature(hashes).reshape(-1, BAND_ROWS)
    acc = np.arange(len(rows), dtype=U) * U(0x9E3779B97F4A7C15)
    for k in range(BAND_ROWS):
        acc = mix(acc ^ rows[:, k])
    if len(hashes) <= SMALL:
        n = len(hashes)
        prefix = n - -(-n * PERCENT // 100) + 1
        acc = np.concatenate([acc, mix(hashes[:prefix] ^ U(0x5851F42D4C957F2D))])
    return acc


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offs = flat(column)
    data = LOWER[data]
    starts, ends, by = word_spans(data, offs)
    words = word_hashes(data, starts, ends)
    shingles = shingle_hashes(words)
    for a, b in zip(by[:-1], by[1:]):
        if b - a >= 5:
            yield np.unique(shingles[a : b - 4])
        elif b > a:
            yield np.array([short_hash(words[a:b])], U)
        else:
            yield np.zeros(0, U)


def digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def sketches(df: DataFrame, key: str, text: str) -> DataFrame:
    """node, n_shingles, digest of the set, bucket keys; one row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in byte_slices(np.asarray(pc.binary_length(b.column(1).fill_null("")))):
                sets = list(shingle_sets(b.column(1)[s.start : s.stop]))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0)[s.start : s.stop],
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([digest(x) if len(x) else None for x in sets], pa.binary()),
                        pa.array([keys_of(x).view(np.int64) if len(x) else None for x in sets], pa.list_(pa.int64())),
                    ],
                    ["node", "n_shingles", "digest", "keys"],
                )

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("node"), F.col(text).cast("string").alias("body")).mapInArrow(tidy(run), f"node {kind}, n_shingles long, digest binary, keys array<long>")


def full_sets(df: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """node and its full set, for the rows of ``wanted`` (node, digest)."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in byte_slices(np.asarray(pc.binary_length(b.column(2).fill_null("")))):
                part = b.slice(s.start, s.stop - s.start)
                sets = [x if digest(x) == d else None for x, d in zip(shingle_sets(part.column(2)), part.column(1).to_pylist())]
                at = [i for i, x in enumerate(sets) if x is not None]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array([sets[i].view(np.int64) for i in at], pa.list_(pa.int64()))], ["node", "hashes"])

    texts = df.select(F.col(key).alias("node"), F.col(text).cast("string").alias("body"))
    texts = texts.where(maybe_among(wanted, "node", F.col("node")))
    # rows that repeat a key and its text count once; the join has dealt them by key already
    once = wanted.join(texts, "node").withColumn("same", F.xxhash64("body")).dropDuplicates(["node", "same"])
    return once.select("node", "digest", "body").mapInArrow(tidy(run), f"node {kind}, hashes array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity, by exact intersection."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", F.size("ha").alias("na"), F.size("hb").alias("nb"), F.size(F.array_intersect("ha", "hb")).alias("common"))
    return both.where(F.lit(100) * F.col("common") >= F.lit(PERCENT) * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """node and component (its least node) for all nodes of the edges (a, b); alternating stars to the fixed point."""
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        then = materialize(small, label)
        found = then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        discard(now)
        now = then
        if found[0] == found[2] and tuple(found) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = tuple(found)


def near_sizes(x, y):
    """Sizes that allow the similarity at all."""
    return 100 * F.least(x, y) >= PERCENT * F.greatest(x, y)


def apart(placed: DataFrame, keys: DataFrame) -> DataFrame:
    """Pairs (a, b) of bucket mates in different components, from (key, node, n, comp).

    A bucket of at most MATES members gives all its pairs across components, so pairs grow with the members. A
    larger one, such as of many texts that share one passage, is parted by a further band of its members, in
    CHAINS independent chains: texts at the similarity share about ten of the bands and meet again in the
    parts of several chains, while others fall apart. What is still large after SPLITS bands gives a star;
    :func:`across_blocks` compares what that leaves apart.
    """
    bands = BINS // BAND_ROWS
    found = None
    for depth in range(SPLITS + 1):
        mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("members"), F.min(F.struct("node", "n", "comp")).alias("hub")).where("low != high").select("key", "members", "hub")
        rows = materialize(placed.join(mixed, "key"), f"apart{depth}")
        few = rows.where(F.col("members") <= MATES)
        one = few.select("key", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("cx"))
        other = few.select("key", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("comp").alias("cy"))
        across = one.join(other, "key").where((F.col("x") < F.col("y")) & (F.col("cx") != F.col("cy")) & near_sizes(F.col("nx"), F.col("ny"))).select(F.col("x").alias("a"), F.col("y").alias("b"))
        many = rows.where(F.col("members") > MATES)
        if depth == SPLITS:
            star = many.where((F.col("comp") != F.col("hub.comp")) & near_sizes(F.col("n"), F.col("hub.n"))).select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
            across = across.union(star)
        pairs = materialize(across.distinct(), f"across{depth}")
        found = pairs if found is None else found.union(pairs)
        if depth == SPLITS or not many.take(1):
            return found.distinct()
        # the bucket keys of these members travel with them from here on
        held = many.select("key", "node", "n", "comp", "keys") if depth else materialize(many.select("key", "node", "n", "comp").join(keys, "node"), "held")

        def parted(chain: int) -> DataFrame:
            band = F.pmod(F.xxhash64("key", F.lit(chain), F.lit(depth)), F.lit(bands)).cast("int")  # noqa: B023
            return held.select(F.xxhash64("key", F.lit(chain), F.get("keys", band)).alias("key"), "node", "n", "comp", "keys")  # noqa: B023

        parts = [parted(c) for c in range(CHAINS if depth == 0 else 1)]
        placed = functools.reduce(DataFrame.union, parts)
    raise AssertionError


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set of distinct hashes."""
    sets = [*left, *right]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    kinds, token = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    here = row < len(left)
    f_left, f_right = np.bincount(token[here], minlength=len(kinds)), np.bincount(token[~here], minlength=len(kinds))
    out = np.zeros((len(left), len(right)), np.float32)
    both = (f_left > 0) & (f_right > 0)
    dense = np.flatnonzero(both & (np.maximum(f_left, f_right) >= DENSE))
    place = np.full(len(kinds), -1)
    place[dense] = np.arange(len(dense))
    at = place[token]
    for low in range(0, len(dense), 2048):
        use = (at >= low) & (at < low + 2048)
        table = np.zeros((len(sets), min(2048, len(dense) - low)), np.float32)
        table[row[use], at[use] - low] = 1
        out += table[: len(left)] @ table[len(left) :].T
    # the others stand in few sets: their pairs one by one
    rest = both & (place < 0)
    one, other = here & rest[token], ~here & rest[token]
    rows_right = row[other][np.argsort(token[other], kind="stable")] - len(left)
    first = np.concatenate([[0], np.cumsum(np.where(rest, f_right, 0))])
    times = f_right[token[one]]
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    cell = np.repeat(row[one], times) * len(right) + rows_right[np.repeat(first[token[one]], times) + step]
    return out + np.bincount(cell, minlength=out.size).reshape(out.shape)


def linking(nodes: list, comps: list, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple]:
    """Links between left and right rows that join different components; no more than bring them together."""
    common = common_counts([sets[i] for i in left], [sets[i] for i in right])
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    _, comp = np.unique(np.asarray(comps, object).astype(str), return_inverse=True)
    near = 100 * common >= PERCENT * (size[left][:, None] + size[right][None, :] - common)
    x, y = np.nonzero(near & (comp[left][:, None] != comp[right][None, :]))
    x, y = left[x], right[y]
    low, high = np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])
    _, one = np.unique(low * len(sets) + high, return_index=True)
    root = list(range(len(sets)))

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for i in one.tolist():
        u, v = top(int(low[i])), top(int(high[i]))
        if u != v:
            root[max(u, v)] = min(u, v)
            out.append((int(x[i]), int(y[i])))
    return out


def across_blocks(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links (a, b) that join the components of crowded buckets' members, from (key, node, n, comp).

    Every two members of different components are compared on their full sets, so nothing is left to chance.
    The members outside a bucket's largest component and those inside are dealt to blocks of bound size; a cell
    is a pair of blocks, of which one holds outside members. A bucket's cells go to different tasks.
    """
    sums = placed.groupBy("key", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    of_key = sums.groupBy("key").agg(F.max(F.struct("rows", "shingles", "comp")).alias("most"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"))
    blocks = lambda rows, shingles: F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    crowded = of_key.where((F.col("rows") > MATES) & (F.col("rows") > F.col("most.rows")))
    plan = crowded.select("key", F.col("most.comp").alias("main"), blocks(F.col("rows") - F.col("most.rows"), F.col("shingles") - F.col("most.shingles")).alias("outer"), blocks(F.col("most.rows"), F.col("most.shingles")).alias("inner"))
    draw = F.xxhash64("node", "key")
    outside = F.col("comp") != F.col("main")
    own = F.when(outside, F.pmod(draw, "outer")).otherwise(F.col("outer") + F.pmod(draw, "inner")).cast("int")
    met = F.sequence(F.lit(0), F.when(outside, F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1)
    rows = placed.join(plan, "key").withColumn("own", own).withColumn("met", met).select("key", "node", "comp", "own", "met")
    rows = materialize(rows, "crowded")
    kind = dict(placed.dtypes)["node"]
    if not rows.take(1):
        return rows.select(F.col("node").alias("a"), F.col("node").alias("b"))
    cells = rows.join(sets, "node").select("key", "node", "comp", "own", "hashes", F.explode("met").alias("other"))
    cells = cells.select(F.struct("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("cell"), "node", "comp", "own", "hashes")

    def compare(t: pa.Table) -> pa.Table:
        own = np.asarray(t["own"])
        i, j = own.min(), own.max()
        values = t["hashes"].combine_chunks()
        flat_values, offs = np.asarray(values.values).view(U), np.asarray(values.offsets)
        found = [flat_values[x:y] for x, y in zip(offs[:-1], offs[1:])]
        nodes = t["node"].combine_chunks()
        cell = t["cell"][0].as_py()
        pairs = []
        if (i, j) == (cell["i"], cell["j"]):  # else one of the two blocks is empty
            pairs = linking(nodes.to_pylist(), t["comp"].to_pylist(), found, np.flatnonzero(own == i), np.flatnonzero(own == j))
        a, b = (pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1))
        return pa.table({"a": nodes.take(a), "b": nodes.take(b)})

    return cells.groupBy("cell").applyInArrow(compare, f"a {kind}, b {kind}")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``n_shingles``, ``component_id`` and ``kept`` for every row."""
    spark = df.sparkSession
    ship_package(spark)
    rows = materialize(sketches(df, key, text), "sketch")
    sets = rows.where("digest IS NOT NULL AND node IS NOT NULL")
    reps = materialize(sets.groupBy("digest").agg(F.min("node").alias("node"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")), "reps")
    keyed = reps.select("node", "n", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub"), F.min(F.struct(F.xxhash64("node", "key").alias("draw"), "node", "n")).alias("second"), F.count("*").alias("members")).where("members > 1")
    mates = materialize(keyed.join(hubs, "key").select("key", "node", "n", "hub", F.struct("second.node", "second.n").alias("second")), "mates")

    stars = (
        mates.select("node", "n", F.explode(F.array("hub", "second")).alias("h"))
        .where((F.col("node") != F.col("h.node")) & near_sizes(F.col("n"), F.col("h.n")))
        .select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b"))
        .distinct()
    )
    stars = materialize(stars, "stars")
    wanted = materialize(reps.select("node", "digest").join(mates.select("node").distinct(), "node", "left_semi"), "wanted")
    hashed = materialize(full_sets(df, wanted, key, text), "sets")
    links = materialize(confirmed(stars, hashed), "links")
    comps = components(links)

    placed = mates.select("key", "node", "n").join(comps, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("comp"))
    more = materialize(confirmed(apart(placed, reps.select("node", "keys")).join(stars, ["a", "b"], "left_anti"), hashed), "more")
    if more.take(1):
        comps = components(links.union(more), "cc2")
        placed = mates.select("key", "node", "n").join(comps, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("comp"))
    last = materialize(across_blocks(placed, hashed), "last")
    if last.take(1):
        comps = components(links.union(more).union(last), "cc3")

    class_of = reps.select("digest", F.col("node").alias("rep")).join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("cls"))
    joined = rows.select("node", "n_shingles", "digest").join(class_of, "digest", "left")
    # a key whose rows have several sets joins their classes
    split = joined.where("node IS NOT NULL").groupBy("node").agg(F.min("cls").alias("low"), F.max("cls").alias("high"))
    bridges = split.where("low IS NOT NULL AND low != high")
    if bridges.take(1):
        merged = components(joined.where("node IS NOT NULL AND cls IS NOT NULL").select(F.col("node").alias("a"), F.col("cls").alias("b")).distinct(), "cc4")
        named = joined.join(merged.withColumnRenamed("component", "final"), "node", "left").select("node", "n_shingles", F.coalesce("final", "node").alias("cls"))
    else:
        named = joined.select("node", "n_shingles", F.coalesce("cls", "node").alias("cls"))
    out = materialize(
        named.select(
            F.col("node").alias(key),
            "n_shingles",
            F.when(F.col("node").isNotNull(), F.col("cls")).alias("component_id"),
            F.coalesce(F.col("node") == F.col("cls"), F.lit(True)).alias("kept"),
        ),
        "classes",
    )
    for t in (rows, reps, mates, stars, wanted, hashed, links, more, last):
        discard(t)
    return out


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without the documents that are not the least of their class; all columns as they are.

    Rows whose key cannot be a dropped one stay where they are; only the others are dealt by key.
    """
    dropped = materialize(near_duplicates(df, key, text).where(~F.col("kept")).select(F.col(key).alias("gone")).distinct(), "dropped")
    maybe = maybe_among(dropped, "gone", F.col(key))
    suspects = df.where(maybe).join(dropped.withColumnRenamed("gone", key), key, "left_anti")
    return df.where(~maybe).unionByName(suspects)
