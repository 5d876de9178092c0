"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A window is a string of ``window`` bytes (LENGTH unless told) inside one text. Each window belongs to one suffix bucket, named by its
content: by its least k-mer, on which side of it the window reaches further, and the bytes that all such windows
share. Equal windows share a bucket, so buckets are sorted one by one, each on its own, and a bucket
whose name occurs once is never sorted at all.

In a block, suffixes are sorted bucket by bucket (by leading bytes), COVER bytes deep. Ties are resolved by
precomputed ranks of the difference-cover sample: for two suffixes there is a shift below COVER that puts
both on sample positions, whose ranks reach beyond a window. So a bucket needs memory for its own
suffixes and the sample's ranks only. Neighbours in suffix order that agree on a window's bytes are repeats.

Runs of windows of one text that share a bucket travel as one segment, and equal segments are counted, not
copied, so a passage that a third of all texts share is sent and sorted once per block.

With ``min_words``, only runs that touch so many words go: short windows then find passages whose bytes are
few, and repeats of less than a passage stay.

Results by case: null text is empty; a text shorter than a window keeps everything; repeated rows are separate
occurrences, so they remove each other's bytes; rows with null keys count like others;
removed bytes may leave broken UTF-8, which the byte result keeps as it is and the text result drops; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.members import maybe_among
from ..plans.session import discard, materialize, ship_package, tidy
from .bpe import byte_slices
from .kernels import BASE, SEPARATORS, U, flat, mix, powers

LENGTH = 400
KMER = 32
#: Window for passages of more than fifty words: they may be shorter than LENGTH, while fifty words of prose are not below this.
PASSAGE, PASSAGE_WORDS = 232, 50
#: Bytes scanned at once: their arrays fit the caches.
CHUNK = 1 << 16
#: A difference cover modulo 57: each residue is the difference of two members (fixed value).
COVER = 57
MEMBERS = (0, 1, 3, 13, 32, 36, 43, 52)
#: Different segments of a bucket beyond which it is parted by finer names, and the width of their pieces.
CROWD, NARROW = 1024, 16
#: Bytes of texts that look up their segments together.
GROUP_BYTES = 1 << 20
#: Suffixes sorted at once inside a block, and bytes of a block.
BUCKET = 1 << 16
BLOCK_BYTES = 1 << 20


# --- scanning: windows to buckets -------------------------------------------------------------------


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w entries."""
    n = len(x) - w + 1
    pad = -len(x) % w
    full = np.concatenate([x, np.full(pad, x.dtype.type(np.iinfo(x.dtype).max))]).reshape(-1, w)
    head = np.minimum.accumulate(full, axis=1).ravel()
    tail = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[w - 1 : w - 1 + n])


class Hasher:
    """Hashes of any substrings of a buffer from polynomial prefix sums."""

    def __init__(self, data: np.ndarray, window: int) -> None:
        self.up, self.down = powers(CHUNK + 2 * window)
        self.acc = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * self.up[: len(data)], out=self.acc[1:])

    def __call__(self, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        return mix((self.acc[to] - self.acc[at]) * self.down[at])

    def kmers(self, n: int) -> np.ndarray:
        return mix((self.acc[KMER : KMER + n] - self.acc[:n]) * self.down[:n])


def segments(data: np.ndarray, offs: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """row, first window, windows, bucket, content hash and distance to the k-mer of each segment of a buffer.

    The buffer is at most CHUNK and a window long, so positions fit the low bits of the hashes that are compared.
    Windows of a bucket start in the same half of the reach before their k-mer.
    """
    span = window - KMER + 1
    half = (span + 1) // 2
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U, U, np.int64))
    if len(data) < window:
        return empty
    h = Hasher(data, window)
    n = len(data) - KMER + 1
    order = (h.kmers(n) & ~U((1 << 20) - 1)) | np.arange(n, dtype=U)
    least = sliding_min(order, span)
    pos = (least & U((1 << 20) - 1)).astype(np.int64)
    start = np.arange(len(pos))
    row = np.searchsorted(offs, start, "right") - 1
    inside = start + window <= offs[row + 1]
    start, row, pos = start[inside], row[inside], pos[inside]
    if not len(start):
        return empty
    far = (pos - start >= half).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(pos) != 0) | (np.diff(row) != 0) | (np.diff(far) != 0) | (np.diff(start) != 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    p, f, at = pos[first], far[first], start[first]
    # what all windows of a half share: from the latest start to the earliest end
    low = np.where(f == 1, p - half, p)
    high = np.where(f == 1, p - (span - 1), p - (half - 1)) + window
    bucket = mix(h(low, high) + (f.astype(U) + U(1)) * U(BASE))
    content = h(at, at + count + window - 1) + count.astype(U) * U(0x8CB92BA72F3D8DD7)
    return row[first], at, count, bucket, mix(content + (p - at).astype(U)), p - at


def scan(data: np.ndarray, offs: np.ndarray, window: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments of any buffer: short texts together, long texts in overlapping chunks of windows."""
    k, n = 0, len(offs) - 1
    while k < n:
        stop = max(int(np.searchsorted(offs, offs[k] + CHUNK, "right")) - 1, k + 1)
        size = offs[stop] - offs[k]
        for a in range(0, max(int(size) - window + 1, 1), CHUNK):
            b = min(a + CHUNK + window - 1, int(size)) if size > CHUNK else int(size)
            base = int(offs[k]) + a
            local = np.clip(offs[k : stop + 1] - base, 0, b - a)
            row, at, count, bucket, content, lead = segments(data[base : base + b - a], local, window)
            if len(row):
                yield row + k, at + base - offs[row + k], count, bucket, content, lead
            if size <= CHUNK:
                break
        k = stop


# --- sorting: one block of segments ------------------------------------------------------------------


@functools.lru_cache(maxsize=1)
def shifts() -> tuple[np.ndarray, np.ndarray]:
    """shift[r, s]: least d below COVER with r + d and s + d both members; and which residues are members."""
    member = np.zeros(COVER, bool)
    member[list(MEMBERS)] = True
    d = np.arange(COVER)
    hit = member[(d[:, None, None] + d) % COVER] & member[(d[None, :, None] + d) % COVER]
    if not hit.any(axis=2).all():
        raise AssertionError("not a difference cover")
    return hit.argmax(axis=2), member


def packed_words(text: np.ndarray) -> np.ndarray:
    """Big-endian 64-bit word at every position; text is padded with a window and 64 zero bytes at least."""
    n = len(text) - 8
    out = np.zeros(n, U)
    for k in range(8):
        out <<= U(8)
        out |= text[k : k + n]
    return out


def dense(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Ranks (equal for equal keys) given a sorting order of the keys."""
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def leading(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """The first COVER bytes at each position as seven words and a byte."""
    return (*[words[at + 8 * k] for k in range(COVER // 8)], words[at + 8 * (COVER // 8)] >> U(56))


def tie_order(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order by several keys, refining only what still ties, and the group number of each sorted place."""
    order = np.argsort(keys[0], kind="stable")
    s = keys[0][order]
    group = np.cumsum(np.concatenate([[False], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    for k in keys[1:]:
        twin = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        at = np.flatnonzero(twin)
        if not len(at):
            break
        g, v = group[at], k[order[at]]
        sub = np.lexsort((v, g))
        order[at] = order[at][sub]
        split = np.zeros(len(order), bool)
        split[1:] = group[1:] != group[:-1]
        v = v[sub]
        fresh = np.concatenate([[False], (v[1:] != v[:-1])])
        split[at] |= fresh & np.concatenate([[False], at[1:] - at[:-1] == 1])
        group = np.cumsum(split)
    return order, group


def sample_ranks(words: np.ndarray, size: int, window: int) -> np.ndarray:
    """Rank by at least a window of each sample position below size; -1 elsewhere. Prefix doubling in steps of COVER."""
    member = shifts()[1]
    at = np.flatnonzero(member[np.arange(size) % COVER])
    order, group = tie_order(leading(words, at))
    rank = np.full(size + 8 * COVER + window, -1, np.int64)
    rank[at[order]] = group
    depth = COVER
    while depth < window:
        key = ((rank[at] + 1) << 32) | (rank[at + depth] + 1)
        order = np.argsort(key, kind="stable")
        rank[at] = dense(order, key)
        depth *= 2
    return rank


def repeats(text: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """For each start (a window in text): whether another start has the same window."""
    shift, _ = shifts()
    padded = np.concatenate([text, np.zeros(window + 9 * COVER + 16, np.uint8)])
    words = packed_words(padded)
    rank = sample_ranks(words, len(text) + 2 * COVER, window)
    found = np.zeros(len(starts), bool)
    lead = (words[starts] >> U(40)).astype(np.int64)
    # suffix buckets: ranges of leading bytes, one sorted after the other
    ladder = np.argsort(lead, kind="stable")
    edges = np.flatnonzero(np.diff(lead[ladder], prepend=-1))
    cuts, last = [], 0
    for e in [*edges[1:].tolist(), len(ladder)]:
        if e - last >= BUCKET or e == len(ladder):
            cuts.append((last, e))
            last = e
    for a, b in cuts:
        own = ladder[a:b]
        order, group = tie_order(leading(words, starts[own]))
        sizes = np.bincount(group)
        keep = sizes[group] > 1
        own, group = own[order][keep], group[keep]
        rounds = 0
        # all tied groups at once: part each by its middle member, comparing at the shift that both residues share
        while len(own):
            head = np.flatnonzero(np.diff(group, prepend=-1))
            size = np.diff(np.append(head, len(own)))
            pick = head + (size * ((rounds * 0.381966 + 0.5) % 1)).astype(np.int64)
            which = np.repeat(np.arange(len(head)), size)
            pivot = starts[own[pick]][which]
            here = starts[own]
            d = shift[here % COVER, pivot % COVER]
            diff = rank[here + d] - rank[pivot + d]
            # agreement on a window is what counts; ranks may tell apart bytes beyond it
            side = np.sign(diff)
            equal = side == 0
            near = np.flatnonzero(~equal)
            if len(near):
                x, y = here[near], pivot[near]
                ok = np.ones(len(near), bool)
                for k in (*range(0, window - 8, 8), window - 8):
                    i = np.flatnonzero(ok)
                    if not len(i):
                        break
                    ok[i] = words[x[i] + k] == words[y[i] + k]
                equal[near[ok]] = True
            mates = np.add.reduceat(equal.astype(np.int64), head)
            found[own[equal & (mates[which] > 1)]] = True
            rest = np.flatnonzero(~equal)
            key = which[rest] * 2 + (side[rest] > 0)
            again = np.argsort(key, kind="stable")
            rest, key = rest[again], key[again]
            group = np.cumsum(np.diff(key, prepend=key[:1]) != 0) if len(key) else key
            sizes = np.bincount(group) if len(group) else group
            keep = sizes[group] > 1 if len(group) else np.zeros(0, bool)
            own, group = own[rest][keep], group[keep]
            rounds += 1
    return found


def block_ranges(texts: list[bytes], counts: np.ndarray, window: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each segment of a block: ranges [from, to) of its windows that repeat in the block."""
    sizes = np.array([len(t) for t in texts])
    base = np.concatenate([[0], np.cumsum(sizes)])
    which = np.repeat(np.arange(len(texts)), counts)
    within = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    hit = repeats(np.frombuffer(b"".join(texts), np.uint8), base[which] + within, window)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    # a run of windows may not cross into the next segment
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        while a < b:
            s = which[a]
            end = min(b, a + int(counts[s] - within[a]))
            out[s].append((int(within[a]), int(within[end - 1]) + 1))
            a = end
    return out


# --- the operator ------------------------------------------------------------------------------------


def _ranges(cuts: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in c] for c in cuts], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))


def decisions(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = LENGTH) -> tuple[DataFrame, int]:
    """group, bucket, content and ``ranges``: the windows of a segment that repeat, for each group of texts that
    holds the segment; and the number of groups.

    Texts are grouped by a hash, about GROUP_BYTES to a group. A segment is looked up once for a group, however
    many of its texts hold it, so a passage that every text holds costs a row for each group.
    """
    if window < 2 * KMER:
        raise ValueError(f"a window has {2 * KMER} bytes at least")
    ship_package(df.sparkSession)
    rows = _rows(df, key, text)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in byte_slices(np.asarray(pc.binary_length(b.column(1)))):
                rid = np.asarray(b.column(0))[s]
                data, offs = flat(b.column(1)[s.start : s.stop])
                for row, at, count, bucket, content, lead in scan(data, offs, window):
                    small = [pa.array(x.astype(np.int32)) for x in (at, count, lead)]
                    yield pa.RecordBatch.from_arrays([pa.array(rid[row]), *small, pa.array(bucket.view(np.int64)), pa.array(content.view(np.int64))], ["rid", "at", "n", "lead", "bucket", "content"])

    segs = materialize(rows.mapInArrow(tidy(found), "rid long, at int, n int, lead int, bucket long, content long"), "segments")
    windows = segs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = 1 << max(4, int(windows // GROUP_BYTES).bit_length())
    # any place that holds a segment stands for it; all firsts are of one row, and such sums are kept by hash
    one = [F.first(c).alias(c) for c in ("rid", "at", "n", "lead")]
    held = materialize(segs.groupBy(F.pmod("rid", F.lit(groups)).alias("group"), "bucket", "content").agg(F.count("*").alias("uses"), *one), "held")
    discard(segs)
    # tables on both sides of each join on a bucket, so that a hot one can be split where it is joined
    shared = materialize(held.groupBy("bucket").agg(F.sum("uses").alias("uses")).where("uses > 1").select("bucket"), "names")
    hot = materialize(held.join(shared, "bucket"), "shared")
    discard(held)
    discard(shared)
    kinds = materialize(hot.groupBy("bucket", "content").agg(F.sum("uses").alias("uses"), *one), "kinds")
    several = materialize(kinds.groupBy("bucket").agg(F.count("*").alias("kinds")).where("kinds > 1"), "several")
    # only buckets of different segments need sorting
    items = materialize(kinds.join(several, "bucket").withColumn("off", F.lit(0)), "items")
    results = [_sorted(rows, items.where(F.col("kinds") <= CROWD).withColumn("part", F.col("bucket")), window)]
    crowded = items.where(F.col("kinds") > CROWD)
    spare = [several, items]
    if crowded.take(1):
        spare += _narrow(rows, crowded, results, window)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").cast("long").alias("b")))
    decided = kinds.where("uses > 1").select("bucket", "content", whole.alias("ranges"))
    for r in results:
        decided = decided.unionByName(r)
    decided = materialize(decided.where(F.size("ranges") > 0), "decided")
    out = materialize(hot.select("group", "bucket", "content").join(decided, ["bucket", "content"]).select("group", "bucket", "content", "ranges"), "decisions")
    for t in (hot, kinds, decided, *spare):
        discard(t)
    return out, groups


def _asked(rows: DataFrame, items: DataFrame, *more: str) -> DataFrame:
    """body, and ``want``: the segments of it that are to be looked at."""
    want = items.groupBy("rid").agg(F.collect_list(F.struct("at", "n", "lead", "bucket", "content", "off", *more)).alias("want"))
    return rows.where(maybe_among(items, "rid", F.col("rid"))).join(want, "rid").select("body", "want")


def _sorted(rows: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """bucket, content and ``ranges`` of windows that repeat within a part; parts hold at most CROWD segments."""
    spark = rows.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data, want = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                cols = [pa.array([w[c] for w in want], t) for c, t in (("part", pa.int64()), ("bucket", pa.int64()), ("content", pa.int64()), ("off", pa.int32()), ("n", pa.int32()))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([data[w["at"] : w["at"] + w["n"] + window - 1] for w in want], pa.binary())], ["part", "bucket", "content", "off", "n", "bytes"])

    size = items.agg(F.coalesce(F.sum(F.col("n") + F.lit(window)), F.lit(0))).first()[0]
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size) // BLOCK_BYTES + 1)
    texts = _asked(rows, items, "part").mapInArrow(tidy(cut), "part long, bucket long, content long, off int, n int, bytes binary")
    # equal windows share their part, so a block of whole parts is complete in itself
    dealt = texts.repartition(blocks, "part").sortWithinPartitions("part")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0

        def flush(part: list[tuple]) -> pa.RecordBatch:
            cuts = block_ranges([p[5] for p in part], np.array([p[4] for p in part]), window)
            cuts = [[(a + p[3], b + p[3]) for a, b in c] for p, c in zip(part, cuts)]
            return pa.RecordBatch.from_arrays([pa.array([p[1] for p in part], pa.int64()), pa.array([p[2] for p in part], pa.int64()), _ranges(cuts)], ["bucket", "content", "ranges"])

        for b in batches:
            for p in zip(*[c.to_pylist() for c in b.columns]):
                # a block closes between two parts
                if held and total >= BLOCK_BYTES and p[0] != held[-1][0]:
                    yield flush(held)
                    held, total = [], 0
                held.append(p)
                total += len(p[5])
        if held:
            yield flush(held)

    return dealt.mapInArrow(tidy(sort), "bucket long, content long, ranges array<struct<a:long,b:long>>")


def pieces(data: bytes, want: dict, width: int, window: int) -> Iterator[tuple[int, int, bytes]]:
    """First window, windows and name of a segment's pieces of ``width`` distances to the k-mer.

    The name is a digest of the bytes that all windows of a piece share, so equal windows still meet.
    """
    kmer, first, stop = want["at"] + want["lead"], want["at"], want["at"] + want["n"]
    while first < stop:
        number = (kmer - first) // width
        last = min(kmer - number * width, stop - 1)
        low = kmer - number * width
        yield first, last - first + 1, xxhash.xxh3_128_digest(data[low : low - width + 1 + window], number)
        first = last + 1


def _narrow(rows: DataFrame, crowded: DataFrame, results: list[DataFrame], window: int) -> list[DataFrame]:
    """Parts buckets of more than CROWD different segments by finer names; adds to results and returns the tables made.

    Segments of a crowded bucket mostly straddle the end of a common passage and differ beyond it: by names of
    longer shared bytes they part company. What is crowded even so is decided window by window, by digest.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = b.column(0)[i].as_py()
                out = [(w["rid"], w["bucket"], w["content"], w["off"] + first - w["at"], first, n, w["lead"] + w["at"] - first, d) for w in b.column(1)[i].as_py() for first, n, d in pieces(data, w, NARROW, window)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["rid", "bucket", "content", "off", "at", "n", "lead", "name"])

    named = materialize(_asked(rows, crowded, "rid").mapInArrow(tidy(name), "rid long, bucket long, content long, off int, at int, n int, lead int, name binary"), "named")
    uses = materialize(named.groupBy("name").agg(F.count("*").alias("uses")).where("uses > 1"), "uses")
    again = materialize(named.join(uses, "name"), "again")
    part = F.conv(F.substring(F.hex("name"), 1, 15), 16, 10).cast("long")
    results.append(_sorted(rows, again.where(F.col("uses") <= CROWD).withColumn("part", part), window))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = b.column(0)[i].as_py()
                out = [(w["bucket"], w["content"], w["off"] + first - w["at"], d) for w in b.column(1)[i].as_py() for first, _, d in pieces(data, w, 1, window)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["bucket", "content", "off", "name"])

    made = [named, uses, again]
    most = again.where(F.col("uses") > CROWD)
    if most.take(1):
        windows = materialize(_asked(rows, most).mapInArrow(tidy(single), "bucket long, content long, off int, name binary"), "windows")
        twice = materialize(windows.groupBy("name").agg(F.count("*").alias("uses")).where("uses > 1").select("name"), "twice")
        one = F.array(F.struct(F.col("off").cast("long").alias("a"), (F.col("off") + 1).cast("long").alias("b")))
        results.append(windows.join(twice, "name").select("bucket", "content", one.alias("ranges")))
        made += [windows, twice]
    return made


def _body(df: DataFrame, text: str) -> Column:
    column = F.col(text) if dict(df.dtypes)[text] == "binary" else F.col(text).cast("string").cast("binary")
    return F.coalesce(column, F.lit(b""))


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    # an id of key and content: rows that repeat a key stay apart, rows that repeat entirely have one answer
    return df.select(F.xxhash64(F.col(key).cast("string"), _body(df, text)).alias("rid"), _body(df, text).alias("body"))


def word_starts(body: bytes) -> np.ndarray:
    """Where the words of a text start: runs without white space."""
    solid = ~SEPARATORS[np.frombuffer(body, np.uint8)]
    return np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]])) if len(solid) else np.zeros(0, np.int64)


def passages(body: bytes, runs: list[tuple[int, int]], min_words: int) -> list[tuple[int, int]]:
    """The runs that touch ``min_words`` words at least."""
    if not runs or min_words < 2:
        return runs
    at = word_starts(body)
    first = np.array([a for a, _ in runs])
    low = np.searchsorted(at, first, "left")
    high = np.searchsorted(at, [z for _, z in runs], "left")
    # a word that a run enters in its middle started before the run; one that ended before it is not touched
    solid = ~SEPARATORS[np.frombuffer(body, np.uint8)]
    inside = (first > 0) & solid[first] & solid[first - 1]
    return [r for r, n in zip(runs, high - low + inside) if n >= min_words]


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = LENGTH, min_words: int = 0) -> DataFrame:
    """key, ``kept`` (remaining bytes), ``n_bytes``, ``n_removed`` and ``n_spans`` of every row."""
    return _stripped(df, key, text, (), window=window, min_words=min_words).withColumnRenamed("key", key)


def _stripped(df: DataFrame, key: str, text: str, keep: tuple, as_text: bool = False, window: int = LENGTH, min_words: int = 0) -> DataFrame:
    """key, the ``keep`` columns as keep_0, keep_1 and so on, and what is left of each text: bytes, or with
    ``as_text`` the whole characters among them."""
    kind = pa.string() if as_text else pa.binary()

    def strip(bodies: pa.Array, cuts: list[list[tuple[int, int]]]) -> list[pa.Array]:
        kept, removed, spans = [], [], []
        for data, runs in zip(bodies.to_pylist(), cuts):
            left = without(data, runs := passages(data, runs, min_words))
            kept.append(left.decode("utf-8", "ignore") if as_text else left)
            removed.append(len(data) - len(left))
            spans.append(len(runs))
        return [pa.array(kept, kind), pc.binary_length(bodies).cast(pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())]

    made = [T.StructField("kept", T.StringType() if as_text else T.BinaryType()), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]]
    return _with_runs(df, key, text, keep, window, strip, made)


def without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    if not runs:
        return data
    edges = [0, *[x for r in runs for x in r], len(data)]
    return b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2]))


def _with_runs(df: DataFrame, key: str, text: str, keep: tuple, window: int, use, made: list[T.StructField]) -> DataFrame:
    """key, the ``keep`` columns, and the columns ``made`` that ``use`` gives for texts and the runs of their repeated bytes."""
    found, groups = decisions(df, key, text, window)
    body = _body(df, text)
    own = df.select(F.col(key).alias("key"), *[c.alias(f"keep_{k}") for k, c in enumerate(keep)], body.alias("body"))
    rid = F.xxhash64(F.col("key").cast("string"), F.col("body"))
    own = own.select(F.pmod(rid, F.lit(groups)).alias("group"), F.lit(1).alias("is_text"), "*")
    # the decisions of a group come before its texts, which then pass one by one
    both = own.unionByName(found.withColumn("is_text", F.lit(0)), allowMissingColumns=True)
    both = both.repartition("group").sortWithinPartitions("group", "is_text")
    fields = [f for f in own.schema.fields if f.name not in ("group", "is_text", "body")]
    copied = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, known = None, [], None
        for whole in batches:
            for s in byte_slices(np.asarray(pc.fill_null(pc.binary_length(whole.column(whole.schema.get_field_index("body"))), 0))):
                b = whole.slice(s.start, s.stop - s.start)
                col = {f.name: b.column(k) for k, f in enumerate(b.schema)}
                tags = np.asarray(col["group"]) * 2 + np.asarray(col["is_text"])
                edges = [0, *(np.flatnonzero(np.diff(tags)) + 1).tolist(), len(tags)]
                for x, y in zip(edges, edges[1:]):
                    if x == y:
                        continue
                    if tags[x] >> 1 != group:
                        group, parts, known = tags[x] >> 1, [], None
                    if not tags[x] & 1:
                        parts.append((np.asarray(col["content"][x:y]), col["ranges"][x:y]))
                        continue
                    if known is None:
                        known, parts = Known(parts), []
                    bodies = col["body"][x:y]
                    columns = use(bodies, known.runs(bodies, window))
                    yield pa.RecordBatch.from_arrays([*[col[c][x:y] for c in copied], *columns], [*copied, *[f.name for f in made]])

    return both.mapInArrow(tidy(run), T.StructType(fields + made))


class Known:
    """What is decided for the segments of a group: ranges of windows by content, in flat arrays.

    A segment's content names its bucket too, since both follow from the same bytes. One that was decided in
    several parts stands here several times.
    """

    def __init__(self, parts: list[tuple[np.ndarray, pa.Array]]) -> None:
        content = np.concatenate([np.zeros(0, np.int64), *[c for c, _ in parts]])
        sizes = np.concatenate([np.zeros(0, np.int64), *[np.asarray(r.value_lengths(), np.int64) for _, r in parts]])
        fields = [r.flatten().flatten() for _, r in parts]
        self.a, self.b = (np.concatenate([np.zeros(0, np.int64), *[np.asarray(f[k]) for f in fields]]) for k in (0, 1))
        order = np.argsort(content, kind="stable")
        self.content, self.sizes, self.first = content[order], sizes[order], (np.cumsum(sizes) - sizes)[order]

    def runs(self, bodies: pa.Array, window: int) -> list[list[tuple[int, int]]]:
        """For each text the maximal byte runs that its repeated windows cover, in order."""
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(bodies))]
        if not len(self.content):
            return out
        data, offs = flat(bodies)
        found = []
        for row, at, _, _, content, _ in scan(data, offs, window):
            content = content.view(np.int64)
            low, high = (np.searchsorted(self.content, content, side) for side in ("left", "right"))
            hit = np.flatnonzero(high > low)
            if len(hit):
                n = (high - low)[hit]
                entry, of = spread_out(low[hit], n), np.repeat(hit, n)
                m = self.sizes[entry]
                each, of = spread_out(self.first[entry], m), np.repeat(of, m)
                found.append((row[of], at[of] + self.a[each], at[of] + self.b[each] - 1 + window))
        if not found:
            return out
        row, start, end = (np.concatenate(x) for x in zip(*found))
        # texts on one line: a run ends where the next start lies beyond all ends so far
        shift = row * (int(end.max()) + 2)
        order = np.argsort(shift + start, kind="stable")
        row, start, reach = row[order], start[order], np.maximum.accumulate((shift + end)[order])
        new = np.ones(len(row), bool)
        new[1:] = (shift[order] + start)[1:] > reach[:-1]
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(row)) - 1
        for r, a, z in zip(row[head].tolist(), start[head].tolist(), (reach - shift[order])[last].tolist()):
            out[r].append((a, z))
        return out


def spread_out(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places at, at + 1, ... at + size - 1 of each entry, one after the other."""
    return np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = None, window: int = LENGTH, min_words: int = 0) -> DataFrame:
    """``df`` with every repeated string taken out of ``text``; ``length`` names a column of character counts to renew.

    A character that a cut parts in the middle goes with it.
    """
    others = [c for c in df.columns if c not in (key, text)]
    done = _stripped(df, key, text, (F.col(text).isNull(), *[F.col(c) for c in others]), as_text=True, window=window, min_words=min_words)
    # bytes that no longer form a character are dropped with the cut; null stays null
    body = F.when(~F.col("keep_0"), F.col("kept"))
    kinds = dict(df.dtypes)
    found = {key: F.col("key"), text: body, **{c: F.col(f"keep_{k}") for k, c in enumerate(others, 1)}}
    if length:
        found[length] = F.when(F.col("n_removed") > 0, F.length(body).cast(kinds[length])).otherwise(found[length])
    return done.select(*[found[c].alias(c) for c in df.columns])


def repeats_and_passages(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = LENGTH, short: int = PASSAGE, min_words: int = PASSAGE_WORDS) -> DataFrame:
    """The columns of :func:`remove_repeats` for ``window``, and what repeats of passages of many words besides:
    ``n_passages`` and ``passage_bytes`` count the runs of repeated windows of ``short`` bytes that touch
    ``min_words`` words, and their bytes.

    A window can only repeat where all ``short`` windows inside it repeat. So the longer ones are sought in the
    runs of repeated short windows alone, and most bytes are looked at once.
    """
    if not short < window:
        raise ValueError("the passages' window has to be the shorter one")
    body = _body(df, text)
    rid = F.xxhash64(F.col(key).cast("string"), body)

    def note(bodies: pa.Array, cuts: list[list[tuple[int, int]]]) -> list[pa.Array]:
        count, size, long = [], [], []
        for data, runs in zip(bodies.to_pylist(), cuts):
            own = passages(data, runs, min_words)
            count.append(len(own))
            size.append(sum(z - a for a, z in own))
            long.append([{"a": a, "run": data[a:z]} for a, z in runs if z - a >= window])
        return [pa.array(count, pa.int64()), pa.array(size, pa.int64()), pa.array(long, pa.list_(pa.struct([("a", pa.int64()), ("run", pa.binary())])))]

    made = T._parse_datatype_string("n_passages long, passage_bytes long, long array<struct<a: long, run: binary>>").fields
    seen = _with_runs(df, key, text, (rid,), short, note, made).where("n_passages > 0 OR size(long) > 0").withColumnRenamed("keep_0", "rid")
    seen = materialize(seen.select("rid", "n_passages", "passage_bytes", "long"), "short")
    runs = seen.select("rid", F.explode("long").alias("r")).select(F.concat_ws(":", "rid", "r.a").alias("place"), "rid", F.col("r.a").alias("a"), F.col("r.run").alias("run"))
    ranges = T._parse_datatype_string("cuts array<struct<a: long, b: long>>").fields
    inner = _with_runs(runs, "place", "run", (F.col("rid"), F.col("a")), window, lambda _, cuts: [_ranges(cuts)], ranges).where(F.size("cuts") > 0)
    placed = inner.select(F.col("keep_0").alias("rid"), F.transform("cuts", lambda c: F.struct((c.a + F.col("keep_1")).alias("a"), (c.b + F.col("keep_1")).alias("b"))).alias("cuts"))
    # rows that repeat entirely have the same cuts, so a set holds those of one text
    cuts = placed.groupBy("rid").agg(F.sort_array(F.flatten(F.collect_set("cuts"))).alias("cuts"))
    facts = seen.groupBy("rid").agg(F.max("n_passages").alias("n_passages"), F.max("passage_bytes").alias("passage_bytes"))
    facts = materialize(facts.join(cuts, "rid", "left"), "facts")
    discard(seen)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in byte_slices(np.asarray(pc.binary_length(whole.column(1)))):
                b = whole.slice(s.start, s.stop - s.start)
                texts, found = b.column(1).to_pylist(), [[(c["a"], c["b"]) for c in x or ()] for x in b.column(2).to_pylist()]
                kept = [without(t, c) for t, c in zip(texts, found)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(kept, pa.binary()), *[pa.array(x, pa.int64()) for x in (map(len, texts), [len(t) - len(k) for t, k in zip(texts, kept)], map(len, found))], b.column(3), b.column(4)],
                    ["key", "kept", "n_bytes", "n_removed", "n_spans", "n_passages", "passage_bytes"],
                )

    rows = df.select(F.col(key).alias("key"), body.alias("body"), rid.alias("rid"))
    maybe = maybe_among(facts, "rid", F.col("rid"))
    zero = F.lit(0).cast("long")
    plain = rows.where(~maybe).select("key", F.col("body").alias("kept"), F.octet_length("body").cast("long").alias("n_bytes"), *[zero.alias(c) for c in ("n_removed", "n_spans", "n_passages", "passage_bytes")])
    # texts without repeats stay where they are
    touched = rows.where(maybe).join(facts, "rid", "left").select("key", "body", "cuts", *[F.coalesce(c, zero).alias(c) for c in ("n_passages", "passage_bytes")])
    kind = dict(df.dtypes)[key]
    done = touched.mapInArrow(tidy(strip), f"key {kind}, kept binary, n_bytes long, n_removed long, n_spans long, n_passages long, passage_bytes long")
    return plain.unionByName(done).withColumnRenamed("key", key)
