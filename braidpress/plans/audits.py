"""Queries whose SQL works the same results out by itself: coder bits, merges, attention folds, files, reports."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.arrays import attention_score, dot
from ..functions.tables import ATTENTION_COEF
from ..operators import attention, coder, container
from ..operators import vocabulary as V
from ..operators.buffers import flat_lists, lists_of
from ..operators.kernels import attend, rne
from ..sources import formats, tensors
from . import compress as C
from .queries import PAIR_LETTERS, PRICE, S_LUT, S_Q, SCORE, causal, cents, little, pair_vocabulary, query, s_clamp, s_clamp8, s_rne, s_udiv, table
from .session import scratch_dir, ship_package

# --- the coder ---------------------------------------------------------------------------------------


@query(
    """WITH RECURSIVE f AS (SELECT i AS byte, 1 + (i * 37) % 11 AS n FROM range(256) AS r(i)),
    u AS (SELECT byte, n, CAST(sum(n) OVER (ORDER BY byte) AS BIGINT) AS upto, CAST(sum(n) OVER () AS BIGINT) AS total FROM f),
    l AS (SELECT list(upto - n ORDER BY byte) AS below, list(upto ORDER BY byte) AS upto, max(total) AS total FROM u),
    c(id, sym, i, low, high, late, bits) AS (
      SELECT p_partkey, list_transform(string_split(p_name, ''), lambda x: ord(x)), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(4294967295 AS BIGINT), CAST(0 AS BIGINT), '' FROM part
      UNION ALL
      SELECT id, sym, CASE WHEN kind = 'next' THEN i + 1 ELSE i END,
        CASE kind WHEN 'next' THEN low + (high - low + 1) * l.below[sym[i + 1] + 1] // l.total WHEN 'emit' THEN (low << 1) & 4294967295 ELSE (low - 1073741824) << 1 END,
        CASE kind WHEN 'next' THEN low + (high - low + 1) * l.upto[sym[i + 1] + 1] // l.total - 1 WHEN 'emit' THEN ((high << 1) & 4294967295) | 1 ELSE ((high - 1073741824) << 1) | 1 END,
        CASE kind WHEN 'next' THEN late WHEN 'emit' THEN 0 ELSE late + 1 END,
        CASE WHEN kind = 'emit' THEN bits || CASE WHEN low >= 2147483648 THEN '1' || repeat('0', late) ELSE '0' || repeat('1', late) END ELSE bits END
      FROM (SELECT *, CASE WHEN high < 2147483648 OR low >= 2147483648 THEN 'emit' WHEN low >= 1073741824 AND high < 3221225472 THEN 'late' WHEN i < len(sym) THEN 'next' END AS kind FROM c) s, l
      WHERE kind IS NOT NULL),
    b AS (SELECT id, arg_max(bits, (i, length(bits), late)) || '1' AS bits FROM c GROUP BY id)
    SELECT p_partkey, (length(bits) + 7) // 8 AS n_bytes, rpad(bits, CAST((length(bits) + 7) // 8 * 8 AS INTEGER), '0') AS bits FROM b JOIN part ON id = p_partkey"""
)
def coder_bits(spark, sf_dir):
    """The coder's bits, against a bit-by-bit recursion."""
    ship_package(spark)
    sums = np.cumsum([1 + i * 37 % 11 for i in range(256)]).tolist()
    rows = table(spark, sf_dir, "part").select("p_partkey", V.byte_tokens(F.col("p_name")).alias("symbols"))
    coded = rows.select("p_partkey", "symbols", coder.encode_column(F.col("symbols"), F.lit(sums)).alias("coded"))
    back = coder.decode_column(F.col("coded"), F.lit(sums), F.size("symbols"))
    digits = F.array_join(F.transform(F.split(F.hex("coded"), ""), lambda h: F.lpad(F.conv(h, 16, 2), 4, "0")), "")
    same = F.when(back == F.col("symbols"), digits)  # null unless it decodes
    return coded.select("p_partkey", F.octet_length("coded").cast("bigint").alias("n_bytes"), same.alias("bits"))


# --- vocabulary --------------------------------------------------------------------------------------

S_PAIR = f"(CASE WHEN length(p[i]) = 1 AND length(p[i + 1]) = 1 AND instr('{PAIR_LETTERS}', p[i]) > 0 AND instr('{PAIR_LETTERS}', p[i + 1]) > 0 THEN (256 + (instr('{PAIR_LETTERS}', p[i]) - 1) * 9 + instr('{PAIR_LETTERS}', p[i + 1]) - 1) * CAST(1000000 AS BIGINT) + i END)"


@query(
    f"""WITH RECURSIVE w AS (SELECT DISTINCT piece FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS piece FROM documents)),
    s(piece, p) AS (
      SELECT piece, string_split(piece, '') FROM w
      UNION ALL
      SELECT piece, list_concat(list_concat(list_slice(p, 1, place - 1), [p[place] || p[place + 1]]), list_slice(p, place + 2, len(p)))
      FROM (SELECT piece, p, list_min(list_filter(list_transform(range(1, len(p)), lambda i: {S_PAIR}), lambda x: x IS NOT NULL)) % 1000000 AS place FROM s) n WHERE place IS NOT NULL),
    last AS (SELECT piece, arg_min(p, len(p)) AS p FROM s GROUP BY piece)
    SELECT piece, array_to_string(p, ' ') AS parts FROM last"""
)
def piece_merge(spark, sf_dir):
    """Merges by rank of every word that occurs, against a recursion that merges one pair a step."""
    ship_package(spark)
    sent = spark.sparkContext.broadcast(pair_vocabulary())

    @F.pandas_udf("string")
    def split(s):
        return s.map(lambda p: b" ".join(sent.value.split_piece(p.encode())).decode())

    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("piece")).distinct()
    return words.select("piece", split("piece").alias("parts"))


@query(
    """WITH x AS (SELECT doc_id, coalesce(text, '') AS t, replace(coalesce(text, ''), 'the', '') AS r FROM documents),
    l AS (SELECT *, reverse(t) AS v, CASE WHEN contains(t, 'the') THEN instr(reverse(t), 'eht') - 1 ELSE length(t) END AS tail FROM x)
    SELECT doc_id, CAST((length(t) - length(r)) // 3 AS BIGINT) AS specials, CAST(strlen(r) + (length(t) - length(r)) // 3 AS BIGINT) AS n_tokens,
    CASE WHEN tail = 0 THEN 0 ELSE CAST(strlen(right(t, 1)) AS BIGINT) END AS last FROM l"""
)
def encode_allowed(spark, sf_dir):
    """Special strings become ids only where they are allowed; the last piece is one character."""
    ship_package(spark)
    vocab = V.Vocabulary({bytes([b]): b for b in range(256)}, {"the": 256, "of": 257}, r"(?s).")
    sent = spark.sparkContext.broadcast(vocab)

    @F.pandas_udf("specials bigint, n_tokens bigint, last bigint")
    def run(s):
        import pandas as pd

        out = []
        for t in s:
            ids, last = sent.value.encode(t or "", ["the"])
            out.append((ids.count(256), len(ids), last))
        return pd.DataFrame(out, columns=["specials", "n_tokens", "last"])

    return table(spark, sf_dir, "documents").select("doc_id", run("text").alias("r")).select("doc_id", "r.*")


@query(
    f"""WITH l AS (SELECT unnest(range(9)) AS i), v AS (
      SELECT chr(CAST(c AS INTEGER)) AS piece, c AS token FROM range(1, 128) AS r(c)
      UNION ALL SELECT substr('{PAIR_LETTERS}', CAST(a.i + 1 AS INTEGER), 1) || substr('{PAIR_LETTERS}', CAST(b.i + 1 AS INTEGER), 1), 256 + a.i * 9 + b.i FROM l a, l b),
    p AS (SELECT DISTINCT substr(lower(n_name), 1, CAST(n AS INTEGER)) AS prefix FROM nation, range(1, 4) AS r(n))
    SELECT prefix, token FROM p JOIN v ON starts_with(piece, prefix)"""
)
def token_prefixes(spark, sf_dir):
    """Tokens that start with a prefix: what may complete an unstable end."""
    names = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("n"))
    prefixes = names.select(F.explode(F.array(*[F.substring("n", 1, k) for k in (1, 2, 3)])).alias("prefix")).distinct()
    return V.starting_with(prefixes, pair_vocabulary(), "prefix").select("prefix", F.col("token").cast("bigint").alias("token"))


# --- integers and attention --------------------------------------------------------------------------


@query(f"SELECT l_orderkey, CAST(sum({s_rne(PRICE, 7)}) AS BIGINT) AS total, CAST(sum({s_rne(PRICE, 1)} * l_linenumber) AS BIGINT) AS weighted FROM lineitem GROUP BY l_orderkey")
def vector_shift(spark, sf_dir):
    """The NumPy form of the rounded shift, over arrays."""
    ship_package(spark)

    def shifted(column: Column, shift: int) -> Column:
        @F.arrow_udf("array<long>")
        def run(s: pa.Array) -> pa.Array:
            values, offs = flat_lists(s)
            return lists_of(rne(values, shift), offs, pa.int64(), s)

        return run(column)

    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", cents().alias("x")))).alias("a"))
    line, x = F.transform("a", lambda s: s.l_linenumber), F.transform("a", lambda s: s.x)
    return rows.select("l_orderkey", A.total(shifted(x, 7)).alias("total"), A.dot(shifted(x, 1), line).alias("weighted"))


SINK = [(i * 29) % 255 - 127 for i in range(64)]


def s_exp_list(diff: str) -> str:
    """The attention exponential with the table as list ``lut.l``."""
    t = f"((-({diff}) * {ATTENTION_COEF} + 8388608) >> 24)"
    return f"(CASE WHEN ({diff}) >= 0 THEN 65535 WHEN ({t} >> 8) >= 31 THEN 1 ELSE {s_clamp(f'(((CAST(65536 AS BIGINT) >> CAST(least({t} >> 8, 31) AS INTEGER)) * lut.l[({t} & 255) + 1] + 32768) >> 16)', 1, 65535)} END)"


def s_fold() -> str:
    rescaled = "((z[1] * f + CASE WHEN z[1] * f >= 0 THEN 32768 ELSE -32768 END) >> 16)"
    out = s_clamp8(f"(CASE WHEN a < 0 THEN -1 ELSE 1 END * {s_udiv('abs(a)', 'greatest(s, 1)')})")
    return f"""WITH RECURSIVE {S_Q}, {S_LUT.replace('lut AS', 'lut0 AS')}, lut AS (SELECT list(v ORDER BY i) AS l FROM lut0),
    own AS (SELECT vec_id, list(x ORDER BY i) AS v, CAST(sum(x * ((i * 29) % 255 - 127)) AS BIGINT) AS d FROM q GROUP BY vec_id),
    pair AS (SELECT a.vec_id AS a, b.vec_id AS b, CAST(sum(a.x * b.x) AS BIGINT) AS d FROM q a JOIN q b ON a.vec_id // 16 = b.vec_id // 16 AND b.vec_id <= a.vec_id AND a.i = b.i GROUP BY a.vec_id, b.vec_id),
    steps AS (SELECT a AS vec_id, list(b ORDER BY b) AS ids, list({SCORE} ORDER BY b) AS scores FROM pair GROUP BY a),
    r(vec_id, sink, t, m, s, acc) AS (
      SELECT vec_id, k, CAST(0 AS BIGINT), CASE WHEN k THEN {SCORE} END, CAST(CASE WHEN k THEN 65535 ELSE 0 END AS BIGINT), list_transform(range(64), lambda i: CAST(0 AS BIGINT)) FROM own, (VALUES (FALSE), (TRUE)) AS x(k)
      UNION ALL
      SELECT vec_id, sink, t + 1, top, CAST(CASE WHEN f IS NULL THEN s ELSE (s * f + 32768) >> 16 END + w AS BIGINT),
        list_transform(list_zip(acc, v), lambda z: CAST(CASE WHEN f IS NULL THEN z[1] ELSE {rescaled} END + w * z[2] AS BIGINT))
      FROM (SELECT n.*, CASE WHEN m IS NOT NULL AND score > m THEN {s_exp_list('m - score')} END AS f, {s_exp_list('score - top')} AS w
        FROM (SELECT r.*, scores[t + 1] AS score, own.v, greatest(coalesce(m, scores[t + 1]), scores[t + 1]) AS top
          FROM r JOIN steps USING (vec_id) JOIN own ON own.vec_id = steps.ids[t + 1] WHERE t < len(ids)) n, lut) e),
    fin AS (SELECT vec_id, sink, arg_max(s, t) AS s, arg_max(acc, t) AS acc FROM r GROUP BY vec_id, sink),
    y AS (SELECT vec_id, sink, CAST(list_sum(list_transform(list_zip(acc, range(1, 65)), lambda z: z[2] * (SELECT_OUT))) AS BIGINT) AS y FROM fin)
    SELECT vec_id // 16 AS g, vec_id % 16 AS pos, max(y) FILTER (WHERE NOT sink) AS plain, max(y) FILTER (WHERE sink) AS sunk, max(y) FILTER (WHERE NOT sink) AS kernel_plain, max(y) FILTER (WHERE sink) AS kernel_sunk
    FROM y GROUP BY vec_id""".replace("SELECT_OUT", out.replace("abs(a)", "abs(z[1])").replace("a < 0", "z[1] < 0"))


@query(s_fold())
def attn_fold(spark, sf_dir):
    """The ordered fold with and without a sink, as array expressions and by the kernel; checksums of the outputs."""
    ship_package(spark)
    weigh = lambda y: A.total(F.transform(y, lambda v, i: v.cast("bigint") * (i + 1)))
    rows = causal(spark, sf_dir).groupBy("g", "pos").agg(F.max("q").alias("q"), F.collect_list(F.struct("t", "score", "v")).alias("steps"))
    score = attention_score(dot(F.col("q"), F.array(*[F.lit(int(x)).cast("bigint") for x in SINK])), 20000)
    out = rows.select("g", "pos", "q", weigh(attention.fold(F.col("steps"))).alias("plain"), weigh(attention.fold(F.col("steps"), score)).alias("sunk"), F.transform(F.sort_array("steps"), lambda s: s.v).alias("vs"))

    @F.pandas_udf("plain bigint, sunk bigint")
    def kernel(q, vs):
        import pandas as pd

        found = []
        for x, v in zip(q, vs):
            kv = np.stack([np.asarray(r) for r in v]).astype(np.int64)[None]
            y = [attend(np.asarray(x, np.int64)[None, None, None], kv, kv, np.array([20000]), kv.shape[1] - 1, s) for s in (None, np.array(SINK))]
            found.append([int((a[0, 0, 0] * np.arange(1, 65)).sum()) for a in y])
        return pd.DataFrame(found, columns=["plain", "sunk"])

    return out.withColumn("k", kernel("q", "vs")).select("g", "pos", "plain", "sunk", F.col("k.plain").alias("kernel_plain"), F.col("k.sunk").alias("kernel_sunk"))


# --- containers, files, reports ----------------------------------------------------------------------


@query(
    f"""WITH c AS (SELECT doc_id, hex(encode(text)) AS h, CAST(strlen(text) AS BIGINT) AS n, CAST((strlen(text) + 63) // 64 AS BIGINT) AS k FROM documents),
    l AS (SELECT *, CASE WHEN n % 64 = 0 AND n > 0 THEN 64 ELSE n % 64 END AS last FROM c)
    SELECT doc_id, sha256('435A49507631' || '0000' || {little('n', 4)} || {little('12 + 2 * k', 4)} || {little('7', 4)} || {little('k', 4)} || {little('last', 2)} || '0006'
      || repeat('4000', CAST(greatest(k - 1, 0) AS INTEGER)) || CASE WHEN k > 0 THEN {little('last', 2)} ELSE '' END || h) AS file_sha256, n AS back_bytes FROM l"""
)
def raw_container(spark, sf_dir):
    """Containers without the outer codec, byte for byte, and read again."""
    ship_package(spark)

    @F.pandas_udf("file string, back bigint")
    def run(s):
        import pandas as pd

        out = []
        for t in s:
            raw = t.encode()
            box = container.Container(7, uncompressed_len=len(raw))
            for i in range(0, len(raw), 64):
                box.add_chunk(raw[i : i + 64], len(raw[i : i + 64]), i + 64 >= len(raw))
            data = box.to_bytes(compressed=False)
            again = container.Container.from_bytes(data, compressed=False)
            out.append((data.hex().upper(), len(b"".join(again.chunks)) if b"".join(again.chunks) == raw else -1))
        return pd.DataFrame(out, columns=["file", "back"])

    docs = table(spark, sf_dir, "documents").select("doc_id", run("text").alias("r"))
    return docs.select("doc_id", F.sha2("r.file", 256).alias("file_sha256"), F.col("r.back").alias("back_bytes"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n FROM documents")
def codec_roundtrip(spark, sf_dir):
    """The outer codec as columns: compressed, and back to as many bytes where they are the same."""
    ship_package(spark)
    raw = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    head = container.pack_outer(F.lit(0), F.lit(0), F.octet_length("raw").cast("bigint"), F.lit(12))
    boxed = raw.withColumn("box", F.concat(head, container.compress_payload(F.col("raw"), level=3)))
    back = container.decompress_payload(F.col("box"), F.lit(0))
    return boxed.select("doc_id", F.when(back == F.col("raw"), F.octet_length("raw").cast("bigint")).alias("n"))


@query(
    """WITH d AS (SELECT source, lang, CAST(strlen(text) AS BIGINT) AS n, CAST((strlen(text) + 63) // 64 AS BIGINT) AS k FROM documents),
    s AS (SELECT source, lang, count(*) AS texts, CAST(sum(n) AS BIGINT) AS n_bytes, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(k) AS BIGINT) AS n_chunks, CAST(sum(28 + 2 * k + n) AS BIGINT) AS container_bytes FROM d GROUP BY source, lang)
    SELECT *, CAST(n_bytes AS DOUBLE) / container_bytes AS ratio, container_bytes * 100.0::DOUBLE / nullif(n_bytes, 0) AS percent, container_bytes * 8.0::DOUBLE / nullif(n_tokens, 0) AS bits_per_token FROM s"""
)
def compression_report(spark, sf_dir):
    """Sizes by source and language of all documents in containers of raw chunks, whose sizes SQL can tell."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.octet_length("text").cast("bigint").alias("n_bytes"), F.encode("text", "UTF-8").alias("raw"))
    n = F.octet_length("raw")
    cut = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(64)), lambda a: F.substr("raw", a + 1, F.lit(64))))
    rows = docs.select("doc_id", "source", "lang", "n_bytes", F.posexplode_outer(cut).alias("chunk_idx", "coded")).withColumn("n_tokens", F.coalesce(F.octet_length("coded"), F.lit(0)))
    boxes = container.assemble(rows, ["doc_id", "source", "lang"], compressed=False)
    return C.compression_report(boxes, ["source", "lang"])


def folder(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def item_of(suffix: str) -> Column:
    return F.regexp_extract("path", rf"(\d+)\.{suffix}$", 1).cast("bigint").alias("item_id")


@query("SELECT item_id, text FROM benchmark")
def text_files(spark, sf_dir):
    """Texts written as files and scanned again."""
    to = folder(spark, "texts")
    formats.write_texts(table(spark, sf_dir, "benchmark"), to, "item_id")
    return formats.read_texts(spark, f"{to}/*.txt").select(item_of("txt"), "text")


@query("SELECT item_id, CAST(pos // 64 AS INTEGER) AS chunk_idx, hex(encode(text))[2 * pos + 1 : 2 * pos + 128] AS coded, CAST(least(64, strlen(text) - pos) AS BIGINT) AS n_tokens FROM (SELECT item_id, text, unnest(range(0, strlen(text), 64)) AS pos FROM benchmark)")
def container_files(spark, sf_dir):
    """Containers written as files and scanned again, chunk by chunk."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.encode("text", "UTF-8").alias("raw"))
    cut = F.transform(F.sequence(F.lit(0), F.octet_length("raw") - 1, F.lit(64)), lambda a: F.substr("raw", a + 1, F.lit(64)))
    rows = items.where(F.octet_length("raw") > 0).select("item_id", "n_bytes", F.posexplode(cut).alias("chunk_idx", "coded")).withColumn("n_tokens", F.octet_length("coded"))
    to = folder(spark, "boxes")
    formats.write_containers(container.assemble(rows, ["item_id"], level=3), to, "item_id")
    return formats.read_containers(spark, f"{to}/*.czip").select(item_of("czip"), "chunk_idx", F.hex("coded").alias("coded"), "n_tokens")


@query(
    """SELECT name, CAST(i AS BIGINT) AS i, CAST(CASE name WHEN 'a_i8' THEN i % 256 - 128 WHEN 'b_u8' THEN i % 256 WHEN 'c_i16' THEN i * 31 - 32768 WHEN 'd_u16' THEN i * 31 WHEN 'e_i32' THEN i * 1000003 - 2147483648 ELSE i * 1000003 END AS BIGINT) AS value
    FROM range(2000) AS r(i), (VALUES ('a_i8'), ('b_u8'), ('c_i16'), ('d_u16'), ('e_i32'), ('f_u32')) AS n(name)"""
)
def typed_views(spark, sf_dir):
    """Tensors of every integer type, written as a file and read as cells."""
    i = np.arange(2000)
    values = {"a_i8": (i % 256 - 128).astype("i1"), "b_u8": (i % 256).astype("u1"), "c_i16": (i * 31 - 32768).astype("i2"), "d_u16": (i * 31).astype("u2"), "e_i32": (i * 1000003 - (1 << 31)).astype("i4"), "f_u32": (i * 1000003).astype("u4")}
    raw = tensors.build([tensors.of_array(k, v) for k, v in values.items()])
    to = folder(spark, "tensors")
    formats.write_files(spark.createDataFrame([("rules", raw)], "name string, data binary"), to, "name", "data", "tensors")
    cells = formats.tensor_cells(formats.read_tensors(spark, f"{to}/*.tensors"))
    return cells.select("name", F.col("i").cast("bigint").alias("i"), "value")


