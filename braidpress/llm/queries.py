"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, minhash, quality, rules, suffix_dedup, token_counts, toxicity, urls


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.roundtrip(table(spark, sf_dir, "documents"), vocabulary())
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_limit(token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary()))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.repeats_and_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "passage_bytes")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = "'<|im_end|><|im_start|>assistant ok'"
    extra = spark.sql(f"SELECT -1L AS conv_id, t.turn, t.role, {probe} AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    done = chat.format_chats(rows.unionByName(extra))
    back = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


OP6_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in OP6_RULES)
    rules_df = spark.sql(f"SELECT * FROM VALUES {values} AS r(host, path, action)")
    return urls.judge(table(spark, sf_dir, "pages"), rules_df)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.apply_rules(table(spark, sf_dir, "documents"))
    return out.drop("class_distance", "common_distance")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_chat": op4_chat,
    "op5_minhash": op5_minhash,
    "op6_url_rules": op6_url_rules,
    "op8_toxicity": op8_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontamination": op10_decontamination,
    "op7_token_counts": op7_token_counts,
}

OP4_SQL = """
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
l AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         regexp_replace(text, '<(~*)\\|', '<~\\1|', 'g') AS escaped
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(11 + sum(length(escaped) + CASE WHEN before IS NULL THEN 13 + length(role) WHEN before = role THEN 11 ELSE 24 + length(role) END) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id
"""

OP6_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, p, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (
  SELECT page_id, arg_max(h || r.p, length(h || r.p)) AS rule, arg_max(action, length(h || r.p)) AS action
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN f ON p.page_id = f.page_id
"""

def op3_sql() -> str:
    """Windows as 64-bit hashes; starts of repeated windows that touch or overlap make a run."""
    long, short, reach = suffix_dedup.LENGTH, suffix_dedup.PASSAGE, 128
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
c AS (SELECT r, n, c, substr(h, CAST(2 * c + 1 AS INTEGER), {2 * (reach + long - 1)}) AS s FROM (SELECT r, n, h, unnest(range(0, n, {reach})) AS c FROM d) x),
p AS (
  SELECT r, c + j AS i, CASE WHEN c + j + {long} <= n THEN hash(substr(s, CAST(2 * j + 1 AS INTEGER), {2 * long})) END AS w, CASE WHEN c + j + {short} <= n THEN hash(substr(s, CAST(2 * j + 1 AS INTEGER), {2 * short})) END AS v
  FROM (SELECT *, unnest(range(least({reach}, n - c))) AS j FROM c) x),
a AS (
  SELECT r, i, {long} AS k FROM p JOIN (SELECT w FROM p WHERE w IS NOT NULL GROUP BY w HAVING count(*) > 1) USING (w)
  UNION ALL SELECT r, i, {short} FROM p JOIN (SELECT v FROM p WHERE v IS NOT NULL GROUP BY v HAVING count(*) > 1) USING (v)),
g AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY r, k ORDER BY i) <= k THEN 0 ELSE 1 END AS opens FROM a),
o AS (SELECT *, sum(opens) OVER (PARTITION BY r, k ORDER BY i) AS run FROM g),
runs AS (SELECT r, k, min(i) AS a, max(i) + k AS z FROM o GROUP BY r, k, run),
s AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM runs WHERE k = {long}),
y AS (
  SELECT s.r, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, CAST(2 * before + 1 AS INTEGER), CAST(2 * (a - before) AS INTEGER)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(z) + 1 AS INTEGER)) AS rest
  FROM s JOIN d ON d.r = s.r GROUP BY s.r),
m AS (
  SELECT runs.r, z - a AS size, array_to_string(list_transform(regexp_extract_all(substr(h, CAST(2 * a + 1 AS INTEGER), CAST(2 * (z - a) AS INTEGER)), '..'), lambda b: CASE WHEN b IN ('20', '09', '0A', '0B', '0C', '0D') THEN ' ' ELSE 'x' END), '') AS shape
  FROM runs JOIN d ON d.r = runs.r WHERE k = {short}),
x AS (SELECT r, count(*) AS n_passages, CAST(sum(size) AS BIGINT) AS passage_bytes FROM m WHERE len(list_filter(string_split(shape, ' '), lambda t: t <> '')) >= {suffix_dedup.PASSAGE_WORDS} GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256, coalesce(n_passages, 0) AS n_passages, coalesce(passage_bytes, 0) AS passage_bytes
FROM d LEFT JOIN y ON d.r = y.r LEFT JOIN x ON d.r = x.r
"""


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
                                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(root) AS component_id, r.doc_id = min(root) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


def op9_sql() -> str:
    every = sorted({w for v in rules.COMMON.values() for w in v})
    classes = [r"\p{Ll}", r"\p{Lu}", "[0-9]", r"[.,;:!?''\"()-]", rules.SYMBOLS]
    chars = [f"CAST(len(regexp_extract_all(body, '{c}')) AS DOUBLE)" for c in classes]
    common = [f"CAST(len(list_filter(words, lambda x: x = '{w}')) AS DOUBLE)" for w in every]
    langs = ", ".join(f"'{x}'" for x in rules.LANGUAGES)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body, CASE WHEN lang IN ({langs}) THEN lang ELSE '*' END AS ref_lang FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
f AS (
  SELECT doc_id, ref_lang, words, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(body, '{rules.SYMBOLS}')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         [{", ".join(chars)}] AS c, [{", ".join(common)}] AS m FROM w),
v AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM f WHERE len(words) >= 5),
x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + 4], ' ')) AS uses FROM v),
y AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM x WHERE uses > 1),
z AS (SELECT doc_id, CAST(sum(least(5, coalesce(after - i, 5))) AS BIGINT) AS n_repeat_words FROM y GROUP BY doc_id),
b AS (
  SELECT f.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed,
         list_append(c, greatest(0, word_chars - list_sum(c))) AS cs, list_append(m, greatest(0, n_words - list_sum(m))) AS ms FROM f LEFT JOIN z ON f.doc_id = z.doc_id),
bins AS (SELECT doc_id, ref_lang, base_failed, 'c' AS kind, unnest(cs) AS v, generate_subscripts(cs, 1) AS i FROM b UNION ALL SELECT doc_id, ref_lang, base_failed, 'm', unnest(ms), generate_subscripts(ms, 1) FROM b),
own AS (SELECT ref_lang, kind, i, sum(v) AS r FROM bins WHERE NOT base_failed GROUP BY ref_lang, kind, i),
refs AS (SELECT * FROM own WHERE ref_lang <> '*' UNION ALL SELECT '*', kind, i, sum(r) FROM own GROUP BY kind, i),
shares AS (SELECT *, r / sum(r) OVER (PARTITION BY ref_lang, kind) AS q, sum(r) OVER (PARTITION BY ref_lang, kind) AS t FROM refs),
sm AS (SELECT doc_id, kind, v + {rules.SMOOTH} * r / greatest(t, 1) AS s, q FROM bins JOIN shares USING (ref_lang, kind, i)),
pq AS (SELECT doc_id, kind, s / sum(s) OVER (PARTITION BY doc_id, kind) AS p, q FROM sm),
js AS (SELECT doc_id, kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS d FROM pq GROUP BY doc_id, kind),
far AS (SELECT doc_id, max(d) FILTER (WHERE kind = 'c') AS dc, max(d) FILTER (WHERE kind = 'm') AS dm FROM js GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(n_words >= {rules.GUARD} AND (dc > {rules.CLASS_LIMIT[0]} + {rules.CLASS_LIMIT[1]} / sqrt(n_words) OR dm > {rules.COMMON_LIMIT[0]} + {rules.COMMON_LIMIT[1]} / sqrt(n_words)), FALSE) AS kept
FROM b LEFT JOIN far ON b.doc_id = far.doc_id
"""


SQL: dict[str, str] = {
    "op3_suffix_dedup": op3_sql(),
    "op4_chat": OP4_SQL,
    "op5_minhash": OP5_SQL,
    "op6_url_rules": OP6_SQL,
    "op9_quality_rules": op9_sql(),
}
