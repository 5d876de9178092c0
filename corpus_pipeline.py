"""The corpus pipeline: quality, near duplicates, repeated strings, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame,
which is written as Parquet and read again before the next. All stages but the last return the columns of
``documents``.

Results by case, for every stage: an empty table gives an empty one; extra columns pass through all stages but the
last, whatever their names; rows that repeat a key or a whole row are judged one by one, unless a stage says
otherwise; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidpress.llm import bpe, decontam, minhash, quality, suffix_dedup
from braidpress.llm.queries import table, vocabulary
from braidpress.plans.session import materialize

QUALITY_THRESHOLD = 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects.

    Null and empty texts have a score like others, from the same statistics; a null key has no label and is
    judged by its text. Without any labels nothing is known to be bad, and all rows stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), QUALITY_THRESHOLD)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least document of each group of near duplicates.

    Null and empty texts are linked with nothing and stay, as do rows with a null key; rows that repeat a key are one
    document: all of them stay or go.
    """
    return minhash.one_of_each(docs)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages of fifty words and more out of the texts, wherever they stand.

    The operator's own 400 bytes are longer than many such passages. All occurrences go, so a text that is nothing
    else becomes empty, not null; null stays null; rows that repeat a text empty each other.
    """
    return suffix_dedup.without_repeats(docs, length="n_chars", window=suffix_dedup.PASSAGE, min_words=suffix_dedup.PASSAGE_WORDS)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold benchmark items.

    Rows are named by a digest of key and text: a leaking row with a null key goes too, and of rows that repeat
    a key only those whose own text leaks.
    """
    name = "leak_row"
    while name in docs.columns:
        name += "_"
    digest = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))), 256)
    rows = docs.withColumn(name, digest)
    leaks = decontam.contaminated(rows, table(spark, sf_dir, "benchmark"), key=name).select(name).distinct()
    return rows.join(leaks, name, "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text (packed, little-endian, 32 bits), and the digest of what they decode to.

    Null and empty texts have no ids; every row gives one row, with its key, null or not.
    """
    out = bpe.roundtrip(docs, vocabulary())
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each),
    ("suffix-array dedup", no_repeats),
    ("benchmark decontamination", no_leaks),
    ("BPE encoding and decoding", tokens),
]

#: SQL expresses neither a classifier's fit nor byte-level encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
