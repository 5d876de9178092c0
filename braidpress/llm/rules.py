"""Quality rules by distribution divergence, with DataFrame functions only.

Base figures (words, characters in words, symbols, repeated lines, repeated five-word windows) are array
expressions over one row, so no text is shuffled. The verdict compares a document's character-class and
common-word histograms to those of its language with the Jensen-Shannon distance. Language references are
sums over all documents that pass the base rules; there is one for each language of a fixed list, and one
for all, so the table that is joined has a fixed bound.

Results by case: a null text has no words; it fails the base rule (fewer than 10 words). Documents of fewer
words than GUARD keep the base verdict; an unknown or null language is compared to the sum of all.
Repeated rows each get a row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import materialize

WORD = r"[\x20\x09-\x0D]+"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = r"[#*$%&|<>]"
LANGUAGES = ("en", "fr", "de", "es")
#: The most common function words of four languages.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del"],
}
#: Words below which the distances say nothing.
GUARD = 30
#: Distances (0 to 1) above which a document fails: a base, and a part that falls with the root of its number of
#: words, as the distance of a fair sample from its language does.
CLASS_LIMIT, COMMON_LIMIT = (0.12, 1.8), (0.09, 1.6)
#: Added to every bin, so that short documents are not far from their language by chance alone.
SMOOTH = 1.0

#: Lower case, upper case, digits, punctuation, symbols and the rest.
CHAR_BINS = 6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though the body names it often."""
    return F.transform(F.array(value), body)[0]


def base_columns(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the histograms' counts."""

    def repeated(words: Column) -> Column:
        def windows(w: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))

        def covered(h: Column) -> Column:
            at = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

            def positions(a: Column) -> Column:
                twice = F.filter(a, lambda s, k: F.get(a, k - 1).h.eqNullSafe(s.h) | F.get(a, k + 1).h.eqNullSafe(s.h))
                return F.sort_array(F.transform(twice, lambda s: s.i))

            def total(p: Column) -> Column:
                steps = F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5))))
                return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

            return let(let(at, positions), total)

        return F.when(F.size(words) < 6, F.lit(0)).otherwise(let(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))

    def over(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
        chars = F.length(F.array_join(words, ""))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            chars.cast("long").alias("word_chars"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated(words).cast("long").alias("n_repeat_words"),
            F.array(
                F.regexp_count(text, F.lit(r"\p{Ll}")).cast("double"),
                F.regexp_count(text, F.lit(r"\p{Lu}")).cast("double"),
                F.regexp_count(text, F.lit(r"[0-9]")).cast("double"),
                F.regexp_count(text, F.lit(r"[.,;:!?'\"()-]")).cast("double"),
                F.regexp_count(text, F.lit(SYMBOLS)).cast("double"),
                chars.cast("double"),
            ).alias("chars"),
            common(words).alias("common"),
        )

    return let(F.array_remove(F.split(text, WORD), ""), over)


def common(words: Column) -> Column:
    """Counts of the common words of every language; the last entry is the number of words."""
    every = sorted({w for v in COMMON.values() for w in v})
    hit = F.filter(words, lambda w: w.isin(every))
    return let(hit, lambda h: F.concat(F.transform(F.array(*map(F.lit, every)), lambda q: F.size(F.filter(h, lambda w: w == q)).cast("double")), F.array(F.size(words).cast("double"))))


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance (base 2, so 0 to 1) of two arrays of positive counts."""

    def norm(x: Column) -> Column:
        return let(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), lambda t: F.transform(x, lambda v: v / t))

    def part(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)

    return let(F.struct(norm(a).alias("p"), norm(b).alias("q")), lambda s: F.sqrt(F.greatest(F.lit(0.0), (part(s.p, s.q) + part(s.q, s.p)) / 2)))


def histogram(counts: Column) -> Column:
    """Bins from counts whose last entry is the total: the total becomes the rest."""
    known = F.slice(counts, 1, F.size(counts) - 1)
    rest = F.greatest(F.lit(0.0), F.element_at(counts, -1) - F.aggregate(known, F.lit(0.0), lambda s, v: s + v))
    return F.concat(known, F.array(rest))


def smoothed(doc: Column, ref: Column) -> Column:
    """A document's bins with SMOOTH counts added in the reference's proportions."""
    total = F.aggregate(ref, F.lit(0.0), lambda s, v: s + v)
    return let(total, lambda t: F.zip_with(doc, ref, lambda d, r: d + F.lit(SMOOTH) * r / F.greatest(t, F.lit(1.0))))


def apply_rules(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, the base figures, ``base_failed``, both distances and ``kept`` of every row."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    known = F.when(F.col(lang).isin(*LANGUAGES), F.col(lang)).otherwise(F.lit("*"))
    rows = df.select(F.col(key).alias("key"), known.alias("ref_lang"), base_columns(body).alias("b")).select("key", "ref_lang", "b.*", F.get("b.chars", F.lit(CHAR_BINS - 2)).cast("long").alias("n_symbols"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = materialize(rows.withColumn("base_failed", failed).withColumn("chars", histogram(F.col("chars"))).withColumn("common", histogram(F.col("common"))), "rules")
    sums = [F.sum(F.get(c, F.lit(k))).alias(f"{c}{k}") for c, n in _bins().items() for k in range(n)]
    good = rows.where(~F.col("base_failed"))
    by_lang = good.groupBy("ref_lang").agg(*sums)
    every = by_lang.agg(F.lit("*").alias("ref_lang"), *[F.sum(f"{c}{k}").alias(f"{c}{k}") for c, n in _bins().items() for k in range(n)])
    refs = by_lang.where("ref_lang != '*'").unionByName(every).select("ref_lang", *[F.array(*[F.coalesce(f"{c}{k}", F.lit(0.0)) for k in range(n)]).alias(f"ref_{c}") for c, n in _bins().items()])
    # at most len(LANGUAGES) + 1 rows
    joined = rows.join(F.broadcast(refs), "ref_lang", "left")
    measured = joined.withColumn("class_distance", distance(smoothed(F.col("chars"), F.col("ref_chars")), F.col("ref_chars"))).withColumn("common_distance", distance(smoothed(F.col("common"), F.col("ref_common")), F.col("ref_common")))
    beyond = lambda c, limit: F.col(c) > F.lit(limit[0]) + F.lit(limit[1]) / F.sqrt("n_words")
    far = (F.col("n_words") >= GUARD) & (beyond("class_distance", CLASS_LIMIT) | beyond("common_distance", COMMON_LIMIT))
    return measured.select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"), "class_distance", "common_distance",
    )


def _bins() -> dict[str, int]:
    return {"chars": CHAR_BINS, "common": len({w for v in COMMON.values() for w in v}) + 1}
