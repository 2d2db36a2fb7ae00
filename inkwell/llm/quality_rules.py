"""Quality rules with distribution divergence (native).

Base rules look at length and repetition. The method compares a document with
its language: the histogram of its character classes and that of the common
words it holds, each by Jensen-Shannon distance to the language's reference and to that
of all languages together, which texts of several languages are near to. A
document goes if both histograms are too far from either; short ones, whose
histograms say little, are not judged.

References are fitted on all documents that pass the base rules and the length
guard: first the mean class histogram of each language, then, over the
documents no farther from it than the average, the final ones. Means are sums
of whole millionths, so they do not depend on the order of summation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import join_counted, let, stored, words

#: Base rules: least number of words, largest percentage of repeated words.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Least number of words of a document that the method judges.
JUDGED_WORDS = 75
#: Largest distances; a document beyond both is rejected.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.18, 0.25
#: Default least number of eligible documents from which a language has a reference of its own.
MIN_REFERENCE = 8
SCALE = 1_000_000

#: Character classes besides the rest (fixed values, as regular expressions).
CLASSES = (
    r"[A-Z]",
    r"[0-9]",
    r"""[.,;:'"()-]""",
    r"[!?]",
    r"[#*$%&|<>@^~=_+{}\[\]\\/]",
    r"[^\x00-\x7F]",
)
#: Common words of the languages (fixed values).
COMMON = {
    "en": "the of and to in a is that it for on was as with be by are this",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au plus",
    "es": "de la que el en y a los se del las un por con no una su para es al lo",
}
COMMON_WORDS = sorted({w for text in COMMON.values() for w in text.split()})


def repeated_words(tokens: Column) -> Column:
    """Words in 3-word windows that occur twice or more, each counted once.
    Windows are compared by 64-bit digest within their document."""
    def count(digests: Column) -> Column:
        tagged = F.sort_array(F.transform(digests, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        spots = let(tagged, lambda s: F.sort_array(F.transform(
            F.filter(F.transform(s, lambda x, k: F.struct(
                x.i.alias("i"),
                (((k > 0) & (F.get(s, k - 1).h == x.h)).eqNullSafe(True)
                 | (F.get(s, k + 1).h == x.h).eqNullSafe(True)).alias("twice"))),
                lambda x: x.twice), lambda x: x.i)))
        covered = F.aggregate(
            spots, F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
            lambda a, p: F.struct((p + 3).alias("end"),
                                  (a.n + p + 3 - F.greatest(a.end, p)).alias("n")),
            lambda a: a.n)
        return F.when(F.size(F.array_distinct(digests)) < F.size(digests), covered).otherwise(
            F.lit(0).cast("bigint"))

    return let(tokens, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("bigint")).otherwise(
        let(F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))), count)))


def features(docs: DataFrame) -> DataFrame:
    """Counts and histograms of every document (null text: empty)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", text.alias("text"), words(text).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("bigint")
    chars = F.length(F.array_join("w", "")).cast("bigint")
    common = F.filter(F.transform("w", F.lower), lambda x: x.isin(COMMON_WORDS))
    rows = rows.select(
        "doc_id", "lang", F.size("w").cast("bigint").alias("n_words"), chars.alias("word_chars"),
        n(r"[#*$%&|<>]").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.array(*[n(c) for c in CLASSES]).alias("few"),
        let(common, lambda c: F.array(*[(F.size(c) - F.size(F.array_remove(c, w))).cast("bigint")
                                        for w in COMMON_WORDS])).alias("common"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)
    return rows.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.concat(F.array(F.col("word_chars") - total("few")), "few").alias("classes"),
        F.concat("common", F.array(F.col("n_words") - total("common"))).alias("common"),
        ((F.col("n_words") < MIN_WORDS)
         | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))).alias("base_failed"))


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of one length."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def both(t: Column) -> Column:
        def term(c: Column, r: Column) -> Column:
            p, q = c / t.p, r / t.q
            return (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2
        return F.sqrt(F.greatest(F.lit(0.0), total(F.zip_with(counts, reference, term))))

    return let(F.struct(total(counts).alias("p"), total(reference).alias("q")), both)


def _means(column: str, size: int) -> list[Column]:
    whole = F.aggregate(column, F.lit(0).cast("bigint"), lambda x, y: x + y)
    return [F.sum(F.floor(F.get(F.col(column), F.lit(i)) * SCALE / whole)).cast("double").alias(f"{column}{i}")
            for i in range(size)]


def _references(rows: DataFrame, least: int, **columns: int) -> DataFrame:
    """(lang, reference, and for each of ``columns`` ref_ and all_ arrays): the sums
    of each language (of all where it has fewer than ``least`` rows; ``reference``
    says which) and those of all languages."""
    sums = [m for c, size in columns.items() for m in _means(c, size)]
    per = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *sums)
    arrays = [F.array(*[f"{c}{i}" for i in range(size)]).alias(f"ref_{c}")
              for c, size in columns.items()]
    pool = per.agg(F.sum("n").alias("n"), *[F.sum(f"{c}{i}").alias(f"{c}{i}")
                                            for c, size in columns.items() for i in range(size)])
    pool = pool.select(*[a.alias(f"all_{c}") for a, c in zip(arrays, columns)])
    per = per.select("lang", "n", *arrays)
    return per.crossJoin(F.broadcast(pool)).select(  # the pool is one row
        F.col("lang").alias("_lang"), *[f"all_{c}" for c in columns],
        F.when(F.col("n") >= least, F.lit("language")).otherwise(F.lit("all")).alias("reference"),
        *[F.when(F.col("n") >= least, F.col(f"ref_{c}")).otherwise(F.col(f"all_{c}"))
          .alias(f"ref_{c}") for c in columns])


def _with_references(rows: DataFrame, references: DataFrame) -> DataFrame:
    """Rows beside their language's reference, null if it has none."""
    out = join_counted(rows, references, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    return out.drop("_lang")


def judged(docs: DataFrame, min_reference: int = MIN_REFERENCE) -> DataFrame:
    """Every document with its counts, ``base_failed``, ``kept`` and ``reference``:
    'language' if its language has ``min_reference`` eligible documents to be
    compared with, 'all' if it has fewer (the texts of all languages then stand
    in), null if it has none.

    Null and empty texts have no words and fail the base rules. A null language
    is a language. A language none of whose documents is eligible has no
    reference: its documents are too short to be judged. Repeated rows are
    judged alike. Extra columns are not read. No rows: no output.
    """
    rows = stored(features(docs), "rules-features")
    able = rows.where(~F.col("base_failed") & (F.col("n_words") >= JUDGED_WORDS))
    first = _with_references(able, _references(able, min_reference, classes=len(CLASSES) + 1))
    first = first.withColumn("far", F.floor(distance(F.col("classes"), F.col("ref_classes")) * SCALE))
    first = stored(first.drop("ref_classes", "all_classes", "reference"), "rules-first")
    mean = first.groupBy(F.col("lang").alias("_lang")).agg(
        F.sum("far").alias("far_sum"), F.count(F.lit(1)).alias("far_n"))
    near = join_counted(first, mean, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
    near = near.where(F.col("far") * F.col("far_n") <= F.col("far_sum"))
    sizes = {"classes": len(CLASSES) + 1, "common": len(COMMON_WORDS) + 1}
    out = _with_references(rows, stored(_references(near, min_reference, **sizes), "rules-references"))
    nearest = lambda c: F.least(distance(F.col(c), F.col(f"ref_{c}")),
                                distance(F.col(c), F.col(f"all_{c}")))
    off = (nearest("classes") > MAX_CLASS_DISTANCE) & (nearest("common") > MAX_WORD_DISTANCE)
    seen = ~F.col("base_failed") & (F.col("n_words") >= JUDGED_WORDS) & F.col("ref_classes").isNotNull()
    return out.withColumn("kept", ~F.col("base_failed") & ~F.when(seen, off).otherwise(F.lit(False)))


def query(docs: DataFrame) -> DataFrame:
    """op1: counts, base rules and verdict of every document."""
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                               "n_repeat_words", "base_failed", "kept")
