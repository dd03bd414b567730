"""Quality rules: word and line counts, and the distance of a text's histograms from its language.

Every text is read once, with SQL functions only. Its counts go to a small table; the reference
histogram of a language is the sum over all its documents, so the work grows with the table and only one
row per language is joined back. A text is refused if a base rule fails, or if it is long
enough to judge and its character classes or its common words are further from the language than allowed.

Defined cases: a null text has no words and fails the base rule; a null language is a language of its own;
a language whose references hold nothing (no words at all) refuses nothing beyond the base rules; repeated rows
give one row each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.session import materialize

MIN_WORDS = 50
MAX_REPEATED = 50
# The distances above which a text is refused, and the least evidence for a verdict.
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.45
MIN_CHARS, MIN_COMMON = 200, 50

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Character classes, taken from a text one after the other.
CLASSES = {
    "lower": r"\p{Ll}+",
    "upper": r"\p{Lu}+",
    "letter": r"[\p{L}\p{M}]+",
    "digit": r"[0-9]+",
    "stop": r"[.,;:!?]+",
    "quote": r"['\"()\[\]\-]+",
    "symbol": r"[#*$%&|<>]+",
}
# Common words of some languages.
COMMON_WORDS = """
the of and to in is that it for on was with as be by are this have from or
der die und das den von zu mit ist des im ein nicht auf eine
le la les et des en du un une que qui pour dans est par
el los las que y una con para del se por es
""".split()


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def _repeat_words(windows: Column) -> Column:
    """Words inside windows that occur at least twice."""
    n = F.size(windows)

    def same(rows: Column, k: Column, step: int) -> Column:
        other = F.get(rows, k + step)
        return F.coalesce(other["h"] == F.get(rows, k)["h"], F.lit(False))

    rows = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # Binding the sorted rows to a lambda variable keeps them from being sorted again for each row.
    repeated = F.flatten(
        F.transform(
            F.array(rows),
            lambda r: F.array_compact(
                F.transform(r, lambda x, k: F.when(same(r, k, -1) | same(r, k, 1), x["i"]))
            ),
        )
    )
    covered = F.array_distinct(F.flatten(F.transform(repeated, lambda i: F.array(i, i + 1, i + 2))))
    return F.when((n > 1) & (F.size(F.array_distinct(windows)) < n), F.size(covered)).otherwise(0)


def text_counts(documents: DataFrame, keep: Sequence[str] = ("doc_id", "lang")) -> DataFrame:
    """Counts of every text, in one row each: the base counts, character classes and common words."""
    whole = documents.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    split = whole.withColumn("words", words_of(F.col("text")))
    window = F.transform(
        F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    common = F.filter(
        F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(COMMON_WORDS)
    )
    counted = split.select(
        *keep,
        F.size("words").cast("long").alias("n_words"),
        window.alias("windows"),
        "words",
        F.array_join("words", "").alias("chars"),
        lines.alias("lines"),
        common.alias("common"),
    ).select(
        *keep,
        "n_words",
        F.length("chars").cast("long").alias("word_chars"),
        F.regexp_replace("chars", CLASSES["lower"], "").alias("rest_1"),
        F.length("chars").alias("left_0"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("windows")).cast("long").alias("n_repeat_words"),
        "common",
    )
    counted = counted.withColumn(
        "n_symbols",
        F.length(F.regexp_replace("rest_1", r"[^#*$%&|<>]+", "")).cast("long"),
    )
    counts = []
    for k, (name, pattern) in enumerate(CLASSES.items(), 1):
        if k > 1:
            counted = counted.withColumn(f"rest_{k}", F.regexp_replace(f"rest_{k - 1}", pattern, ""))
        counted = counted.withColumn(f"left_{k}", F.length(f"rest_{k}"))
        counts.append((F.col(f"left_{k - 1}") - F.col(f"left_{k}")).alias(name))
    other = F.col(f"left_{len(CLASSES)}").alias("other")
    histogram = F.array(*[c.cast("double") for c in [*counts, other]])
    # Lengths of a joined list before and after a word is taken out give its count.
    joined = F.concat(F.lit(" "), F.array_join("common", "  "), F.lit(" "))
    counted = counted.withColumn("joined", joined)
    n_common = [
        (
            (F.octet_length("joined") - F.octet_length(F.replace("joined", F.lit(f" {w} "), F.lit(""))))
            / (len(w.encode()) + 2)
        )
        for w in sorted(set(COMMON_WORDS))
    ]
    rest = F.col("n_words").cast("double") - F.size("common")
    return counted.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        histogram.alias("char_counts"),
        F.array(*n_common, rest).alias("word_counts"),
    )


def _sums(column: str, n: int) -> Column:
    return F.array(*[F.coalesce(F.sum(F.get(column, F.lit(i))), F.lit(0.0)) for i in range(n)])


def _js_distance(counts: Column, reference: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits, null if one side is empty."""

    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def term(p: Column, q: Column) -> Column:
        return (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2

    n, r = total(counts), total(reference)
    shares = F.zip_with(counts, reference, lambda x, y: F.struct((x / n).alias("p"), (y / r).alias("q")))
    divergence = F.aggregate(
        F.transform(shares, lambda s: term(s["p"], s["q"])), F.lit(0.0), lambda a, x: a + x
    )
    return F.when((n > 0) & (r > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def quality_rules(
    documents: DataFrame,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    keep: Sequence[str] = ("doc_id", "lang"),
) -> DataFrame:
    """One row per document: the base counts, both distances and the verdict ``kept``."""
    counts = materialize(text_counts(documents, keep), "text-counts")
    n_chars, n_common = len(CLASSES) + 1, len(set(COMMON_WORDS)) + 1
    references = counts.groupBy(F.coalesce("lang", F.lit("")).alias("ref_lang")).agg(
        _sums("char_counts", n_chars).alias("ref_chars"), _sums("word_counts", n_common).alias("ref_words")
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")
    )
    judged = (
        counts.join(references, F.coalesce("lang", F.lit("")) == F.col("ref_lang"), "left")
        .withColumn("base_failed", base_failed)
        .withColumn(
            "char_distance",
            F.when(
                F.col("word_chars") >= MIN_CHARS, F.round(_js_distance(F.col("char_counts"), F.col("ref_chars")), 9)
            ),
        )
        .withColumn(
            "word_distance",
            F.when(
                F.col("n_words") >= MIN_COMMON, F.round(_js_distance(F.col("word_counts"), F.col("ref_words")), 9)
            ),
        )
    )
    far = F.coalesce(F.col("char_distance") > max_char_distance, F.lit(False)) | F.coalesce(
        F.col("word_distance") > max_word_distance, F.lit(False)
    )
    return judged.withColumn("kept", ~F.col("base_failed") & ~far).select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "char_distance",
        "word_distance",
    )
