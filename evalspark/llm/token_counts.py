"""Exact token counts for every context limit, from the histogram of encoded lengths.

Documents are counted by encoded length, before the shuffle as far as possible. Suffix sums over the
lengths then answer, for any limit: how many documents reach it, how many tokens they hold, how many tokens
are left when every document is cut there. Lengths are summed by ranges first and within a range
afterwards, so no task sees more than one range of lengths or one row per range.

Defined cases: a null or empty text has length 0; an empty table gives an empty histogram; repeated rows
count each; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.tokens import with_token_counts
from evalspark.session import materialize

RANGE = 1024


def length_histogram(documents: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """``length`` and ``n_docs``, one row per encoded length that occurs."""
    counted = with_token_counts(documents, vocabulary=vocabulary)
    return counted.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For every length: documents and tokens at or above it, tokens left if all are cut there.

    ``docs_at_most`` is the number of documents up to the length and ``share_at_most`` their share.
    """
    rows = histogram.withColumns(
        {"n_tokens": F.col("length") * F.col("n_docs"), "range": F.floor(F.col("length") / RANGE)}
    )
    sums = rows.groupBy("range").agg(F.sum("n_docs").alias("docs"), F.sum("n_tokens").alias("tokens"))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = sums.select(
        "range",
        F.coalesce(F.sum("docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("docs").over(everything).alias("all_docs"),
        F.sum("tokens").over(everything).alias("all_tokens"),
    )
    within = Window.partitionBy("range").orderBy(F.desc("length"))
    summed = rows.join(ranges, "range").withColumns(
        {
            "docs_at_least": F.col("docs_above") + F.sum("n_docs").over(within),
            "tokens_at_least": F.col("tokens_above") + F.sum("n_tokens").over(within),
        }
    )
    cut = F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")
    at_most = F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")
    return summed.select(
        "length",
        "n_docs",
        "n_tokens",
        "docs_at_least",
        "tokens_at_least",
        cut.alias("truncated_tokens"),
        at_most.alias("docs_at_most"),
        (at_most / F.col("all_docs")).alias("share_at_most"),
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """For each context limit: documents above it, and tokens left if all documents are cut there.

    The next longer length has the suffix sums of the limit. ``limits`` is the caller's short list.
    """
    least = sums.agg(*[
        F.min_by(
            F.struct("docs_at_least", "tokens_at_least"), F.when(F.col("length") > limit, F.col("length"))
        ).alias(f"at_{i}")
        for i, limit in enumerate(limits)
    ], F.sum("n_tokens").alias("all_tokens"))
    entries = [F.struct(F.lit(x).cast("long").alias("limit"), F.col(f"at_{i}").alias("at")) for i, x in enumerate(limits)]
    rows = least.select("all_tokens", F.explode(F.array(*entries)).alias("e")).select("all_tokens", "e.*")
    longer = F.coalesce("at.docs_at_least", F.lit(0))
    tokens = F.coalesce("at.tokens_at_least", F.lit(0))
    total = F.coalesce("all_tokens", F.lit(0))
    return rows.select(
        "limit", longer.alias("docs_above"), (total - tokens + F.col("limit") * longer).alias("truncated_tokens")
    )


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The smallest length that at least the given share of the documents does not exceed."""
    least = sums.agg(
        *[F.min(F.when(F.col("share_at_most") >= q, F.col("length"))).alias(f"q_{i}") for i, q in enumerate(shares)]
    )
    entries = [F.struct(F.lit(float(q)).alias("share"), F.col(f"q_{i}").alias("length")) for i, q in enumerate(shares)]
    return least.select(F.inline(F.array(*entries)))


def token_counts(documents: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    # Stored, as the sums read the histogram twice and its texts should be encoded once.
    return suffix_sums(materialize(length_histogram(documents, vocabulary), "histogram"))
