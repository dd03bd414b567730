"""A compact stand-in for the wide table, for everything that only counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.schemas import Variant

WEIGHT = "n"


def answer_profile(wide: DataFrame, variants: Sequence[Variant]) -> DataFrame:
    """Number of items per combination of label, keyword, length and answers.

    Scores, slices, transitions and dataset statistics depend on these columns alone, so one pass over
    the items serves them all: pass the profile in place of the items, with ``weight=WEIGHT``. It has
    one row per combination that occurs, never more than there are items.
    """
    names = [v.name for v in variants]
    return wide.groupBy("truth", "keyword", "text_length", *names).agg(F.count("*").alias(WEIGHT))
