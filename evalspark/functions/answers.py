"""From a free-form answer to a decision, an explanation and a 0/1 prediction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.text import strip
from evalspark.schemas import DECISIONS

# The markers of a formatted answer, and how far an unformatted one is read.
DECISION_MARK = "DECISION:"
EXPLANATION_MARK = "EXPLANATION:"
FALLBACK_CHARS = 50


def _says(text: Column, word: str, mode: str) -> Column:
    if mode == "compat":
        return F.contains(text, F.lit(word))
    if mode == "word":
        return F.rlike(text, F.lit(rf"\b{word}\b"))
    raise ValueError(f"mode must be 'compat' or 'word', not {mode!r}")


def strip_preamble(response: Column, closing: str = "</think>") -> Column:
    """Keep what follows the last closing tag of a reasoning preamble."""
    return F.substring_index(response, closing, -1)


def _formatted(response: Column) -> Column:
    return F.contains(response, F.lit(DECISION_MARK)) & F.contains(response, F.lit(EXPLANATION_MARK))


def decision(response: Column, mode: str = "compat") -> Column:
    """Yes, No, Unclear, or Error where there is no response.

    ``compat`` looks for the substrings ``yes`` and then ``no``, so ``cannot`` reads as No; ``word``
    asks for whole words.
    """
    after_mark = F.split_part(response, F.lit(DECISION_MARK), F.lit(2))
    marked = F.lower(F.split_part(after_mark, F.lit(EXPLANATION_MARK), F.lit(1)))
    # Cut before lower-casing too, which never shortens a text, so long answers are not lower-cased whole.
    opening = F.substring(F.lower(F.substring(response, 1, FALLBACK_CHARS)), 1, FALLBACK_CHARS)
    judged = F.when(_formatted(response), marked).otherwise(opening)
    return (
        F.when(response.isNull(), "Error")
        .when(_says(judged, "yes", mode), "Yes")
        .when(_says(judged, "no", mode), "No")
        .otherwise("Unclear")
    )


def explanation(response: Column, error: Column | None = None) -> Column:
    """The stripped text after the explanation marker, else the whole response, else the error."""
    failure = F.lit("no response") if error is None else F.coalesce(error, F.lit("no response"))
    return (
        F.when(response.isNull(), failure)
        .when(_formatted(response), strip(F.split_part(response, F.lit(EXPLANATION_MARK), F.lit(2))))
        .otherwise(response)
    )


def prediction(decided: Column, unclear: str = "zero") -> Column:
    """1 for Yes and 0 for all else; with ``unclear='null'`` only a clear No gives 0."""
    if unclear == "zero":
        return F.equal_null(decided, F.lit("Yes")).cast("int")
    if unclear == "null":
        return F.when(decided == "Yes", 1).when(decided == "No", 0)
    raise ValueError(f"unclear must be 'zero' or 'null', not {unclear!r}")


def decision_code(decided: Column) -> Column:
    """Position in ``DECISIONS``: a fixed-width stand-in that keeps aggregation hash-based."""
    code = F.when(decided == DECISIONS[0], 0)
    for position, name in enumerate(DECISIONS[1:], start=1):
        code = code.when(decided == name, position)
    return code


def decision_name(code: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(d) for d in DECISIONS]), code + 1)


def response_field(body: Column) -> Column:
    """The ``response`` field of a stored JSON body, empty where the field is absent."""
    return F.coalesce(F.get_json_object(body, "$.response"), F.lit(""))
