"""Text functions that follow Python's rules for whitespace and word characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# A run of two or more letters, numbers or underscores: what \b\w\w+\b finds in Python. Java's own
# \w is ASCII only, and its Unicode mode also takes combining marks.
WORD = r"[\p{L}\p{N}_]{2,}"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def words(text: Column) -> Column:
    """All words of the lower-cased text, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def content_words(text: Column, stop_words: list[str]) -> Column:
    """``words`` without the stop words; repeats kept, as a count vectoriser needs them."""
    found = words(text)
    return F.filter(found, lambda w: ~w.isin(stop_words)) if stop_words else found
