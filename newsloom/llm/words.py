"""Word rules that several operators share, as JVM-side expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word of running text: everything between ASCII blanks.
BLANK_WORD = r"[^\x20\x09-\x0D]+"
#: What separates the words that benchmark windows are made of (after A-Z are lower-cased, or before).
PLAIN_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def count_words(text: Column) -> Column:
    """Number of blank-separated words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(BLANK_WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast built-in; other text is translated letter by letter."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def plain_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters; null gives an empty array."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), PLAIN_SEPARATOR), ""), F.array().cast("array<string>"))
