"""Words and other text columns, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
#: Runs of white space of any script, in the syntax that both Java and RE2 read.
SPACES = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def words(text: Column) -> Column:
    """Array of the maximal runs of letters or digits of the lower-cased text; null for a null text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_set(text: Column) -> Column:
    """The distinct words in sorted order; empty for a null text."""
    return F.array_sort(F.array_distinct(F.coalesce(words(text), F.array().cast("array<string>"))))


def squash(text: Column) -> Column:
    """Lower case, white space collapsed to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), SPACES, " "))
