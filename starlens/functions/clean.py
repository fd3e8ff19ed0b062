"""Scrubbing and null-safe casts for dirty columns (Column -> Column).

All casts are ``try_cast``: a value that does not parse becomes null
instead of failing the job, whatever the session's ANSI setting.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from starlens.functions._col import as_col

# Fixed patterns of the scrubs (must stay exactly these to give the
# same cleaned values as the reference's jobs).
DECIMAL_JUNK = "[^0-9.]+"      # keep digits and dots
INTEGER_JUNK = "[^0-9]"        # keep digits
NON_LETTER = "[^a-zA-Z\\s]"    # keep ASCII letters and whitespace
# Punctuation = anything that is not a letter, a number, "_" or a
# whitespace character.  Unicode classes, so accented words survive.
PUNCT = "[^\\p{L}\\p{N}_\\s]"


def scrub_decimal(c) -> Column:
    """Drop every character that is not a digit or a dot ("4.5 stars" -> "4.5")."""
    return F.regexp_replace(as_col(c), DECIMAL_JUNK, "")


def scrub_integer(c) -> Column:
    """Drop every character that is not a digit ('{"k": 69}' -> "69")."""
    return F.regexp_replace(as_col(c), INTEGER_JUNK, "")


def letters_only(c) -> Column:
    """Keep ASCII letters and whitespace only."""
    return F.regexp_replace(as_col(c), NON_LETTER, "")


def strip_punct(c) -> Column:
    """Remove punctuation, keeping Unicode letters/digits; null stays null."""
    return F.regexp_replace(as_col(c), PUNCT, "")


def try_double(c) -> Column:
    return as_col(c).try_cast("double")


def try_bigint(c) -> Column:
    return as_col(c).try_cast("bigint")


def decimal_value(c) -> Column:
    """Scrub to digits/dots, then parse as double (null when nothing parses)."""
    return try_double(scrub_decimal(c))


def integer_value(c) -> Column:
    """Scrub to digits, then parse as bigint (null when no digit is left)."""
    return try_bigint(scrub_integer(c))
