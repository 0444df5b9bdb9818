"""Value normalisers shared by every operator.

Two texts that differ only in letter case or surrounding white space are the
same; null, blank, ``.`` and ``NA`` (any case) are missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that is trimmed, and texts that mean "no value".
BLANKS = " \t\r\n"
MISSING = ("", ".", "na")

# Spellings of the two strands after trimming and lower-casing.
PLUS = ("+", "1", "+1", "plus", "forward", "fwd", "positive", "sense")
MINUS = ("-", "-1", "−", "−1", "minus", "reverse", "rev", "negative", "antisense")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tidy(c: Column | str) -> Column:
    """Trimmed text, letter case kept; null where missing."""
    t = F.trim(_col(c), F.lit(BLANKS))
    return F.when(~F.lower(t).isin(*MISSING), t)


def key(c: Column | str) -> Column:
    """Trimmed, lower-case text; null where missing."""
    t = F.lower(F.trim(_col(c), F.lit(BLANKS)))
    return F.when(~t.isin(*MISSING), t)


def strand_sign(c: Column | str) -> Column:
    """``+`` or ``-`` from a sign, a signed number or a word; else null."""
    t = key(c)
    return F.when(t.isin(*PLUS), F.lit("+")).when(t.isin(*MINUS), F.lit("-"))


def number(c: Column | str) -> Column:
    """Lenient cast of text to double; missing and unreadable texts are null."""
    return tidy(c).try_cast("double")
