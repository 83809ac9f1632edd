"""Text helpers with Python's notion of lines and blanks, as JVM column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The separators at which Python's str.splitlines() breaks.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
UNUSUAL_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
# The characters that Python's str.strip() takes off.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def unix_lines(text: Column) -> Column:
    """Every line separator as one ``\\n``; texts without unusual separators pass as they are."""
    unusual = reduce(or_, [text.contains(c) for c in UNUSUAL_BREAKS])  # byte searches, cheaper than a class
    return F.when(unusual, F.regexp_replace(text, LINE_BREAK, "\n")).otherwise(text)


def split_lines(text: Column) -> Column:
    """``str.splitlines()`` as an array: no line after a last separator, and none in an empty text."""
    lines = F.split(F.regexp_replace(unix_lines(text), "\n\\z", ""), "\n")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(lines)


def strip(text: Column) -> Column:
    """``str.strip()``: blanks of any kind, not only spaces."""
    return F.trim(text, F.lit(BLANKS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANKS))


def indent_width(text: Column) -> Column:
    """Number of leading blank characters (all of them when the line is blank)."""
    return F.length(text) - F.length(lstrip(text))


def int_list(numbers: Column) -> Column:
    """An integer array in the bracketed form used by prompts: ``[1, 2, 3]``."""
    return F.concat(F.lit("["), F.array_join(numbers.cast("array<string>"), ", "), F.lit("]"))
