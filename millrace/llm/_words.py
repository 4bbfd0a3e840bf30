"""Words and shingles as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space between words: blank, and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
SPLIT = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once.

    A column that is used within a lambda function, or several times, may be put in
    place of its name when a filter or another projection is moved past it, and is then
    worked out again for each element. A lambda's variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPLIT))


def shingle_starts(words_: Column, width: int) -> Column:
    """Where shingles start; fewer words than ``width`` are one shingle, none have none."""
    n = F.size(words_)
    last = F.greatest(n - width, F.lit(0))
    return F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def shingle_hash(words_: Column, start: Column, width: int) -> Column:
    """64-bit hash of a shingle's words; words beyond the end are skipped."""
    return F.xxhash64(*(F.get(words_, start + k) for k in range(width)))


def shingle_text(words_: Column, start: Column, width: int) -> Column:
    return F.array_join(F.slice(words_, start + 1, width), " ")
