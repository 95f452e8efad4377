"""Word and line expressions that several operators share; all of them built-in column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed by contract: a word is a run of anything but these six characters.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with `value` computed once a row, however often `use` refers to it."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array; null gives none."""
    blank = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(blank, " ", -1), "")


def word_count(text: Column) -> Column:
    """The number of words, without making an array of them."""
    blank = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    padded = F.concat(F.lit(" "), blank)
    starts = F.regexp_replace(padded, "[^ ]+", "x")
    return F.length(starts) - F.length(F.translate(starts, "x", ""))


def lines_of(text: Column) -> Column:
    """The lines of a text, split at each newline; null gives none."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def has_word(line: Column) -> Column:
    return F.length(F.translate(line, SPACES, "")) > 0
