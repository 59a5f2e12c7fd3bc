"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space between words, as a Java/RE2 pattern; a word is a run of anything else.
BREAK = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it.

    An expression used inside a higher-order function is evaluated anew for every element; bound to
    a lambda variable it is evaluated once, which keeps array work linear in the length of the text.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """All words of a text, in order; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK, -1), "")


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a whole text: two independent 64-bit hashes (null is a text of its own)."""
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text, F.length(text))]


def require(df: DataFrame, *names: str) -> None:
    """Raise when ``df`` lacks a column or has it twice, before any job starts."""
    for name in names:
        if df.columns.count(name) != 1:
            raise ValueError(f"column {name!r} must be there once, not {df.columns.count(name)} times")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes not to be a column of ``df``."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name
