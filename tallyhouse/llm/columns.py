"""Column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ASCII letters, and the character classes of words.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
BLANK = r"[\x20\x09-\x0D]"
SPACED_WORD = r"[^\x20\x09-\x0D]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def uniform(*values: Column) -> Column:
    """A number in (0, 1), the same on every run, from a hash of `values`."""
    bits = F.shiftrightunsigned(F.xxhash64(*values), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def pack(docs: DataFrame, *needed: str) -> DataFrame:
    """`needed`, and all other columns as the one column `_row`: so no name that an operator uses can clash with theirs."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, (F.struct(*rest) if rest else F.lit(None).cast("boolean")).alias("_row"))


def unpack(packed: DataFrame, docs: DataFrame, *needed: str, more: tuple[str, ...] = ()) -> DataFrame:
    """The columns of `docs` out of what `pack` made, and those of `more`."""
    return packed.select(*(F.col(c) if c in needed else F.col("_row").getField(c).alias(c) for c in docs.columns), *more)


def ascii_lower(text: str) -> Column:
    """The text with A-Z, and no other letter, in lower case; NULL is empty."""
    return F.translate(text_or_empty(text), UPPER, LOWER)


def plain_words(text: str) -> Column:
    """The lower-cased runs of digits, ASCII letters and characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")
