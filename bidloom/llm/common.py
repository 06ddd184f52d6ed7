"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.sources.shared import Workspace

#: Bytes of ASCII that are no word characters become spaces, A-Z become a-z; every byte of a
#: non-ASCII character stays, so UTF-8 text can be split without decoding it.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)

#: The same separators as a Java pattern.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written into the shared folder and read back; see ``Workspace``."""
    return Workspace(df.sparkSession).write(df, tag)


def with_row_id(df: DataFrame, name: str = "rid") -> DataFrame:
    """A key per input row, so that null or repeated ids stay separate rows.

    The numbers follow the split of the input, which may change when executors come or go.  So
    they must be written before anything is joined by them, and be read from there.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def whole_row(columns, name: str) -> Column:
    """The named columns as one struct, so that no name can clash with others."""
    return F.struct(*[F.col(f"`{c}`") for c in columns]).alias(name)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    """Lower-cased words of a text as an array, in JVM expressions; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NON_WORD), "")


def byte_words(text: str | None) -> list[bytes]:
    """The same words as UTF-8 bytes, for Python tasks."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()
