"""Column helpers shared by the operators of this subpackage.

A word is a maximal run of characters other than the six ASCII blanks, in every operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Names of helper columns start with this, so they do not clash with columns of the input.
OWN = "_llm_"
KEY = [OWN + "id", OWN + "hash"]


def whole(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null and blank texts."""
    trimmed = F.btrim(whole(text), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def n_words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_key(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add a join key that is never null and equal for rows of equal id and text only.

    Ids may be null or repeated, so they cannot serve as keys themselves. Rows of equal keys are
    repetitions of each other.
    """
    return df.withColumns(
        {
            KEY[0]: F.coalesce(F.col(id).cast("long"), F.lit(-(2**63)).cast("long")),
            KEY[1]: F.xxhash64(F.col(id), F.col(text), F.col(text).isNull()),
        }
    )


def remainder(id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(modulus))


def open_files(uri: str):
    """(file system, path) of a folder named by a URI, for workers that read or write files."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri
