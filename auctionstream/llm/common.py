"""Column helpers that several operators share."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: The white space between words; everything else belongs to a word.
SPACE = "[ \\t-\\r]"
WORD = "[^ \\t-\\r]+"
#: Numbers from here on stand for missing ids; they sort after every other one.
NO_ID = 2**62


def documents(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used.

    Catalyst may copy an expression into every place that names it, and into the body of a lambda that
    runs once per element. A lambda variable is never copied.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))


def id_key(doc_id: Column, text: Column) -> Column:
    """A number to know a document by: its id, or one that equal texts without an id share."""
    of_text = F.shiftrightunsigned(F.xxhash64(text), 2).bitwiseOR(F.lit(NO_ID))
    return F.coalesce(doc_id.cast("long"), of_text)


def unsigned(value: Column) -> Column:
    """The hash as a number of 0 to 2^53, for fractions and buckets."""
    return F.shiftrightunsigned(value, 11)


def bytes_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of an Arrow text column; empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def portions(items: list, weight: Callable[[object], int], limit: int) -> Iterator[list]:
    """Cut a list so that a portion weighs at most ``limit``, or is a single item."""
    portion, total = [], 0
    for item in items:
        size = weight(item)
        if portion and total + size > limit:
            yield portion
            portion, total = [], 0
        portion.append(item)
        total += size
    if portion:
        yield portion
