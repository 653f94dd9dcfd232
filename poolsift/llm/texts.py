"""Words and documents as the operators of this package read them."""

from __future__ import annotations

import string

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolsift.session import pin

# A null text is an empty one. Words after A-Z are lowered; upper case is in the class instead.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOKEN = r"[^\x20\x09-\x0D]+"


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, text): only what an operator reads, so other columns can bear any name.

    ``row`` tells rows with equal or null ids apart. It is the same in every attempt of a task, but
    another scan may be cut into other partitions: rows may only be joined with what was derived
    from the same written numbers.
    """
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def slices(batches, rows: int = 512):
    """Arrow batches cut small: a task holds so many texts, and what it makes of them, at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def located(docs: DataFrame) -> DataFrame:
    """(row, doc): the whole rows of ``docs``, each with a name that any scan gives it again.

    A row of Parquet files is named by its file and its index there, however the files are split.
    Other inputs are numbered and written first.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("index"))
    try:
        return docs.select(place.alias("row"), whole)
    except AnalysisException:
        number = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("index"))
        return pin(docs.select(number.alias("row"), whole), "located")


def numbered_in(table: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``numbered`` for a table made by ``located``."""
    return table.select("row", F.col("doc")[id_col].alias("doc_id"), F.coalesce(F.col("doc")[text_col], F.lit("")).alias("text"))


def without(docs: DataFrame, bad: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id and text are not in ``bad`` (doc_id, text_hash); null ids match each other."""
    key = [F.col(id_col).eqNullSafe(F.col("__id")), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__hash")]
    bad = bad.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    return docs.join(bad, key, "left_anti")


def lowered(text: Column | str) -> Column:
    """A-Z in lower case, all other letters as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once per row however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def tokens(text: str) -> list[bytes]:
    """Words between white space after lowering A-Z: both byte methods know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split()
