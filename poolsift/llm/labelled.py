"""The bounded sample of labelled rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolsift.llm.texts import remainder

#: Rows that a fit uses at most; those with the smallest id hashes, so a uniform sample.
MAX_ROWS = 20_000


def learnable(id_col: str = "doc_id") -> Column:
    """Rows whose labels may be learned from: crc32 of the id, modulo 3, is not 1."""
    return remainder(id_col, 3) != 1


def sample(labels: DataFrame, label: str, max_rows: int = MAX_ROWS, id_col: str = "doc_id") -> DataFrame:
    """(labelled_id, label): at most ``max_rows`` ids that may be learned from, with 0 or 1.

    Ids that are null or without a label are left out; of several labels of an id the largest holds.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & learnable(id_col))
    known = known.groupBy(F.col(id_col).alias("labelled_id")).agg(F.max(label).cast("int").alias("label"))
    return known.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(max_rows)


def with_labels(rows: DataFrame, labelled: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``rows`` that ``labelled`` names, with their label; at most its bound is broadcast."""
    return rows.join(F.broadcast(labelled), F.col(id_col) == F.col("labelled_id")).drop("labelled_id")
