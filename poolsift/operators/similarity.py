"""How close one embedded column is to others."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolsift.functions.ranking import top_n


def _dot(a, b) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a, b) -> Column:
    """Cosine of two vectors; 0 where one of them has no length."""
    lengths = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(lengths > 0, _dot(a, b) / lengths).otherwise(0.0)


def column_similarity(
    df: DataFrame, target: str, others, limit: int | None = None, key: str = "id"
) -> DataFrame:
    """``column_name, similarity``: mean cosine of ``target`` and each other column, largest first.

    Rows with any null are left out. One scan serves all columns. ``limit`` keeps the
    first rows by ``key``, as an option of the caller.
    """
    rows = df.dropna(subset=[target, *others])
    if limit is not None:
        rows = top_n(rows, limit, [F.col(key)])
    means = rows.agg(*[F.avg(cosine(target, c)).alias(c) for c in others])
    long = means.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("similarity")) for c in others])
        ).alias("_r")
    )
    return long.select("_r.column_name", "_r.similarity").orderBy(F.desc("similarity"), "column_name")
