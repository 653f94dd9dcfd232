"""A pool on shared storage whose state changes without touching its texts: merge on read.

The pool's rows are written once, bucketed and sorted by id. Every later change is a narrow row
(id, sequence, what is new) in a table of its own with the same buckets. Reading folds the changes to
the latest per id and joins them to the rows bucket by bucket, so no text is shuffled, whatever the
size of the state. ``compact`` writes the folded changes as one row per id.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsift.functions.columns import present
from poolsift.operators.pool import POOL_COLUMNS
from poolsift.session import fresh_path

CHANGES = "id, seq, is_labelled, label, scored, model_prediction, uncertainty_score".split(", ")


class PoolStore:
    """Rows of a pool, and the changes made to them in order.

    Updates follow ``pool.save_predictions``, ``pool.apply_labels`` and ``pool.mark_labelled``. Rows of
    one id, repeated or not, get the same changes; rows without an id get none.
    """

    def __init__(self, pool: DataFrame, buckets: int | None = None):
        self.spark: SparkSession = pool.sparkSession
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder, self.name = fresh_path(self.spark, "store"), f"poolsift_{uuid.uuid4().hex}"
        self.seq, self.version, self.tables = 0, 0, []
        self._kind = pool.schema["id"].dataType.simpleString()
        self._append(pool.select(*POOL_COLUMNS), "rows")
        self._append(self._nothing(), self._changes)

    @property
    def _changes(self) -> str:
        return f"changes_{self.version}"

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], f"id {self._kind}, seq long, is_labelled boolean, label string, scored boolean, model_prediction string, uncertainty_score double")

    def _append(self, df: DataFrame, table: str) -> None:
        full = f"{self.name}_{table}"
        writer = df.repartition(self.buckets, "id").write.mode("append").format("parquet").bucketBy(self.buckets, "id").sortBy("id")
        writer.option("path", f"{self.folder}/{table}").saveAsTable(full)
        if full not in self.tables:
            self.tables.append(full)

    def _change(self, df: DataFrame, **columns) -> None:
        self.seq += 1
        new = df.filter(F.col("id").isNotNull()).select("id", F.lit(self.seq).cast("long").alias("seq"), *(c.alias(n) for n, c in columns.items()))
        given = self._nothing().schema
        missing = [F.lit(None).cast(given[c].dataType).alias(c) for c in CHANGES if c not in new.columns]
        self._append(new.select("*", *missing).select(*CHANGES), self._changes)

    # --- updates -------------------------------------------------------------------------

    def save_predictions(self, predictions: DataFrame) -> None:
        """Store prediction and score of the scored ids; an id scored twice keeps the highest score."""
        self._change(predictions, scored=F.lit(True), model_prediction=F.col("model_prediction").cast("string"), uncertainty_score=F.col("uncertainty_score"))

    def apply_labels(self, labels: DataFrame) -> None:
        """Reveal ``id, label`` pairs; a pair without a label changes nothing."""
        self._change(labels.filter(present("label")), is_labelled=F.lit(True), label=F.col("label"))

    def mark_labelled(self, ids: DataFrame) -> None:
        """Set the flag of the ids and keep their label."""
        self._change(ids, is_labelled=F.lit(True))

    # --- reading -------------------------------------------------------------------------

    def changes(self) -> DataFrame:
        """One row per changed id: the flag if ever set, the latest label, the latest prediction with its score."""
        all_changes = self.spark.table(f"{self.name}_{self._changes}")
        return (
            all_changes.groupBy("id")
            .agg(
                F.max("seq").alias("seq"),
                F.max("is_labelled").alias("is_labelled"),
                F.max(F.when(F.col("label").isNotNull(), F.struct("seq", "label"))).alias("_label"),
                F.max("scored").alias("scored"),
                F.max(F.when(F.col("scored"), F.struct("seq", "uncertainty_score", "model_prediction"))).alias("_score"),
            )
            .select("id", "seq", "is_labelled", F.col("_label.label").alias("label"), "scored", "_score.model_prediction", "_score.uncertainty_score")
        )

    def read(self) -> DataFrame:
        """The pool as it stands now."""
        new = self.changes().select("id", *(F.col(c).alias(f"_{c}") for c in CHANGES[2:]))
        scored = F.coalesce("_scored", F.lit(False))
        merged = self.spark.table(f"{self.name}_rows").join(new, "id", "left").withColumns(
            {
                "is_labelled": F.col("is_labelled") | F.coalesce("_is_labelled", F.lit(False)),
                "label": F.coalesce("_label", "label"),
                "model_prediction": F.when(scored, F.col("_model_prediction")).otherwise(F.col("model_prediction")),
                "uncertainty_score": F.when(scored, F.col("_uncertainty_score")).otherwise(F.col("uncertainty_score")),
            }
        )
        return merged.select(*POOL_COLUMNS)

    def compact(self) -> None:
        """Replace the changes by their latest; readers of the old table should be done."""
        folded, old = self.changes(), f"{self.name}_{self._changes}"
        self.version += 1
        self._append(folded.select(*CHANGES), self._changes)
        self.spark.sql(f"drop table {old}")
        self.tables.remove(old)

    def drop(self) -> None:
        """Forget the tables; their files lie in the shared folder like all others."""
        for table in self.tables:
            self.spark.sql(f"drop table if exists {table}")
        self.tables = []
