"""Stop rules and reports over the rows of a prepared log (``runs.prepare_log``).

Previous values and streaks come from the log in its written order, so one run may hold any
share of the log.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolsift.functions.columns import is_base
from poolsift.functions.ranking import Ordered, with_previous

CONTINUE = "continue"


def _missing(c: str, value) -> Column:
    return F.coalesce(F.col(c) >= value, F.lit(False)) if value is not None else F.lit(False)


def stop_plateau(
    log: DataFrame, eps: float = 0.0, patience: int = 1, value: str = "selected_samples_avg_uncertainty"
) -> DataFrame:
    """Adds ``streak`` and ``plateau``: rows in a row whose value fell by less than ``eps``.

    Rows without a value neither add to a streak nor break it, and never stop. A
    patience of 0 turns the rule off.
    """
    if patience == 0:
        return log.withColumn("streak", F.lit(0).cast("long")).withColumn("plateau", F.lit(False))
    known = log.filter(F.col(value).isNotNull()).select("id", "run", F.col(value).alias("_value"))
    steps = Ordered(known, "id", ["run"]).previous({"_before": "_value"}).positions("_pos")
    flat = F.coalesce(F.col("_before") - F.col("_value") < eps, F.lit(False))
    marked = steps.running({"_last": (F.when(~flat, F.col("_pos")), "max")}).rows
    streaks = marked.select("id", (F.col("_pos") - F.col("_last")).alias("streak"))
    out = log.join(streaks, "id", "left")
    return out.withColumn("plateau", F.coalesce(F.col("streak") >= patience, F.lit(False)))


def stop_budget(
    log: DataFrame,
    accuracy_threshold: float | None = None,
    label_budget: int | None = None,
    max_iterations: int | None = None,
) -> DataFrame:
    """Adds ``stop, reason`` to rows that carry ``plateau``: plateau, accuracy, labels, iterations, in this order."""
    reason = (
        F.when(F.col("plateau"), "uncertainty_plateau")
        .when(_missing("accuracy", accuracy_threshold), f"accuracy_threshold ({accuracy_threshold})")
        .when(_missing("train_data_size", label_budget or None), "label_budget")
        .when(_missing("iteration_no", max_iterations or None), f"max_iterations_reached ({max_iterations})")
        .otherwise(CONTINUE)
    )
    return log.withColumn("reason", reason).withColumn("stop", F.col("reason") != CONTINUE)


def _with_gain(log: DataFrame) -> DataFrame:
    steps = with_previous(log, "id", {"previous_accuracy": "accuracy"}, ["run"])
    return steps.withColumn("gain", F.col("accuracy") - F.col("previous_accuracy"))


def stop_classic(
    log: DataFrame,
    min_uncertainty: float = 0.0,
    max_iterations: int | None = 20,
    success_rate: float | None = 0.85,
    min_gain: float | None = None,
) -> DataFrame:
    """Adds ``stop, reason``: no scores, low pool uncertainty, iterations, success, small positive gain."""
    small = F.coalesce((F.col("gain") > 0) & (F.col("gain") < min_gain), F.lit(False)) if min_gain is not None else F.lit(False)
    reason = (
        F.when(F.col("avg_uncertainty_pool").isNull(), "pool_empty")
        .when(F.col("avg_uncertainty_pool") < min_uncertainty, "T_threshold_reached")
        .when(_missing("iteration_no", max_iterations), "max_iterations_reached")
        .when(_missing("accuracy", success_rate), "success_rate_reached")
        .when(small, "improvement_below_I")
    )
    out = _with_gain(log).withColumn("reason", reason)
    return out.withColumn("stop", F.col("reason").isNotNull())


def stop_min_gain(log: DataFrame, min_gain: float = 0.001, unlabelled: str = "unlabelled") -> DataFrame:
    """Adds ``stop, reason``: a gain below ``min_gain``, then an empty pool; never on a first row."""
    reason = F.when(
        F.col("previous_accuracy").isNotNull(),
        F.when(F.col("gain") < min_gain, "min_improvement_not_met").when(F.col(unlabelled) == 0, "pool_empty"),
    )
    out = _with_gain(log).withColumn("reason", reason)
    return out.withColumn("stop", F.col("reason").isNotNull())


def iteration_report(log: DataFrame) -> DataFrame:
    """Per row: iteration, rows labelled in it, accuracy before and after, stop flag and reason."""
    narrow = log.select("id", "run", "iteration_no", "method", "train_data_size", "accuracy", "notes")
    steps = with_previous(narrow, "id", {"previous_accuracy": "accuracy", "_size_before": "train_data_size"}, ["run"])
    base = is_base("method")
    added = F.col("train_data_size") - F.coalesce(F.col("_size_before"), F.lit(0))
    stops = ~F.coalesce(F.col("notes").isin(CONTINUE, "base_classifier"), F.lit(True))
    return steps.select(
        "id",
        "run",
        F.col("iteration_no").alias("iteration"),
        F.when(base, F.lit(0)).otherwise(added).cast("long").alias("n_labeled"),
        "previous_accuracy",
        F.col("accuracy").alias("new_accuracy"),
        stops.alias("stop_condition"),
        F.col("notes").alias("stop_reason"),
    )
