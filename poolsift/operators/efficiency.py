"""How quickly, and with how many labels, a method gets good."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolsift.functions.columns import is_random
from poolsift.functions.ranking import positions, with_previous
from poolsift.operators.runs import labels_used
from poolsift.operators.significance import scored_rows

# Shares of the best macro-F1, unit of label counts.
LEVELS = [0.7, 0.8, 0.9, 0.95]
PER_LABELS = 1000


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def curve_auc(results: DataFrame) -> DataFrame:
    """Trapezoid area of macro-F1 over the iterations in log order, and per 1000 labels.

    Neighbouring rows meet by position, so no method has to fit into one task.
    """
    rows = scored_rows(results).withColumn("_labels", labels_used())
    pairs = with_previous(rows, "id", {"_x": "iteration_no", "_y": "macro_f1"}, ["method"])
    strip = (F.col("iteration_no") - F.col("_x")) * (F.col("macro_f1") + F.col("_y")) / 2.0
    summed = pairs.groupBy("method").agg(
        F.count("*").alias("_n"), F.sum(strip).alias("auc"), F.max_by("_labels", "id").alias("total_labels")
    )
    return summed.filter(F.col("_n") > 1).select(
        "method", "auc", "total_labels", (_ratio(F.col("auc"), F.col("total_labels")) * PER_LABELS).alias("learning_efficiency")
    )


def convergence(results: DataFrame, levels=LEVELS) -> DataFrame:
    """``method, level, iteration, labels, macro_f1`` where a share of the best value is first reached."""
    rows = scored_rows(results)
    best = rows.agg(F.max("macro_f1")).scalar()
    seen = rows.withColumn("_best", best)
    found = {"iteration": F.col("iteration_no").cast("long"), "labels": labels_used(), "macro_f1": F.col("macro_f1")}
    # plain numbers as aggregation buffers keep this a hash aggregate
    firsts = [
        F.min_by(c, F.when(F.col("macro_f1") >= F.col("_best") * level, F.col("id"))).alias(f"_{name}{i}")
        for i, level in enumerate(levels)
        for name, c in found.items()
    ]
    wide = seen.groupBy("method").agg(*firsts)
    cells = [
        F.struct(F.lit(float(level)).alias("level"), *[F.col(f"_{name}{i}").alias(name) for name in found])
        for i, level in enumerate(levels)
    ]
    long = wide.select("method", F.explode(F.array(*cells)).alias("_c")).select("method", "_c.*")
    return long.filter(F.col("macro_f1").isNotNull())


def final_rows(rows: DataFrame) -> DataFrame:
    """Last row of each method, with the id of its first."""
    return rows.groupBy("method").agg(
        F.min("id").alias("first_id"),
        F.max_by("macro_f1", "id").alias("macro_f1"),
        F.max_by(labels_used(), "id").alias("labels"),
    )


def label_efficiency(results: DataFrame) -> DataFrame:
    """Final macro-F1 per 1000 labels."""
    finals = final_rows(scored_rows(results))
    return finals.select(
        "method", "macro_f1", "labels", (_ratio(F.col("macro_f1"), F.col("labels")) * PER_LABELS).alias("label_efficiency")
    )


def early_performance(results: DataFrame) -> DataFrame:
    """Macro-F1 a quarter into the log of a method, for methods with at least four rows."""
    rows = scored_rows(results).select("id", "method", "macro_f1")
    sizes = rows.groupBy("method").agg(F.count("*").alias("_n")).filter(F.col("_n") >= 4)
    quarter = sizes.select("method", F.floor(F.col("_n") / 4).alias("early_iteration"))
    placed = positions(rows, "id", ["method"])
    return placed.join(quarter, "method").filter(F.col("position") == F.col("early_iteration") + 1).select(
        "method", "early_iteration", F.col("macro_f1").alias("early_performance")
    )


def cost_benefit(results: DataFrame) -> DataFrame:
    """Final values against the first method with ``random`` in its name."""
    finals = final_rows(scored_rows(results))
    base = finals.filter(is_random("method")).agg(F.min_by(F.struct("method", "macro_f1", "labels"), "first_id")).scalar()
    rows = finals.withColumn("_b", base).filter(F.col("method") != F.col("_b.method"))
    f1, labels = F.col("macro_f1"), F.col("labels")
    base_f1, base_labels = F.col("_b.macro_f1"), F.col("_b.labels")
    gain, saved = f1 - base_f1, base_labels - labels
    comparable = (base_f1 > 0) & (labels > 0) & (base_labels > 0)
    return rows.select(
        "method",
        gain.alias("performance_gain"),
        (_ratio(gain, base_f1) * 100.0).alias("performance_gain_pct"),
        saved.alias("label_savings"),
        (_ratio(saved, base_labels) * 100.0).alias("label_savings_pct"),
        F.when(comparable, (f1 / labels) / (base_f1 / base_labels)).otherwise(1.0).alias("efficiency_ratio"),
        f1.alias("method_f1"),
        base_f1.alias("random_f1"),
        labels.alias("method_labels"),
        base_labels.alias("random_labels"),
    )
