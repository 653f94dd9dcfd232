"""Learning curves per method and what they gain over random sampling."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolsift.operators.runs import drop_base_rows, extract_metric
from poolsift.session import pin

BASELINE = "random_sampling"
METRICS = ["accuracy", "macro_f1"]
# Performance targets and the full-label reference point.
TARGETS = [0.3, 0.4, 0.5, 0.6]
FULL_ACCURACY, FULL_F1, FULL_LABELS = 0.716, 0.725, 1000


def learning_curve(results: DataFrame) -> DataFrame:
    """``method, train_data_size, accuracy, macro_f1``: per size the latest row, missing values 0."""
    rows = extract_metric(drop_base_rows(results).filter(F.col("method").isNotNull()), METRICS)
    # plain numbers as aggregation buffers keep this a hash aggregate
    latest = [F.max_by(F.coalesce(F.col(m), F.lit(0.0)), "id").alias(m) for m in METRICS]
    return rows.groupBy("method", "train_data_size").agg(*latest)


def common_sizes(curve: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Every other method beside the baseline at the train sizes both have."""
    base = curve.filter(F.col("method") == baseline).select(
        "train_data_size", F.col("accuracy").alias("base_accuracy"), F.col("macro_f1").alias("base_macro_f1")
    )
    return curve.filter(F.col("method") != baseline).join(base, "train_data_size")


def improvement_vs_random(curve: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Mean and largest gain in percent at common sizes; a baseline of 0 gives no gain."""
    pairs = common_sizes(curve, baseline)

    def gain(m):
        base = F.col(f"base_{m}")
        return F.when(base != 0, (F.col(m) - base) / base * 100.0)

    return pairs.groupBy("method").agg(
        F.avg(gain("accuracy")).alias("accuracy_improvement_pct"),
        F.avg(gain("macro_f1")).alias("macro_f1_improvement_pct"),
        F.max(gain("accuracy")).alias("max_accuracy_improvement_pct"),
        F.max(gain("macro_f1")).alias("max_macro_f1_improvement_pct"),
        F.count("*").alias("common_sizes"),
    )


def labels_to_target(curve: DataFrame, targets=TARGETS) -> DataFrame:
    """``method, metric, target, labels``: the smallest size at or above the target, if any."""
    cells = [
        F.struct(F.lit(m).alias("metric"), F.lit(float(t)).alias("target"), F.col(m).alias("value"))
        for m in METRICS
        for t in targets
    ]
    rows = curve.select("method", "train_data_size", F.explode(F.array(*cells)).alias("_c"))
    return (
        rows.select("method", "train_data_size", "_c.*")
        .filter(F.col("value") >= F.col("target"))
        .groupBy("method", "metric", "target")
        .agg(F.min("train_data_size").alias("labels"))
    )


def data_savings(curve: DataFrame, targets=TARGETS, baseline: str = BASELINE) -> DataFrame:
    """Mean and largest share of labels saved at targets both reach; 0 where there are none."""
    curve = pin(curve, "curve")  # read four times below
    reached = labels_to_target(curve, targets).filter(F.col("labels") > 0)
    base = reached.filter(F.col("method") == baseline).select("metric", "target", F.col("labels").alias("_base"))
    saved = (
        reached.filter(F.col("method") != baseline)
        .join(base, ["metric", "target"])
        .withColumn("_pct", (F.col("_base") - F.col("labels")) / F.col("_base") * 100.0)
    )

    def of(m):
        return F.when(F.col("metric") == m, F.col("_pct"))

    summed = saved.groupBy("method").agg(
        F.avg(of("accuracy")).alias("avg_accuracy_savings_pct"),
        F.avg(of("macro_f1")).alias("avg_macro_f1_savings_pct"),
        F.max(of("accuracy")).alias("max_accuracy_savings_pct"),
        F.max(of("macro_f1")).alias("max_macro_f1_savings_pct"),
    )
    there = curve.filter(F.col("method") == baseline).agg(F.count("*")).scalar()
    methods = curve.filter((F.col("method") != baseline) & (there > 0)).select("method").distinct()
    return methods.join(summed, "method", "left").na.fill(0.0)


def final_points(curve: DataFrame) -> DataFrame:
    """The point of each method at its largest train size."""
    last = [F.max_by(m, "train_data_size").alias(m) for m in METRICS]
    return curve.groupBy("method").agg(*last, F.max("train_data_size").alias("train_data_size"))


def gap_to_full(curve: DataFrame) -> DataFrame:
    """Final values and how far they stay below a fully labelled reference."""
    return final_points(curve).select(
        "method",
        F.col("accuracy").alias("final_accuracy"),
        F.col("macro_f1").alias("final_macro_f1"),
        F.col("train_data_size").alias("final_train_size"),
        ((FULL_ACCURACY - F.col("accuracy")) / FULL_ACCURACY * 100.0).alias("accuracy_gap_pct"),
        ((FULL_F1 - F.col("macro_f1")) / FULL_F1 * 100.0).alias("macro_f1_gap_pct"),
        (F.col("train_data_size") / FULL_LABELS * 100.0).alias("size_vs_full_pct"),
    )


def final_stats(curve: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Spread of the final values over methods; empty without the baseline or a second method."""
    finals = final_points(curve)
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS]
    long = finals.select("method", F.explode(F.array(*cells)).alias("_c")).select("method", "_c.*")
    spread = long.groupBy("metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count("*").alias("methods"),
        F.max(F.col("method") == baseline).alias("_based"),
    )
    return spread.filter(F.col("_based") & (F.col("methods") >= 2)).drop("_based")


def final_vs_random(curve: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Difference of the final values to the baseline's, absolute and in percent."""
    finals = final_points(curve)
    base = finals.filter(F.col("method") == baseline).select(F.struct("accuracy", "macro_f1")).scalar()
    rows = finals.filter(F.col("method") != baseline).withColumn("_base", base).filter(F.col("_base").isNotNull())

    def diff(m):
        return F.col(m) - F.col(f"_base.{m}")

    def pct(m):
        return F.when(F.col(f"_base.{m}") != 0, diff(m) / F.col(f"_base.{m}") * 100.0)

    return rows.select(
        "method",
        diff("accuracy").alias("accuracy_difference"),
        diff("macro_f1").alias("macro_f1_difference"),
        pct("accuracy").alias("accuracy_improvement_pct"),
        pct("macro_f1").alias("macro_f1_improvement_pct"),
    )
