"""Is a method better than the baseline, and how sure is that?

Rows pair by their position within the method, up to the shorter length. Positions are
bucketed and the pairs meet by an equi-join on the position, so one method holding most
of the log is spread like any other. Rows without a macro-F1 take no position.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolsift.functions.columns import significance_stars
from poolsift.functions.ranking import positions
from poolsift.functions.tails import f_tail, t_tail
from poolsift.operators.runs import drop_base_rows, extract_metric
from poolsift.session import pin

# Names of the baseline in order of preference, share of the best value aimed at.
BASELINES = ["random_sampling", "random"]
TARGET_SHARE = 0.95


def scored_rows(results: DataFrame) -> DataFrame:
    """The narrow rows all comparisons start from, written once: JSON is read a single time."""
    rows = extract_metric(drop_base_rows(results).filter(F.col("method").isNotNull()), ["macro_f1"])
    narrow = rows.select("id", "method", "iteration_no", "train_data_size", "macro_f1")
    return pin(narrow, "scored").filter(F.col("macro_f1").isNotNull())


def baseline_name(rows: DataFrame) -> Column:
    """The preferred baseline name among the methods, null without one."""
    found = [F.max(F.when(F.col("method") == b, F.col("method"))) for b in BASELINES]
    return rows.agg(F.coalesce(*found)).scalar()


def paired(rows: DataFrame) -> DataFrame:
    """``method, position, f1, base_f1``."""
    base = baseline_name(rows)
    placed = positions(rows.select("id", "method", "macro_f1"), "id", ["method"]).withColumn("_base", base)
    mine = placed.filter(F.col("method") != F.col("_base"))
    theirs = placed.filter(F.col("method") == F.col("_base"))
    return mine.select("method", "position", F.col("macro_f1").alias("f1")).join(
        theirs.select("position", F.col("macro_f1").alias("base_f1")), "position"
    )


def _safe(c: Column, positive: Column) -> Column:
    return F.when(positive, c).otherwise(0.0)


def pair_statistics(rows: DataFrame) -> DataFrame:
    """Everything about the pairs of a method in one aggregate."""
    diff = F.col("f1") - F.col("base_f1")
    sums = paired(rows).groupBy("method").agg(
        F.count("*").alias("pairs"),
        F.avg(diff).alias("mean_diff"),
        F.stddev_samp(diff).alias("_sd"),
        F.var_samp("f1").alias("_var"),
        F.var_samp("base_f1").alias("_base_var"),
        F.avg("base_f1").alias("_base_mean"),
        F.max_by("f1", "position").alias("method_final_f1"),
        F.max_by("base_f1", "position").alias("random_final_f1"),
    )
    pooled = F.sqrt((F.col("_var") + F.col("_base_var")) / 2)
    return sums.withColumn("_pooled", pooled).select(
        "method",
        "pairs",
        "mean_diff",
        _safe(F.col("mean_diff") / F.col("_base_mean") * 100.0, F.col("_base_mean") > 0).alias("mean_diff_pct"),
        F.when(F.col("_sd") > 0, F.col("mean_diff") / (F.col("_sd") / F.sqrt("pairs"))).alias("t_statistic"),
        _safe(F.col("mean_diff") / F.col("_pooled"), F.col("_pooled") > 0).alias("cohens_d"),
        "method_final_f1",
        "random_final_f1",
    )


def _with_p(stats: DataFrame) -> DataFrame:
    return stats.withColumn("p_value", t_tail(F.col("t_statistic"), F.col("pairs") - 1))


def paired_t_test(results: DataFrame) -> DataFrame:
    stats = _with_p(pair_statistics(scored_rows(results)))
    return stats.select("method", "pairs", "t_statistic", "p_value", "mean_diff", "mean_diff_pct")


def cohens_d(results: DataFrame) -> DataFrame:
    """Mean difference over the pooled deviation, 0 without spread."""
    return pair_statistics(scored_rows(results)).select(
        "method", "cohens_d", "mean_diff", "mean_diff_pct", "method_final_f1", "random_final_f1"
    )


def performance_table(results: DataFrame) -> DataFrame:
    stats = _with_p(pair_statistics(scored_rows(results)))
    return stats.select(
        "method", "mean_diff", "mean_diff_pct", "p_value", "cohens_d", significance_stars("p_value").alias("stars")
    )


def anova_methods(results: DataFrame) -> DataFrame:
    """One-way F over the methods with more than one row; empty for fewer than two of them."""
    groups = (
        scored_rows(results)
        .groupBy("method")
        .agg(F.count("*").alias("n"), F.avg("macro_f1").alias("mean"), F.var_samp("macro_f1").alias("var"))
        .filter(F.col("n") > 1)
    )
    everyone = Window.partitionBy()  # one row per method
    grand = F.sum(F.col("n") * F.col("mean")).over(everyone) / F.sum("n").over(everyone)
    sums = groups.withColumn("_grand", grand).agg(
        F.count("*").alias("n_methods"),
        F.sum("n").alias("_rows"),
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("_grand"), F.lit(2.0))).alias("_between"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("_within"),
    )
    d1, d2 = F.col("n_methods") - 1, F.col("_rows") - F.col("n_methods")
    ratio = F.when(F.col("_within") > 0, (F.col("_between") / d1) / (F.col("_within") / d2))
    return (
        sums.filter(F.col("n_methods") >= 2)
        .withColumn("f_statistic", ratio)
        .select("n_methods", "f_statistic", f_tail(F.col("f_statistic"), d1, d2).alias("p_value"))
    )


def iterations_to_target(results: DataFrame) -> DataFrame:
    """First iteration at 95 % of the best macro-F1, and the reduction against the baseline.

    Only methods that get there, and nothing unless the baseline does. The ratio to
    iteration 0 is null.
    """
    rows = scored_rows(results)
    best = rows.agg(F.max("macro_f1")).scalar()
    base = baseline_name(rows)
    reached = (
        rows.withColumn("_best", best)
        .filter(F.col("macro_f1") >= F.col("_best") * TARGET_SHARE)
        .groupBy("method")
        .agg(F.min_by("iteration_no", "id").alias("target_iter"))
    )
    base_iter = reached.filter(F.col("method") == base).agg(F.max("target_iter")).scalar()
    both = reached.withColumn("random_iter", base_iter).filter(F.col("random_iter").isNotNull())
    mine, theirs = F.col("target_iter"), F.col("random_iter")
    return both.select(
        "method",
        mine.cast("long").alias("target_iter"),
        theirs.cast("long").alias("random_iter"),
        F.when(theirs > 0, (theirs - mine) / theirs * 100.0).alias("iteration_reduction_pct"),
        F.when(mine > 0, theirs / mine).alias("efficiency_ratio"),
    )
