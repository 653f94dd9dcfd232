"""Metrics over one prediction table.

A prediction table is ``id, label, predicted_class, predicted_label, confidence``, and
``member`` where several models are compared. Predict once; everything here aggregates.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolsift.functions.columns import label_code, present, uncertainty
from poolsift.operators.sampling import kfold, label_table, stratified_kfold

# Error share cut-off, example text length, report lengths.
HIGH_CONFIDENCE = 0.8
EXAMPLE_CHARS = 200
TOP_PAIRS = 10
EXAMPLE_PAIRS = 5


def is_correct() -> Column:
    """Label text against predicted label text; a missing side is wrong."""
    return F.coalesce(F.col("label") == F.col("predicted_label"), F.lit(False))


def _share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def accuracy(pred: DataFrame) -> DataFrame:
    """Share of correct rows among those with a text and a label; null for none."""
    kept = pred.filter(present("description") & present("label"))
    return kept.agg(_share(is_correct()).alias("accuracy"), F.count("*").alias("total"))


def evaluate_rows(pred: DataFrame, label_col: str = "label") -> DataFrame:
    """Adds ``is_correct``. If every true label is a whole number, codes are compared, else texts."""
    number = F.trim(F.col(label_col).cast("string")).try_cast("double")
    whole = F.coalesce(number == F.floor(number), F.lit(False))
    all_whole = pred.agg(F.min(whole)).scalar()
    same_code = F.coalesce(number.cast("long") == F.col("predicted_class"), F.lit(False))
    same_text = F.coalesce(F.col(label_col).cast("string") == F.col("predicted_label"), F.lit(False))
    return pred.withColumn("_codes", all_whole).withColumn(
        "is_correct", F.when(F.col("_codes"), same_code).otherwise(same_text)
    ).drop("_codes")


def evaluate_summary(rows: DataFrame) -> DataFrame:
    """Totals of :func:`evaluate_rows`; the deviation is the sample one."""
    correct = F.col("is_correct")
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(correct).alias("correct"),
        _share(correct).alias("accuracy"),
        F.avg("confidence").alias("mean_confidence"),
        F.stddev_samp("confidence").alias("confidence_std"),
    )


def per_class_accuracy(pred: DataFrame) -> DataFrame:
    return pred.groupBy("label").agg(_share(is_correct()).alias("accuracy"), F.count("*").alias("total"))


def class_report(pred: DataFrame, labels) -> DataFrame:
    """Precision, recall, F1 and support over the fixed label space; 0 where undefined.

    One pass counts (true, predicted) pairs; the rest works on those few rows.
    """
    pairs = (
        pred.select(label_code("label", labels).alias("t"), F.col("predicted_class").alias("p"))
        .filter(F.col("t").isNotNull())
        .groupBy("t", "p")
        .agg(F.count("*").alias("n"))
    )
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    true_side = pairs.groupBy(F.col("t").alias("code")).agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    predicted_side = pairs.groupBy(F.col("p").alias("code")).agg(F.sum("n").alias("predicted"))
    joined = (
        label_table(pred.sparkSession, labels)
        .join(true_side, "code", "left")
        .join(predicted_side, "code", "left")
        .na.fill(0, ["support", "hits", "predicted"])
    )
    precision = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    scored = joined.select("label", "support", precision.alias("_p"), recall.alias("_r"))
    both = F.col("_p") + F.col("_r")
    f1 = F.when(both > 0, 2.0 * F.col("_p") * F.col("_r") / both).otherwise(0.0)
    return scored.select(
        "label",
        F.col("_p").alias("precision"),
        F.col("_r").alias("recall"),
        f1.alias("f1"),
        F.col("support").cast("long").alias("support"),
    )


def macro_f1(pred: DataFrame, labels) -> DataFrame:
    return class_report(pred, labels).agg(F.avg("f1").alias("macro_f1"))


def recall_map(pred: DataFrame, labels) -> DataFrame:
    """One map ``recall_<label in lower case>`` -> recall, ready for the results log."""
    entry = F.struct(F.concat(F.lit("recall_"), F.lower("label")).alias("key"), F.col("recall").alias("value"))
    return class_report(pred, labels).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("recalls")
    )


def pool_mean_uncertainty(pool: DataFrame) -> DataFrame:
    return pool.agg(F.avg("uncertainty_score").alias("avg_uncertainty_pool"))


def batch_mean_uncertainty(selected: DataFrame, rescored: DataFrame | None = None) -> DataFrame:
    """Mean score of a batch: the stored scores if there are any, else those of ``rescored``."""
    stored = F.avg("uncertainty_score")
    if rescored is None:
        return selected.agg(stored.alias("selected_samples_avg_uncertainty"))
    fresh = rescored.join(selected.select("id"), "id", "left_semi").agg(F.avg("uncertainty_score")).scalar()
    return selected.agg(stored.alias("_stored")).select(
        F.coalesce("_stored", fresh).alias("selected_samples_avg_uncertainty")
    )


def test_mean_uncertainty(pred: DataFrame) -> DataFrame:
    return pred.agg(F.avg(uncertainty("probs")).alias("avg_uncertainty"))


# --- folds and models ----------------------------------------------------------------


def cross_validate(pred: DataFrame, k: int = 5, seed=42, stratified: bool = True) -> DataFrame:
    """Accuracy, size and mean confidence per fold of one prediction table; nothing is retrained."""
    narrow = pred.select("id", "label", "predicted_label", "confidence")
    folds = stratified_kfold(narrow, k, seed) if stratified else kfold(narrow, k, seed)
    return folds.groupBy("fold").agg(
        _share(is_correct()).alias("accuracy"),
        F.count("*").alias("test_size"),
        F.avg("confidence").alias("mean_confidence"),
    )


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation over the folds."""
    return folds.agg(
        F.avg("accuracy").alias("mean_accuracy"),
        F.stddev_pop("accuracy").alias("std_accuracy"),
    )


def compare_models(pred: DataFrame) -> DataFrame:
    """Per member accuracy and confidence, best first; the window sees one row per model."""
    per_model = pred.groupBy("member").agg(
        _share(is_correct()).alias("accuracy"),
        F.count_if(is_correct()).alias("correct"),
        F.count("*").alias("total"),
        F.avg("confidence").alias("mean_confidence"),
        F.stddev_pop("confidence").alias("confidence_std"),
    )
    best_first = Window.orderBy(F.desc("accuracy"))
    return per_model.withColumn("rank", F.rank().over(best_first).cast("long"))


def compare_models_by_class(pred: DataFrame) -> DataFrame:
    return pred.groupBy("member", "label").agg(
        _share(is_correct()).alias("accuracy"), F.count("*").alias("total")
    )


# --- errors --------------------------------------------------------------------------


def error_rows(pred: DataFrame) -> DataFrame:
    return pred.filter(~is_correct())


def errors_by_true(pred: DataFrame) -> DataFrame:
    wrong = ~is_correct()
    return pred.groupBy("label").agg(
        F.count("*").alias("total"),
        F.count_if(wrong).alias("errors"),
        _share(wrong).alias("error_rate"),
        _share(is_correct()).alias("accuracy"),
    )


def errors_by_predicted(pred: DataFrame) -> DataFrame:
    """Errors per predicted label and their share of all errors."""
    errors = error_rows(pred)
    counts = errors.groupBy("predicted_label").agg(F.count("*").alias("errors"))
    everything = Window.partitionBy()
    share = F.col("errors") / F.sum("errors").over(everything)
    return counts.select("predicted_label", "errors", share.alias("error_share"))


def confusion_pairs(pred: DataFrame) -> DataFrame:
    return error_rows(pred).groupBy("label", "predicted_label").agg(F.count("*").alias("errors"))


def _top_pairs(pairs: DataFrame, n: int) -> DataFrame:
    return pairs.orderBy(F.desc("errors"), "label", "predicted_label").limit(n)


def confusion_top(pred: DataFrame, n: int = TOP_PAIRS) -> DataFrame:
    """The most frequent (true, predicted) error pairs."""
    return _top_pairs(confusion_pairs(pred), n)


def confidence_by_outcome(pred: DataFrame) -> DataFrame:
    return pred.groupBy(is_correct().alias("is_correct")).agg(
        F.avg("confidence").alias("mean"),
        F.stddev_pop("confidence").alias("std"),
        F.min("confidence").alias("min"),
        F.max("confidence").alias("max"),
    )


def high_conf_errors(pred: DataFrame, threshold: float = HIGH_CONFIDENCE) -> DataFrame:
    return error_rows(pred).filter(F.col("confidence") >= threshold)


def error_examples(pred: DataFrame, n: int = EXAMPLE_PAIRS) -> DataFrame:
    """The lowest-id error of each of the most frequent pairs, its text cut for display.

    Count and example come from one aggregate, so no pair is gathered in one task.
    """
    text = F.col("description")
    shown = F.when(F.length(text) > EXAMPLE_CHARS, F.concat(F.substring(text, 1, EXAMPLE_CHARS), F.lit("...")))
    first = F.min_by(F.struct("id", "confidence", F.coalesce(shown, text).alias("text")), "id")
    pairs = (
        error_rows(pred)
        .groupBy("label", "predicted_label")
        .agg(F.count("*").alias("errors"), first.alias("_example"))
    )
    return _top_pairs(pairs, n).select(
        "label",
        "predicted_label",
        F.col("errors").alias("pattern_count"),
        F.col("_example.id").alias("id"),
        F.col("_example.confidence").alias("confidence"),
        F.col("_example.text").alias("text"),
    )


def evaluation_summary(pred: DataFrame, main_member=0, k: int = 5, seed=42) -> DataFrame:
    """One row over all parts: accuracy and error rate of one model, its folds, the best model."""
    mine = pred.filter(F.col("member") == main_member)
    folds = cv_summary(cross_validate(mine, k, seed))
    models = compare_models(pred)
    best = models.agg(F.min_by("member", F.struct("rank", "member"))).scalar()
    return mine.agg(
        _share(is_correct()).alias("accuracy"),
        _share(~is_correct()).alias("error_rate"),
    ).select(
        "accuracy",
        "error_rate",
        best.cast("long").alias("best_model"),
        folds.select("mean_accuracy").scalar().alias("cv_mean_accuracy"),
        folds.select("std_accuracy").scalar().alias("cv_std_accuracy"),
    )
