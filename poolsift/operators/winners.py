"""Which method wins, by which metric, and by how much over random sampling."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolsift.functions.columns import is_random
from poolsift.operators.runs import drop_base_rows, extract_metric, labels_used
from poolsift.session import pin

# Minority class recalls, compared metrics, share aimed at, label counts assumed if unknown.
MINORITY = ["recall_contract", "recall_internship", "recall_volunteer", "recall_temporary"]
COMPARED = ["final_f1", "final_accuracy", "avg_minority_recall"]
TARGET_SHARE = 0.95
RANDOM_LABELS, METHOD_LABELS = 10_000, 3_000


def _valid(results: DataFrame, keys) -> DataFrame:
    return extract_metric(drop_base_rows(results).filter(F.col("method").isNotNull()), keys)


def _best_row(rows: DataFrame, score: str, fields) -> DataFrame:
    """Per method the row with the highest score (the earliest of equals) and the method's first id."""
    # rows without a score are passed over here; as a filter the JSON would be read twice
    scored = F.col(score).isNotNull()
    best = F.max_by(F.struct(*fields), F.when(scored, F.struct(F.col(score), -F.col("id"))))
    first = F.min(F.when(scored, F.col("id")))
    found = rows.groupBy("method").agg(first.alias("first_id"), best.alias("_b")).filter(F.col("first_id").isNotNull())
    return found.select("method", "first_id", "_b.*")


# --- combined score ------------------------------------------------------------------


def _combined(results: DataFrame) -> DataFrame:
    rows = _valid(results, ["macro_f1", "accuracy"])
    return rows.withColumn("combined_score", (F.col("macro_f1") + F.col("accuracy")) / 2.0).withColumn(
        "labels", labels_used()
    )


def best_by_combined(results: DataFrame) -> DataFrame:
    """Per method its row with the highest mean of macro-F1 and accuracy."""
    return _best_row(
        _combined(results),
        "combined_score",
        [
            F.col("macro_f1").alias("final_f1"),
            F.col("accuracy").alias("final_accuracy"),
            F.col("iteration_no").cast("long").alias("final_iteration"),
            F.col("labels").alias("final_labels"),
            "combined_score",
        ],
    )


def objectives(results: DataFrame) -> DataFrame:
    """The best other method against the random baseline, one row; empty without either."""
    rows = _combined(results)
    finals = pin(best_by_combined(results), "best")  # one row per method
    whole = F.struct("method", "final_f1", "final_accuracy", "final_labels", "combined_score")
    best = finals.filter(~is_random("method")).agg(
        F.max_by(whole, F.struct(F.col("combined_score"), -F.col("first_id")))
    )
    base = finals.filter(is_random("method")).agg(F.min_by(whole, "first_id"))
    sided = rows.withColumn("_b", best.scalar()).withColumn("_r", base.scalar())

    def first_at(side: str, other: str) -> Column:
        there = (F.col("method") == F.col(f"{side}.method")) & (
            F.col("combined_score") >= F.col(f"{other}.combined_score") * TARGET_SHARE
        )
        return F.min_by("labels", F.when(there, F.struct("iteration_no", "id")))

    needed = sided.agg(
        F.first("_b", ignorenulls=True).alias("_b"),
        F.first("_r", ignorenulls=True).alias("_r"),
        first_at("_b", "_r").alias("_best_needs"),
        first_at("_r", "_b").alias("_random_needs"),
    ).filter(F.col("_b").isNotNull() & F.col("_r").isNotNull())
    b, r = (lambda c: F.col(f"_b.{c}")), (lambda c: F.col(f"_r.{c}"))
    best_needs = F.coalesce("_best_needs", b("final_labels"))
    random_needs = F.coalesce("_random_needs", r("final_labels"))

    def pct(top, bottom):
        return F.when(bottom > 0, top / bottom * 100.0).otherwise(0.0)

    return needed.select(
        b("method").alias("best_method"),
        r("method").alias("random_method"),
        b("final_f1").alias("best_final_f1"),
        b("final_accuracy").alias("best_final_accuracy"),
        b("combined_score").alias("best_combined_score"),
        r("final_f1").alias("random_final_f1"),
        r("final_accuracy").alias("random_final_accuracy"),
        r("combined_score").alias("random_combined_score"),
        pct(b("combined_score") - r("combined_score"), r("combined_score")).alias("performance_difference_pct"),
        best_needs.alias("data_for_target"),
        r("final_labels").alias("random_final_labels"),
        pct(r("final_labels") - best_needs, r("final_labels")).alias("data_savings_pct"),
        random_needs.alias("data_for_random_target"),
        b("final_labels").alias("best_final_labels"),
        F.when(b("final_labels") > 0, random_needs / b("final_labels")).otherwise(1.0).alias("data_ratio"),
    )


# --- best macro-F1 -------------------------------------------------------------------


def best_by_f1(results: DataFrame) -> DataFrame:
    """Per method its row with the highest macro-F1, all metrics, and the mean of the minority recalls."""
    signals = ["avg_uncertainty_pool", "selected_samples_avg_uncertainty"]
    rows = _valid(results, ["macro_f1", "accuracy", *signals, *MINORITY]).withColumn("labels", labels_used())
    best = _best_row(
        rows,
        "macro_f1",
        [
            F.col("macro_f1").alias("final_f1"),
            F.col("accuracy").alias("final_accuracy"),
            F.col("labels").alias("final_labels"),
            *signals,
            *MINORITY,
        ],
    )
    known = F.filter(F.array(*MINORITY), lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x)
    mean = F.when(F.size(known) > 0, total / F.size(known)).otherwise(0.0)
    return best.withColumn("avg_minority_recall", mean)


def _long(best: DataFrame, names, key: str) -> DataFrame:
    cells = [F.struct(F.lit(m).alias(key), F.col(m).alias("value")) for m in names]
    carried = best.select("method", "first_id", "final_labels", F.explode(F.array(*cells)).alias("_c"))
    return carried.select("method", "first_id", "final_labels", "_c.*")


def _baseline(best: DataFrame, fields) -> Column:
    return best.filter(is_random("method")).agg(F.min_by(F.struct(*fields), "first_id")).scalar()


def method_extremes(best: DataFrame) -> DataFrame:
    """Best and worst non-baseline method per metric; the method seen first wins ties."""
    long = _long(best.filter(~is_random("method")), COMPARED, "metric").filter(F.col("value").isNotNull())
    pair = F.struct("method", "value")
    return (
        long.groupBy("metric")
        .agg(
            F.max_by(pair, F.struct(F.col("value"), -F.col("first_id"))).alias("_top"),
            F.min_by(pair, F.struct("value", "first_id")).alias("_low"),
        )
        .select(
            "metric",
            F.col("_top.method").alias("best_method"),
            F.col("_top.value").alias("best_value"),
            F.col("_low.method").alias("worst_method"),
            F.col("_low.value").alias("worst_value"),
        )
    )


def best_vs_random(best: DataFrame) -> DataFrame:
    """Per metric the method with the largest positive gain over the baseline, nulls if none gains."""
    best = pin(best, "best")  # one row per method
    base = _baseline(best, ["final_labels", *COMPARED])
    long = _long(best.filter(~is_random("method")), COMPARED, "metric").withColumn("_r", base)
    base_value = F.coalesce(*[F.when(F.col("metric") == m, F.col(f"_r.{m}")) for m in COMPARED])
    gains = long.filter(F.col("_r").isNotNull()).withColumn("random_value", base_value)
    pct = F.when(F.col("random_value") > 0, (F.col("value") - F.col("random_value")) / F.col("random_value") * 100.0)
    gains = gains.withColumn("_pct", F.coalesce(pct, F.lit(0.0)))
    ahead = F.when(F.col("_pct") > 0, F.struct(F.col("_pct"), -F.col("first_id")))
    top = gains.groupBy("metric").agg(
        F.max("random_value").alias("random_value"),
        F.max("_r.final_labels").alias("_base_labels"),
        F.max_by(F.struct("method", "value", "_pct", "final_labels"), ahead).alias("_t"),
    )
    base_labels = F.coalesce(F.nullif("_base_labels", F.lit(0)), F.lit(RANDOM_LABELS))
    labels = F.coalesce(F.nullif(F.col("_t.final_labels"), F.lit(0)), F.lit(METHOD_LABELS))
    return top.select(
        "metric",
        "random_value",
        F.col("_t.method").alias("best_method"),
        F.col("_t.value").alias("best_value"),
        F.col("_t._pct").alias("improvement_pct"),
        F.when(F.col("_t").isNotNull(), base_labels / labels).alias("label_ratio"),
    )


def minority_vs_random(best: DataFrame) -> DataFrame:
    """Per minority class the largest gain in recall over the baseline; a missing recall counts 0."""
    best = pin(best, "best")  # one row per method
    base = _baseline(best, MINORITY)
    long = _long(best.filter(~is_random("method")), MINORITY, "class_recall").withColumn("_r", base)
    base_value = F.coalesce(
        *[F.when(F.col("class_recall") == m, F.col(f"_r.{m}")) for m in MINORITY], F.lit(0.0)
    )
    gains = (
        long.filter(F.col("_r").isNotNull())
        .withColumn("random_value", base_value)
        .withColumn("_gain", F.coalesce("value", F.lit(0.0)) - F.col("random_value"))
    )
    ahead = F.when(F.col("_gain") > 0, F.struct(F.col("_gain"), -F.col("first_id")))
    top = gains.groupBy("class_recall").agg(
        F.max("random_value").alias("random_value"),
        F.max_by(F.struct("method", "value", "_gain"), ahead).alias("_t"),
    )
    gain = F.coalesce(F.col("_t._gain"), F.lit(0.0))
    return top.select(
        "class_recall",
        "random_value",
        F.col("_t.method").alias("best_method"),
        F.coalesce("_t.value", F.lit(0.0)).alias("best_value"),
        gain.alias("improvement"),
        F.when(F.col("random_value") > 0, gain / F.col("random_value") * 100.0).otherwise(0.0).alias("improvement_pct"),
    )


def overall_winner(best: DataFrame) -> DataFrame:
    """The non-baseline method with the highest mean of the compared metrics, and where it leads."""
    best = pin(best, "best")  # one row per method
    mean = (F.col("final_accuracy") + F.col("final_f1") + F.col("avg_minority_recall")) / 3.0
    scored = best.filter(~is_random("method")).withColumn("score", mean).filter(F.col("score") > 0)
    winner = scored.agg(
        F.max_by(F.struct("method", "score"), F.struct(F.col("score"), -F.col("first_id"))).alias("_w")
    ).filter(F.col("_w").isNotNull())
    leads = method_extremes(best).agg(F.map_from_entries(F.collect_list(F.struct("metric", "best_method")))).scalar()
    flags = [(F.col("_w.method") == F.try_element_at("_leads", F.lit(m))).alias(f"leads_{m}") for m in COMPARED]
    return winner.withColumn("_leads", leads).select(
        F.col("_w.method").alias("method"), F.col("_w.score").alias("score"), *flags
    )
