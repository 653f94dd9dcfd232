"""Shaping a results log: metrics as columns, runs, series.

A log may hold one run or millions, and one run may hold most rows. Runs are numbered
by a running sum over the log id, and everything per run is an aggregate.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolsift.functions.columns import is_base, metrics_named, parse_metrics
from poolsift.functions.ranking import running
from poolsift.session import pin

# Display names of methods, size from which a random run counts as full labelling.
METHOD_TITLES = {
    "uncertainty_sampling": "Uncertainty Sampling",
    "diversity_sampling": "Diversity Sampling",
    "query_by_comitee": "Query by Committee",
    "random_sampling": "Random Sampling",
}
FULL_SIZE = 10_000
FULL_TITLE = "Full Size Labelling"
# Fixed value: labels per iteration where the log does not say.
LABELS_PER_ITERATION = 1000


def extract_metric(results: DataFrame, keys) -> DataFrame:
    """The named metrics as double columns, null where missing."""
    found = results.select("*", metrics_named("metrics", keys).alias("_m"))
    return found.select(*results.columns, *[F.col("_m")[k].alias(k) for k in keys])


def prepare_log(results: DataFrame, keys) -> DataFrame:
    """The log with ``run`` and the metrics as columns, written once: stop rules read it several times."""
    # the JSON is read where the rows lie, and only narrow rows are numbered
    return pin(split_runs(extract_metric(results, keys).drop("metrics", "params")), "log")


def drop_base_rows(results: DataFrame) -> DataFrame:
    return results.filter(~is_base("method"))


def labels_used() -> Column:
    return F.coalesce(F.col("train_data_size"), F.col("iteration_no") * LABELS_PER_ITERATION).cast("long")


def starts_run() -> Column:
    """Iteration 0, or a row logged for the model before any selection."""
    zero = F.coalesce(F.col("iteration_no") == 0, F.lit(False))
    base = F.coalesce((F.upper("method") == "BASE") | (F.col("method") == "base_classifier"), F.lit(False))
    noted = F.coalesce(F.col("notes") == "base_classifier", F.lit(False))
    return zero | base | noted


def split_runs(results: DataFrame) -> DataFrame:
    """Adds ``run``, counted from 1 in id order; the first row always opens run 1."""
    first = results.agg(F.min("id")).scalar()
    flags = results.select("id", starts_run().alias("_starts")).withColumn("_first", first)
    opens = (F.col("_starts") | (F.col("id") == F.col("_first"))).cast("long")
    numbers = running(flags, "id", {"run": (opens, "sum")}).select("id", "run")
    return results.join(numbers, "id").select(*results.columns, "run")  # only (id, flag) is ordered


def _named_method() -> Column:
    name = F.trim("method")
    return F.when((F.upper(name) != "BASE") & (name != "base_classifier") & (name != ""), name)


def run_method(runs: DataFrame) -> DataFrame:
    """``run, method``: the first real method of a run, ``unknown`` without one."""
    name = _named_method()
    first = F.min_by(name, F.when(name.isNotNull(), F.col("id")))
    return runs.groupBy("run").agg(F.coalesce(first, F.lit("unknown")).alias("method"))


def run_header(runs: DataFrame) -> DataFrame:
    """Per run the last known pool size, train size and batch size, and the note of its last row."""

    def last(c):
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("id")))

    batch = F.get_json_object(last("params"), "$.N").try_cast("long")
    return runs.groupBy("run").agg(
        last("data_size").alias("pool_size"),
        last("train_data_size").alias("train_data_size"),
        F.coalesce(last("n"), batch).alias("n"),
        F.max_by("notes", "id").alias("stop_reason"),
    )


def _entries(runs: DataFrame) -> DataFrame:
    exploded = runs.select("run", "iteration_no", F.explode(parse_metrics("metrics")).alias("metric", "value"))
    return exploded.filter(F.col("value").isNotNull())


def metric_series(runs: DataFrame, accuracy_percent: bool = False) -> DataFrame:
    """``run, iteration_no, metric, value`` of everything but the class recalls.

    Rows without a value are left out, so a metric nobody logged in a run has no series.
    """
    rows = _entries(runs).filter(~F.col("metric").startswith("recall_"))
    if accuracy_percent:
        value = F.when(F.col("metric") == "accuracy", F.col("value") * 100.0).otherwise(F.col("value"))
        rows = rows.withColumn("value", value)
    return rows


def recall_series(runs: DataFrame) -> DataFrame:
    """``run, iteration_no, class_name, value`` of the class recalls."""
    rows = _entries(runs).filter(F.col("metric").startswith("recall_"))
    words = F.replace(F.replace("metric", F.lit("recall_"), F.lit("")), F.lit("_"), F.lit(" "))
    title = F.array_join(F.transform(F.split(words, "-"), F.initcap), "-")
    return rows.select("run", "iteration_no", title.alias("class_name"), "value")


def series_label(runs: DataFrame) -> DataFrame:
    """``run, title``: display name of a run's method. A last, large random run is the full labelling."""
    name = _named_method()
    per_run = runs.groupBy("run").agg(
        F.coalesce(F.min_by(name, F.when(name.isNotNull(), F.col("id"))), F.lit("unknown")).alias("_method"),
        F.max("train_data_size").alias("_size"),
    )
    last = runs.agg(F.max("run")).scalar()
    titles = F.create_map(*[F.lit(x) for pair in METHOD_TITLES.items() for x in pair])
    full = (F.col("run") == F.col("_last")) & (F.col("_method") == "random_sampling") & (F.col("_size") >= FULL_SIZE)
    title = F.when(full, FULL_TITLE).otherwise(F.coalesce(F.try_element_at(titles, F.col("_method")), F.col("_method")))
    return per_run.withColumn("_last", last).select("run", title.alias("title"))
