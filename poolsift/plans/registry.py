"""Every operator as a query over the driver tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsift.functions import columns as c
from poolsift.operators import (
    curves,
    efficiency,
    evaluation,
    pool,
    runs,
    sampling,
    scoring,
    selection,
    significance,
    similarity,
    stopping,
    winners,
)
from poolsift.operators.store import PoolStore
from poolsift.plans.fixtures import LABELS, Tables
from poolsift.plans.loop import LoopParams, active_learning_loop
from poolsift.session import fresh_path, pin
from poolsift.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def tidy(df: DataFrame) -> DataFrame:
    """One numeric form for comparison: long integers, doubles with six decimals."""
    out = []
    for f in df.schema.fields:
        col = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            col = c.rounded(col.cast("double"))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            col = col.cast("long")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.DoubleType):
            col = F.transform(col, lambda x: c.rounded(x))
        out.append(col.alias(f.name))
    return df.select(*out)


def query(fn):
    """Register ``fn(tables)`` under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(fn(Tables(spark, sf_dir)))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


# --- sources and sinks ---------------------------------------------------------------


@query
def read_postings_csv(t):
    path = fresh_path(t.spark, "postings.csv")
    files.write_csv(t.postings, path)
    return files.read_postings_csv(t.spark, path)


@query
def read_results(t):
    """A tab-separated log with shuffled, missing and further columns, read by name."""
    path = fresh_path(t.spark, "results.tsv")
    stamp = F.lit("2024-05-06 07:08:09")
    log = t.results.drop("t", "run_by").withColumns({"created_at": stamp, "host": F.concat(F.lit("h"), F.col("id"))})
    files.write_csv(log.select(*reversed(log.columns)), path, sep="\t")
    return files.read_results(t.spark, path).withColumn("created_at", F.year("created_at"))


@query
def read_results_unnamed(t):
    """The same from a file without a known extension, comma-separated."""
    path = fresh_path(t.spark, "results.log")
    files.write_csv(t.results.select("notes", "method", "id", "metrics"), path)
    return files.read_results(t.spark, path).select("id", "method", "metrics", "notes", "train_data_size")


@query
def read_jsonl(t):
    """Events' JSON text as a line file: ``error`` lines are broken, ``signup`` lines have a text for a number."""
    path = fresh_path(t.spark, "props.jsonl")
    broken = F.when(F.col("event_type") == "error", F.concat(F.lit("{"), F.col("props")))
    line = broken.when(F.col("event_type") == "signup", F.lit('{"k": "none"}')).otherwise(F.col("props"))
    t.raw("events").select(line.alias("value")).write.text(path)
    return files.read_jsonl(t.spark, path, "k long")


@query
def read_jsonl_keys(t):
    """Without a schema: the first object's keys, all text."""
    path = fresh_path(t.spark, "props.jsonl")
    t.raw("events").select(F.col("props").alias("value")).write.text(path)
    return files.read_jsonl(t.spark, path)


@query
def head_rows(t):
    return files.head_rows(t.rows, 100, "id")


@query
def write_table_csv(t):
    """The three snapshots, read back and counted."""
    test, rest = pool.split_test(t.pool, 0.2)
    paths = files.write_table_csv(rest, test.drop("moved_at"), t.results, fresh_path(t.spark, "snapshot"))
    pool_ddl = "id long, description string, is_labelled boolean, label string, model_prediction string, uncertainty_score double"
    parts = []
    for name in ("pool", "test_data"):
        back = files.read_results(t.spark, paths[name], pool_ddl, multi_line=True)
        parts.append(
            back.agg(
                F.lit(name).alias("name"),
                F.count("*").alias("rows"),
                F.sum("id").alias("ids"),
                F.sum(F.length("description")).alias("chars"),
                F.sum("uncertainty_score").alias("score"),
            )
        )
    back = files.read_results(t.spark, paths["results"])
    parts.append(
        back.agg(
            F.lit("results").alias("name"),
            F.count("*").alias("rows"),
            F.sum("id").alias("ids"),
            F.sum(F.length("metrics")).alias("chars"),
            F.sum("train_data_size").cast("double").alias("score"),
        )
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def write_json(t):
    path = fresh_path(t.spark, "report.json")
    files.write_json(tidy(evaluation.compare_models(t.predictions)), path)
    schema = "member long, accuracy double, correct long, total long, mean_confidence double, confidence_std double, rank long"
    return files.read_jsonl(t.spark, path, schema)


@query
def pool_from_postings(t):
    return files.pool_from_postings(t.postings).select("id", "description", "is_labelled", "label")


@query
def results_append(t):
    row = {
        "test_id": "99",
        "iteration_no": 1,
        "model_name": "textmodel",
        "train_data_size": 100,
        "method": "random_sampling",
        "metrics": {"accuracy": 0.5},
        "notes": "continue",
    }
    path = fresh_path(t.spark, "results.parquet")
    t.results.write.parquet(path)
    out = files.append_to_log(t.spark, path, row)
    return runs.extract_metric(out, ["accuracy"]).select("id", "test_id", "iteration_no", "method", "accuracy", "notes")


@query
def next_test_id(t):
    return files.next_test_id(t.results)


@query
def union_results(t):
    first = t.results.filter(c.is_base("method")).select("id", "method", "train_data_size")
    second = t.results.filter(~c.is_base("method")).select("id", "method", "iteration_no", "notes")
    return files.union_results(first, second)


# --- filters, projections, scalars ---------------------------------------------------


@query
def unlabelled_page(t):
    return pool.unlabelled_page(t.pool, 50, 25).select("id", "description", "is_labelled", "label")


@query
def unlabelled_with_labels(t):
    return pool.unlabelled_with_labels(t.pool).select("id", "description", "label")


@query
def labelled_rows(t):
    return pool.labelled_rows(t.pool).select("id", "description", "label")


@query
def test_page(t):
    test, _ = pool.split_test(t.pool, 0.2)
    return pool.test_page(test, 20, 10).select("id", "label", "is_labelled")


@query
def unlabelled_count(t):
    return pool.unlabelled_count(t.pool)


@query
def label_filter(t):
    return pool.label_filter(t.rows, ["de", "fr"]).select("id", "label")


@query
def label_rejects(t):
    return pool.label_rejects(t.rows, ["de", "fr"])


@query
def label_encode(t):
    return pool.label_encode(t.rows, ["de", "en", "fr"]).select("id", "label", "label_code")


@query
def label_decode(t):
    return pool.label_decode(t.embeddings, LABELS, "cluster", "name").select("id", "cluster", "name")


@query
def truncate_tokens(t):
    return t.rows.select("id", c.truncate_tokens("description").alias("text"))


@query
def normalize_probs(t):
    """Embeddings shifted to mostly non-negative; sums at or below zero give null."""
    part = F.transform("embedding", lambda x: x.cast("double") + 0.05)
    return t.embeddings.select("id", c.normalize_probs(part).alias("probs")).select(
        "id", F.col("probs").isNull().alias("missing"), F.explode_outer("probs").alias("p")
    )


@query
def softmax_predict(t):
    probs = c.softmax("embedding")
    return t.embeddings.select("id", probs.alias("probs")).select(
        "id",
        c.predicted_class("probs").alias("predicted_class"),
        c.confidence("probs").alias("confidence"),
        c.uncertainty("probs").alias("uncertainty"),
    )


@query
def entropy(t):
    return t.scores.select(
        "id", "member", c.entropy("probs").alias("entropy"), c.normalized_entropy("probs").alias("normalized")
    )


@query
def parse_metrics(t):
    return t.results.select("id", F.explode_outer(c.parse_metrics("metrics")).alias("key", "value"))


@query
def extract_metric(t):
    return runs.extract_metric(t.results, ["accuracy", "macro_f1", "recall_internship"]).select(
        "id", "accuracy", "macro_f1", "recall_internship"
    )


@query
def drop_base_rows(t):
    return runs.drop_base_rows(t.results).select("id", "method", "iteration_no")


@query
def normalize_model_name(t):
    return t.results.select("id", c.model_name("model_name").alias("model_name"))


@query
def significance_stars(t):
    return t.scores.select("id", "member", c.significance_stars(F.element_at("probs", 1)).alias("stars"))


# --- joins ---------------------------------------------------------------------------


@query
def fetch_selected(t):
    chosen = t.raw("labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return pool.fetch_selected(t.pool, chosen).select("id", "description", "label")


@query
def remaining_pool(t):
    moved = t.raw("labels").select(F.col("doc_id").alias("id"))
    return pool.remaining_pool(t.pool, moved).select("id", "label", "uncertainty_score")


@query
def committee_by_id(t):
    outputs = selection.committee_by_id(t.scores)
    return outputs.select("id", F.size("outputs").alias("members"), F.posexplode("outputs").alias("place", "o")).select(
        "id", "members", "place", "o.member", *[F.col("o.probs")[k].alias(f"p{k}") for k in range(4)]
    )


@query
def common_sizes(t):
    return curves.common_sizes(curves.learning_curve(t.results))


# --- labelling state -----------------------------------------------------------------


@query
def save_predictions(t):
    """Two members score every row; an id counts once, with its highest score."""
    new = t.scores.filter("member > 0").select(
        "id",
        c.predicted_class("probs").cast("string").alias("model_prediction"),
        c.rounded(c.uncertainty("probs")).alias("uncertainty_score"),
    )
    return pool.save_predictions(t.pool, new).select("id", "model_prediction", "uncertainty_score", "is_labelled")


@query
def apply_labels(t):
    """Quality as a label; quality 0 comes without one and must change nothing. Every id comes twice."""
    named = F.explode(F.array(F.lit("fine"), F.lit("good"))).alias("name")
    new = t.raw("labels").select(F.col("doc_id").alias("id"), "quality", named)
    new = new.select("id", F.when(F.col("quality") == 1, F.col("name")).alias("label"))
    hidden = t.pool.withColumn("is_labelled", F.lit(False))
    return pool.apply_labels(hidden, new).select("id", "is_labelled", "label")


@query
def mark_labelled(t):
    ids = t.embeddings.filter("cluster = 3")
    ids = ids.union(ids)
    return pool.mark_labelled(t.pool, ids).select("id", "is_labelled", "label")


def _stored_updates(t, compact: bool) -> DataFrame:
    """Predictions of members 1 and 2 together, labels from quality, flags, then member 0 again where toxic is 1."""
    store = PoolStore(t.pool.withColumn("is_labelled", F.lit(False)))
    scored = t.scores.select(
        "id",
        "member",
        c.predicted_class("probs").cast("string").alias("model_prediction"),
        c.rounded(c.uncertainty("probs")).alias("uncertainty_score"),
    )
    store.save_predictions(scored.filter("member > 0"))
    quality = t.raw("labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, F.lit("good")).alias("label"))
    store.apply_labels(quality)
    if compact:
        store.compact()
    store.mark_labelled(t.embeddings.filter("cluster = 3"))
    toxic = t.raw("labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    store.save_predictions(scored.filter("member = 0").join(toxic, "id", "left_semi"))
    if compact:
        store.compact()
    return store.read().select("id", "is_labelled", "label", "model_prediction", "uncertainty_score", F.length("description").alias("chars"))


@query
def store_updates(t):
    """Changes in order, latest first, folded when read."""
    return _stored_updates(t, compact=False)


@query
def store_compacted(t):
    """The same with changes compacted in between and at the end."""
    return _stored_updates(t, compact=True)


@query
def reset_pool(t):
    return pool.reset_pool(t.pool).select("id", "is_labelled", "label", "model_prediction", "uncertainty_score")


@query
def reset_counts(t):
    return pool.reset_counts(t.pool)


@query
def init_labelled(t):
    return pool.init_labelled(t.pool, 1000, 7).select("id", "is_labelled", "label")


@query
def split_test(t):
    test, _ = pool.split_test(t.pool, 0.2)
    return test.select("id", "description", "label", "is_labelled")


@query
def split_remaining(t):
    _, rest = pool.split_test(t.pool, test_size=75)
    return rest.select("id", "label", "is_labelled")


@query
def committee_upsert(t):
    """Two rounds of member outputs; the later round covers the ids the labels know."""
    later = t.raw("labels").select(F.col("doc_id").alias("id"))
    one = t.scores.select("id", "member", c.predicted_class("probs").alias("predicted_class"))
    two = one.join(later, "id", "left_semi").withColumn("predicted_class", F.col("predicted_class") + 10)
    outputs = one.withColumn("seq", F.lit(1)).unionByName(two.withColumn("seq", F.lit(2)))
    return pool.committee_upsert(outputs)


# --- sampling and balancing ----------------------------------------------------------


@query
def random_sampling(t):
    return sampling.random_sampling(t.pool, 100).select("id", "description", "label")


@query
def fallback_random(t):
    nothing = t.pool.filter("label = 'none'")
    return sampling.fallback_random(nothing, t.pool, 40, 5).select("id", "label")


@query
def sample_n(t):
    return sampling.sample_n(t.rows, 120, 3).select("id", "label")


@query
def train_test_split(t):
    return sampling.train_test_split(t.rows, 0.2).select("id", "label", "part")


@query
def stratified_subsample(t):
    ranked = selection.uncertainty_ids(t.pool, 250).join(t.pool.select("id", "label"), "id")
    return sampling.stratified_subsample(ranked, 50).select("id", "label", "rank")


@query
def balance_min_class(t):
    return sampling.balance_min_class(t.rows, LABELS).select("id", "label")


@query
def balance_fixed(t):
    return sampling.balance_fixed(t.rows, LABELS, 130).select("id", "label", "draw")


@query
def balance_intelligent(t):
    return sampling.balance_intelligent(t.rows, LABELS, 400).select("id", "label")


@query
def balanced_usable(t):
    return sampling.balanced_usable(t.rows, LABELS, 500)


@query
def class_counts(t):
    return sampling.class_counts(t.rows)


@query
def kfold(t):
    return sampling.kfold(t.rows, 5).select("id", "fold")


@query
def stratified_kfold(t):
    return sampling.stratified_kfold(t.rows, 5, label_col="source").select("id", "source", "fold")


# --- selection -----------------------------------------------------------------------


@query
def uncertainty_sampling(t):
    return selection.uncertainty_sampling(t.pool, 100).select("id", "description", "label", "uncertainty_score", "rank")


@query
def committee_vote(t):
    return selection.committee_vote(t.scores, t.pool, 60).select("id", "votes", "vote_entropy", "rank", "label")


@query
def committee_js(t):
    return selection.committee_js(t.scores, t.pool, 60).select("id", "js", "mean_entropy", "rank", "description")


@query
def committee_scores(t):
    return selection.committee_scores(t.scores)


@query
def nearest_to_centroid(t):
    """The embedding table's own label as cluster, its mean as centre."""
    points = t.embeddings
    centres = scoring.class_centroids(
        points.select("embedding", F.col("cluster").cast("string").alias("label")), [str(i) for i in range(10)]
    )
    return selection.nearest_to_centroid(points, centres.select(F.col("code").alias("cluster"), F.col("centroid").alias("centre")))


@query
def diversity_sampling(t):
    return selection.diversity_sampling(t.pool, t.embeddings, 50).select("id", "label")


# --- training and scoring ------------------------------------------------------------


@query
def class_weights(t):
    return scoring.class_weights(t.rows, [*LABELS, "it"])


def _known(t) -> DataFrame:
    return pool.labelled_rows(t.pool)


def _model(t, features=256):
    return scoring.train_classifier(_known(t), LABELS, features=features, algorithm="hashed")


@query
def train_classifier(t):
    """Confusion counts of the fitted model on rows it has not seen."""
    rest = pool.unlabelled_with_labels(t.pool)
    pred = scoring.predict_many(rest.select("id", "description", "label"), _model(t), LABELS)
    return pred.groupBy("label", "predicted_label").agg(F.count("*").alias("rows"))


@query
def model_predict(t):
    return scoring.model_predict(t.pool, _model(t), LABELS).select("id", "is_labelled", "model_prediction", "uncertainty_score")


@query
def predict_many(t):
    scored = scoring.predict_many(t.rows.select("id", "description", "label"), _model(t), LABELS)
    return scored.drop("description", "probs")


SOFTMAX = {"features": 1024, "max_iter": 8}


def _softmax(t):
    return scoring.train_classifier(_known(t), LABELS, **SOFTMAX, algorithm="softmax")


@query
def train_logistic(t):
    """Confusion counts of logistic regression on rows it has not seen."""
    rest = pool.unlabelled_with_labels(t.pool)
    pred = scoring.predict_many(rest.select("id", "description", "label"), _softmax(t), LABELS)
    return pred.groupBy("label", "predicted_label").agg(F.count("*").alias("rows"))


@query
def logistic_weights(t):
    """Its coefficients by bucket and label; the last bucket is the intercept."""
    weights = _softmax(t).weights.select("bucket", F.posexplode("w").alias("code", "weight"))
    return weights.select("bucket", c.label_name("code", LABELS).alias("label"), "weight")


@query
def model_predict_logistic(t):
    return scoring.model_predict(t.pool, _softmax(t), LABELS).select("id", "is_labelled", "model_prediction", "uncertainty_score")


@query
def predict_many_logistic(t):
    scored = scoring.predict_many(t.rows.select("id", "description", "label"), _softmax(t), LABELS)
    return scored.drop("description", "probs")


@query
def committee_predict(t):
    """Two learners, a member that cannot be loaded, and one that fails while it scores."""

    def broken():
        raise OSError("no such model")

    wrong = scoring.HashedBayes(t.raw("labels"), 256, len(LABELS))
    models = {0: _model(t), 1: _model(t, 64), 2: broken, 3: wrong}
    scored = scoring.committee_predict(pool.unlabelled_rows(t.pool), models, LABELS)
    return scored.select("id", "member", "predicted_class", c.confidence("probs").alias("confidence"))


@query
def embed_text(t):
    entries = scoring.embed_text(t.rows).select("id", F.posexplode("embedding").alias("dim", "value"))
    return entries.filter("value <> 0").withColumn("value", c.rounded("value"))


@query
def centroid_predict(t):
    vectors = t.embeddings.select("id", "embedding").join(t.pool.select("id", "label", "is_labelled"), "id")
    centroids = scoring.class_centroids(vectors.filter("is_labelled"), LABELS)
    return scoring.centroid_predict(vectors, centroids, LABELS).select(
        "id", "predicted_class", "predicted_label", "confidence"
    )


# --- evaluation ----------------------------------------------------------------------


@query
def accuracy(t):
    return evaluation.accuracy(t.one_model)


@query
def evaluate_rows(t):
    return evaluation.evaluate_rows(t.predictions).select("id", "member", "label", "predicted_label", "is_correct")


@query
def evaluate_summary(t):
    return evaluation.evaluate_summary(evaluation.evaluate_rows(t.one_model))


@query
def per_class_accuracy(t):
    return evaluation.per_class_accuracy(t.predictions)


@query
def class_report(t):
    return evaluation.class_report(t.predictions, LABELS)


@query
def macro_f1(t):
    return evaluation.macro_f1(t.predictions, LABELS)


@query
def recall_map(t):
    return evaluation.recall_map(t.predictions, LABELS).select(F.explode("recalls").alias("key", "recall"))


@query
def pool_mean_uncertainty(t):
    return evaluation.pool_mean_uncertainty(t.pool)


@query
def batch_mean_uncertainty(t):
    return evaluation.batch_mean_uncertainty(selection.uncertainty_sampling(t.pool, 100))


@query
def test_mean_uncertainty(t):
    return evaluation.test_mean_uncertainty(t.one_model)


@query
def cross_validate(t):
    return evaluation.cross_validate(t.one_model)


@query
def cv_summary(t):
    return evaluation.cv_summary(evaluation.cross_validate(t.one_model, stratified=False))


@query
def compare_models(t):
    return evaluation.compare_models(t.predictions)


@query
def compare_models_by_class(t):
    return evaluation.compare_models_by_class(t.predictions)


@query
def errors_by_true(t):
    return evaluation.errors_by_true(t.predictions)


@query
def errors_by_predicted(t):
    return evaluation.errors_by_predicted(t.predictions)


@query
def confusion_top(t):
    return evaluation.confusion_top(t.predictions)


@query
def confidence_by_outcome(t):
    return evaluation.confidence_by_outcome(t.predictions)


@query
def high_conf_errors(t):
    return evaluation.high_conf_errors(t.predictions).select("id", "member", "label", "predicted_label", "confidence")


@query
def error_examples(t):
    return evaluation.error_examples(t.one_model)


@query
def error_rows(t):
    return evaluation.error_rows(t.one_model).select("id", "label", "predicted_label", "confidence", "description")


@query
def evaluation_summary(t):
    return evaluation.evaluation_summary(t.predictions)


# --- results log ---------------------------------------------------------------------


@query
def split_runs(t):
    return runs.split_runs(t.results).select("id", "run", "method", "iteration_no")


@query
def run_method(t):
    return runs.run_method(runs.split_runs(t.results))


@query
def run_header(t):
    return runs.run_header(runs.split_runs(t.results))


@query
def metric_series(t):
    return runs.metric_series(runs.split_runs(t.results), accuracy_percent=True)


@query
def recall_series(t):
    return runs.recall_series(runs.split_runs(t.results))


@query
def series_label(t):
    return runs.series_label(runs.split_runs(t.results))


@query
def learning_curve(t):
    return curves.learning_curve(t.results)


@query
def improvement_vs_random(t):
    return curves.improvement_vs_random(curves.learning_curve(t.results))


@query
def labels_to_target(t):
    return curves.labels_to_target(curves.learning_curve(t.results))


@query
def data_savings(t):
    return curves.data_savings(curves.learning_curve(t.results))


@query
def gap_to_full(t):
    return curves.gap_to_full(curves.learning_curve(t.results))


@query
def final_stats(t):
    return curves.final_stats(curves.learning_curve(t.results))


@query
def final_vs_random(t):
    return curves.final_vs_random(curves.learning_curve(t.results))


@query
def paired_t_test(t):
    return significance.paired_t_test(t.results)


@query
def cohens_d(t):
    return significance.cohens_d(t.results)


@query
def anova_methods(t):
    return significance.anova_methods(t.results)


@query
def iterations_to_target(t):
    return significance.iterations_to_target(t.results)


@query
def performance_table(t):
    return significance.performance_table(t.results)


@query
def curve_auc(t):
    return efficiency.curve_auc(t.results)


@query
def convergence(t):
    return efficiency.convergence(t.results)


@query
def label_efficiency(t):
    return efficiency.label_efficiency(t.results)


@query
def early_performance(t):
    return efficiency.early_performance(t.results)


@query
def cost_benefit(t):
    return efficiency.cost_benefit(t.results)


@query
def best_by_combined(t):
    return winners.best_by_combined(t.results).drop("first_id")


@query
def objectives(t):
    return winners.objectives(t.results)


@query
def best_by_f1(t):
    return winners.best_by_f1(t.results).drop("first_id")


@query
def method_extremes(t):
    return winners.method_extremes(winners.best_by_f1(t.results))


@query
def best_vs_random(t):
    return winners.best_vs_random(winners.best_by_f1(t.results))


@query
def minority_vs_random(t):
    return winners.minority_vs_random(winners.best_by_f1(t.results))


@query
def overall_winner(t):
    return winners.overall_winner(winners.best_by_f1(t.results))


# --- loop control --------------------------------------------------------------------


def _log(t) -> DataFrame:
    keys = ["accuracy", "macro_f1", "avg_uncertainty_pool", "selected_samples_avg_uncertainty"]
    return runs.prepare_log(t.results, keys)


@query
def stop_plateau(t):
    return stopping.stop_plateau(_log(t), eps=0.05, patience=2).select("id", "run", "iteration_no", "streak", "plateau")


@query
def stop_budget(t):
    flagged = stopping.stop_plateau(_log(t), eps=0.05, patience=2)
    out = stopping.stop_budget(flagged, accuracy_threshold=0.85, label_budget=12_000, max_iterations=5)
    return out.select("id", "run", "stop", "reason")


@query
def stop_classic(t):
    out = stopping.stop_classic(_log(t), min_uncertainty=0.1, max_iterations=7, success_rate=0.7, min_gain=0.05)
    return out.select("id", "run", "previous_accuracy", "gain", "stop", "reason")


@query
def stop_min_gain(t):
    log = _log(t).withColumn("unlabelled", F.col("data_size") - F.col("train_data_size"))
    return stopping.stop_min_gain(log).select("id", "run", "gain", "stop", "reason")


@query
def iteration_report(t):
    return stopping.iteration_report(_log(t))


LOOP = {"n": 50, "max_iterations": 3, "features": 1024}


def _run_loop(t):
    """Three iterations of uncertainty sampling with the hashed learner, on stored parts; the log the loop writes."""
    test, rest = (pin(part, "part") for part in pool.split_test(t.pool, 0.2))
    log = active_learning_loop(rest, test, "uncertainty_sampling", LABELS, LoopParams(**LOOP, algorithm="hashed"))
    measures = ["accuracy", "macro_f1", "avg_uncertainty_pool", "selected_samples_avg_uncertainty"]
    return runs.extract_metric(log, measures).select(
        "id", "test_id", "iteration_no", "train_data_size", "method", *measures, "notes"
    )


_run_loop.__name__ = "active_learning_loop"
query(_run_loop)


# --- other ---------------------------------------------------------------------------


@query
def column_similarity(t):
    """Four slices of the embeddings as embedded columns."""
    parts = t.embeddings.select(
        "id", *[F.slice("embedding", 16 * i + 1, 16).alias(n) for i, n in enumerate(["target", "a", "b", "c"])]
    )
    return similarity.column_similarity(parts, "target", ["a", "b", "c"])
