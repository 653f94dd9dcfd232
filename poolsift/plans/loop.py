"""The selection loop: score, select, reveal, train, evaluate, log, decide.

The texts are written once, bucketed by id. What changes is narrow and is written per iteration to
tables with the same buckets: which ids were revealed, and the scores of the rest. No iteration
shuffles a text. That cuts the lineage of an iterative plan and survives the loss of executors. The
driver sees one metrics row per iteration.
"""

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolsift.functions.columns import present, uncertainty
from poolsift.functions.ranking import hash_positions
from poolsift.operators import evaluation, pool as pools, sampling, scoring, selection
from poolsift.operators.store import PoolStore
from poolsift.session import fresh_path
from poolsift.sources.files import RESULTS_SCHEMA, next_test_id


@dataclass
class LoopParams:
    n: int = 2000
    seed: int = 42
    base_train_size: int = 100
    max_samples: int | None = None
    max_iterations: int = 12
    label_budget: int | None = 10_000
    accuracy_threshold: float | None = None
    plateau_eps: float = 0.0
    plateau_patience: int = 0
    stratified_batch: bool = False
    candidate_factor: int = 5
    features: int = 4096
    train_iterations: int = 20
    algorithm: str = "logistic"
    # which rule ends the loop: budget (plateau, accuracy, labels, iterations), classic or min_gain
    stop_rule: str = "budget"
    min_uncertainty: float = 0.0
    success_rate: float | None = 0.85
    min_gain: float | None = None
    run_by: str | None = None
    # buckets of the stored pool; the session's shuffle partitions if not given
    buckets: int | None = None
    # changes of so many iterations are folded into one row per id
    compact_every: int = 4


@dataclass
class Context:
    """What a strategy may use: ``pool`` with the current scores, ``rows`` without them.

    Plans over texts should start from ``rows``, which joins nothing large.
    """

    pool: DataFrame
    rows: DataFrame
    test: DataFrame
    labels: list
    params: LoopParams
    model: object
    n: int
    iteration: int = 1
    extra: dict = field(default_factory=dict)

    def open_rows(self) -> DataFrame:
        return pools.page(pools.usable(pools.unlabelled_rows(self.rows)), self.params.max_samples)

    def committee(self) -> DataFrame:
        """Outputs of the current model and of a second learner on the open rows."""
        known = pools.labelled_rows(self.rows)
        second = scoring.train_classifier(known, self.labels, self.params.features, algorithm="bayes")
        return scoring.committee_predict(self.open_rows(), dict(enumerate([self.model, second])), self.labels)


#: Members of the loop's committee, in the order of their numbers.
COMMITTEE = ["model", "tfidf-bayes"]

# A strategy returns rows with ``id`` and, if it has an order, ``rank``.
Strategy = Callable[[Context], DataFrame]

STRATEGIES: dict[str, Strategy] = {
    "random_sampling": lambda ctx: sampling.random_sampling(ctx.pool, ctx.n, ctx.params.seed + ctx.iteration),
    "uncertainty_sampling": lambda ctx: selection.uncertainty_sampling(ctx.pool, ctx.n),
    "diversity_sampling": lambda ctx: selection.diversity_sampling(
        ctx.pool, ctx.extra.get("embeddings") or scoring.embed_text(ctx.open_rows()), ctx.n, ctx.params.max_samples
    ),
    "query_by_comitee": lambda ctx: selection.committee_js(ctx.committee(), ctx.pool, ctx.n),
    "committee_vote": lambda ctx: selection.committee_vote(ctx.committee(), ctx.pool, ctx.n),
}


class _State:
    """The pool as a store: its texts are written once, reveals and scores are changes that meet them by bucket."""

    def __init__(self, pool: DataFrame, buckets: int | None = None):
        self.spark = pool.sparkSession
        empty = {"model_prediction": F.lit(None).cast("string"), "uncertainty_score": F.lit(None).cast("double")}
        self.store = PoolStore(pool.withColumns(empty), buckets)
        self.folder = fresh_path(self.spark, "loop")
        self.scores = self.spark.createDataFrame([], "id long, model_prediction string, uncertainty_score double")
        self.counts: scoring.BayesCounts | None = None

    def _write(self, df: DataFrame, name: str, step: int) -> DataFrame:
        path = f"{self.folder}/{name}/step={step}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def pool(self) -> DataFrame:
        return self.store.read()

    def rows(self) -> DataFrame:
        return self.pool().select("id", "description", "is_labelled", "label")

    def reveal(self, ids: DataFrame, step: int) -> int:
        revealed = self._write(ids.select("id"), "revealed", step)
        self.store.mark_labelled(revealed)
        return revealed.count()

    def rescore(self, predictions: DataFrame, step: int) -> None:
        self.scores = self._write(scoring.prediction_columns(predictions), "scores", step)
        self.store.save_predictions(self.scores)

    def batch(self, selected: DataFrame, step: int) -> DataFrame:
        """Pins a selection, so later steps do not run the strategy again."""
        keep = [c for c in ("id", "label", "rank", "uncertainty_score") if c in selected.columns]
        return self._write(selected.select(*keep), "batch", step)

    def texts_of(self, ids: DataFrame, n: int) -> DataFrame:
        """Rows of at most ``n`` ids. A list of ids prunes buckets and row groups of the texts; more are joined by bucket."""
        if n > selection.ID_LIST:
            return self.rows().join(ids.select("id"), "id", "left_semi")
        return self.rows().filter(F.col("id").isin([r["id"] for r in ids.select("id").collect()]))


def _train(state: _State, labels, params: LoopParams, batch: DataFrame | None = None):
    """A model of all revealed rows. Hashed Bayes adds the counts of ``batch`` to those it has."""
    if params.algorithm == "hashed":
        if state.counts is None or batch is None:
            state.counts = scoring.bayes_counts(pools.labelled_rows(state.rows()), labels, params.features)
        else:
            wanted = params.n * (params.candidate_factor if params.stratified_batch else 1)
            state.counts = state.counts.plus(state.texts_of(batch, wanted), labels)
        return state.counts.model()
    known = pools.labelled_rows(state.rows())
    return scoring.train_classifier(known, labels, params.features, params.train_iterations, params.algorithm)


def _evaluate(test: DataFrame, model, labels, state: _State, step: int) -> dict:
    """Accuracy, macro-F1, recalls and mean uncertainty from one written prediction table."""
    usable = pools.label_filter(test, labels).select("id", "description", "label")
    scored = scoring.predict_many(usable, model, labels).drop("description")
    pred = state._write(scored, "test_predictions", step)
    report = evaluation.class_report(pred, labels)
    correct = F.avg(F.when(evaluation.is_correct(), 1.0).otherwise(0.0))
    totals = pred.agg(correct.alias("accuracy"), F.avg(uncertainty("probs")).alias("avg_uncertainty")).first()
    per_class = report.select("label", "recall", "f1").collect()  # one row per label
    recalls = {f"recall_{r.label.lower()}": r.recall for r in per_class}
    return {**totals.asDict(), "macro_f1": sum(r.f1 for r in per_class) / len(labels), "recalls": recalls}


@dataclass
class Step:
    """What a stop rule may look at after an iteration."""

    iteration: int
    labelled: int
    accuracy: float | None
    previous_accuracy: float | None
    pool_uncertainty: float | None
    plateau: bool
    pool_left: bool

    @property
    def gain(self) -> float | None:
        known = self.accuracy is not None and self.previous_accuracy is not None
        return self.accuracy - self.previous_accuracy if known else None


# The reasons that stop rules write to the log, here and in ``operators.stopping``.


def _budget_rule(params: LoopParams, step: Step) -> str | None:
    if step.plateau:
        return "uncertainty_plateau"
    if params.accuracy_threshold is not None and step.accuracy is not None and step.accuracy >= params.accuracy_threshold:
        return f"accuracy_threshold ({params.accuracy_threshold})"
    if params.label_budget and step.labelled >= params.label_budget:
        return "label_budget"
    if params.max_iterations and step.iteration >= params.max_iterations:
        return f"max_iterations_reached ({params.max_iterations})"
    return None


def _classic_rule(params: LoopParams, step: Step) -> str | None:
    if step.pool_uncertainty is None:
        return "pool_empty"
    if step.pool_uncertainty < params.min_uncertainty:
        return "T_threshold_reached"
    if params.max_iterations is not None and step.iteration >= params.max_iterations:
        return "max_iterations_reached"
    if params.success_rate is not None and step.accuracy is not None and step.accuracy >= params.success_rate:
        return "success_rate_reached"
    if params.min_gain is not None and step.gain is not None and 0 < step.gain < params.min_gain:
        return "improvement_below_I"
    return None


def _min_gain_rule(params: LoopParams, step: Step) -> str | None:
    if step.gain is None:
        return None
    if params.min_gain is not None and step.gain < params.min_gain:
        return "min_improvement_not_met"
    return None if step.pool_left else "pool_empty"


STOP_RULES: dict[str, Callable[[LoopParams, Step], str | None]] = {
    "budget": _budget_rule,
    "classic": _classic_rule,
    "min_gain": _min_gain_rule,
}


def active_learning_loop(
    pool: DataFrame,
    test: DataFrame,
    strategy: str | Strategy,
    labels,
    params: LoopParams | None = None,
    results: DataFrame | None = None,
    embeddings: DataFrame | None = None,
) -> DataFrame:
    """Runs until a stop rule holds or the pool is empty; returns the rows it logged.

    ``strategy`` is a name of ``STRATEGIES`` or any function from :class:`Context` to
    selected rows. ``results`` is an earlier log the numbering continues.
    ``params.stop_rule`` names one of ``STOP_RULES``.
    """
    params = params or LoopParams()
    spark = pool.sparkSession
    method = strategy if isinstance(strategy, str) else strategy.__name__
    select = STRATEGIES[strategy] if isinstance(strategy, str) else strategy
    first_id, test_id = 1, "1"
    if results is not None:
        first_id = (results.agg(F.max("id")).first()[0] or 0) + 1
        test_id = str(next_test_id(results).first()[0])

    state = _State(pool, params.buckets)
    if state.rows().filter("is_labelled").isEmpty():
        seeds = sampling.random_sampling(pools.usable(state.rows()), params.base_train_size, params.seed)
        state.reveal(seeds, -1)
    model = _train(state, labels, params)
    log_path = f"{state.folder}/results"

    def write_row(iteration, name, size, metrics, notes, previous=None):
        row = {
            "id": first_id + iteration,
            "test_id": test_id,
            "iteration_no": iteration,
            "model_name": {"logistic": "tfidf-logistic", "bayes": "tfidf-bayes", "softmax": "hashed-softmax"}.get(params.algorithm, "hashed-bayes"),
            "train_data_size": size,
            "method": name,
            "data_size": params.max_samples,
            "n": params.n if iteration else None,
            "metrics": json.dumps(metrics),
            "params": json.dumps(
                {
                    "method": name,
                    "DATA_SIZE": params.max_samples,
                    "N": params.n,
                    "previous_accuracy": previous,
                    "accuracy_threshold": params.accuracy_threshold,
                    "committee": COMMITTEE if name in ("query_by_comitee", "committee_vote") else None,
                }
            ),
            "run_by": params.run_by,
            "notes": notes,
        }
        columns = [f.split()[0] for f in RESULTS_SCHEMA.split(", ")]
        one = spark.createDataFrame([tuple(row.get(c) for c in columns)], RESULTS_SCHEMA)
        one.coalesce(1).write.mode("append").parquet(log_path)

    base = _evaluate(test, model, labels, state, 0)
    write_row(0, "BASE", 0, {"accuracy": base["accuracy"], "avg_uncertainty": base["avg_uncertainty"]}, "base_classifier")
    labelled, before, streak, iteration = 0, None, 0, 1
    previous = base["accuracy"]

    while True:
        open_rows = pools.page(pools.usable(pools.unlabelled_rows(state.rows())), params.max_samples)
        state.rescore(scoring.predict_many(open_rows.select("id", "description"), model, labels), iteration)

        wanted = params.n * (params.candidate_factor if params.stratified_batch else 1)
        ctx = Context(state.pool(), state.rows(), test, labels, params, model, wanted, iteration, {"embeddings": embeddings})
        # only rows with text and label can be revealed, whatever the strategy returns
        chosen = select(ctx).filter(present("description") & present("label"))
        chosen = state.batch(chosen, 2 * iteration)
        if chosen.isEmpty():
            chosen = state.batch(sampling.fallback_random(chosen, state.pool(), params.n, params.seed), 2 * iteration + 1)
        if params.stratified_batch:
            if "rank" not in chosen.columns:
                chosen = hash_positions(chosen, "id", params.seed, alias="rank")
            chosen = sampling.stratified_subsample(chosen, params.n, params.seed)
        if chosen.isEmpty():
            break
        if "uncertainty_score" not in chosen.columns:
            chosen = chosen.withColumn("uncertainty_score", F.lit(None).cast("double"))
        mean = evaluation.batch_mean_uncertainty(chosen, state.scores).first()[0]
        if params.plateau_patience and mean is not None:
            streak = streak + 1 if before is not None and before - mean < params.plateau_eps else 0
            before = mean

        labelled += state.reveal(chosen, iteration)
        model = _train(state, labels, params, chosen)
        if iteration % params.compact_every == 0:
            state.store.compact()
        found = _evaluate(test, model, labels, state, iteration)
        plateau = bool(params.plateau_patience) and mean is not None and streak >= params.plateau_patience
        pool_mean = state.scores.agg(F.avg("uncertainty_score")).first()[0]
        left = not pools.usable(pools.unlabelled_rows(state.rows())).isEmpty()
        step = Step(iteration, labelled, found["accuracy"], previous, pool_mean, plateau, left)
        reason = STOP_RULES[params.stop_rule](params, step) or "continue"
        metrics = {
            "accuracy": found["accuracy"],
            "avg_uncertainty": pool_mean,
            "avg_uncertainty_pool": pool_mean,
            "selected_samples_avg_uncertainty": mean,
            "macro_f1": found["macro_f1"],
            **found["recalls"],
        }
        write_row(iteration, method, labelled, metrics, reason, previous)
        previous = found["accuracy"]
        if reason != "continue":
            break
        iteration += 1
    state.store.drop()
    return spark.read.schema(RESULTS_SCHEMA).parquet(log_path)
