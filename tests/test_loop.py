"""The loop end to end on separable texts."""

import json

import pytest

from poolsift.operators import runs
from poolsift.plans.loop import STOP_RULES, STRATEGIES, LoopParams, Step, active_learning_loop

LABELS = ["A", "B"]
DDL = "id long, description string, is_labelled boolean, label string, model_prediction string, uncertainty_score double"


def texts(spark, start, n):
    words = {"A": "apple pear plum", "B": "car bus train"}
    rows = [(start + i, f"{words['AB'[i % 2]]} w{i % 9}", False, "AB"[i % 2], None, None) for i in range(n)]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="module")
def data(spark):
    return texts(spark, 0, 80).cache(), texts(spark, 1000, 20).cache()


def small(**more):
    return LoopParams(**{"n": 10, "base_train_size": 6, "features": 64, "train_iterations": 5, "max_iterations": 2, **more})


@pytest.mark.parametrize("strategy", sorted(STRATEGIES))
def test_strategies(data, strategy):
    log = active_learning_loop(*data, strategy, LABELS, small(max_iterations=1)).orderBy("id").collect()
    assert [r.iteration_no for r in log] == [0, 1]
    assert (log[0].method, log[0].notes) == ("BASE", "base_classifier")
    assert log[0].train_data_size == 0 and 0 < log[1].train_data_size <= 10
    assert log[-1].notes == "max_iterations_reached (1)"
    metrics = json.loads(log[-1].metrics)
    assert metrics["accuracy"] == 1.0 and {"macro_f1", "recall_a", "recall_b", "avg_uncertainty_pool"} <= set(metrics)


def test_budget_stop_and_numbering(data):
    first = active_learning_loop(*data, "random_sampling", LABELS, small(label_budget=10))
    rows = first.orderBy("id").collect()
    assert [(r.id, r.test_id, r.notes) for r in rows] == [(1, "1", "base_classifier"), (2, "1", "label_budget")]
    second = active_learning_loop(*data, "uncertainty_sampling", LABELS, small(label_budget=10), results=first)
    assert [(r.id, r.test_id) for r in second.orderBy("id").collect()] == [(3, "2"), (4, "2")]
    both = runs.split_runs(first.unionByName(second))
    assert sorted(r.run for r in both.collect()) == [1, 1, 2, 2]


def test_custom_strategy_empty_choice_falls_back_and_pool_runs_dry(data):
    def nothing(ctx):
        return ctx.pool.filter("id < 0")

    log = active_learning_loop(*data, nothing, LABELS, small(n=50, max_iterations=9, label_budget=None)).orderBy("id").collect()
    assert [r.train_data_size for r in log] == [0, 50, 74]
    assert log[1].method == "nothing"


def test_stratified_batch_is_balanced(data):
    seen = []

    def lopsided(ctx):
        rows = STRATEGIES["uncertainty_sampling"](ctx)
        seen.append(ctx.n)
        return rows

    log = active_learning_loop(*data, lopsided, LABELS, small(stratified_batch=True, max_iterations=1)).orderBy("id").collect()
    assert seen == [50] and log[1].train_data_size == 10


def test_accuracy_and_plateau_stops(data):
    log = active_learning_loop(*data, "random_sampling", LABELS, small(accuracy_threshold=0.9)).orderBy("id").collect()
    assert log[-1].notes == "accuracy_threshold (0.9)" and len(log) == 2
    flat = active_learning_loop(*data, "random_sampling", LABELS, small(plateau_eps=5.0, plateau_patience=1, max_iterations=5))
    assert flat.orderBy("id").collect()[-1].notes == "uncertainty_plateau"


def test_classic_and_min_gain_stops(data):
    easy = small(stop_rule="classic", success_rate=0.9, algorithm="hashed", max_iterations=4)
    log = active_learning_loop(*data, "random_sampling", LABELS, easy).orderBy("id").collect()
    assert [r.notes for r in log] == ["base_classifier", "success_rate_reached"]
    assert {"previous_accuracy", "accuracy_threshold", "committee"} <= set(json.loads(log[1].params))
    gain = small(stop_rule="min_gain", min_gain=0.5, algorithm="hashed", run_by="tests")
    log = active_learning_loop(*data, "random_sampling", LABELS, gain).orderBy("id").collect()
    assert log[-1].notes == "min_improvement_not_met" and log[-1].run_by == "tests"


@pytest.mark.parametrize(
    "rule, facts, reason",
    [
        ("classic", dict(pool_uncertainty=None), "pool_empty"),
        ("classic", dict(pool_uncertainty=0.1), "T_threshold_reached"),
        ("classic", dict(iteration=20), "max_iterations_reached"),
        ("classic", dict(accuracy=0.9), "success_rate_reached"),
        ("classic", dict(accuracy=0.51), "improvement_below_I"),
        ("classic", dict(accuracy=0.4), None),
        ("min_gain", dict(accuracy=0.4), "min_improvement_not_met"),
        ("min_gain", dict(accuracy=0.6, pool_left=False), "pool_empty"),
        ("min_gain", dict(accuracy=0.6), None),
        ("min_gain", dict(previous_accuracy=None, pool_left=False), None),
        ("budget", dict(plateau=True), "uncertainty_plateau"),
        ("budget", dict(), None),
    ],
)
def test_stop_rules(rule, facts, reason):
    params = LoopParams(min_uncertainty=0.2, min_gain=0.05, max_iterations=20)
    step = Step(**{**dict(iteration=1, labelled=10, accuracy=0.5, previous_accuracy=0.5, pool_uncertainty=0.4, plateau=False, pool_left=True), **facts})
    assert STOP_RULES[rule](params, step) == reason
