"""What the physical plans must and must not hold."""

import pytest

from poolsift.functions import ranking
from poolsift.functions.columns import predicted_class, uncertainty
from poolsift.operators import curves, evaluation, pool, sampling, scoring, selection
from poolsift.operators.store import PoolStore
from poolsift.plans import loop
from poolsift.plans.fixtures import LABELS, Tables
from poolsift.plans.registry import QUERIES
from poolsift.session import pin

FOLDER = "/root/testdata/sf0.001"
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups"]
TRAINED = {"train_classifier", "model_predict", "predict_many", "committee_predict", "active_learning_loop", "diversity_sampling"}
TRAINED |= {"embed_text"}  # vectors are folded with NumPy
TRAINED |= {"read_postings_csv"}  # records are put together from lines
TRAINED |= {"train_logistic", "logistic_weights", "model_predict_logistic", "predict_many_logistic"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    return pin(Tables(spark, FOLDER).pool, "pool")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINED))
def test_no_pair_tables_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert [word for word in FORBIDDEN if word in text] == []


def wide_shuffles(df):
    """Exchanges whose input still carries the text column."""
    lines = plan(df).splitlines()
    found = []
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line:
            below = next((x for x in lines[i + 1 :] if "FileScan" in x or "Project" in x or "Window" in x), "")
            if "description#" in below:
                found.append(line)
    return found


@pytest.mark.parametrize(
    "choose",
    [
        lambda p: sampling.random_sampling(p, 50),
        lambda p: sampling.kfold(p, 7),
        lambda p: sampling.stratified_kfold(p, 7),
        lambda p: scoring.embed_text(p),
        lambda p: pool.split_test(p, 0.2)[0],
        lambda p: pool.split_test(p, 0.2)[1],
        lambda p: pool.init_labelled(p, 50),
        lambda p: sampling.balance_min_class(p, LABELS),
        lambda p: sampling.train_test_split(p, 0.2),
        lambda p: selection.uncertainty_sampling(p, 50),
        lambda p: pool.unlabelled_page(p, 50, 10),
    ],
)
def test_texts_are_not_shuffled(stored, choose):
    assert wide_shuffles(choose(stored)) == []


def test_filters_and_columns_reach_the_scan(stored):
    text = plan(selection.uncertainty_ids(stored, 10))
    assert "IsNotNull(is_labelled)" in text
    assert "IsNotNull(uncertainty_score)" in text
    assert "description" not in text
    assert "IsNotNull(description), Not(EqualTo(desc" in plan(pool.unlabelled_count(stored))


def test_aggregates_combine_before_the_shuffle(spark):
    t = Tables(spark, FOLDER)
    for df in (
        evaluation.class_report(t.predictions, LABELS),
        evaluation.error_examples(t.one_model),
        curves.learning_curve(t.results),
        sampling.class_counts(t.rows),
    ):
        assert "partial_" in plan(df)
    assert "SortAggregate" not in plan(curves.learning_curve(t.results))


@pytest.mark.parametrize(
    "choose, scans",
    [
        (lambda p: sampling.random_sampling(p, 50), 2),
        (lambda p: pool.split_test(p, 0.2)[0], 2),
        (lambda p: sampling.balance_min_class(p, LABELS), 2),
        (lambda p: sampling.balance_intelligent(p, LABELS, 100), 2),
        (lambda p: sampling.balance_fixed(p, LABELS, 30), 3),
    ],
)
def test_seeded_choices_read_texts_once_more(stored, choose, scans, monkeypatch):
    """One reading writes the eligible ids, the rest of ``scans`` returns the rows."""
    written = []
    monkeypatch.setattr(ranking, "pin", lambda df, name: written.append(plan(df)) or pin(df, name))
    text = plan(choose(stored))
    assert sum(part.count("description") > 0 for part in (x.split("ReadSchema: ")[1].split("\n")[0] for x in [*text.split("FileScan")[1:]])) == scans - 1
    assert sum("description" in x for x in written) == 1


def test_store_reads_meet_changes_without_moving_texts(spark, stored, tmp_path):
    """Neither an update nor a reading shuffles texts, although nothing may be broadcast."""
    known = Tables(spark, FOLDER).scores.filter("member = 0").select(
        "id", predicted_class("probs").cast("string").alias("model_prediction"), uncertainty("probs").alias("uncertainty_score")
    )
    store, limit = PoolStore(stored, 4), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store.save_predictions(known)
        store.mark_labelled(known.filter("id % 3 = 0"))
        for _ in range(2):
            text = plan(store.read())
            assert "SortMergeJoin" in text and "description" in text and "Exchange" not in text
            store.compact()
        state = plan(store.read().select("id", "uncertainty_score"))
        assert "description" not in state
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def moved_texts(df):
    """Exchanges that put out the text column."""
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if "Exchange" in node.nodeName() and "description#" in node.output().mkString(" "):
            found.append(node.nodeName())
    return found


def test_texts_that_move_are_seen(stored):
    assert moved_texts(stored.repartition("id")) == ["Exchange"] and moved_texts(stored.groupBy("id").count()) == []


def test_no_iteration_of_the_loop_moves_texts(spark, monkeypatch):
    """Plans of all that iterations write, once the pool is stored, with broadcasts off."""
    test, rest = (pin(part, "part") for part in pool.split_test(Tables(spark, FOLDER).pool, 0.2))
    found, write = [], loop._State._write

    def noted(state, df, name, step):
        found.append((name, moved_texts(df)))
        return write(state, df, name, step)

    monkeypatch.setattr(loop._State, "_write", noted)
    for module in (scoring, ranking, selection):
        monkeypatch.setattr(module, "pin", lambda df, name: found.append((name, moved_texts(df))) or pin(df, name))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        params = loop.LoopParams(n=10, max_iterations=2, features=64, algorithm="hashed", compact_every=1)
        loop.active_learning_loop(rest, test, "uncertainty_sampling", LABELS, params).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert {"scores", "batch", "revealed", "test_predictions", "bayes_words", "selection"} <= {name for name, _ in found}
    assert [x for x in found if x[1]] == []
