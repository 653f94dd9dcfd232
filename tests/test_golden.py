"""Hand-size cases with known results."""

import pytest
from pyspark.sql import functions as F

from poolsift.functions import columns as c
from poolsift.functions.tails import f_tail, t_tail
from poolsift.operators import curves, efficiency, evaluation, pool, runs, sampling, selection, significance, stopping, winners


def near(x):
    return pytest.approx(x, abs=2e-6)


# --- committee -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def committee(spark):
    rows = [
        (1, 0, [0.7, 0.2, 0.1]), (1, 1, [0.1, 0.2, 0.7]),
        (2, 0, [0.6, 0.3, 0.1]), (2, 1, [0.6, 0.3, 0.1]),
        (3, 0, [1.0, 0.0, 0.0]), (3, 1, [0.0, 1.0, 0.0]),
        (4, 0, [0.4, 0.3, 0.3]), (4, 1, [0.3, 0.4, 0.3]),
        (5, 0, [0.5, 0.3, 0.2]),
        (6, 0, [0.0, 0.0, 0.0]), (6, 1, [0.5, 0.3, 0.2]),
    ]
    return spark.createDataFrame(rows, "id long, member int, probs array<double>")


@pytest.fixture(scope="module")
def open_pool(spark):
    rows = [(i, f"text {i}", i == 9, "A", None, None) for i in range(1, 10)]
    ddl = "id long, description string, is_labelled boolean, label string, model_prediction string, uncertainty_score double"
    return spark.createDataFrame(rows, ddl)


def test_committee_scores(committee):
    got = {r.id: (r.js, r.mean_entropy) for r in selection.committee_scores(committee).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1] == (near(0.253102), near(1.054920))
    assert got[2] == (near(0.0), near(0.897946))
    assert got[3] == (near(0.693147), near(0.693147))
    assert got[4] == (near(0.007167), near(1.096067))


def test_committee_js_order(committee, open_pool):
    rows = selection.committee_js(committee, open_pool, 10).orderBy("rank").collect()
    assert [r.id for r in rows] == [3, 1, 4, 2]
    assert rows[0].description == "text 3"


def test_committee_vote_order(committee, open_pool):
    rows = selection.committee_vote(committee.filter("id < 6"), open_pool, 3).orderBy("rank").collect()
    assert [r.votes for r in rows] == [2, 2, 2]
    assert {r.id for r in rows} == {1, 3, 4}


# --- class report --------------------------------------------------------------------


def test_class_report(spark):
    labels = ["A", "B", "C", "D"]
    rows = [(i, "x", t, labels.index(p), p) for i, (t, p) in enumerate(zip("AAAABBBCC", "AAABBBACB"))]
    pred = spark.createDataFrame(rows, "id long, description string, label string, predicted_class int, predicted_label string")
    got = {r.label: r for r in evaluation.class_report(pred, labels).collect()}
    assert (got["A"].precision, got["A"].recall, got["A"].f1, got["A"].support) == (0.75, 0.75, 0.75, 4)
    assert (got["B"].precision, got["B"].recall, got["B"].f1) == (0.5, near(2 / 3), near(0.571429))
    assert (got["C"].precision, got["C"].recall, got["C"].f1) == (1.0, 0.5, near(0.666667))
    assert (got["D"].precision, got["D"].recall, got["D"].f1, got["D"].support) == (0, 0, 0, 0)
    assert evaluation.macro_f1(pred, labels).first()[0] == near(0.497024)
    assert evaluation.accuracy(pred).first().accuracy == near(2 / 3)
    assert evaluation.recall_map(pred, labels).first()[0]["recall_b"] == near(2 / 3)


def test_evaluate_rows_compares_codes_when_all_labels_are_numbers(spark):
    ddl = "id long, label string, predicted_class int, predicted_label string"
    numeric = spark.createDataFrame([(1, "2", 2, "x"), (2, " 3.0 ", 3, "y"), (3, "1", 0, "1")], ddl)
    assert [r.is_correct for r in evaluation.evaluate_rows(numeric).orderBy("id").collect()] == [True, True, False]
    mixed = spark.createDataFrame([(1, "2", 2, "x"), (2, "y", 9, "y"), (3, None, 0, None)], ddl)
    assert [r.is_correct for r in evaluation.evaluate_rows(mixed).orderBy("id").collect()] == [False, True, False]


# --- curves --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def log(spark):
    base = {500: (0.30, 0.28), 1000: (0.42, 0.40), 1500: (0.50, 0.48), 2000: (0.55, 0.54)}
    better = {500: (0.36, 0.35), 1000: (0.50, 0.49), 1500: (0.58, 0.57), 2000: (0.62, 0.61)}
    rows, i = [], 1
    for method, curve in (("random_sampling", base), ("uncertainty_sampling", better)):
        rows.append((i, "1", 0, 0, "BASE", '{"accuracy": 0.2}', "base_classifier"))
        for step, (size, (acc, f1)) in enumerate(curve.items(), 1):
            i += 1
            rows.append((i, "1", step, size, method, f'{{"accuracy": {acc}, "macro_f1": {f1}}}', "continue"))
        i += 1
    ddl = "id long, test_id string, iteration_no int, train_data_size long, method string, metrics string, notes string"
    return spark.createDataFrame(rows, ddl)


def test_improvement_and_savings(log):
    curve = curves.learning_curve(log)
    gain = curves.improvement_vs_random(curve).first()
    assert (gain.accuracy_improvement_pct, gain.max_accuracy_improvement_pct) == (near(16.943723), near(20))
    assert (gain.macro_f1_improvement_pct, gain.max_macro_f1_improvement_pct) == (near(19.803241), near(25))
    saved = curves.data_savings(curve).first()
    assert (saved.avg_accuracy_savings_pct, saved.max_accuracy_savings_pct) == (near(11.111111), near(33.333333))
    assert (saved.avg_macro_f1_savings_pct, saved.max_macro_f1_savings_pct) == (near(25), near(50))


def test_gap_to_full(log):
    got = {r.method: r for r in curves.gap_to_full(curves.learning_curve(log)).collect()}
    assert (got["random_sampling"].accuracy_gap_pct, got["random_sampling"].macro_f1_gap_pct) == (near(23.184358), near(25.517241))
    assert (got["uncertainty_sampling"].accuracy_gap_pct, got["uncertainty_sampling"].macro_f1_gap_pct) == (near(13.407821), near(15.862069))


def test_significance(log):
    t = significance.paired_t_test(log).first()
    assert (t.pairs, t.t_statistic, t.p_value) == (4, near(13.856406), near(0.000814))
    assert (t.mean_diff, t.mean_diff_pct) == (near(0.08), near(18.823529))
    assert significance.cohens_d(log).first().cohens_d == near(0.704361)
    assert significance.performance_table(log).first().stars == "***"
    f = significance.anova_methods(log).first()
    assert (f.n_methods, f.f_statistic, f.p_value) == (2, near(0.992248), near(0.357654))


def test_efficiency(log):
    auc = {r.method: r for r in efficiency.curve_auc(log).collect()}["uncertainty_sampling"]
    assert (auc.auc, auc.learning_efficiency) == (near(1.54), near(0.77))
    label = {r.method: r.label_efficiency for r in efficiency.label_efficiency(log).collect()}
    assert label["uncertainty_sampling"] == near(0.305)
    early = {r.method: (r.early_iteration, r.early_performance) for r in efficiency.early_performance(log).collect()}
    assert early["uncertainty_sampling"] == (1, near(0.49))
    reached = {}
    for r in efficiency.convergence(log).orderBy("method", "level").collect():
        reached.setdefault(r.method, []).append(r.iteration)
    assert reached == {"uncertainty_sampling": [2, 2, 3, 4], "random_sampling": [3, 4]}
    cost = efficiency.cost_benefit(log).first()
    assert (cost.performance_gain, cost.performance_gain_pct) == (near(0.07), near(12.962963))
    assert (cost.label_savings, cost.efficiency_ratio) == (0, near(1.129630))


def test_winners(log):
    best = {r.method: r.combined_score for r in winners.best_by_combined(log).collect()}
    assert best == {"uncertainty_sampling": near(0.615), "random_sampling": near(0.545)}
    assert winners.objectives(log).first().performance_difference_pct == near(12.844037)


def test_no_baseline_gives_nothing(log):
    alone = log.filter("method <> 'random_sampling'")
    curve = curves.learning_curve(alone)
    best = winners.best_by_f1(alone)
    for df in (
        significance.paired_t_test(alone),
        significance.iterations_to_target(alone),
        efficiency.cost_benefit(alone),
        winners.objectives(alone),
        curves.improvement_vs_random(curve),
        curves.data_savings(curve),
        curves.final_vs_random(curve),
        curves.final_stats(curve),
        winners.best_vs_random(best),
        winners.minority_vs_random(best),
    ):
        assert df.count() == 0


def test_no_method_ahead_gives_nulls(log):
    swapped = log.withColumn(
        "method",
        F.when(F.col("method") == "random_sampling", "x").when(F.col("method") == "uncertainty_sampling", "random_sampling").otherwise(F.col("method")),
    )
    rows = {r.metric: r for r in winners.best_vs_random(winners.best_by_f1(swapped)).collect()}
    assert rows["final_f1"].best_method is None and rows["final_f1"].label_ratio is None
    assert rows["final_f1"].random_value == near(0.61)


def test_runs(log):
    got = [(r.id, r.run) for r in runs.split_runs(log).orderBy("id").collect()]
    assert [run for _, run in got] == [1] * 5 + [2] * 5
    late = runs.split_runs(log.filter("id > 2")).orderBy("id").collect()
    assert late[0].run == 1 and late[-1].run == 2


# --- tails ---------------------------------------------------------------------------


@pytest.mark.parametrize("t,df", [(2.228139, 10), (12.706205, 1), (1.959964, 10**8)])
def test_t_tail_at_critical_values(spark, t, df):
    assert spark.range(1).select(t_tail(F.lit(t), F.lit(df))).first()[0] == pytest.approx(0.05, abs=1e-6)


@pytest.mark.parametrize("f,d1,d2", [(4.102821, 2, 10), (2.689628, 4, 30), (6.607891, 1, 5), (2.371932, 4, 10**8)])
def test_f_tail_at_critical_values(spark, f, d1, d2):
    assert spark.range(1).select(f_tail(F.lit(f), F.lit(d1), F.lit(d2))).first()[0] == pytest.approx(0.05, abs=1e-6)


# --- quotas --------------------------------------------------------------------------


def quotas(spark, counts, target):
    df = spark.createDataFrame([(chr(97 + i), i, n) for i, n in enumerate(counts)], "label string, code int, n long")
    return [r.quota for r in sampling.intelligent_quotas(df, target).orderBy("label").collect()]


def test_intelligent_quotas(spark):
    assert quotas(spark, [3, 5, 8, 20, 30], 50) == [3, 5, 8, 20, 14]
    assert quotas(spark, [3, 5, 8, 20, 30], 36) == [3, 5, 8, 10, 10]
    assert quotas(spark, [3, 5, 8, 20, 30], 37) == [3, 5, 8, 20, 1]
    assert quotas(spark, [10, 10, 10, 10, 10], 9) == [2, 2, 2, 2, 1]
    assert quotas(spark, [3, 5], 100) == [3, 5]
    assert quotas(spark, [3, 5, 1, 2, 4, 6], 100) == [3, 5, 1, 2, 4, 6]


def test_stratified_subsample_fills_from_leftovers(spark):
    labels = "AAABAAAACAABA"  # A 10, B 2, C 1
    df = spark.createDataFrame([(i, l, i + 1) for i, l in enumerate(labels)], "id long, label string, rank long")
    rows = sampling.stratified_subsample(df, 7).collect()
    taken = {l: sorted(r.id for r in rows if r.label == l) for l in "ABC"}
    assert len(rows) == 7
    assert (len(taken["A"]), len(taken["B"]), len(taken["C"])) == (4, 2, 1)
    assert taken["A"] == [0, 1, 2, 4]
    assert sampling.stratified_subsample(df, 13).count() == 13


@pytest.mark.parametrize("available,want", [(50, 5), (5, 1)])
def test_init_labelled_cap(spark, available, want):
    rows = [(i, "t", False, "A", None, None) for i in range(available)] + [(1000, "t", False, None, None, None)]
    ddl = "id long, description string, is_labelled boolean, label string, model_prediction string, uncertainty_score double"
    got = pool.init_labelled(spark.createDataFrame(rows, ddl), 100)
    assert got.filter("is_labelled").count() == want
    assert got.filter("id = 1000 and is_labelled").count() == 0


# --- stop rules ----------------------------------------------------------------------


def steps(spark, values, **columns):
    rows = [(i, 1, i, v) for i, v in enumerate(values, 1)]
    df = spark.createDataFrame(rows, "id long, run long, iteration_no int, selected_samples_avg_uncertainty double")
    for name, value in columns.items():
        df = df.withColumn(name, value)
    return df


def test_plateau_stops_at_the_fifth_iteration(spark):
    log = steps(spark, [0.50, 0.40, 0.395, None, 0.394])
    out = stopping.stop_plateau(log, eps=0.01, patience=2).orderBy("id").collect()
    assert [r.plateau for r in out] == [False, False, False, False, True]
    off = stopping.stop_plateau(log, eps=0.01, patience=0).collect()
    assert not any(r.plateau for r in off)


def test_budget_comes_before_iterations(spark):
    log = steps(spark, [0.5], plateau=F.lit(False), accuracy=F.lit(0.1), train_data_size=F.lit(100))
    out = stopping.stop_budget(log, label_budget=100, max_iterations=1).first()
    assert (out.stop, out.reason) == (True, "label_budget")
    none = stopping.stop_budget(log).first()
    assert (none.stop, none.reason) == (False, "continue")


def test_a_falling_accuracy_does_not_stop_the_classic_rule(spark):
    falling = steps(spark, [0.5, 0.5], accuracy=F.lit(0.5) - F.col("id") * 0.02, avg_uncertainty_pool=F.lit(0.4))
    out = stopping.stop_classic(falling, min_gain=0.05).orderBy("id").collect()
    assert [r.reason for r in out] == [None, None]
    rising = steps(spark, [0.5, 0.5], accuracy=F.lit(0.5) + F.col("id") * 0.02, avg_uncertainty_pool=F.lit(0.4))
    out = stopping.stop_classic(rising, min_gain=0.05).orderBy("id").collect()
    assert [r.reason for r in out] == [None, "improvement_below_I"]


# --- scalars -------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"macro_f1": 0.5}', {"macro_f1": 0.5}),
        ('  {"a": 1, "b": null}', {"a": 1.0, "b": None}),
        ('{"a": "word", "b": 2}', {"a": None, "b": 2.0}),
        ("", {}), ("nan", {}), ("not json", {}), (None, {}), ("[1]", {}), ('{"a": 1', {}), ("{'a': 1}", {}),
    ],
)
def test_parse_metrics(spark, text, want):
    df = spark.createDataFrame([(1, text)], "id long, metrics string")
    assert df.select(c.parse_metrics("metrics")).first()[0] == want
    named = runs.extract_metric(df, ["macro_f1", "b"]).first()
    assert (named.macro_f1, named.b) == (want.get("macro_f1"), want.get("b"))


def test_scalars(spark):
    one = spark.range(1)

    def value(col):
        return one.select(col).first()[0]

    assert value(c.label_code(F.lit("Other"), c.LABEL_SPACE)) == 3
    assert value(c.label_code(F.lit("other"), c.LABEL_SPACE)) is None
    assert value(c.label_name(F.lit(6), c.LABEL_SPACE)) == "Volunteer"
    assert value(c.label_name(F.lit(7), c.LABEL_SPACE)) is None
    assert value(c.truncate_tokens(F.lit("  a\tb\n\nc d "), 3)) == "a b c"
    assert value(c.normalize_probs(F.array(F.lit(1.0), F.lit(3.0)))) == [0.25, 0.75]
    assert value(c.normalize_probs(F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert value(c.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))) == [0.5, 0.5]
    assert value(c.model_name(F.lit("m (x) (y)"))) == "m"
    assert value(c.model_name(F.lit("m(x)"))) == "m(x)"
    assert value(c.model_name(F.lit(None).cast("string"))) == "unknown"
    assert [value(c.significance_stars(F.lit(p))) for p in (0.0005, 0.005, 0.02, 0.05)] == ["***", "**", "*", "ns"]
