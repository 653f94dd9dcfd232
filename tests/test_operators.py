"""Properties of state changes, sampling, selection and sources on small inputs."""

import hashlib
import math
import re
import shutil
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from poolsift.functions import tails
from poolsift.operators import pool as P
from poolsift.operators import sampling as S
from poolsift.operators import scoring, selection, similarity
from poolsift.session import fresh_path
from poolsift.sources import files

DDL = "id long, description string, is_labelled boolean, label string, model_prediction string, uncertainty_score double"
LABELS = ["A", "B", "C"]


@pytest.fixture(scope="module")
def pool(spark):
    """A: 70 %, B: 20 %, C: 10 %, with rows lacking a text or a label."""
    rows = []
    for i in range(300):
        label = "A" if i % 10 < 7 else "B" if i % 10 < 9 else "C"
        text = None if i == 4 else "" if i == 5 else "  " if i == 6 else f"text {i}"
        score = None if i % 4 == 0 else (i * 7 % 50) / 50
        rows.append((i, text, i % 5 == 0, None if i == 8 else "" if i == 9 else label, None, score))
    return spark.createDataFrame(rows, DDL).repartition(5).cache()


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


# --- state ---------------------------------------------------------------------------


def test_missing_texts_and_labels_are_not_usable(pool):
    assert {4, 5, 8, 9}.isdisjoint(ids(P.usable(pool)))
    assert 6 in ids(P.usable(pool))
    assert P.unlabelled_count(pool).first()[0] == len(ids(P.unlabelled_with_labels(pool)))


def test_pages_cover_everything_once(pool):
    whole = ids(P.unlabelled_rows(pool))
    paged = [i for k in range(0, 300, 64) for i in ids(P.unlabelled_page(pool, 64, k))]
    assert paged == whole
    assert ids(P.unlabelled_page(pool, None, 200)) == whole[200:]


def test_hidden_labels_are_not_labelled(pool):
    assert all(i % 5 == 0 for i in ids(P.labelled_rows(pool)))


def test_apply_labels_ignores_missing_ones(spark, pool):
    new = spark.createDataFrame([(1, "Z"), (2, None), (3, ""), (9999, "Z")], "id long, label string")
    got = {r.id: (r.is_labelled, r.label) for r in P.apply_labels(pool, new).collect()}
    assert len(got) == 300
    assert got[1] == (True, "Z") and got[2] == (False, "A") and got[3] == (False, "A")


def test_save_predictions_replaces_with_nulls_too(spark, pool):
    new = spark.createDataFrame([(1, None, None), (2, 5, 0.25)], "id long, model_prediction int, uncertainty_score double")
    got = {r.id: (r.model_prediction, r.uncertainty_score) for r in P.save_predictions(pool, new).collect()}
    assert got[1] == (None, None) and got[2] == ("5", 0.25) and got[3] == (None, 21 / 50)


def test_mark_and_reset(spark, pool):
    marked = P.mark_labelled(pool, spark.createDataFrame([(1,), (2,)], "id long"))
    assert set(ids(marked.filter("is_labelled"))) == {1, 2} | {i for i in range(300) if i % 5 == 0}
    reset = P.reset_pool(marked, clear_predictions=False)
    assert reset.filter("is_labelled or label is not null").count() == 0
    assert reset.filter("uncertainty_score is not null").count() == 225
    assert P.reset_counts(pool).first() == (299, 225)


@pytest.mark.parametrize("size", [dict(fraction=0.2), dict(test_size=33), dict(test_size=10_000), dict(fraction=0.0)])
def test_split_parts_are_disjoint_and_complete(pool, size):
    test, rest = P.split_test(pool, **size)
    a, b = ids(test), ids(rest)
    assert sorted(a + b) == list(range(300))
    usable = len(ids(P.usable(pool)))
    assert len(a) == (int(usable * size["fraction"]) if "fraction" in size else min(size["test_size"], usable))
    assert "moved_at" in test.columns


def test_upsert_keeps_the_latest(spark):
    rows = [(0, 1, 5, 1), (0, 1, 7, 3), (0, 1, 6, 2), (1, 1, 4, 1)]
    got = P.committee_upsert(spark.createDataFrame(rows, "member int, id long, predicted_class int, seq long"))
    assert sorted(map(tuple, got.collect())) == [(0, 1, 7), (1, 1, 4)]


def test_label_rejects(pool):
    got = {r.label: (r.dropped, r.dropped_in_all) for r in P.label_rejects(pool, ["A"]).collect()}
    assert got == {"B": (59, 88), "C": (29, 88)}


# --- sampling ------------------------------------------------------------------------


def test_random_sampling_takes_all_of_a_small_pool(pool):
    open_ids = ids(P.unlabelled_rows(pool).filter("description <> ''"))
    assert ids(S.random_sampling(pool, 10**6)) == open_ids
    assert set(ids(S.random_sampling(pool, 20))) < set(open_ids)
    assert ids(S.random_sampling(pool, 20, 1)) != ids(S.random_sampling(pool, 20, 2))


def test_fallback_only_when_empty(pool):
    some = pool.limit(3)
    assert S.fallback_random(some, pool, 5).count() == 3
    assert S.fallback_random(pool.filter("id < 0"), pool, 5).count() == 5


@pytest.mark.parametrize("parts", [1, 7])
def test_balance_min_class(pool, parts):
    got = S.balance_min_class(pool.repartition(parts), LABELS)
    assert Counter(r.label for r in got.collect()) == {"A": 29, "B": 29, "C": 29}
    assert 6 not in ids(got)


def test_an_empty_class_is_an_error(pool):
    with pytest.raises(Exception, match="no rows for label D"):
        S.balance_min_class(pool, [*LABELS, "D"]).collect()


def test_labels_are_stored_stripped(spark):
    df = spark.createDataFrame([(1, "x", " A\n"), (2, "y", "B")], "id long, description string, label string")
    assert sorted(r.label for r in S.balance_min_class(df, ["A", "B"]).collect()) == ["A", "B"]


def test_balance_fixed_draws_with_replacement(pool):
    rows = S.balance_fixed(pool, LABELS, 100).collect()
    assert Counter(r.label for r in rows) == {"A": 100, "B": 100, "C": 100}
    assert all(r.draw is None for r in rows if r.label == "A")
    short = [r for r in rows if r.label == "C"]
    assert sorted(r.draw for r in short) == list(range(1, 101))
    assert len({r.id for r in short}) <= 30
    again = S.balance_fixed(pool.repartition(3), LABELS, 100).collect()
    assert sorted((r.id, r.draw or 0) for r in rows) == sorted((r.id, r.draw or 0) for r in again)


def test_balance_intelligent_counts_follow_the_quotas(pool):
    counts = Counter(r.label for r in S.balance_intelligent(pool, LABELS, 120).collect())
    assert sum(counts.values()) == 120
    assert counts["C"] == 29 and counts["B"] == 59


def test_balanced_usable(pool):
    assert S.balanced_usable(pool, LABELS, 10).first().usable
    assert not S.balanced_usable(pool, LABELS, 1000).first().usable
    assert not S.balanced_usable(pool, [*LABELS, "D"], 10).first().usable


def test_folds_are_even_and_stratified(pool):
    sizes = Counter(r.fold for r in S.kfold(pool, 7).collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 7
    per = Counter((r.label, r.fold) for r in S.stratified_kfold(pool, 5).collect())
    for label in LABELS:
        of = [n for (l, _), n in per.items() if l == label]
        assert max(of) - min(of) <= 1


def test_train_test_split_rounds_up(pool):
    parts = Counter(r.part for r in S.train_test_split(pool, 0.333).collect())
    assert parts == {"test": 100, "train": 200}


# --- selection -----------------------------------------------------------------------


def test_uncertainty_order_and_subset(pool):
    rows = selection.uncertainty_sampling(pool, 40).orderBy("rank").collect()
    keys = [(-r.uncertainty_score, r.id) for r in rows]
    assert len(rows) == 40 and keys == sorted(keys)
    assert not any(r.is_labelled for r in rows)


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, [float(i % 6) * 10 + (i % 7) / 10, float(i % 3) * 10, (i % 5) / 10]) for i in range(300)]
    return spark.createDataFrame(rows, "id long, embedding array<double>")


def test_diversity_gives_one_row_per_cluster(pool, vectors):
    got = selection.diversity_sampling(pool, vectors, 6)
    assert got.count() == 6 and set(ids(got)) <= set(ids(P.usable(P.unlabelled_rows(pool))))
    small = selection.diversity_sampling(pool.filter("id < 12"), vectors, 50)
    assert ids(small) == ids(P.unlabelled_with_labels(pool.filter("id < 12")))


def test_clusters_of_a_coreset_cost_little_more_than_k_means(spark):
    draw = np.random.default_rng(3)
    blobs = draw.normal(0, 4, (40, 8))
    rows = [(i, [float(x) for x in blobs[i % 40] + draw.normal(0, 1, 8)]) for i in range(8000)]
    points = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)
    k = 100
    sample = selection.coreset(points, selection.PER_CENTRE * k)
    assert sample.count() == selection.PER_CENTRE * k
    assert abs(sample.agg(F.sum("weight")).first()[0] / 8000 - 1) < 0.1
    near = selection.assign(points, selection.weighted_centres(sample, k, passes=8), k)
    assert near.count() == 8000
    plain = KMeans(featuresCol="_v", k=k, seed=1, maxIter=8).fit(points.select(array_to_vector("embedding").alias("_v")))
    cost = near.agg(F.sum("far")).first()[0]
    print("cost against plain k-means", cost / plain.summary.trainingCost)
    assert cost <= 1.05 * plain.summary.trainingCost


def test_diversity_with_copies_and_missing_vectors(spark):
    pool = spark.createDataFrame([(i, "t", False, "X", None, None) for i in range(40)], DDL)
    same = spark.createDataFrame([(i, [1.0, 2.0] if i < 30 else None) for i in range(40)], "id long, embedding array<double>")
    got = ids(selection.diversity_sampling(pool, same, 7))
    assert len(got) == len(set(got)) == 7 and max(got) < 30
    assert ids(selection.diversity_sampling(pool, same, 30)) == list(range(30))
    assert ids(selection.diversity_sampling(pool, same.filter("id < 0"), 3)) == []


def test_nearest_takes_the_lowest_id_on_ties(spark):
    points = spark.createDataFrame([(3, 0, [1.0]), (2, 0, [-1.0]), (9, 1, [5.0])], "id long, cluster int, embedding array<double>")
    centres = spark.createDataFrame([(0, [0.0]), (1, [0.0]), (2, [0.0])], "cluster int, centre array<double>")
    got = {r.cluster: r.id for r in selection.nearest_to_centroid(points, centres).collect()}
    assert got == {0: 2, 1: 9}


def test_column_similarity(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0], [1.0, 0.0], [0.0, 1.0]), (2, [1.0, 0.0], None, [1.0, 0.0]), (3, [1.0, 0.0], [1.0, 1.0], [0.0, 2.0])],
        "id long, t array<double>, a array<double>, b array<double>",
    )
    got = [(r.column_name, round(r.similarity, 6)) for r in similarity.column_similarity(df, "t", ["a", "b"]).collect()]
    assert got == [("a", 0.853553), ("b", 0.0)]
    assert similarity.column_similarity(df, "t", ["a", "b"], limit=1).first().similarity == 1.0
    flat = spark.createDataFrame([(1, [0.0], [1.0])], "id long, t array<double>, a array<double>")
    assert similarity.column_similarity(flat, "t", ["a"]).first().similarity == 0.0


# --- scoring -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def texts(spark):
    words = {"A": "apple pear plum", "B": "car bus train", "C": "red green blue"}
    rows = [(i, f"{words[l]} {l.lower()}{i}", True, l, None, None) for i, l in enumerate("AAABBBCCC" * 5)]
    return spark.createDataFrame(rows, DDL).cache()


@pytest.mark.parametrize("algorithm", ["logistic", "bayes"])
def test_classifier_learns(texts, algorithm):
    model = scoring.train_classifier(texts, LABELS, features=256, algorithm=algorithm)
    rows = scoring.predict_many(texts, model, LABELS).collect()
    assert all(r.predicted_label == r.label for r in rows)
    assert all(abs(sum(r.probs) - 1) < 1e-9 and r.confidence == max(r.probs) for r in rows)


def test_a_class_without_rows_has_probability_zero(texts):
    model = scoring.train_classifier(texts.filter("label <> 'C'"), LABELS, features=64)
    assert all(len(r.probs) == 3 and r.probs[2] == 0 for r in scoring.predict_many(texts, model, LABELS).collect())


def test_class_weights(texts):
    got = {r.label: r.weight for r in scoring.class_weights(texts, [*LABELS, "D"]).collect()}
    assert got == {"A": 3.0, "B": 3.0, "C": 3.0, "D": 45.0}


def test_model_predict_scores_only_open_rows(texts):
    model = scoring.train_classifier(texts, LABELS, features=64)
    pool = texts.withColumn("is_labelled", F.col("id") < 10)
    got = scoring.model_predict(pool, model, LABELS, max_samples=7).filter("model_prediction is not null")
    assert ids(got) == list(range(10, 17))


def test_committee_skips_a_broken_member(texts):
    def broken():
        raise OSError("gone")

    model = scoring.train_classifier(texts, LABELS, features=64)
    got = scoring.committee_predict(texts, {"x": model, "y": broken, "z": lambda: model}, LABELS)
    assert Counter(r.member for r in got.collect()) == {"x": 45, "z": 45}
    with pytest.raises(ValueError):
        scoring.committee_predict(texts, {"y": broken}, LABELS)


def test_embeddings_are_unit_vectors(texts):
    for r in scoring.embed_text(texts, 64).collect():
        assert sum(x * x for x in r.embedding) == pytest.approx(1)


def test_embeddings_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one two two"), (None, "three"), (4, "one two two"), (5, "word " * 50_000 + "end")]
    got = scoring.embed_text(spark.createDataFrame(rows, "id long, description string"), 16).collect()
    assert sorted((r.id is None, r.id or 0) for r in got) == [(False, 3), (False, 4), (False, 4), (False, 5), (True, 0)]
    assert all(len(r.embedding) == 16 for r in got) and {sum(r.embedding) for r in got if r.id == 3} == {0.0}
    assert len({tuple(r.embedding) for r in got if r.id == 4}) == 1
    assert scoring.embed_text(spark.createDataFrame([], "id long, description string"), 16).count() == 0


def test_embedding_hashes_no_words_as_columns(texts):
    plan = scoring.embed_text(texts, 64)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "md5" not in plan and "Subquery" not in plan


def test_embedding_equals_its_words_one_by_one(spark):
    odd = ["one two two", "a a\x0bb\n\rA  ÉÀ", "ΣΑΣ x", "日本 語\tone", "y\x1fz one two", " \t "]
    rows = spark.createDataFrame([(i, odd[i % 6]) for i in range(2500)], "id long, description string")
    words = [[w for w in re.split("[ \t\n\r]+", x.lower()) if w] for x in odd]
    digest = {w: hashlib.md5(w.encode()).hexdigest() for x in words for w in x}
    copies = [sum(1 for i in range(2500) if i % 6 == k) for k in range(6)]
    cells = {w: int(h[:6], 16) % 97 for w, h in digest.items()}
    seen = Counter()
    for k, x in enumerate(words):
        seen.update({c: copies[k] for c in {cells[w] for w in x}})
    want = []
    for x in words:
        vector = [0.0] * 16
        for w in x:
            vector[int(digest[w][6:12], 16) % 16] += (1 - 2 * (int(digest[w][12], 16) % 2)) * round(1e6 * math.log(2501 / (seen[cells[w]] + 1)))
        norm = math.sqrt(sum(v * v for v in vector))
        want.append([v / norm if norm else 0.0 for v in vector])
    got = {r.id: r.embedding for r in scoring.embed_text(rows, 16, 97).collect()}
    assert len(got) == 2500 and all(got[i] == pytest.approx(want[i % 6]) for i in got)


# --- sources -------------------------------------------------------------------------

NASTY = ['say "hi"', "two\nlines", "comma, tab\t", " blanks ", "back\\slash", "carriage\r\nreturn", "ünïcode"]


def test_csv_round_trip_keeps_every_character(spark):
    df = spark.createDataFrame([(str(i), t, "A") for i, t in enumerate(NASTY)], "job_id string, description string, formatted_work_type string")
    path = fresh_path(spark, "postings.csv")
    files.write_csv(df, path)
    got = {r.job_id: r.description for r in files.read_postings_csv(spark, path).collect()}
    assert got == {str(i): t for i, t in enumerate(NASTY)}


def test_missing_column_raises(spark):
    path = fresh_path(spark, "postings.csv")
    files.write_csv(spark.createDataFrame([("1", "x")], "job_id string, description string"), path)
    with pytest.raises(KeyError, match="formatted_work_type"):
        files.read_postings_csv(spark, path)


@pytest.mark.parametrize("name,sep", [("r.csv", ","), ("r.tsv", "\t"), ("r.log", ","), ("r.out", "\t")])
def test_results_by_extension(spark, name, sep):
    path = fresh_path(spark, name)
    row = spark.createDataFrame([(1, "7", '{"accuracy": 0.5, "x": 1}')], "id long, test_id string, metrics string")
    files.write_csv(row, path, sep)
    got = files.read_results(spark, path, "id long, test_id string, metrics string").first()
    assert tuple(got) == (1, "7", '{"accuracy": 0.5, "x": 1}')


def test_hashed_members_share_one_reading(texts, monkeypatch):
    models = {
        0: scoring.train_hashed_bayes(texts, LABELS, 64),
        1: scoring.train_softmax(texts, LABELS, 32, steps=2),
        2: scoring.train_hashed_bayes(texts, LABELS, 16),
    }
    short = scoring.HashedBayes(models[0].logs.filter("bucket < 60"), 64, len(LABELS))
    want = {}
    for member, model in models.items():
        for r in scoring.predict_many(texts, model, LABELS).collect():
            want[r.id, member] = (r.predicted_class, [round(p, 9) for p in r.probs])
    names, pin = [], scoring.pin
    monkeypatch.setattr(scoring, "pin", lambda df, name: names.append(name) or pin(df, name))
    got = scoring.committee_predict(texts, {**models, 3: short}, LABELS)
    assert {(r.id, r.member): (r.predicted_class, [round(p, 9) for p in r.probs]) for r in got.collect()} == want
    assert names.count("members") == 1 and "member" not in names


def test_jsonl_skips_broken_lines(spark):
    path = fresh_path(spark, "x.jsonl")
    spark.createDataFrame([('{"a": 1}',), ("{oops",), ('{"a": 2, "b": 3}',)], "value string").write.text(path)
    assert sorted(r.a for r in files.read_jsonl(spark, path, "a long").collect()) == [1, 2]


def test_log_numbering(spark):
    empty = spark.createDataFrame([], files.RESULTS_SCHEMA)
    assert files.next_test_id(empty).first()[0] == 1
    one = files.results_append(empty, {"test_id": "12", "metrics": {"accuracy": 0.5}, "iteration_no": 0})
    two = files.results_append(one, {"test_id": "exp-99"})
    assert [(r.id, r.test_id, r.metrics) for r in two.orderBy("id").collect()] == [(1, "12", '{"accuracy":0.5}'), (2, "exp-99", None)]
    assert files.next_test_id(two).first()[0] == 13


def test_pool_ids_are_dense_in_key_order(spark):
    rows = [(str(k), None if k == 30 else "t", "" if k == 10 else "A") for k in (100, 20, 30, 9, 10)]
    got = files.pool_from_postings(spark.createDataFrame(rows, "job_id string, description string, formatted_work_type string"))
    assert ids(got) == [1, 2, 3] and got.filter("is_labelled").count() == 0


def test_hash_order_is_md5_of_seed_and_id(spark):
    want = sorted(range(50), key=lambda i: hashlib.md5(f"9:{i}".encode()).hexdigest())[:10]
    assert ids(S.sample_n(spark.range(50), 10, 9)) == sorted(want)


def test_repeated_ids_do_not_repeat_rows(spark):
    pool = spark.createDataFrame([(1, "a", False, "X", None, None), (2, "b", False, "Y", None, None)], DDL)
    scores = spark.createDataFrame([(1, "0", 0.2), (1, "1", 0.4)], "id long, model_prediction string, uncertainty_score double")
    assert {r.id: r.model_prediction for r in P.save_predictions(pool, scores).collect()} == {1: "1", 2: None}
    labels = spark.createDataFrame([(1, "A"), (1, "B")], "id long, label string")
    assert P.apply_labels(pool, labels).count() == 2 and P.mark_labelled(pool, labels).count() == 2


def test_nan_scores_are_no_scores(spark):
    pool = spark.createDataFrame([(1, "a", False, "X", "0", float("nan")), (2, "b", False, "Y", "0", 0.3)], DDL)
    assert [r.id for r in selection.uncertainty_sampling(pool, 1).collect()] == [2]


def test_folds_keep_rows_without_an_id(spark):
    rows = spark.createDataFrame([(1, "X"), (None, "X"), (None, None), (2, None)], "id long, label string")
    for folds in (S.kfold(rows, 2), S.stratified_kfold(rows, 2)):
        assert folds.count() == 4 and folds.filter("fold is null").isEmpty()


def test_folds_are_ranges_of_the_seeded_order(spark):
    rows = [(i, "abc"[min(i % 7, 2)] if i % 11 else None) for i in range(203)]
    df = spark.createDataFrame(rows, "id long, label string").repartition(5)
    for k in (1, 2, 5, 300):
        plain = defaultdict(list)
        for i, label in rows:
            plain[label].append((hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
        whole = sorted(x for xs in plain.values() for x in xs)
        for folds, lists in ((S.kfold(df, k), [whole]), (S.stratified_kfold(df, k), [sorted(xs) for xs in plain.values()])):
            want = {}
            for xs in lists:
                size, more = divmod(len(xs), k)
                ends = [j * size + min(j, more) for j in range(1, k + 1)]
                want |= {i: next(j for j, e in enumerate(ends) if at < e) for at, (_, i) in enumerate(xs)}
            assert {r.id: r.fold for r in folds.collect()} == want
    assert S.stratified_kfold(df.filter("id < 0"), 3).count() == 0 and S.kfold(df.filter("id < 0"), 3).count() == 0


def test_tails_without_degrees_of_freedom(spark):
    tail = tails.t_tail(F.lit(2.0), F.lit(0.0))
    assert spark.range(1).select(tail.alias("p")).first().p is None


def test_log_is_read_by_name(spark, tmp_path):
    path = str(tmp_path / "log.csv")
    (tmp_path / "log.csv").write_text('method,id,extra,metrics,train_data_size\nA,7,x,"{""accuracy"": 0.5}",many\n')
    row = files.read_results(spark, path).first()
    assert (row.id, row.method, row.metrics, row.train_data_size, row.extra, row.test_id) == (7, "A", '{"accuracy": 0.5}', None, "x", None)


def test_append_writes_one_row(spark, tmp_path):
    path = str(tmp_path / "log.parquet")
    spark.createDataFrame([], files.RESULTS_SCHEMA).write.parquet(path)
    for k in (1, 2):
        log = files.append_to_log(spark, path, {"test_id": str(k)})
    assert sorted((r.id, r.test_id) for r in log.collect()) == [(1, "1"), (2, "2")]


HARD_CSV = [
    ("1", "plain", "A"),
    ("2", "two\nlines", "B"),
    ("3", 'a "quoted" word\n\n"and" one more', "C"),
    ("4", "", "A"),
    ("5", None, "A"),
    ("6", "comma, and ends in a break\n", "B"),
    ("7", '"', "C"),
    ("8", '""\n"', "C"),
    ("9", "x,y\n1,2,3\n" * 40, "A"),
    ("10", "Grüße 漢字 😀\nzwei", "B"),
    ("11", " blanks stay ", "B"),
    ("12", "cr\r\nlf", "B"),
]


@pytest.mark.parametrize("size", [61, 333, 1 << 20])
def test_quoted_csv_in_ranges_of_any_size(spark, tmp_path, size):
    def cell(v, quoted):
        return "" if v is None else '"' + v.replace('"', '""') + '"' if quoted or set(v) & set(',\n"\r') or v == "" else v

    for name, quoted, close in (("a", True, "\n"), ("b", False, ""), ("c", False, "\n\n")):
        rows = [*HARD_CSV, *HARD_CSV[::-1]]
        text = "job_id,description,formatted_work_type\n" + "\n".join(",".join(cell(v, quoted) for v in r) for r in rows) + close
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    (tmp_path / "d.csv").write_text("job_id,description,formatted_work_type\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        for chosen in ("a.csv", "b.csv", "c.csv", "d.csv", ""):
            path = f"{tmp_path}/{chosen}"
            got = Counter(map(tuple, files.read_postings_csv(spark, path).collect()))
            whole = Counter(map(tuple, files.read_postings_csv(spark, path, split=False).collect()))
            assert got == whole
            # empty cells read as null
            assert chosen == "d.csv" or set(got) == {(k, text or None, label) for k, text, label in HARD_CSV}
        if size == 333:
            assert spark.read.text(f"{tmp_path}/a.csv").rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_writers_of_one_log_take_different_ids(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log.parquet")
    files.results_append(spark.createDataFrame([], files.RESULTS_SCHEMA), {"id": 5, "test_id": "0"}).write.parquet(path)
    claim, between = files._claim, []

    def late(fs, folder, number):  # another writer appends after this one has read the log
        if not between:
            between.append(number)
            files.append_to_log(spark, path, {"test_id": "b"})
        return claim(fs, folder, number)

    monkeypatch.setattr(files, "_claim", late)
    files.append_to_log(spark, path, {"test_id": "a"})
    want = [(5, "0"), (6, "b"), (7, "a")]
    assert sorted((r.id, r.test_id) for r in files.read_log(spark, path).collect()) == want
    with ThreadPoolExecutor(4) as many:
        list(many.map(lambda k: files.append_to_log(spark, path, {"test_id": str(k)}).count(), range(4)))
    rows = files.read_log(spark, path).collect()
    assert len({r.id for r in rows}) == len(rows) == 7 and {r.test_id for r in rows} == {"0", "a", "b", "0", "1", "2", "3"}
    before = sorted(map(str, rows))
    old = [p for p in (tmp_path / "log.parquet").iterdir() if p.name.startswith("row-")]
    assert len(old) == 6 and sorted(map(str, files.compact_log(spark, path).collect())) == before
    shutil.copy(next((tmp_path / "log.parquet").glob("rows-*")), tmp_path / "log.parquet" / "row-again.parquet")
    assert sorted(map(str, files.read_log(spark, path).collect())) == before
    assert files.append_to_log(spark, path, {"test_id": "z"}).agg({"id": "max"}).first()[0] == max(r.id for r in rows) + 1


def test_batches_are_fetched_without_shuffling_texts(spark):
    texts = spark.range(50).select("id", F.lit("text").alias("description"), F.lit("X").alias("label"))
    flags = spark.range(10).withColumn("is_labelled", F.lit(True))
    scores = spark.range(50).select("id", F.lit("0").alias("model_prediction"), (F.col("id") / 50).alias("uncertainty_score"))
    joined = texts.join(flags, "id", "left").na.fill({"is_labelled": False}).join(scores, "id", "left")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chosen = selection.uncertainty_sampling(joined, 5)
        plan = chosen._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(r.id for r in chosen.collect()) == [45, 46, 47, 48, 49]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert all(f"{k}" in line for line in plan.split("\n") if "Filter id" in line for k in range(45, 50))
    assert plan.index("LeftOuter") < plan.index("Filter id")
