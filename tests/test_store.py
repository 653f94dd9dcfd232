"""The pool store against the functions it follows, counts that add up, and the benchmark script."""

import json
import os
import math
import random
import subprocess
import sys

import pytest

from poolsift.operators import pool, scoring
from poolsift.operators.store import PoolStore

DDL = "id long, description string, is_labelled boolean, label string, model_prediction string, uncertainty_score double"
LABELS = ["A", "B", "C"]


def rows_of(df):
    return sorted(map(tuple, df.select(*pool.POOL_COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def base(spark):
    rows = [(i, f"text {i}", i % 5 == 0, "AB"[i % 2] if i % 3 else None, "1" if i % 4 == 0 else None, 0.5 if i % 4 == 0 else None) for i in range(30)]
    return spark.createDataFrame([*rows, rows[7], (None, "no id", False, "A", None, None), (None, None, False, None, None, None)], DDL)


@pytest.mark.parametrize("seed", range(3))
def test_store_follows_the_functions(spark, base, seed):
    """Random updates, some of unknown and repeated ids, with compactions at random."""
    rng = random.Random(seed)
    store, plain = PoolStore(base, 3), base
    for _ in range(5):
        kind, ids = rng.choice(["predictions", "labels", "flags"]), [rng.choice([*range(34), None]) for _ in range(12)]
        if kind == "predictions":
            new = spark.createDataFrame([(i, rng.choice(["0", "1", None]), rng.choice([0.1, 0.2, None])) for i in ids], "id long, model_prediction string, uncertainty_score double")
            store.save_predictions(new)
            plain = pool.save_predictions(plain, new)
        elif kind == "labels":
            new = spark.createDataFrame([(i, rng.choice(["A", "C", "", None])) for i in ids], "id long, label string")
            store.apply_labels(new)
            plain = pool.apply_labels(plain, new)
        else:
            new = spark.createDataFrame([(i,) for i in ids], "id long")
            store.mark_labelled(new)
            plain = pool.mark_labelled(plain, new)
        plain = spark.createDataFrame(plain.collect(), DDL)
        if rng.random() < 0.4:
            before = rows_of(store.read())
            store.compact()
            assert rows_of(store.read()) == before
    assert rows_of(store.read()) == rows_of(plain)
    store.drop()


def test_store_of_an_empty_pool(spark, base):
    store = PoolStore(base.limit(0), 2)
    store.mark_labelled(base)
    store.compact()
    assert store.read().count() == 0


def labelled(spark, start, n):
    rng = random.Random(start)
    rows = [(start + i, " ".join(rng.choices([f"{x}{k}" for k in range(6)] + ["all"], k=8)), True, x.upper(), None, None) for i in range(n) for x in [rng.choice("abc")]]
    return spark.createDataFrame(rows, DDL)


def test_counts_of_batches_equal_training_from_scratch(spark):
    counts, seen = None, None
    for start, n in ((0, 10), (100, 7), (200, 1), (300, 0)):
        batch = labelled(spark, start, n)
        seen = batch if seen is None else seen.unionByName(batch)
        counts = scoring.bayes_counts(batch, LABELS, 32) if counts is None else counts.plus(batch, LABELS)
        whole = scoring.train_hashed_bayes(seen, LABELS, 32)
        assert sorted(counts.model().logs.collect()) == sorted(whole.logs.collect())


def test_softmax_learns_and_does_not_depend_on_partitions(spark):
    train, test = labelled(spark, 0, 120), labelled(spark, 1000, 40)
    models = [scoring.train_classifier(train.repartition(k), LABELS, 64, 15, algorithm="softmax") for k in (1, 5)]
    first, second = ({r["bucket"]: [round(x, 9) for x in r["w"]] for r in m.weights.collect()} for m in models)
    assert first == second and len(first) == 65
    right = scoring.predict_many(test, models[0], LABELS).filter("label = predicted_label").count()
    assert right >= 38


def test_benchmark_prints_one_line(tmp_path):
    env = {**os.environ, "BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "2"}
    done = subprocess.run([sys.executable, "bench.py", "random_sampling"], capture_output=True, text=True, env=env, timeout=200)
    line = json.loads(done.stdout.strip().splitlines()[-1])
    assert done.returncode == 0 and list(line["queries"]) == ["random_sampling"] and line["sf"] == "0.001"


def test_softmax_steps_expand_no_words(spark, monkeypatch):
    plans, pin = [], scoring.pin

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return pin(df, name)

    train = labelled(spark, 0, 30)
    monkeypatch.setattr(scoring, "pin", noted)
    model = scoring.train_softmax(train, LABELS, 16, steps=2)
    steps = [text for name, text in plans if name == "softmax_weights"][1:]
    scored = scoring.predict_many(train, model, LABELS)._jdf.queryExecution().executedPlan().toString()
    assert len(steps) == 2 and not any("Generate" in text for text in steps)
    assert "md5" not in scored


def test_softmax_hashes_odd_texts_as_the_columns_do(spark):
    odd = ["", " \t", "a a\x0bb\n\rA  ÉÀ", "ΣΑΣ İ x", None, "w " * 3000 + "end", "x\x00y\x1fz", "日本 語"] * 150
    rows = spark.createDataFrame([(i, x, "A") for i, x in enumerate(odd)], "id long, description string, label string")
    train = labelled(spark, 0, 60).select("id", "description", "label")
    model = scoring.train_softmax(train.unionByName(rows.filter("id < 8")), LABELS, 32, steps=3)
    got = {r["id"]: r["probs"] for r in scoring.predict_many(rows, model, LABELS).collect()}
    table, logits = model.table().first()["_table"], {}
    for r in rows.select("id", scoring.hashed_words("description", 32).alias("b")).collect():
        sums = [sum(table[b][k] for b in r["b"]) / max(1, len(r["b"])) ** 0.5 + table[32][k] for k in range(len(LABELS))]
        logits[r["id"]] = [math.exp(x) for x in sums]
    assert len(got) == len(odd)
    for i, e in logits.items():
        assert got[i] == pytest.approx([x / sum(e) for x in e])
