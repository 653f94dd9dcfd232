"""The registered queries and the pipeline on the smallest tables."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from check import compare, connect
from poolsift.llm.queries import ORACLES, QUERIES
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    problem, _ = compare(spark, connect(FOLDER), FOLDER, name)
    assert problem is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_document_is_there(spark, docs, name):
    ids = Counter(r["doc_id"] for r in QUERIES[name](spark, FOLDER).select("doc_id").collect())
    assert set(ids) == set(docs) and (name == "op2_packing" or set(ids.values()) == {1})


def test_simhash_components(spark, docs):
    ids = sorted(docs)
    groups = brute.near_groups([brute.fingerprint(docs[i]) for i in ids])
    least = {g: min(i for i, h in zip(ids, groups) if h == g) for g in groups}
    rows = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op5_simhash"](spark, FOLDER).collect()}
    assert rows == {i: (f"{brute.fingerprint(docs[i]):016x}", least[g]) for i, g in zip(ids, groups)}


def test_held_out_flags(spark):
    for name, modulus, value in (("op3_quality", 3, 1), ("op10_toxicity", 3, 1), ("op8_ctw", 7, 2)):
        for r in QUERIES[name](spark, FOLDER).collect():
            assert r["held_out"] == (brute.remainder(r["doc_id"], modulus) == value)


def test_pipeline_against_brute_force(spark, docs, tmp_path):
    toxic = {r["doc_id"] for r in QUERIES["op10_toxicity"](spark, FOLDER).collect() if r["predicted"]}
    civil = {i: t for i, t in sorted(docs.items()) if i not in toxic}
    fresh = brute.kept_texts(civil.items())
    assert not brute.repeated_fifty(civil.items(), fresh)
    ids = sorted(fresh)
    groups = brute.near_groups([brute.fingerprint(fresh[i]) for i in ids])
    first = {}
    for i, g in zip(ids, groups):
        first.setdefault(g, i)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = {i: fresh[i] for i in first.values() if not brute.contamination(fresh[i], bench)[1]}
    expect = [civil, fresh, {i: fresh[i] for i in first.values()}, kept]
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = table.columns
    for k, ((name, stage), want) in enumerate(zip(corpus_pipeline.STAGES, expect)):
        stage(spark, table, FOLDER).write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
        assert table.columns == columns
        rows = table.collect()
        assert len(rows) == len(want) and {r["doc_id"]: r["text"] for r in rows} == want, name
        assert all(r["n_chars"] == len(r["text"]) for r in rows) or k == 0
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    length = defaultdict(int)
    for r in pieces:
        length[r["doc_id"]] += r["length"]
    assert set(length) == set(kept) and all(length[r["doc_id"]] == r["doc_tokens"] for r in pieces)
