"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsift.llm import (
    alignment,
    ctw,
    decontamination,
    license_scan,
    line_dedup,
    packing,
    quality_gam,
    quality_rules,
    resampling,
    sharding,
    simhash,
    token_counts,
    toxicity,
)
from poolsift.llm.labelled import learnable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and licence notices of every text; base places are exact spans of the scan."""
    found = license_scan.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["exact"])
    starts = F.transform(base, lambda s: s["first"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        license_scan.labels_of(base).alias("base_labels"),
        license_scan.labels_of(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in the training sequences."""
    return packing.pack(_table(spark, sf_dir, "documents")).drop("row", "ids")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text; learned from labels of ids that are not held out."""
    found = quality_gam.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", (~learnable()).alias("held_out"), "score", "predicted")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"].cast("string"))))
    items = F.coalesce(F.array_compact(items), F.array().cast("array<string>"))
    hit = decontamination.hit_words("spans")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the learned rules on every text."""
    found = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select(*base, "rule")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without its repeated passages, with the number of lines and of removed ones."""
    done = line_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", "text")


def op8_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and context-tree log-probabilities of every text, and its code length per byte."""
    docs = _table(spark, sf_dir, "documents")
    found = ctw.scores(docs, docs.filter(~ctw.held_out()))
    bits = -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")
    return found.withColumns({"held_out": ctw.held_out(), "bits_per_byte": bits}).drop("row")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every row; row counts differ by one at most."""
    placed = sharding.assign(_table(spark, sf_dir, "documents"))
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every text; learned from labels of ids that are not held out."""
    found = toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", (~learnable()).alias("held_out"), "score", "predicted")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between two tokenizers in every text, scored by the corpus's counts of id pairs."""
    return alignment.align(_table(spark, sf_dir, "documents"))[0]


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of every text for the benchmark's distribution, and the rank of the drawn tenth."""
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_license": op1_license,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_decontamination": op4_decontamination,
    "op5_simhash": op5_simhash,
    "op6_quality_rules": op6_quality_rules,
    "op7_line_dedup": op7_line_dedup,
    "op8_ctw": op8_ctw,
    "op9_sharding": op9_sharding,
    "op10_toxicity": op10_toxicity,
    "op11_alignment": op11_alignment,
    "op12_token_counts": op12_token_counts,
    "op13_resampling": op13_resampling,
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _license_sql() -> str:
    """The scan again: pairs by text instead of hash, diagonals merged by a running sum."""
    rows = license_scan.pair_table()
    values = ", ".join(f"('{label}', {exact}, {pairs}, {place}, '{a} {b}')" for label, exact, pairs, place, a, b in rows)
    return rf"""
        with t(label, exact, pairs, place, pair) as (values {values}),
        w as (select doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
        p as (select doc_id, i - 1 as place_at, ws[i] || ' ' || ws[i + 1] pair from (select *, unnest(range(1, len(ws))) i from w)),
        v as (select doc_id, label, exact, pairs, place, place_at, place_at - place as diagonal from p join t using (pair)),
        f as (
          select *, case when diagonal - lag(diagonal) over o <= case when exact then 0 else {license_scan.DRIFT} end then 0 else 1 end fresh
          from v window o as (partition by doc_id, label order by diagonal, place_at)),
        g as (
          select *, sum(fresh) over (partition by doc_id, label order by diagonal, place_at rows unbounded preceding) as copy_no from f),
        c as (
          select doc_id, label, exact, min(place_at) as begins, count(distinct place) / any_value(pairs) as cover
          from g group by doc_id, label, exact, copy_no),
        s as (select * from c where cover >= case when exact then 1 else {license_scan.COVER} end)
        select w.doc_id, cast(len(any_value(ws)) as bigint) n_words, count(begins) filter (exact) as n_base,
               cast(min(begins) filter (exact) as bigint) as first_word, cast(max(begins) filter (exact) as bigint) as last_word,
               coalesce(string_agg(distinct label, ',' order by label) filter (exact), '') base_labels,
               coalesce(string_agg(distinct label, ',' order by label), '') labels, coalesce(max(cover), 0.0) score
        from w left join s using (doc_id) group by w.doc_id
    """


ORACLES = {
    "op1_license": _license_sql(),
    "op4_decontamination": r"""
        with w as (
          select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws
          from documents),
        b as (
          select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws
          from benchmark),
        bw as (
          select distinct item_id, least(10, len(ws)) n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') gram
          from (select *, unnest(range(1, greatest(1, len(ws) - 9) + 1)) i from b where len(ws) > 0)),
        sizes as (select distinct n from bw),
        dw as (
          select doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') gram
          from (select *, unnest(range(1, len(ws) - n + 2)) i from w, sizes where len(ws) >= n)),
        hits as (select doc_id, i, n, item_id from dw join bw using (n, gram)),
        placed as (select distinct doc_id, unnest(range(i, i + n)) p from hits),
        counts as (select doc_id, count(*) n_hit from placed group by doc_id),
        items as (
          select doc_id, count(distinct item_id) n_items,
                 string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) ids
          from hits group by doc_id)
        select w.doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit,
               cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(ids, '')) items_sha256,
               coalesce(n_hit, 0) > 0 contaminated
        from w left join counts using (doc_id) left join items using (doc_id)
    """,
    # CRC-32 of the distinct words by a table of 256 remainders, byte by byte
    "op13_resampling": rf"""
        with recursive steps(k, i, c) as (
          select 0, i, i from range(256) r(i)
          union all
          select k + 1, i, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where k < 8),
        remainders as (select list(c order by i) t from steps where k = 8),
        d as (select doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
        b as (select regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
        dw as (select doc_id, unnest(ws) w from d),
        bw as (select unnest(ws) w from b),
        own as (select w, hex(encode(w)) h from (select w from dw union select w from bw)),
        crcs as (
          select w, xor(list_reduce(
              list_prepend(4294967295::bigint, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::bigint)),
              lambda acc, x: xor(acc >> 8, t[1 + (xor(acc, x) & 255)])), 4294967295) % 10000 as bucket
          from own, remainders),
        s as (select bucket, count(*) n from dw join crcs using (w) group by bucket),
        t as (select bucket, count(*) n from bw join crcs using (w) group by bucket),
        gain as (
          select i as bucket, cast(floor(1000 * ln(
              (coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + 10000)::double
              / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from t) + 10000)::double))) as bigint) as g
          from range(10000) r(i) left join s on s.bucket = i left join t on t.bucket = i),
        sums as (select doc_id, count(*) n, sum(g) total from dw join crcs using (w) join gain using (bucket) group by doc_id),
        scored as (
          select doc_id, coalesce(n, 0) as n_features, coalesce(cast((total - ((total % n) + n) % n) // n as bigint), 0) as weight,
            ('0x' || sha256('2024:' || doc_id)[1:8])::bigint as h
          from d left join sums using (doc_id)),
        noisy as (
          select doc_id, n_features, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::double))) as bigint) as score from scored),
        ranked as (
          select *, row_number() over (order by score desc, doc_id) as place, count(*) over () as eligible from noisy where n_features >= 20)
        select n.doc_id, n.n_features, n.weight, n.score, case when place <= 10 * eligible // 100 then place end as rank
        from noisy n left join ranked r using (doc_id)
    """,
}
