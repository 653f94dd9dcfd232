"""Documents drawn by how much more likely their words are in a target corpus than in the whole.

Word features are hashed into buckets by CRC-32. A bucket's gain compares its share of the target's
features with its share of the corpus's; a document weighs the mean of its features' gains, and
weights with Gumbel noise from the ids' hashes are ranked, which draws without replacement.

Frequent words, and frequent pairs where features are pairs, have their CRC states and buckets in a
table that every task gets; it is found on a bounded sample and changes no result, as all other
features take the CRC itself. Bucket totals are exact counts over all documents.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsift.functions.ranking import Ordered
from poolsift.llm.encoding import byte_slices
from poolsift.llm.texts import numbered
from poolsift.session import pin

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Rows whose words the frequent ones are found on, about: those with small hashes.
SAMPLE_ROWS = 2_000
#: Frequent words, and as many frequent runs of each length from 2 on, at most.
HEAD = 1 << 16
# A-Z become lower case, other ASCII that is neither digit nor a-z becomes a space; UTF-8 bytes stay
_KEEP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Words of letters, digits and all non-ASCII characters, A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split()


class _States(dict):
    """CRC-32 of words: the frequent ones from the table, others computed."""

    def __missing__(self, word):
        return zlib.crc32(word)


class _Runs(dict):
    """Buckets of runs of words: the frequent ones from the table, others from the first word's CRC state on."""

    def __init__(self, table, states: _States, buckets: int):
        super().__init__(table)
        self.states, self.buckets = states, buckets

    def __missing__(self, run):
        state = self.states[run[0]]
        for word in run[1:]:
            state = zlib.crc32(word, zlib.crc32(b" ", state))
        return state % self.buckets


class Hasher:
    """Texts to the buckets of all their runs of ``least`` to ``most`` words."""

    def __init__(self, head: dict[int, list], least: int, most: int, buckets: int):
        self.least, self.most, self.buckets = least, most, buckets
        self.states = _States((w, zlib.crc32(w)) for (w,) in head.get(1, ()))
        self.runs = _Runs({}, self.states, buckets)
        self.runs.update((run, self.runs[run]) for n in range(2, most + 1) for run in head.get(n, ()))

    def __call__(self, text: str) -> np.ndarray:
        own, found = words(text), []
        for n in range(self.least, self.most + 1):
            if n == 1:
                found.append(np.fromiter(map(self.states.__getitem__, own), np.int64, len(own)) % self.buckets)
            else:
                runs = zip(*(own[k:] for k in range(n)))
                found.append(np.fromiter(map(self.runs.__getitem__, runs), np.int64, max(0, len(own) - n + 1)))
        return np.concatenate(found)


def frequent_runs(rows: DataFrame, most: int, sample_rows: int = SAMPLE_ROWS, limit: int = HEAD) -> dict[int, list]:
    """The most frequent runs of 1 to ``most`` words, at most ``limit`` of each length, on about ``sample_rows`` rows."""
    share = min(1.0, sample_rows / max(1, rows.count()))
    chosen = rows.filter(F.xxhash64("row") < F.lit(int((2 * share - 1) * (1 << 63)) - (share == 1.0))).select("text")

    def count(batches):
        counts = Counter()
        for batch in byte_slices(batches, 0):
            for text in batch.column(0).to_pylist():
                own = words(text)
                for n in range(1, most + 1):
                    counts.update(zip(*(own[k:] for k in range(n))))
        runs, numbers = list(counts), list(counts.values())
        yield pa.RecordBatch.from_arrays([pa.array([list(r) for r in runs], pa.list_(pa.binary())), pa.array(numbers, pa.int64())], ["run", "n"])

    counts = chosen.mapInArrow(count, "run array<binary>, n long").groupBy("run").agg(F.sum("n").alias("n")).filter("n > 1")
    head = {}
    for n in range(1, most + 1):
        found = counts.filter(F.size("run") == n).orderBy(F.desc("n"), "run").limit(limit).collect()
        head[n] = [tuple(bytes(w) for w in r["run"]) for r in found]
    return head


def bucket_counts(rows: DataFrame, hasher_args: tuple, name: str) -> DataFrame:
    """(bucket, ``name``): features of all rows by bucket; every task adds up a vector of all buckets."""
    buckets = hasher_args[-1]

    def run(batches):
        hasher, total = Hasher(*hasher_args), np.zeros(buckets, np.int64)
        for batch in byte_slices(batches, 0):
            found = [hasher(text) for text in batch.column(0).to_pylist()]
            total += np.bincount(np.concatenate(found), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def gains(spark, source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of every bucket, floored; ``buckets`` numbers."""
    table = spark.range(buckets).select(F.col("id").alias("bucket")).join(source, "bucket", "left").join(target, "bucket", "left")
    table = table.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    totals = table.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = {c: F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t")}
    ratio = (d["t"] + 1) * (d["all_s"] + buckets) / ((d["s"] + 1) * (d["all_t"] + buckets))
    found = table.withColumns({c: totals.select(c).scalar() for c in ("all_s", "all_t")})
    rows = found.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain")).orderBy("bucket").collect()
    return np.array([r["gain"] for r in rows], np.int64)


def weighed(rows: DataFrame, hasher_args: tuple, gain: np.ndarray) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight): the floored mean gain of each row's features."""
    fields = [rows.schema["row"], rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))]

    def run(batches):
        hasher = Hasher(*hasher_args)
        for batch in byte_slices(batches):
            n_words, n_features, weight = [], [], []
            for text in batch.column(2).to_pylist():
                found = hasher(text)
                n_words.append(len(found) if hasher.least == hasher.most == 1 else len(words(text)))
                n_features.append(len(found))
                weight.append(int(gain[found].sum()) // len(found) if len(found) else 0)
            columns = [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))


def noise(id_col: str, seed: str):
    """Standard Gumbel noise in thousandths, from the first 32 bits of sha256 of ``seed:id``."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least: int = 1,
    most: int = 1,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; ``rank`` is null for rows not drawn.

    Drawn is the floored ``percent`` of the rows with ``min_words`` words, by score, then by id; null ids
    come last and are hashed as empty text, rows of equal ids are rows of their own. A null or empty
    text has no features and weight 0. Without target features all gains come from smoothing; an empty table gives
    no rows. Very long texts are hashed whole. Other columns are not read.
    """
    spark = docs.sparkSession
    rows, goal = numbered(docs, id_col, text_col), numbered(target.withColumn("__id", F.lit(0)), "__id", target_text)
    args = (frequent_runs(rows, most), least, most, buckets)
    gain = gains(spark, bucket_counts(rows, args, "s"), bucket_counts(goal, args, "t"), buckets)
    scored = weighed(rows, args, gain).withColumn("score", F.col("weight") + noise("doc_id", seed))
    scored = pin(scored, "scored")
    fit = F.col("n_words") >= min_words
    # scores are thousandths of sums of logarithms: some ten thousand values, whatever the corpus
    steps = scored.filter(fit).groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).collect()
    drawn = sum(r["n"] for r in steps) * percent // 100
    lowest, kept = None, 0
    for r in steps:
        if kept >= drawn:
            break
        lowest, kept = r["score"], kept + r["n"]
    out = ["doc_id", "n_features", "weight", "score"]
    if lowest is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    inside = fit & (F.col("score") >= lowest)
    near = scored.filter(inside).select(*out, "row", (-F.col("score")).alias("_down"), F.col("doc_id").isNull().alias("_no_id"))
    placed = Ordered(near, ["_down", "_no_id", "doc_id", "row"]).positions("rank").rows
    placed = placed.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return placed.unionByName(scored.filter(~inside).select(*out, F.lit(None).cast("long").alias("rank")))
