"""Training and scoring text classifiers with Spark ML or by hashed words, and a centroid scorer on embeddings."""

import hashlib
import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import IDF, HashingTF, Tokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsift.functions.columns import (
    confidence,
    label_code,
    label_name,
    predicted_class,
    present,
    rounded,
    softmax,
)
from poolsift.operators.pool import label_filter, page, save_predictions, unlabelled_rows
from poolsift.operators.sampling import label_table
from poolsift.session import pin

log = logging.getLogger(__name__)


def class_weights(df: DataFrame, labels, label_col: str = "label") -> DataFrame:
    """``label, code, weight``: total / count, or the total for a class without rows."""
    known = df.filter(F.col(label_col).isin(list(labels)))
    counts = known.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("_n"))
    return (
        label_table(df.sparkSession, labels)
        .join(counts, "label", "left")
        .withColumn("_total", F.coalesce(F.sum("_n").over(Window.partitionBy()), F.lit(0)))  # one row per label
        .select(
            "label",
            "code",
            (F.col("_total") / F.coalesce("_n", F.lit(1))).alias("weight"),
        )
    )


def _text_stages(features: int):
    return [
        Tokenizer(inputCol="_text", outputCol="_words"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features"),
    ]


def _with_text(df: DataFrame) -> DataFrame:
    """Whole texts: the learners here have no token limit (``columns.truncate_tokens`` is for those that do)."""
    return df.withColumn("_text", F.col("description"))


def word_hashes(text: str) -> Column:
    """A word array as numbers: the first six hex digits of the md5 of lowered words between blanks."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[ \\t\\n\\r]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("long"))


def hashed_words(text: str, features: int) -> Column:
    """The same as bucket numbers, modulo ``features``."""
    return _buckets(word_hashes(text), features)


def _buckets(hashes, features: int) -> Column:
    return F.transform(hashes, lambda h: (h % features).cast("int"))


def _lowered(text: str) -> Column:
    """What ``_digests`` takes: the bytes of the lowered text, empty for null."""
    return F.lower(F.coalesce(F.col(text), F.lit(""))).cast("binary")


def _digests(texts):
    """Of an Arrow array of ``_lowered`` texts: (row of each word, its number, the md5 of each number).

    Words stand between blanks as in ``word_hashes``; of a digest it is the first eight bytes. Every
    different word of the batch is hashed once.
    """
    for blank in (b"\t", b"\n", b"\r"):
        texts = pc.replace_substring(texts, blank, b" ")
    lists = pc.split_pattern(texts, b" ")
    rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    words = lists.flatten().dictionary_encode()
    numbers, found = words.indices.to_numpy(zero_copy_only=False), words.dictionary.to_pylist()
    digests = np.frombuffer(b"".join(hashlib.md5(w, usedforsecurity=False).digest() for w in found), ">u8")[::2].astype(np.uint64)
    if b"" in found:
        kept = numbers != found.index(b"")
        rows, numbers = rows[kept], numbers[kept]
    return rows, numbers, digests


def _bucket_of(digests, features: int):
    """``hashed_words`` of digests."""
    return ((digests >> np.uint64(40)) % np.uint64(features)).astype(np.int64)


def _cut(batch, rows: int = 1024):
    """A batch or array cut small: so many texts are held as words at a time."""
    return (batch.slice(k, rows) for k in range(0, len(batch), rows))


def _lists(values, lengths):
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(values))


def _in_order(table: DataFrame, key: str, value: str) -> DataFrame:
    """A table of bounded size as one array in order of its key, in one row."""
    return table.agg(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]).alias("_table"))


def _predicted(scored: DataFrame, keep, labels) -> DataFrame:
    return scored.select(
        *keep,
        predicted_class("probs").alias("predicted_class"),
        label_name(predicted_class("probs"), labels).alias("predicted_label"),
        confidence("probs").alias("confidence"),
        "probs",
    )


@dataclass(frozen=True)
class HashedBayes:
    """Multinomial naive Bayes over hashed words: log-probabilities by bucket and class, one small table."""

    logs: DataFrame
    features: int
    classes: int

    @property
    def size(self) -> int:
        return self.features

    def table(self) -> DataFrame:
        """One row: the log-probabilities in order of the buckets."""
        return _in_order(self.logs, "bucket", "logs")

    def probs(self, buckets: str, table: str) -> Column:
        zeros = F.array_repeat(F.lit(0.0), self.classes)
        return softmax(F.aggregate(buckets, zeros, lambda acc, b: F.zip_with(acc, F.col(table)[b], lambda x, y: x + y)))

    def predict(self, df: DataFrame, labels) -> DataFrame:
        """As ``predict_many``. The table, ``features`` rows, travels as one value: no text is shuffled."""
        rows = df.withColumn("_logs", self.table().scalar()).withColumn("_buckets", hashed_words("description", self.features))
        return _predicted(rows.withColumn("probs", self.probs("_buckets", "_logs")), df.columns, labels)


@dataclass(frozen=True)
class BayesCounts:
    """What hashed naive Bayes knows of its training rows: words by class and bucket, rows by class.

    Counts only add up, so a batch of new rows is all that ``plus`` reads.
    """

    words: DataFrame
    rows: DataFrame
    features: int
    classes: int

    def plus(self, batch: DataFrame, labels) -> "BayesCounts":
        new = bayes_counts(batch, labels, self.features, store=False)
        words = self.words.unionByName(new.words).groupBy("_code", "bucket").agg(F.sum("_n").alias("_n"))
        rows = self.rows.unionByName(new.rows).groupBy("_code").agg(F.sum("_n").alias("_n"))
        return BayesCounts(pin(words, "bayes_words"), pin(rows, "bayes_rows"), self.features, self.classes)

    def model(self, smoothing: float = 1.0) -> HashedBayes:
        """Every class is weighted by total / count, so that all are equally likely beforehand."""
        of_class = self.rows.withColumn("_all", F.sum("_n").over(Window.partitionBy()))  # one row per label
        weights = of_class.select("_code", (F.col("_all") / F.col("_n")).alias("weight"))
        weighted = self.words.join(F.broadcast(weights), "_code").withColumn("_n", F.col("_n") * F.col("weight"))
        # whole numbers are added up, then weighted: the order of rows changes no bit
        totals = self.words.groupBy("_code").agg(F.sum("_n").alias("_n")).join(F.broadcast(weights), "_code").withColumn("_n", F.col("_n") * F.col("weight"))
        whole = totals.agg(F.map_from_entries(F.collect_list(F.struct("_code", "_n")))).scalar()
        per_bucket = weighted.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("_code", "_n"))).alias("_by"))
        every = self.words.sparkSession.range(self.features).select(F.col("id").cast("int").alias("bucket")).join(per_bucket, "bucket", "left")

        def log(k):
            n = F.coalesce(F.try_element_at("_by", F.lit(k)), F.lit(0.0))
            of = F.coalesce(F.try_element_at("_whole", F.lit(k)), F.lit(0.0))
            return F.log((n + smoothing) / (of + smoothing * self.features))

        logs = every.withColumn("_whole", whole).select("bucket", F.array(*map(log, range(self.classes))).alias("logs"))
        return HashedBayes(pin(logs, "hashed_bayes"), self.features, self.classes)


def bayes_counts(labelled: DataFrame, labels, features: int = 1024, store: bool = True) -> BayesCounts:
    """Counts of all labelled rows, from one reading of their texts for each of the two tables."""
    coded = label_filter(labelled, labels).withColumn("_code", label_code("label", labels))
    words = coded.select("_code", F.explode(hashed_words("description", features)).alias("bucket"))
    words = words.groupBy("_code", "bucket").agg(F.count("*").alias("_n"))
    rows = coded.groupBy("_code").agg(F.count("*").alias("_n"))
    if store:
        words, rows = pin(words, "bayes_words"), pin(rows, "bayes_rows")
    return BayesCounts(words, rows, features, len(labels))


def train_hashed_bayes(labelled: DataFrame, labels, features: int = 1024, smoothing: float = 1.0) -> HashedBayes:
    """Naive Bayes with every class weighted by total / count, so that all are equally likely beforehand."""
    return bayes_counts(labelled, labels, features).model(smoothing)


# --- multinomial logistic regression by full-batch steps ---------------------------------


@dataclass(frozen=True)
class Softmax:
    """Weights by bucket and class over idf-weighted hashed words; bucket ``features`` holds the intercepts.

    A text's vector is its words' idf, added up by bucket and divided by the root of its word count.
    """

    weights: DataFrame
    idf: DataFrame
    features: int
    classes: int

    @property
    def size(self) -> int:
        return self.features + 1

    def table(self) -> DataFrame:
        """One row: weights times idf in order of the buckets."""
        scaled = self.weights.join(self.idf, "bucket").select("bucket", F.transform("w", lambda x: x * F.col("idf")).alias("w"))
        return _in_order(scaled, "bucket", "w")

    def logits(self, buckets: str, table: str) -> Column:
        start, words = F.array_repeat(F.lit(0.0), self.classes), F.greatest(F.size(buckets), F.lit(1))
        added = F.aggregate(buckets, start, lambda acc, b: F.zip_with(acc, F.col(table)[b], lambda x, y: x + y))
        return F.zip_with(added, F.col(table)[self.features], lambda x, y: x / F.sqrt(words) + y)

    def probs(self, buckets: str, table: str) -> Column:
        return softmax(self.logits(buckets, table))

    def predict(self, df: DataFrame, labels) -> DataFrame:
        """As ``predict_many``; a map over the rows. The weights, ``features`` rows, go with the tasks."""
        probs = F.arrow_udf(_word_probs(self.array()), T.ArrayType(T.DoubleType()))
        return _predicted(df.withColumn("probs", probs(_lowered("description"))), df.columns, labels)

    def array(self):
        """``table`` in NumPy, of a row per bucket; unknown weights are NaN."""
        return np.array(self.table().first()["_table"], dtype=np.float64).reshape(self.size, self.classes)


def _shares(logits):
    powers = np.exp(logits - logits.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def _sums(place, values, size: int):
    """The columns of ``values`` (one array each) added up by place."""
    return np.stack([np.bincount(place, v, size) for v in values], axis=1)


def _word_probs(weights):
    """A function from an Arrow array of ``_lowered`` texts to their probabilities by class."""
    features, classes = len(weights) - 1, weights.shape[1]

    def score(texts: pa.Array) -> pa.Array:
        probs = [np.empty((0, classes))]
        for some in _cut(texts):
            rows, numbers, digests = _digests(some)
            of_word = weights[_bucket_of(digests, features)].T
            words = np.maximum(np.bincount(rows, minlength=len(some)), 1)[:, None]
            logits = _sums(rows, (w[numbers] for w in of_word), len(some)) / np.sqrt(words) + weights[features]
            probs.append(_shares(logits))
        probs = np.concatenate(probs)
        return _lists(pa.array(probs.ravel(), from_pandas=True), np.full(len(probs), classes))

    return score


def _counted(features: int):
    """A map of Arrow batches (code, weight, lowered text) to their different buckets with word counts."""

    def count(batches):
        for whole in batches:
            for batch in _cut(whole):
                rows, numbers, digests = _digests(batch.column(2))
                found, counts = np.unique(rows * features + _bucket_of(digests, features)[numbers], return_counts=True)
                lengths = np.bincount(found // features, minlength=len(batch))
                columns = [_lists((found % features).astype(np.int32), lengths), _lists(counts.astype(np.int32), lengths)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["_code", "weight", "_buckets", "_counts"])

    return count


def _slopes(weights):
    """A map of ``_counted`` rows to one task's residuals by bucket, added up; the last one is the intercept's."""
    features, classes = len(weights) - 1, weights.shape[1]
    of_bucket = np.ascontiguousarray(weights.T)

    def add_up(batches):
        total, some = np.zeros((features + 1, classes)), False
        for batch in batches:
            code, weight = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            buckets, counts = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 3))
            n, some = len(batch), True
            rows = np.repeat(np.arange(n), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
            # the intercept's feature is 1, a word's one over the root of the word count
            x = counts / np.sqrt(np.maximum(np.bincount(rows, counts, n), 1))[rows]
            off = _shares(_sums(rows, (w[buckets] * x for w in of_bucket), n) + weights[features])
            off[np.arange(n), code] -= 1
            off *= weight[:, None]
            total += _sums(buckets, (o[rows] * x for o in off.T), features + 1)
            total[features] += off.sum(axis=0)
        if some:
            columns = [np.arange(features + 1, dtype=np.int32), _lists(total.ravel(), np.full(features + 1, classes))]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), columns[1]], ["bucket", "g"])

    return add_up


def train_softmax(labelled: DataFrame, labels, features: int = 4096, steps: int = 20, rate: float = 0.5, ridge: float = 0.001) -> Softmax:
    """Multinomial logistic regression: a fixed number of gradient steps over all rows, from zero weights.

    Classes are weighted by total / count. Words are hashed once; every row is written as its different
    buckets with their counts. A step reads them once, adds up the residuals of a task in one array of
    ``features`` rows, sums these by bucket and joins them with the table of weights. The result
    depends on the rows alone, not on their order or partitions.
    """
    spark, classes = labelled.sparkSession, len(labels)
    rows = label_filter(labelled, labels).withColumn("_code", label_code("label", labels))
    weights = class_weights(rows, labels).select(F.col("code").alias("_code"), "weight")
    rows = rows.select("_code", _lowered("description").alias("_text")).join(F.broadcast(weights), "_code")
    counted = "_code int, weight double, _buckets array<int>, _counts array<int>"
    rows = pin(rows.select("_code", "weight", "_text").mapInArrow(_counted(features), counted), "softmax_rows")
    n, total = rows.agg(F.count("*"), F.sum("weight")).first()
    seen = rows.select(F.explode("_buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("df"))
    every = spark.range(features + 1).select(F.col("id").cast("int").alias("bucket"))
    smooth = F.log((F.lit(n) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0))
    idf = every.join(seen, "bucket", "left").select("bucket", F.when(F.col("bucket") == features, 1.0).otherwise(smooth).alias("idf"))
    idf = pin(idf, "softmax_idf")
    current = pin(every.select("bucket", F.array_repeat(F.lit(0.0), classes).alias("w")), "softmax_weights")
    for _ in range(steps):
        each = rows.mapInArrow(_slopes(Softmax(current, idf, features, classes).array()), "bucket int, g array<double>")
        slope = each.groupBy("bucket").agg(F.array(*(F.sum(F.col("g")[k]) for k in range(classes))).alias("g"))
        stepped = current.join(idf, "bucket").join(slope, "bucket", "left").withColumn("_total", F.lit(total).cast("double"))
        zero = F.array_repeat(F.lit(0.0), classes)
        moved = F.zip_with("w", F.coalesce("g", zero), lambda w, g: w - rate * (g * F.col("idf") / F.col("_total") + ridge * w))
        current = pin(stepped.select("bucket", moved.alias("w")), "softmax_weights")
    return Softmax(current, idf, features, classes)


def train_classifier(labelled: DataFrame, labels, features: int = 4096, max_iter: int = 20, algorithm: str = "logistic"):
    """A fitted model over all labelled rows, every class weighted by total / count.

    ``algorithm`` is ``logistic`` or ``bayes`` on TF-IDF, ``hashed`` for naive Bayes on word hashes, or
    ``softmax`` for logistic regression on them by ``max_iter`` full-batch steps.
    """
    if algorithm == "hashed":
        return train_hashed_bayes(labelled, labels, features)
    if algorithm == "softmax":
        return train_softmax(labelled, labels, features, max_iter)
    rows = label_filter(labelled, labels).withColumn("_code", label_code("label", labels).cast("double"))
    weights = class_weights(rows, labels).select("label", "weight")
    weighted = _with_text(rows).join(F.broadcast(weights), "label").select("_text", "_code", "weight")
    columns = {"featuresCol": "_features", "labelCol": "_code", "weightCol": "weight", "probabilityCol": "_probability"}
    if algorithm == "bayes":
        head = NaiveBayes(**columns)
    else:
        # regParam keeps the optimum finite on separable seed sets
        head = LogisticRegression(**columns, maxIter=max_iter, regParam=0.01, family="multinomial")
    return Pipeline(stages=[*_text_stages(features), head]).fit(weighted)


def predict_many(df: DataFrame, model, labels) -> DataFrame:
    """Adds ``predicted_class, predicted_label, confidence, probs``; a map over the rows."""
    if isinstance(model, (HashedBayes, Softmax)):
        return model.predict(df, labels)
    keep = df.columns
    scored = model.transform(_with_text(df))
    probs = vector_to_array("_probability")
    # classes beyond the largest code seen in training have no entry in the vector
    padded = F.transform(F.sequence(F.lit(0), F.lit(len(labels) - 1)), lambda i: F.coalesce(F.get("_raw", i), F.lit(0.0)))
    return (
        scored.withColumn("_raw", probs)
        .withColumn("probs", padded)
        .select(
            *keep,
            predicted_class("probs").alias("predicted_class"),
            label_name(predicted_class("probs"), labels).alias("predicted_label"),
            confidence("probs").alias("confidence"),
            "probs",
        )
    )


def prediction_columns(pred: DataFrame) -> DataFrame:
    """``id, model_prediction, uncertainty_score`` as the pool stores them."""
    return pred.select(
        "id",
        F.col("predicted_class").cast("string").alias("model_prediction"),
        rounded(F.lit(1.0) - F.col("confidence")).alias("uncertainty_score"),
    )


def model_predict(pool: DataFrame, model, labels, max_samples: int | None = None) -> DataFrame:
    """The pool with fresh scores on its unlabelled rows, or on the first ``max_samples`` of them."""
    open_rows = page(unlabelled_rows(pool).filter(present("description")), max_samples)
    return save_predictions(pool, prediction_columns(predict_many(open_rows.select("id", "description"), model, labels)))


def committee_predict(df: DataFrame, models: dict, labels) -> DataFrame:
    """Long output ``id, member, predicted_class, probs`` of several models.

    ``models`` maps a member to a model or to a function that loads one. Members on hashed words share one
    reading of the texts, in which every word is hashed once; each one's table is written and
    checked before. Others read the texts on their own. A member that cannot be loaded, or fails, is skipped.
    """
    parts, stacked = [], []
    for member, model in models.items():
        try:
            loaded = model() if callable(model) else model
            if isinstance(loaded, (HashedBayes, Softmax)):
                stacked.append((member, loaded, _checked(loaded)))
                continue
            scored = predict_many(df.select("id", "description"), loaded, labels)
            parts.append(pin(scored.select("id", F.lit(member).alias("member"), "predicted_class", "probs"), "member"))
        except Exception as reason:  # any failure of one member leaves the others working
            log.warning("committee member %s skipped: %s", member, reason)
    if stacked:
        rows, outputs = df.select("id", word_hashes("description").alias("_hashes")), []
        for nth, (member, model, table) in enumerate(stacked):
            buckets, place, probs = f"_b{nth}", f"_t{nth}", f"_p{nth}"
            rows = rows.withColumn(buckets, _buckets("_hashes", model.features)).withColumn(place, table.scalar())
            rows = rows.withColumn(probs, model.probs(buckets, place)).drop(buckets, place)
            outputs.append(F.struct(F.lit(member).alias("member"), predicted_class(probs).alias("predicted_class"), F.col(probs).alias("probs")))
        parts.append(pin(rows.select("id", F.explode(F.array(*outputs)).alias("_o")).select("id", "_o.*"), "members"))
    if not parts:
        raise ValueError("no committee member could be loaded")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _checked(model) -> DataFrame:
    """A hashed model's table, written; raises if it has not an entry for every bucket and class."""
    table = pin(model.table(), "member_table")
    partial = F.exists("_table", lambda x: F.coalesce(F.size(x), F.lit(0)) != model.classes)
    found = table.select(F.size("_table").alias("size"), partial.alias("partial")).first()
    if found["size"] != model.size or found["partial"]:
        raise ValueError(f"the model has {found['size']} of {model.size} buckets, or buckets without all classes")
    return table


def embed_text(df: DataFrame, features: int = 256, cells: int = 1 << 16) -> DataFrame:
    """``id, embedding``: unit vectors of signed hashed TF-IDF, for clustering; rows without a text are left out.

    A word's md5 gives its cell (hex digits 1 to 6), in which document frequencies are counted, its
    dimension (7 to 12) and its sign (13). Its weight is ln((n + 1) / (df + 1)) in whole millionths,
    so that sums do not depend on the order of words. The table of weights has ``cells`` rows
    whatever the corpus and goes with the tasks; texts are mapped, not shuffled. A text of which
    nothing has a weight is the zero vector.
    """
    rows = df.filter(present("description")).select("id", _lowered("description").alias("_text"))
    seen = rows.select("_text").mapInArrow(_texts_by_cell(cells), "cell int, df long")
    seen = seen.groupBy("cell").agg(F.sum("df").alias("df"))
    weight = F.round(1e6 * F.log((rows.agg(F.count("*")).scalar() + 1) / (F.coalesce("df", F.lit(0)) + 1))).cast("long")
    every = df.sparkSession.range(cells).select(F.col("id").cast("int").alias("cell"))
    weights = pin(every.join(seen, "cell", "left").select("cell", weight.alias("weight")), "word_weights")
    table = np.array(_in_order(weights, "cell", "weight").first()["_table"], dtype=np.float64)
    vector = T.StructField("embedding", T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(_unit_vectors(table, features), T.StructType([rows.schema["id"], vector]))


def _texts_by_cell(cells: int):
    """A map of Arrow batches of lowered texts to the numbers of one task's texts by word cell."""

    def count(batches):
        total = np.zeros(cells, np.int64)
        for whole in batches:
            for batch in _cut(whole):
                rows, numbers, digests = _digests(batch.column(0))
                total += np.bincount(np.unique(rows * cells + _bucket_of(digests, cells)[numbers]) % cells, minlength=cells)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], ["cell", "df"])

    return count


def _unit_vectors(weights, features: int):
    """A map of Arrow batches (id, lowered text) to dense vectors of length one; a few texts at a time."""
    at_once = min(1024, max(1, (1 << 20) // features))

    def fold(batches):
        for whole in batches:
            for batch in _cut(whole, at_once):
                rows, numbers, digests = _digests(batch.column(1))
                n, sign = len(batch), 1 - 2 * ((digests >> np.uint64(12)) & np.uint64(1)).astype(np.int64)
                dims = (((digests >> np.uint64(16)) & np.uint64(0xFFFFFF)) % np.uint64(features)).astype(np.int64)
                # whole numbers below 2^53: exact in doubles
                values = sign * weights[_bucket_of(digests, len(weights))]
                sums = np.bincount(rows * features + dims[numbers], values[numbers], n * features).astype(np.float64).reshape(n, features)
                norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
                unit = np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(unit.ravel(), np.full(n, features))], ["id", "embedding"])

    return fold


# --- centroid scorer -----------------------------------------------------------------


def class_centroids(rows: DataFrame, labels) -> DataFrame:
    """``code, centroid``: mean embedding per label; vectors are combined before the shuffle."""
    doubles = F.col("embedding").cast("array<double>")
    coded = rows.select(label_code("label", labels).alias("code"), array_to_vector(doubles).alias("_v"))
    means = coded.filter(F.col("code").isNotNull()).groupBy("code").agg(Summarizer.mean(F.col("_v")).alias("_mean"))
    return means.select("code", vector_to_array("_mean").alias("centroid"))


def centroid_predict(rows: DataFrame, centroids: DataFrame, labels) -> DataFrame:
    """Softmax of the negative distance to the class centroids.

    The centroids, at most one per label, travel as a single value, so no pair table of
    rows and classes arises. ``probs`` follows the codes that have a centroid.
    """
    packed = centroids.agg(F.array_sort(F.collect_list(F.struct("code", "centroid")))).scalar()
    with_centres = rows.withColumn("_centres", packed)

    def minus_distance(c):
        squares = F.zip_with(
            "embedding", c["centroid"], lambda a, b: F.pow(a.cast("double") - b, F.lit(2.0))
        )
        return -F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))

    scored = with_centres.withColumn("_logits", F.transform("_centres", minus_distance)).withColumn(
        "probs", softmax("_logits")
    )
    code = F.get(F.col("_centres"), predicted_class("probs"))["code"]
    return (
        scored.withColumn("predicted_class", code)
        .withColumn("predicted_label", label_name("predicted_class", labels))
        .withColumn("confidence", confidence("probs"))
        .drop("_centres", "_logits")
    )
