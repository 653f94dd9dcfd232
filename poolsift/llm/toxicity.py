"""Toxicity scores: boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words and word beginnings is learned from labelled texts by the odds of being found
in a toxic one. Each text then has a few dense features: densities of three lexicon tiers, hits
near second-person words, capitals, punctuation and obfuscated spelling. The trees are fitted on
features that cross over: each half of the labelled sample is described by the lexicon of the other
half, so that the trees do not trust what a lexicon has memorised. All other texts are described
by the lexicon of the whole sample.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsift.llm import labelled
from poolsift.llm.texts import WORD, lowered, numbered, slices, without
from poolsift.session import pin

#: Lexicon entries at most, log-odds from which a unit is one, toxic texts it must be found in, and
#: their share of all toxic texts: rarer units are mostly chance.
LEXICON, ODDS, SUPPORT, SHARE = 4096, 2.0, 3, 0.02
STEMS = (4, 5, 6, 7)
TREES = 12
THRESHOLD = 0.7
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos ti tú usted ustedes vosotros tus".split()
)
FEATURES = [
    "words", "hits_any", "hits_clear", "hits_strong", "weight_per_word", "most_weight", "count_strong",
    "near_person", "person", "capitals", "shouted", "exclamations", "punctuation", "obfuscated", "stretched", "unmasked",
]
_WORD = re.compile(WORD)
_SHOUT = re.compile(r"[A-Z]{3,}")
#: Digits or signs between letters: the end of a masked stretch, so that no letter run is tried twice.
_MASKED = re.compile(r"(?<=[A-Za-z])[0-9@$*!]+(?=[A-Za-z])")
_TOKEN = re.compile(r"[A-Za-z0-9@$*!]+")
_UNMASK = str.maketrans("013457@$!", "oieastasi")
_NEAR = 5


def units(words):
    """What the lexicon may hold of a word array: the words, and the beginnings of longer ones."""
    def stems(n):
        return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("~")))

    return F.array_distinct(F.concat(words, *map(stems, STEMS)))


def learn_lexicon(texts: DataFrame) -> dict[str, float]:
    """Log-odds by unit from (text, label) rows; one row for each unit crosses to the driver."""
    words = F.regexp_extract_all(lowered("text"), F.lit(WORD), F.lit(0))
    sizes = texts.agg(F.sum("label").alias("toxic"), F.count("*").alias("all")).first()
    toxic, clean = sizes["toxic"] or 0, sizes["all"] - (sizes["toxic"] or 0)
    found = texts.select("label", F.explode(units(words)).alias("unit")).groupBy("unit")
    found = found.agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).filter(F.col("a") >= max(SUPPORT, SHARE * toxic))
    odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (clean + 1))
    best = found.select("unit", F.round(odds, 6).alias("odds")).filter(F.col("odds") >= ODDS)
    return {r["unit"]: r["odds"] for r in best.orderBy(F.desc("odds"), "unit").limit(LEXICON).collect()}


def _weight(word: str, get) -> float:
    """The largest log-odds of the word and its beginnings; 0 if the lexicon has none of them."""
    return max(get(word, 0.0), *(get(word[:n] + "~", 0.0) for n in STEMS if len(word) > n), 0.0)


def _unmasked_hits(text: str, masks, get) -> int:
    """Words with masked stretches whose plain spelling is in the lexicon."""
    hits, end = 0, -1
    for mask in masks:
        if mask.start() >= end:
            start = mask.start()
            while start and _TOKEN.match(text[start - 1]):
                start -= 1
            token = _TOKEN.match(text, start)
            end = token.end()
            hits += bool(_weight(token[0].rstrip("@$*!").lower().translate(_UNMASK), get))
    return hits


def describe(text: str, lexicon: dict[str, float]) -> list[float]:
    """The values of ``FEATURES`` for one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = _WORD.findall(data.lower().decode("utf-8", "surrogatepass"))
    get, different = lexicon.get, set(words)
    weights = {word: w for word in different if (w := _weight(word, get))}
    hits = [(i, weights[word]) for i, word in enumerate(words) if word in weights] if weights else []
    persons = [i for i, word in enumerate(words) if word in SECOND_PERSON] if different & SECOND_PERSON else []
    near = 0
    if hits and persons:
        at = np.array(persons)
        for i, _ in hits:
            k = int(np.searchsorted(at, i))
            near += bool((k < len(at) and at[k] - i <= _NEAR) or (k and i - at[k - 1] <= _NEAR))
    codes = np.frombuffer(data, np.uint8)
    bytes_ = np.bincount(codes, minlength=256) if len(codes) else np.zeros(256, np.int64)
    same = codes[1:] == codes[:-1]
    thrice = same[1:] & same[:-1] & ((codes[2:] | 32) >= 97) & ((codes[2:] | 32) <= 122)
    stretched = int(thrice.sum() - (thrice[1:] & thrice[:-1]).sum())  # runs, not places
    masks = list(_MASKED.finditer(text)) if bytes_[[33, 36, 42, 64, *range(48, 58)]].any() else []
    n, size = max(len(words), 1), max(len(codes), 1)
    strong = sum(w >= 5 for _, w in hits)
    marks = int(bytes_[33] + bytes_[63])
    return [
        float(np.log1p(len(words))),
        len(hits) / n,
        sum(w >= 3.5 for _, w in hits) / n,
        strong / n,
        sum(w for _, w in hits) / n,
        max((w for _, w in hits), default=0.0),
        float(np.log1p(strong)),
        near / n,
        len(persons) / n,
        float(bytes_[65:91].sum()) / size,
        len(_SHOUT.findall(text)) / n,
        marks / n,
        float(marks + bytes_[44] + bytes_[46] + bytes_[59]) / n,
        len(masks) / n,
        stretched / n,
        _unmasked_hits(text, masks, get) / n,
    ]


def features(docs: DataFrame, lexicon: dict[str, float], id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text_hash, FEATURES...) of every row."""
    rows = numbered(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    names = ["row", "doc_id", "text_hash", *FEATURES]

    def compute(batches):
        for batch in slices(batches):
            values = np.array([describe(t, lexicon) for t in batch.column(2).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *(pa.array(values[:, k]) for k in range(len(FEATURES)))], names)

    own = [rows.schema[n] for n in ("row", "doc_id", "text_hash")]
    return rows.mapInArrow(compute, T.StructType([*own, *(T.StructField(n, T.DoubleType()) for n in FEATURES)]))


def scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", max_rows: int = labelled.MAX_ROWS
) -> DataFrame:
    """(row, doc_id, text_hash, FEATURES..., score, predicted) of every row of ``docs``.

    Learns from at most ``max_rows`` labelled rows. A null text is an empty one; rows with equal
    ids are scored one by one. With labels of one kind only, or none, every score is 0.
    """
    known = pin(labelled.sample(labels, label, max_rows, id_col), "labels")
    half = F.pmod(F.crc32(F.concat(F.lit("half"), F.col("labelled_id").cast("string"))), F.lit(2))
    halves = [pin(labelled.with_labels(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), known.filter(half == k)), "half") for k in (0, 1)]
    texts = [h.withColumn("text", F.coalesce("text", F.lit(""))) for h in halves]
    lexicons = [learn_lexicon(t) for t in (*texts, texts[0].union(texts[1]))]
    found = pin(features(docs, lexicons[2], id_col, text_col), "features")
    crossed = [labelled.with_labels(features(texts[k], lexicons[1 - k], "doc_id", "text"), known) for k in (0, 1)]
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    own = pin(crossed[0].union(crossed[1]).select(*FEATURES, "label").coalesce(4), "crossed")
    if own.agg(F.countDistinct("label")).first()[0] < 2:
        return found.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    own = vector.transform(own)
    trees = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=3, stepSize=0.3, seed=7).fit(own)

    def with_margin(rows):
        done = trees.transform(rows).withColumn("margin", F.round(vector_to_array("rawPrediction")[1], 9))
        return done.drop("rawPrediction", "probability", "prediction", "features")

    line = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score")
    line = line.fit(with_margin(own).select("margin", F.col("label").cast("double").alias("label")).coalesce(1))  # bounded by max_rows
    scored = line.transform(with_margin(vector.transform(found)))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score"))
    return scored.withColumns({"score": score, "predicted": (score >= THRESHOLD).cast("int")}).drop("margin")


def keep_civil(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` that are not predicted toxic; columns stay as they are."""
    bad = scores(docs, labels, id_col, text_col, **options).filter("predicted = 1").select("doc_id", "text_hash").distinct()
    return without(docs, bad, id_col, text_col)
