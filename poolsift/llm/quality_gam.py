"""Text quality by a generalised additive model with pairwise interactions.

Each feature of a text falls into one of its quantile bins, and the model adds one number per bin
and per pair of bins. The numbers are learned by boosting in turn: every round gives each feature
a shallow tree of its own on the residuals, added to that feature's table; then the pairs that
still explain most get tables in the same way. Scoring looks the numbers up and adds them.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from poolsift.llm import labelled
from poolsift.llm.texts import numbered, slices
from poolsift.session import pin

FEATURES = [
    "words", "word_length", "upper", "symbols", "exclamations", "digits", "distinct", "top_word",
    "stutter", "repeated_triples", "repeated_lines", "sentence_ends", "line_breaks", "non_ascii", "commas", "empty",
]
BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 32, 4, 120, 60, 0.1
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def describe(text: str) -> list[float]:
    """The values of ``FEATURES`` for one text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    bytes_ = np.bincount(data, minlength=256) if len(data) else np.zeros(256, np.int64)
    words = text.split()
    n, size = max(len(words), 1), max(len(data), 1)
    letters = max(int(bytes_[65:91].sum() + bytes_[97:123].sum()), 1)
    counts = Counter(words)
    triples = Counter(zip(words, words[1:], words[2:]))
    lines = [line for line in text.split("\n") if line.strip()]
    return [
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        float(bytes_[65:91].sum()) / letters,
        float(bytes_[_SYMBOLS].sum()) / n,
        float(bytes_[33] + bytes_[63]) / n,
        float(bytes_[48:58].sum()) / size,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(triples) / max(len(words) - 2, 1) if triples else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        float(bytes_[46]) / n,
        float(bytes_[10]) / n,
        float(bytes_[128:].sum()) / size,
        float(bytes_[44]) / n,
        float(not words),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, FEATURES...) of every row; a null text is an empty one."""
    rows = numbered(docs, id_col, text_col)

    def compute(batches):
        for batch in slices(batches):
            values = np.array([describe(t) for t in batch.column(2).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            columns = [batch.column(0), batch.column(1), *(pa.array(values[:, k]) for k in range(len(FEATURES)))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", *FEATURES])

    fields = [T.StructField("row", T.LongType()), rows.schema["doc_id"], *(T.StructField(n, T.DoubleType()) for n in FEATURES)]
    return rows.mapInArrow(compute, T.StructType(fields))


def _leaves(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Step for each bin of a tree on ordered bins, split greedily into at most ``leaves`` runs."""
    cuts = [0, len(gradient)]
    g, h = np.append(0, gradient.cumsum()), np.append(0, weight.cumsum())

    def value(a, b):
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)

    while len(cuts) <= leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                k = np.arange(a + 1, b)
                gains = value(a, k) + value(k, b) - value(a, b)
                if gains.max() > best[0]:
                    best = (gains.max(), int(k[gains.argmax()]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    step = np.zeros(len(gradient))
    for a, b in zip(cuts, cuts[1:]):
        step[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return step


class Additive:
    """Intercept, one table per feature and one per chosen pair; built by ``fit``."""

    def __init__(self, edges):
        self.edges = edges
        self.bias = 0.0
        self.single = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}

    def bins(self, values: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, values[:, k], "right") for k, e in enumerate(self.edges)]

    def margin(self, bins) -> np.ndarray:
        total = np.full(len(bins[0]), self.bias)
        for table, b in zip(self.single, bins):
            total += table[b]
        for (i, j), table in self.pairs.items():
            total += table[bins[i], bins[j]]
        return total

    def score(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(self.bins(values))))


def fit(values: np.ndarray, labels: np.ndarray) -> Additive:
    """The model of a bounded sample. Labels of one kind give a constant; none give one half."""
    shares = np.linspace(0, 1, BINS + 1)[1:-1]
    model = Additive([np.unique(np.quantile(v, shares)) if len(v) else np.array([]) for v in values.T])
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    model.bias = float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        return model
    bins = model.bins(values)
    margin = model.margin(bins)

    def slopes():
        p = 1 / (1 + np.exp(-margin))
        return labels - p, p * (1 - p)

    for _ in range(ROUNDS):
        for table, b in zip(model.single, bins):
            g, h = slopes()
            step = RATE * _leaves(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)), 3)
            table += step
            margin += step[b]
    g, h = slopes()

    def grid(i, j):
        shape = len(model.single[i]), len(model.single[j])
        cell = bins[i] * shape[1] + bins[j]
        return [np.bincount(cell, x, shape[0] * shape[1]).reshape(shape) for x in (g, h)]

    def quarters(gg, hh):
        """Best split of both axes into four cells: its gain and the step of each cell."""
        cg, ch = gg.cumsum(0).cumsum(1), hh.cumsum(0).cumsum(1)
        corner = [x[:-1, :-1] for x in (cg, ch)]
        right = [x[:-1, -1:] - c for x, c in zip((cg, ch), corner)]
        low = [x[-1:, :-1] - c for x, c in zip((cg, ch), corner)]
        last = [x[-1, -1] - c - r - w for x, c, r, w in zip((cg, ch), corner, right, low)]
        gain = sum(a**2 / (b + 1.0) for a, b in (corner, right, low, last))
        if not gain.size:
            return 0.0, np.zeros_like(gg)
        a, b = np.unravel_index(gain.argmax(), gain.shape)
        step = np.zeros_like(gg)
        for rows in (slice(0, a + 1), slice(a + 1, None)):
            for cols in (slice(0, b + 1), slice(b + 1, None)):
                step[rows, cols] = gg[rows, cols].sum() / (hh[rows, cols].sum() + 1.0)
        return float(gain.max()), step

    ranked = sorted(((quarters(*grid(i, j))[0], (i, j)) for i, j in combinations(range(len(bins)), 2)), reverse=True)
    model.pairs = {pair: np.zeros((len(model.single[pair[0]]), len(model.single[pair[1]]))) for _, pair in ranked[:PAIRS]}
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in model.pairs.items():
            g, h = slopes()
            step = RATE * quarters(*grid(i, j))[1]
            table += step
            margin += step[bins[i], bins[j]]
    return model


def scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", max_rows: int = labelled.MAX_ROWS
) -> DataFrame:
    """(row, doc_id, FEATURES..., score, predicted) of every row of ``docs``.

    Fitted on at most ``max_rows`` labelled rows. Rows with equal ids are scored one by one.
    """
    found = pin(features(docs, id_col, text_col), "features")
    own = labelled.with_labels(found, labelled.sample(labels, label, max_rows, id_col)).orderBy("doc_id", "row")
    own = own.select(*FEATURES, "label").toPandas()
    model = fit(own[FEATURES].to_numpy(np.float64).reshape(-1, len(FEATURES)), own["label"].to_numpy(np.float64))

    def score(batches):
        for batch in batches:
            values = np.column_stack([batch.column(n).to_numpy() for n in FEATURES])
            found = model.score(values)
            columns = [*batch.columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "score", "predicted"])

    return found.mapInArrow(score, T.StructType([*found.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
