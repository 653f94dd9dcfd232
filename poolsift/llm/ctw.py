"""Language-model scores by context-tree weighting, and a unigram baseline.

Every byte is eight binary decisions, each a node of the byte's binary tree. A decision is
predicted from its node and the bytes before it, at every context depth from none to ``DEPTH``.
Each (context, node) has a Krichevsky-Trofimov estimator; a context's weighted probability is half
its own estimate and half the product over its longer contexts, so that the prediction mixes all
depths by how well each one coded the training text. Counts are frozen after training: a document
is charged the code length of its bytes and of the end mark, byte 0, under the trained tree.

The model has every context of up to ``DEPTH`` bytes that the training text holds, and stays in
Spark tables: a row for each (context, node) that was met, weighted from the longest contexts up and
mixed from the shortest down, by one aggregate or join for each depth. A node that a context never
met adds nothing to the weights and predicts evenly. Only the prices of the most frequent bytes in
context go to the scoring tasks; all others meet the texts by a join.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsift.llm.texts import numbered, remainder, slices, tokens
from poolsift.session import pin

DEPTH = 4
#: So many words, the most frequent ones, are looked up in the tasks; all others by a join.
FREQUENT = 1 << 16
#: So many bytes in context, the most frequent ones, are priced in the tasks, 16 bytes for each; all others by a join.
FREQUENT_KEYS = 1 << 19
#: Different words, and bytes, that a counting task holds before it hands its sums on.
HOLD_WORDS, HOLD_BYTES = 1 << 18, 1 << 22
END = 0
_WORD, _BYTES = 0, 1


def _coded(text: str) -> np.ndarray:
    """Lowered bytes and the end mark, after marks that are the first context."""
    data = text.encode("utf-8", "surrogatepass").lower()
    return np.frombuffer(bytes(DEPTH) + data + bytes([END]), np.uint8)


def _keys(coded: np.ndarray) -> np.ndarray:
    """For every byte the number of its context and itself, the newest byte lowest."""
    keys = np.zeros(len(coded) - DEPTH, np.int64)
    for k in range(DEPTH + 1):
        keys = keys << 8 | coded[k : len(keys) + k]
    return keys


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def _count(batches):
    """(kind, key, n) of words and bytes in context; a word's key is its hash, the end's is 0."""
    words, ends, keys, held = Counter(), 0, [], 0

    def rows(kind, values, counts):
        kinds = pa.array(np.full(len(values), kind, np.int32))
        return pa.RecordBatch.from_arrays([kinds, pa.array(values, pa.int64()), pa.array(counts, pa.int64())], ["kind", "key", "n"])

    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            words.update(tokens(text))
            ends += 1
            keys.append(_keys(_coded(text)))
            held += len(keys[-1])
            if len(words) > HOLD_WORDS:
                yield rows(_WORD, [word_hash(w) for w in words], list(words.values()))
                words = Counter()
            if held > HOLD_BYTES:
                yield rows(_BYTES, *np.unique(np.concatenate(keys), return_counts=True))
                keys, held = [], 0
    yield rows(_WORD, [word_hash(w) for w in words] + [0] * bool(ends), [*words.values(), *[ends] * bool(ends)])
    if keys:
        yield rows(_BYTES, *np.unique(np.concatenate(keys), return_counts=True))


def count(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, key, n) summed over all of ``docs``."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(_count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the KT probability of so many zeros and ones, by Stirling-safe log-gamma."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - 2 * math.lgamma(0.5) - _lgamma(zeros + ones + 1.0)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log-gamma for x > 0: the recurrence up to 8, then the Stirling series."""
    x = np.array(x, np.float64)
    shift = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        shift[small] -= np.log(x[small])
        x[small] += 1
    inverse = 1 / x
    series = inverse * (1 / 12 - inverse**2 * (1 / 360 - inverse**2 * (1 / 1260 - inverse**2 / 1680)))
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series


def _bits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at each of the 256 nodes (1 is the root) of rows of 256 byte counts."""
    total = np.zeros((len(counts), 512))
    total[:, 256:] = counts
    for node in range(255, 0, -1):
        total[:, node] = total[:, 2 * node] + total[:, 2 * node + 1]
    return total[:, 0:512:2][:, :256], total[:, 1:512:2][:, :256]


class Tree:
    """The mixed prediction log10 P(byte | bytes before) in one process, for few contexts.

    ``mixed`` and ``prices`` are the same model in Spark tables, which ``scores`` uses.

    ``contexts`` lists (depth, number) with every context's shorter ones; ``counts`` holds, for
    the root and then each of them, how often each byte followed.
    """

    def __init__(self, contexts: list[tuple[int, int]], counts: np.ndarray):
        nodes = [(0, 0), *contexts]
        number = {node: i for i, node in enumerate(nodes)}
        n = len(nodes)
        depth = np.array([d for d, _ in nodes])
        parent = np.array([0] + [number[d - 1, c & ((1 << 8 * (d - 1)) - 1)] for d, c in contexts])
        oldest = np.array([0] + [c >> 8 * (d - 1) for d, c in contexts])
        inner = np.zeros(n, bool)
        inner[parent[1:]] = True
        rest = counts.copy()  # what followed an inner context outside its children
        np.subtract.at(rest, parent[1:], counts[1:])
        own, own_one = self._estimate(counts)
        other, other_one = self._estimate(rest)
        # from the deepest contexts up: log P_w, and the weight of stopping at a context
        weighted, stop = own.copy(), np.ones((n, 256), np.float32)
        for d in range(DEPTH - 1, -1, -1):
            here = np.nonzero((depth == d) & inner)[0]
            below = other[here]
            place = np.zeros(n, np.int64)
            place[here] = np.arange(len(here))
            children = np.nonzero(depth == d + 1)[0]
            np.add.at(below, place[parent[children]], weighted[children])
            both = np.logaddexp(own[here], below) - math.log(2)
            stop[here] = np.exp(own[here] - math.log(2) - both)
            weighted[here] = both
        del weighted, own, other
        # from the root down: what the shorter contexts say, and the weight left for longer ones
        said, left = np.zeros((n, 256), np.float32), np.ones((n, 256), np.float32)
        for d in range(DEPTH + 1):
            here = np.nonzero(depth == d)[0]
            before, room = (said[parent[here]], left[parent[here]]) if d else (0, 1)
            said[here] = before + room * stop[here] * own_one[here]
            left[here] = room * (1 - stop[here])
        self.table = np.concatenate([self._bytes(said), self._bytes(said + left * other_one)])
        # a row for each context where the search ends, then one for each where it goes astray
        self.child = np.repeat(np.arange(2 * n, dtype=np.int32)[:, None], 256, axis=1)
        self.child[:n][inner] = (n + np.nonzero(inner)[0])[:, None]
        self.child[parent[1:], oldest[1:]] = np.arange(1, n)

    @staticmethod
    def _estimate(counts, step=2048):
        """At the 256 binary nodes: natural log of the KT probability, and the chance of a one."""
        logs, chance = np.empty((len(counts), 256)), np.empty((len(counts), 256), np.float32)
        for k in range(0, len(counts), step):
            zeros, ones = _bits(counts[k : k + step])
            logs[k : k + step], chance[k : k + step] = _log_kt(zeros, ones), (ones + 0.5) / (zeros + ones + 1)
        return logs, chance

    @staticmethod
    def _bytes(one, step=2048):
        """log10 of byte probabilities from each binary node's chance of a one."""
        out = np.empty((len(one), 256), np.float32)
        for k in range(0, len(one), step):
            part = np.clip(one[k : k + step].astype(np.float64), 1e-12, 1 - 1e-12)
            logs = np.zeros((len(part), 512))
            for node in range(1, 256):
                logs[:, 2 * node] = logs[:, node] + np.log10(1 - part[:, node])
                logs[:, 2 * node + 1] = logs[:, node] + np.log10(part[:, node])
            out[k : k + step] = logs[:, 256:]
        return out

    def log10(self, text: str, step: int = 1 << 20) -> float:
        """log10 probability of the text's lowered bytes and the end mark."""
        coded, total = _coded(text), 0.0
        for k in range(0, len(coded) - DEPTH, step):
            part = coded[k : k + step + DEPTH]
            row = np.zeros(len(part) - DEPTH, np.int32)
            for d in range(1, DEPTH + 1):
                row = self.child[row, part[DEPTH - d : len(part) - d]]
            total += float(self.table[row, part[DEPTH:]].sum(dtype=np.float64))
        return total


def grow(counts: DataFrame) -> Tree:
    """The tree of all contexts in ``counts`` (key, n), which must fit the driver."""
    depths = F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("depth")
    at = counts.select("key", "n", depths).withColumn("byte", F.col("key").bitwiseAND(F.lit(255)))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), 8 * F.col("depth")) - 1
    at = at.withColumn("context", F.shiftright("key", 8).bitwiseAND(mask))
    own = at.groupBy("depth", "context", "byte").agg(F.sum("n").alias("n")).collect()
    nodes = sorted({(r["depth"], r["context"]) for r in own} - {(0, 0)})
    number = {node: i for i, node in enumerate([(0, 0), *nodes])}
    table = np.zeros((len(number), 256))
    for r in own:
        table[number[r["depth"], r["context"]], r["byte"]] = r["n"]
    return Tree(nodes, table)


def _decisions(keys: DataFrame) -> DataFrame:
    """The eight decisions of each byte: where (context and node in one number) and which bit."""
    byte, level = F.col("key").bitwiseAND(F.lit(255)), F.col("level")
    node = F.call_function("shiftright", byte + 256, 8 - level)
    bit = F.call_function("shiftright", byte, 7 - level).bitwiseAND(F.lit(1))
    levels = keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("level"))
    return levels.withColumns({"at": F.col("key") - byte + node, "bit": bit})


def _shorter(depth) -> Column:
    """``at`` in the context of its last ``depth`` bytes."""
    bits = 8 * (F.lit(depth) if isinstance(depth, int) else depth) + 8
    return F.col("at").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)


def _weigh(batches):
    """Adds to (at, zeros, ones, longer) the weighted probability, the weight of stopping here and the own chance of a one."""
    for batch in batches:
        zeros, ones, longer = (np.array(batch.column(i).to_numpy(zero_copy_only=False), np.float64) for i in (1, 2, 3))
        own, deepest = _log_kt(zeros, ones), np.isnan(longer)
        both = np.where(deepest, own, np.logaddexp(own, np.where(deepest, 0, longer)) - math.log(2))
        stop = np.where(deepest, 1, np.exp(own - math.log(2) - both))
        columns = [*batch.columns[:3], pa.array(both), pa.array(stop), pa.array((ones + 0.5) / (zeros + ones + 1))]
        yield pa.RecordBatch.from_arrays(columns, ["at", "zeros", "ones", "weighted", "stop", "own"])


def mixed(counts: DataFrame) -> list[DataFrame]:
    """(at, chance) of each depth from ``counts`` (key, n): the chance of a one where all longer contexts are unknown."""
    n, bit = F.col("n"), F.col("bit")
    sums = _decisions(counts).groupBy("at").agg(F.sum(n * (1 - bit)).alias("zeros"), F.sum(n * bit).alias("ones"), F.first(F.lit(math.nan)).alias("longer"))
    weighed = []
    for depth in range(DEPTH, -1, -1):
        weighed.append(pin(sums.mapInArrow(_weigh, "at long, zeros long, ones long, weighted double, stop double, own double"), f"weighed{depth}"))
        if depth:
            up = weighed[-1].withColumn("at", _shorter(depth - 1))
            sums = up.groupBy("at").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("longer"))
    out, before = [], None
    for depth, nodes in enumerate(reversed(weighed)):
        nodes = nodes.select("at", "stop", "own")
        if before is None:
            nodes = nodes.withColumns({"before": F.lit(0.0), "room": F.lit(1.0)})
        else:
            shorter = before.select(F.col("at").alias("up"), F.col("said").alias("before"), F.col("left").alias("room"))
            nodes = nodes.withColumn("up", _shorter(depth - 1)).join(shorter, "up")
        said, left = F.col("before") + F.col("room") * F.col("stop") * F.col("own"), F.col("room") * (1 - F.col("stop"))
        before = pin(nodes.select("at", said.alias("said"), left.alias("left")), f"mixed{depth}")
        out.append(before.select("at", F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("said") + F.col("left") / 2)).alias("chance")))
    return out


def _priced(decided: DataFrame) -> DataFrame:
    """(key, price) from the chance of each decision; decisions without a row are even."""
    price = F.sum(F.log10(F.when(F.col("bit") == 1, F.col("chance")).otherwise(1 - F.col("chance"))))
    return decided.groupBy("key").agg((price + (8 - F.count("*")) * math.log10(0.5)).alias("price"))


def prices(counts: DataFrame, model: list[DataFrame]) -> DataFrame:
    """(key, n, price) of all bytes in context that ``model`` was trained on."""
    found = _priced(_decisions(counts.select("key")).join(model[DEPTH], "at"))
    return counts.join(found, "key")


def unseen_prices(keys: DataFrame, model: list[DataFrame]) -> DataFrame:
    """(key, price) of other bytes in context: each decision by the longest context that met its node."""
    asked, found = _decisions(keys), []
    for part, small in ((model[:2], True), (model[2:], False)):  # depths 0 and 1: 2^16 rows at most
        first = 0 if small else 2
        tables = [t.withColumn("depth", F.lit(first + i)) for i, t in enumerate(part)]
        nodes = tables[0]
        for t in tables[1:]:
            nodes = nodes.unionByName(t)
        depth = F.explode(F.array(*[F.lit(first + i) for i in range(len(part))])).alias("depth")
        at = asked.select("key", "level", "bit", "at", depth).withColumn("at", _shorter(F.col("depth")))
        found.append(at.join(F.broadcast(nodes) if small else nodes, ["depth", "at"]).select("key", "level", "bit", "depth", "chance"))
    longest = found[0].unionByName(found[1]).groupBy("key", "level").agg(F.first("bit").alias("bit"), F.max_by("chance", "depth").alias("chance"))
    return keys.join(_priced(longest), "key", "left").na.fill({"price": 8 * math.log10(0.5)})


def _score(text: str, names: np.ndarray, costs: np.ndarray, step: int = 1 << 20) -> tuple[float, list, list]:
    """The sum of the prices of the text's bytes that ``names`` holds, and the others with their numbers."""
    coded, total, odd, times = _coded(text), 0.0, [], []
    for k in range(0, len(coded) - DEPTH, step):
        keys, n = np.unique(_keys(coded[k : k + step + DEPTH]), return_counts=True)
        at = np.searchsorted(names, keys)
        met = at < len(names)
        met[met] = names[at[met]] == keys[met]
        total += float((costs[at[met]] * n[met]).sum())
        odd += keys[~met].tolist()
        times += n[~met].tolist()
    return total, odd, times


def scores(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_bytes, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``score`` is the context tree's log10 probability of the whole text, so ``-score / log10(2) / n_bytes``
    is its code length per byte, ``n_bytes`` counting the end mark. ``base_score`` is the smoothed
    unigram model's. A null text is an empty one. Without training rows N and V are zero and every
    token has the probability 1; the tree then knows nothing and charges eight bits a byte.
    """
    counts = pin(count(train, text_col), "counts")
    words = counts.filter(F.col("kind") == _WORD).select("key", "n")
    known = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, divisor = known["n"] or 0, (known["n"] or 0) + known["v"] + 1
    frequent = words.orderBy(F.desc("n"), "key").limit(FREQUENT).toPandas()
    sc = docs.sparkSession.sparkContext
    seen = counts.filter(F.col("kind") == _BYTES).select("key", "n")
    model = mixed(seen)
    priced = pin(prices(seen, model), "prices")
    often = priced.orderBy(F.desc("n"), "key").limit(FREQUENT_KEYS).select("key", "price").orderBy("key").toArrow()
    tree = sc.broadcast((often.column("key").to_numpy(), often.column("price").to_numpy()))
    logs = np.log10(frequent["n"].to_numpy(np.float64) + 1)
    lookup = sc.broadcast(dict(zip(frequent["key"].tolist(), logs.tolist())))
    rows = numbered(docs, id_col, text_col)
    names = ["row", "doc_id", "n_bytes", "n_tokens", "n_known", "known_log", "score", "rare", "times", "odd", "odd_times"]
    kinds = [pa.int64(), None, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), *[pa.list_(pa.int64()), pa.list_(pa.int32())] * 2]

    def score(batches):
        table, cache = lookup.value, {}
        for batch in slices(batches):
            out = []
            for text in batch.column(2).to_pylist():
                found = Counter(tokens(text))
                n_tokens = sum(found.values()) + 1
                n_known, known_log, rare, times = 0, 0.0, [], []
                found[None] = 1
                for word, n in found.items():
                    log = cache.get(word)
                    if log is None:
                        key = 0 if word is None else word_hash(word)
                        log = table.get(key)
                        if log is None:
                            rare.append(key)
                            times.append(n)
                            continue
                        cache[word] = log
                    n_known += n
                    known_log += n * log
                priced_log, odd, odd_times = _score(text, *tree.value)
                out.append((len(text.encode("utf-8", "surrogatepass")) + 1, n_tokens, n_known, known_log, priced_log, rare, times, odd, odd_times))
            columns = [batch.column(0), batch.column(1)]
            columns += [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds[2:])]
            yield pa.RecordBatch.from_arrays(columns, names)

    types = [T.LongType(), rows.schema["doc_id"].dataType, *[T.LongType()] * 3, T.DoubleType(), T.DoubleType(), *[T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())] * 2]
    done = pin(rows.mapInArrow(score, T.StructType([T.StructField(n, t) for n, t in zip(names, types)])), "scored")
    rare = done.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("key"), F.col("r.times").alias("times"))
    met = rare.join(words, "key")
    more = met.groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_log"))
    odd = done.select("row", F.explode(F.arrays_zip("odd", "odd_times")).alias("r")).select("row", F.col("r.odd").alias("key"), F.col("r.odd_times").alias("times"))
    known_prices = priced.select("key", "price")
    others = pin(odd.select("key").distinct().join(known_prices, "key", "left_anti"), "unseen")
    cost = odd.join(known_prices.unionByName(unseen_prices(others, model)), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("price")).alias("more_score"))
    whole = done.join(more, "row", "left").join(cost, "row", "left").na.fill({"more_known": 0, "more_log": 0.0, "more_score": 0.0})
    base = F.col("known_log") + F.col("more_log") - F.col("n_tokens") * F.lit(math.log10(divisor))
    return whole.select(
        "row",
        "doc_id",
        "n_bytes",
        "n_tokens",
        (F.col("n_known") + F.col("more_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("score") + F.col("more_score")).alias("score"),
    )


def held_out(id_col: str = "doc_id"):
    """Rows that the models do not learn from: a seventh of the ids."""
    return remainder(id_col, 7) == 2
