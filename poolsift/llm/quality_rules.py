"""Quality rules: a decision list learned by sequential covering.

Every text is described by counts and shares of its words, lines and symbols, all by DataFrame
functions. Rules that reject are learned from labelled texts one after another: the statistics of
all pairs of features on a grid of thresholds, one small table, give the conjunction of two
thresholds that separates low quality best on the growing part; it is pruned to one threshold if
that does as well on the pruning part, and it is kept if it is precise there. Texts that a rule
covers leave, and the next rule is grown on the rest. The list becomes one conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolsift.llm import labelled
from poolsift.llm.texts import TOKEN, numbered, once
from poolsift.session import pin

FEATURES = ["words", "word_length", "symbols", "repeated_lines", "repeated_words", "upper", "marks", "distinct", "stops"]
CUTS = 16
RULES = 12
#: A rule must be so precise on the pruning part, and cover so many of its low-quality texts.
PRECISION, SUPPORT = 0.95, 3


def _repeat_words(grams: Column) -> Column:
    """Words inside windows found twice or more, from the hashes of all three-word windows."""
    ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s):
        def repeated(x, k):
            before, after = F.get(s, k - 1), F.get(s, k + 1)
            return F.coalesce(x["h"] == before["h"], F.lit(False)) | F.coalesce(x["h"] == after["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(s, repeated), lambda x: x["i"]))

    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(
        once(ordered, places),
        start,
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), covered).otherwise(0)


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, FEATURES...)."""
    text = F.col("text")
    letters = numbered(docs, id_col, text_col).select(
        "row",
        "doc_id",
        F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("tokens"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))).alias("upper_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[!?]", ""))).alias("n_marks"),
        (F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))).alias("n_stops"),
    )

    def grams(words):
        starts = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    counted = letters.select(
        "row",
        "doc_id",
        F.size("tokens").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        once(once(F.col("tokens"), grams), _repeat_words).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("tokens")).alias("n_distinct"),
        "upper_chars",
        "n_marks",
        "n_stops",
    )
    words = F.greatest(F.col("n_words"), F.lit(1))
    shares = {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "repeated_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeated_words": F.col("n_repeat_words") / words,
        "upper": F.col("upper_chars") / F.greatest(F.col("word_chars"), F.lit(1)),
        "marks": F.col("n_marks") / words,
        "distinct": F.col("n_distinct") / words,
        "stops": F.col("n_stops") / words,
    }
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = ["row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return counted.select(*base, failed.alias("base_failed"), *(v.alias(k) for k, v in shares.items()))


@dataclass(frozen=True)
class Threshold:
    """``feature`` at or above ``cut``, or below it."""

    feature: str
    above: bool
    cut: float

    def holds(self) -> Column:
        value = F.col(self.feature)
        return value >= self.cut if self.above else value < self.cut

    def __str__(self):
        return f"{self.feature} {'>=' if self.above else '<'} {self.cut:.6g}"


Rule = tuple[Threshold, ...]


def _all(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (t.holds() for t in rule))


def verdict(rules: list[Rule]) -> Column:
    """Text of the first rule that holds, null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(_all(rule), F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many cuts the feature reaches."""
    cuts = F.array(*map(F.lit, cuts)).cast("array<double>")
    return F.size(F.filter(cuts, lambda c: c <= F.col(feature)))


def _grids(rows: DataFrame) -> np.ndarray:
    """[part, label, feature, feature, bin, bin]: how many labelled rows fall into each cell."""
    n = len(FEATURES)
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col("bins")[i].alias("a"), F.col("bins")[j].alias("b")) for i in range(n) for j in range(i + 1, n)]
    cells = rows.select("part", "label", F.explode(F.array(*pairs)).alias("p")).groupBy("part", "label", "p.i", "p.j", "p.a", "p.b")
    table = np.zeros((2, 2, len(FEATURES), len(FEATURES), CUTS + 1, CUTS + 1))
    for r in cells.agg(F.count("*").alias("n")).collect():
        table[r["part"], r["label"], r["i"], r["j"], r["a"], r["b"]] = r["n"]
    return table


def _candidates(grid: np.ndarray, cuts: dict[str, list[float]]):
    """(rule, counts[part, label]) for all conjunctions of two thresholds and their single ones."""
    for i, first in enumerate(FEATURES):
        for j in range(i + 1, len(FEATURES)):
            second, cell = FEATURES[j], grid[:, :, i, j]
            for a in range(1, len(cuts[first]) + 1):
                for up_a in (True, False):
                    part = (cell[:, :, a:] if up_a else cell[:, :, :a]).sum(axis=2)
                    one = Threshold(first, up_a, cuts[first][a - 1])
                    total = part.cumsum(axis=2)
                    if j == i + 1:
                        yield (one,), total[:, :, -1]
                    for b in range(1, len(cuts[second]) + 1):
                        below = total[:, :, b - 1]
                        yield (one, Threshold(second, False, cuts[second][b - 1])), below
                        yield (one, Threshold(second, True, cuts[second][b - 1])), total[:, :, -1] - below
    last = FEATURES[-1]
    cell = grid[:, :, -2, -1].sum(axis=2).cumsum(axis=2)
    for b in range(1, len(cuts[last]) + 1):
        yield (Threshold(last, False, cuts[last][b - 1]),), cell[:, :, b - 1]
        yield (Threshold(last, True, cuts[last][b - 1]),), cell[:, :, -1] - cell[:, :, b - 1]


def _worth(counts) -> float:
    """(low - high) / (low + high) quality covered; nothing covered is worth least."""
    low, high = counts[0], counts[1]
    return (low - high) / (low + high) if low + high else -1.0


def learn(rows: DataFrame, max_rules: int = RULES) -> list[Rule]:
    """The decision list from rows with FEATURES and label (0: low quality), at most a bounded sample."""
    part = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0, 1).otherwise(0)
    rows = pin(rows.select("doc_id", "row", "label", part.alias("part"), *FEATURES), "labelled")
    shares = [(k + 0.5) / CUTS for k in range(CUTS)]
    quantiles = rows.agg(*(F.percentile_approx(f, F.array(*map(F.lit, shares)), 10_000).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted({c for c in (quantiles[f] or [])}) for f in FEATURES}
    low = rows.filter("label = 0").agg(*(F.percentile_approx(f, F.array(*map(F.lit, shares[::2])), 10_000).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted({*cuts[f], *(low[f] or [])}) for f in FEATURES}
    cuts = {f: c if len(c) <= CUTS else [c[round(k * (len(c) - 1) / (CUTS - 1))] for k in range(CUTS)] for f, c in cuts.items()}
    rows = pin(rows.withColumn("bins", F.array(*(_bin(f, cuts[f]) for f in FEATURES))), "binned")
    rules: list[Rule] = []
    while len(rules) < max_rules:
        rest = rows.filter(verdict(rules).isNull()) if rules else rows
        grid = _grids(rest)
        total = grid[:, :, 0, 1].sum(axis=(2, 3))
        if not total[0, 0]:
            break
        base = log2((total[0, 0] + 1) / (total[0].sum() + 2))

        def gain(counts):
            return counts[0] * (log2((counts[0] + 1) / (counts.sum() + 2)) - base) if counts[0] else 0.0

        known = {frozenset(rule): counts for rule, counts in _candidates(grid, cuts)}
        best = max(known, key=lambda r: (gain(known[r][0]), -len(r), sorted(map(str, r))))
        shorter = [r for r in known if r < best] + [best]
        rule = max(shorter, key=lambda r: (_worth(known[r][1]), -len(r), gain(known[r][0])))
        low_grown, high_grown = known[rule][0]
        low_held, high_held = known[rule][1]
        if low_held < SUPPORT or low_held < PRECISION * (low_held + high_held) or low_grown < PRECISION * (low_grown + high_grown):
            break
        rules.append(tuple(sorted(rule, key=lambda t: FEATURES.index(t.feature))))
    return rules


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", max_rows: int = labelled.MAX_ROWS) -> DataFrame:
    """Columns of ``describe`` with ``rule`` (the first that rejects, else null) and ``kept``.

    A null text is an empty one. Rows with equal ids are judged one by one. Without labels of both
    kinds there are no rules. Texts that fail the fixed base rules are never kept.
    """
    found = pin(describe(docs, id_col, text_col), "described")
    known = labelled.with_labels(found, labelled.sample(labels, label, max_rows, id_col))
    rules = learn(known.filter("not base_failed"))
    rule = verdict(rules)
    return found.withColumns({"rule": rule, "kept": ~F.col("base_failed") & rule.isNull()})
