"""Benchmark passages in documents, by a distributed positional inverted index.

The index is partitioned by document: each of its rows holds a document's posting lists, the
positions of every word that a benchmark item uses (other words cannot match). A search needs no
shuffle: a window's lists are intersected where the document's lists lie, shifted by the words'
places in the item, from the window's rarest term in the whole corpus on, so that nearly all false
beginnings fall at the second list. Phrase matches are windows of ten consecutive words, proximity
matches are an item's two rarest terms a few words apart.

The index is written once. Benchmark words are handed to the tasks, so benchmarks of more than
``BLOCK_WORDS`` words are taken in blocks, each with an index of its own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsift.llm.texts import WORD, numbered, slices, without
from poolsift.session import pin

WINDOW = 10
BLOCK_WORDS = 100_000
# A-Z lowered; digits, letters and the bytes of all characters beyond ASCII stay, as in WORD; the others part words.
_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def _offsets(lengths) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())


def item_terms(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, place, word, item_words): every word of every item; ``item`` is a row number."""
    rows = numbered(benchmark, id_col, text_col).withColumnRenamed("row", "item").withColumnRenamed("doc_id", "item_id")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = rows.select("item", "item_id", F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("words"))
    return rows.select("item", "item_id", F.size("words").alias("item_words"), F.posexplode("words").alias("place", "word"))


def index(rows: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(row, doc_id, text_hash, n_words, terms, places) of numbered rows: where the vocabulary's words stand."""
    rows = rows.select("row", "doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_hash"))
    fields = [T.StructField("row", T.LongType()), rows.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("n_words", T.LongType())]
    fields.append(T.StructField("terms", T.ArrayType(T.IntegerType())))
    fields.append(T.StructField("places", T.ArrayType(T.ArrayType(T.IntegerType()))))

    numbers, width = {w.encode("utf-8", "surrogatepass"): term for w, term in vocabulary.items()}, max(1, len(vocabulary))

    def post(batches):
        for batch in slices(batches):
            words = [words_of(text) for text in batch.column(2).to_pylist()]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            terms = np.fromiter(map(numbers.get, chain.from_iterable(words), repeat(-1)), np.int64, sizes.sum())
            row = np.repeat(np.arange(len(words)), sizes)
            place = np.arange(len(terms)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            # one number for a row, a term and a place, in this order; a posting list is a run of them
            longest = max(1, sizes.max())
            lists, places = np.divmod(np.sort(((row * width + terms) * longest + place)[terms >= 0]), longest)
            first = np.flatnonzero(np.diff(lists, prepend=-1))
            row, terms = np.divmod(lists[first], width)
            per_row = _offsets(np.bincount(row, minlength=len(words)))
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(lists)), pa.int32()), pa.array(places, pa.int32()))
            columns = [batch.column(0), batch.column(1), batch.column(3), pa.array(sizes)]
            columns += [pa.ListArray.from_arrays(per_row, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(per_row, places)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return rows.mapInArrow(post, T.StructType(fields))


def frequencies(postings: DataFrame) -> dict[int, int]:
    """How often each term of the block stands in the corpus."""
    sizes = postings.select("terms", F.transform("places", F.size).alias("sizes"))
    each = sizes.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x"))
    counts = each.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.sizes").alias("n"))
    return {r["term"]: r["n"] for r in counts.collect()}  # bounded by the block


class Postings:
    """The posting lists of a document by term; places leave Arrow's array only when a search asks for them."""

    def __init__(self, terms: list[int], first: int, offsets, places):
        self.numbers, self.offsets, self.places, self.read = dict(zip(terms, count(first))), offsets, places, {}

    def keys(self):
        return self.numbers.keys()

    def __contains__(self, term: int) -> bool:
        return term in self.numbers

    def __getitem__(self, term: int) -> list[int]:
        if term not in self.read:
            n = self.numbers[term]
            self.read[term] = self.places[self.offsets[n] : self.offsets[n + 1]].tolist()
        return self.read[term]

    def get(self, term: int, default):
        return self[term] if term in self.numbers else default


def documents_of(terms: pa.ListArray, places: pa.ListArray):
    """The ``Postings`` of each row of a batch."""
    per_row = _offsets(terms.value_lengths()).to_pylist()
    lists, known = places.flatten(), terms.flatten().to_numpy().tolist()
    offsets, flat = _offsets(lists.value_lengths()).to_pylist(), lists.flatten().to_numpy()
    for a, b in zip(per_row, per_row[1:]):
        yield Postings(known[a:b], a, offsets, flat)


def _has(places: list[int], at: int) -> bool:
    k = bisect_left(places, at)
    return k < len(places) and places[k] == at


class Phrases:
    """Every window of the items, filed under its rarest term."""

    def __init__(self, items: dict[int, list[int]], counts: dict[int, int], width: int):
        self.items, self.counts, self.width = items, counts, width
        self.windows = defaultdict(list)  # rarest term: (item, start, place)
        for item, terms in items.items():
            for start in range(max(1, len(terms) - width + 1)):
                place = self._by_rarity(item, start)[0]
                if terms[place] in counts:
                    self.windows[terms[place]].append((item, start, place))

    def _by_rarity(self, item: int, start: int) -> list[int]:
        terms = self.items[item]
        return sorted(range(start, min(start + self.width, len(terms))), key=lambda p: (self.counts.get(terms[p], 0), p))

    def search(self, lists: Postings) -> list[tuple[int, int, int]]:
        """(item, first, last) of a document: runs of matching windows, in its words."""
        hits, orders = defaultdict(set), {}
        for term in lists.keys() & self.windows.keys():
            for item, start, place in self.windows[term]:
                if (item, start) not in orders:
                    orders[item, start] = self._by_rarity(item, start)[1:]
                terms = self.items[item]
                for at in lists[term]:
                    begin = at - place
                    if all(_has(lists.get(terms[p], ()), begin + p) for p in orders[item, start]):
                        hits[item, begin].add(start)
        found = []
        for (item, begin), starts in hits.items():
            size = min(self.width, len(self.items[item]))
            run = None
            for start in sorted(starts):
                if run and start == run[1] + 1:
                    run[1] = start
                else:
                    run = [start, start]
                    found.append((item, begin, run))
        return sorted((item, begin + run[0], begin + run[1] + min(self.width, len(self.items[item])) - 1) for item, begin, run in found)


class Proximities:
    """Each item's two rarest different terms, to be found near each other."""

    def __init__(self, items: dict[int, list[int]], counts: dict[int, int], distance: int):
        self.distance, self.pairs = distance, []
        for item, terms in items.items():
            rarest = sorted({t for t in terms if t in counts}, key=lambda t: (counts[t], t))[:2]
            if len(rarest) == 2:
                self.pairs.append((item, *rarest))

    def search(self, lists: Postings) -> list[tuple[int, int, int]]:
        """(item, first, last): each place of the rarest term with the nearest place of the other."""
        found = []
        for item, a, b in self.pairs:
            if a in lists and b in lists:
                for x in lists[a]:
                    k = bisect_left(lists[b], x)
                    y = min(lists[b][max(0, k - 1) : k + 1], key=lambda y: abs(y - x))
                    if abs(y - x) <= self.distance:
                        found.append((item, min(x, y), max(x, y)))
        return sorted(found)


def matches(postings: DataFrame, query, names: dict[int, object], id_type) -> DataFrame:
    """(row, doc_id, text_hash, n_words, spans): what ``query`` finds in each document, (item_id, first, last)."""
    span = T.StructType([T.StructField("item_id", id_type), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
    schema = T.StructType([*postings.select("row", "doc_id", "text_hash", "n_words").schema.fields, T.StructField("spans", T.ArrayType(span))])

    def find(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in slices(batches, 2048):
            spans = []
            for lists in documents_of(batch.column(4), batch.column(5)):
                spans.append([{"item_id": names[i], "first": a, "last": b} for i, a, b in query.search(lists)])
            columns = [*batch.columns[:4], pa.array(spans, to_arrow_type(schema["spans"].dataType))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return postings.mapInArrow(find, schema)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int = BLOCK_WORDS) -> tuple[int, DataFrame]:
    """Into how many blocks of at most about ``block_words`` words the items fall, and their words."""
    terms = pin(item_terms(benchmark, id_col, text_col), "item_terms")
    return -(-terms.agg(F.count("*")).first()[0] // block_words) or 1, terms


def block(terms: DataFrame, parts: int, k: int):
    """(items, vocabulary, names) of a block: items as lists of the vocabulary's numbers."""
    own = terms.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == k)
    vocabulary, items, names = {}, defaultdict(list), {}
    for r in own.orderBy("item", "place").toLocalIterator():  # bounded by the block
        items[r["item"]].append(vocabulary.setdefault(r["word"], len(vocabulary)))
        names[r["item"]] = r["item_id"]
    return dict(items), vocabulary, names


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WINDOW,
    distance: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(row, doc_id, text_hash, n_words, spans) of every row of ``docs``.

    ``spans`` lists (item_id, first, last) of runs of matching windows, word places counted from 0;
    with ``distance`` it lists proximity matches instead. An item of fewer words than a window is
    one window; an item without words, null or empty, matches nothing. Rows with equal or null ids
    are documents of their own. Items with a null id match, too, with a null item_id.
    """
    id_type, found = benchmark.schema[item_col].dataType, []
    rows = numbered(docs, id_col, text_col)
    parts, terms = blocks(benchmark, item_col, item_text_col, block_words)
    if parts > 1:  # several indexes are joined by row
        rows = pin(rows, "rows")
    for k in range(parts):
        items, vocabulary, names = block(terms, parts, k)
        postings = pin(index(rows, vocabulary), "postings")
        counts = frequencies(postings)
        query = Phrases(items, counts, width) if distance is None else Proximities(items, counts, distance)
        found.append(matches(postings, query, names, id_type))
    whole = found[0]
    for more in found[1:]:
        more = more.select("row", F.col("spans").alias("more"))
        whole = whole.join(more, "row").withColumn("spans", F.concat("spans", "more")).drop("more")
    return whole


def hit_words(spans) -> F.Column:
    """Words inside any span: spans in order of their start, each adding what lies past the last end."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["first"].alias("a"), s["last"].alias("b"))))
    start = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n"))
    step = F.aggregate(
        ordered,
        start,
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["b"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"] - 1))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    return F.coalesce(step, F.lit(0)).cast("long")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` without a benchmark window; columns stay as they are."""
    found = contamination(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    return without(docs, found.filter("size(spans) > 0").select("doc_id", "text_hash").distinct(), id_col, text_col)
