"""Repeated passages removed line by line, by overlapping three-line windows.

A sentence ends at a line break, after a full stop, question or exclamation mark before white space,
and after the full stops of other scripts. A sentence of more than ``LONGEST`` words is cut into
lines before each word that has the least hash among ``LONGEST`` words in a row: lines have so many
words at most, and away from its ends a passage is cut alike wherever it stands. Any 50 words then
hold three whole lines, and 20 words, between cuts that only depend on them.

Three consecutive sentences of ``MIN_WORDS`` words make a window, and so do three consecutive lines of
``LINE_WORDS`` words; where they have fewer, the lines beside them join until there are enough, so that
passages of short lines are found as well. The first occurrence of a window in the order (id, row,
place) stays; words that any later occurrence covers go. A removed line's text always survives at
the earliest place of its windows, so nothing disappears from the corpus altogether.

From every line on, the shortest window is hashed and counted, as bare 64-bit numbers that combine
before the shuffle; a longer window from there can only repeat if this one does. Most occur once. A
bitmap of fixed size, set for the repeated ones, then tells a second reading of the texts which windows
have to be looked for at all, and their first places are found by hash. A third reading removes all
windows of the bitmap but those at their first place; one that the bitmap lets through though it occurs
once is at its first place. Words, lines and windows of a batch of texts are found on its bytes
with NumPy, and a window's hash is a difference of prefix sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsift.llm.encoding import byte_slices
from poolsift.llm.texts import located, numbered_in

WINDOW = 3
#: Runs of fewer words recur by chance ("Yes. No. Yes.") and are no passage; windows grow to so many.
MIN_WORDS = 10
#: Windows that may begin or end inside a sentence need so many words.
LINE_WORDS = 20
#: Words of a line at most; four lines less one word are the shortest passage that is found for sure.
LONGEST = 12
#: Bits of the table of repeated windows, 16 MB. A fuller table lets more windows through, none less.
BITS = 1 << 27
#: Bitmaps of Spark have so many bits each.
_BITMAP = 1 << 15
#: First and last code points of Thai to Myanmar, Khmer, Han and kana: no spaces, every character counts as a word.
UNSPACED = (0x0E00, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x312F), (0x3190, 0xA4CF), (0xF900, 0xFAFF), (0xFF00, 0xFF9F), (0x20000, 0x3FFFF)
#: Full stops that need no white space behind them.
STOPS = 0x3002, 0xFF01, 0xFF1F, 0xFF61, 0x0964, 0x06D4, 0x061F, 0x1362
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Odd factors of the two polynomials, for the bytes of a word and the words of a window, and a value for each byte.
BYTE_FACTOR, WORD_FACTOR = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_VALUES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits spread over the whole number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd factor modulo 2^64, and of its inverse, as far as they were asked for."""

    def __init__(self, factor: int):
        self.bases = np.uint64(factor), np.uint64(pow(factor, -1, 1 << 64))
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int):
        if len(self.tables[0]) < n:
            size = max(n, 2 * len(self.tables[0]))
            self.tables = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b)]), dtype=np.uint64) for b in self.bases]
        return self.tables[0][:n], self.tables[1][:n]


def _prefix_sums(values: np.ndarray, powers: _Powers):
    """A function from (first, end) to hashes of those runs of ``values`` that do not depend on where they lie."""
    up, down = powers.upto(len(values) + 1)
    through = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:-1], dtype=np.uint64)])
    return lambda first, end: (through[end] - through[first]) * down[first]


_BYTES, _WORDS = _Powers(BYTE_FACTOR), _Powers(WORD_FACTOR)


class Cut:
    """Words, sentences and lines of some texts, laid end to end as UTF-8 bytes with a line break behind each.

    ``word`` is the first byte of each word, ``sentence`` and ``line`` the first word of each; all of
    them, and ``doc_word`` and ``doc_line`` per text, end with the end of the last.
    """

    def __init__(self, texts: list[str]):
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
        data, n = self.data, len(self.data)
        self.doc_byte = np.concatenate([[0], np.cumsum([len(e) + 1 for e in encoded])]).astype(np.int64)
        space = _SPACE[data]
        starts = ~space
        starts[1:] &= space[:-1]
        stop = np.zeros(n + 1, bool)  # by the byte behind the stop
        lone = np.zeros(n, bool)
        wide = np.flatnonzero(data >= 0xD8) if (data >= 0x80).any() else ()
        if len(wide):  # characters of two bytes and more, as far as they matter here
            size = 2 + (data[wide] >= 0xE0) + (data[wide] >= 0xF0)
            at = np.minimum(wide[:, None] + np.arange(1, 4), n - 1)
            code = data[wide].astype(np.int64) & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 7))
            for k in range(3):
                code = np.where(size > k + 1, code << 6 | data[at[:, k]] & 0x3F, code)
            single = np.zeros(len(wide), bool)
            for low, high in UNSPACED:
                single |= (code >= low) & (code <= high)
            ends = np.isin(code, STOPS)
            starts[wide[single]] = True
            behind = (wide + size)[single]
            starts[behind[~space[behind]]] = True
            stop[(wide + size)[ends]] = True
            lone[wide[single & ends]] = True
        first = np.flatnonzero(starts)
        last = np.flatnonzero(~space[:-1] & (space[1:] | starts[1:])) + 1  # behind each word's last byte
        self.word, self.end = np.append(first, n), last
        words = len(first)
        self.doc_word = np.searchsorted(first, self.doc_byte)
        self.doc_of = np.repeat(np.arange(len(texts)), np.diff(self.doc_word))
        own = mixed(_prefix_sums(_VALUES[data], _BYTES)(first, last) + (last - first).astype(np.uint64))
        self.hash_of = _prefix_sums(own, _WORDS)
        begins = np.zeros(words + 1, bool)
        if words:
            breaks = np.concatenate([[0], np.cumsum(data == 10)])
            marked = stop[last[:-1]] & ~lone[first[1:]]
            marked |= np.isin(data[last[:-1] - 1], list(b".!?")) & (first[1:] > last[:-1])
            begins[1:-1] = marked | (breaks[first[1:]] > breaks[last[:-1]])
        begins[self.doc_word] = True
        self.sentence = np.flatnonzero(begins)
        begins[self._inner_cuts(own >> np.uint64(32), words)] = True
        self.line = np.flatnonzero(begins)
        self.doc_line = np.searchsorted(self.line, self.doc_word)

    def _inner_cuts(self, keys, words) -> np.ndarray:
        """Words that begin a line inside a sentence: the least of so many in a row, the sentence's first word left out."""
        if words < LONGEST:
            return np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(self.sentence) - 1), np.diff(self.sentence))
        first = np.arange(words - LONGEST + 1)
        first = first[(owner[first] == owner[first + LONGEST - 1]) & (first != self.sentence[owner[first]])]
        return np.unique(first + np.lib.stride_tricks.sliding_window_view(keys, LONGEST)[first].argmin(axis=1))

    def _runs(self, starts: np.ndarray, width: int, min_words: int):
        """The shortest runs of ``width`` pieces and ``min_words`` words from each piece on, and up to each.

        (first word, word behind, word behind the shortest run from the first word on). Both kinds
        together cover any longer run, up to both of its ends, without leaving it.
        """
        k = np.arange(len(starts) - 1)
        doc = self.doc_of[starts[:-1]] if len(k) else np.empty(0, np.int64)
        end = np.maximum(np.searchsorted(starts, starts[:-1] + min_words), k + width)
        ahead = (end < len(starts)) & (doc[np.minimum(end, len(k)) - 1] == doc)
        first = np.minimum(np.searchsorted(starts, starts[1:] - min_words, "right") - 1, k + 1 - width)
        back = (first >= 0) & (doc[np.maximum(first, 0)] == doc)
        first, shortest = first[back], starts[end[ahead]]
        behind = starts[end[first]]
        return np.stack([starts[:-1][ahead], shortest, shortest]), np.stack([starts[first], starts[1:][back], behind])

    def windows(self, width: int = WINDOW, min_words: int = MIN_WORDS):
        """(text, first word, word behind, hash, hash of the shortest window from there) of all windows.

        Words count within their text. A text of enough words that has no window is one window.
        Sentences with words enough for windows of lines need none of their own: those cover them.
        """
        least = max(min_words, LINE_WORDS)
        lines, lines_back = self._runs(self.line, width, least)
        few = [r[:, r[1] - r[0] < least] for r in self._runs(self.sentence, width, min_words)]
        sizes = np.diff(self.doc_word)
        some = np.bincount(self.doc_of[np.concatenate([lines[0], few[0][0]])], minlength=len(sizes)) > 0
        bare = np.flatnonzero((sizes >= max(min_words, 1)) & ~some)
        whole = np.stack([self.doc_word[bare], self.doc_word[bare + 1], self.doc_word[bare + 1]])
        found = np.concatenate([lines, few[0], whole, lines_back, few[1]], axis=1)
        _, at = np.unique(found[0] << 32 | found[1], return_index=True)
        first, end, shortest = found[:, at]
        doc = self.doc_of[first]
        value, gate = (mixed(self.hash_of(first, e) + (e - first).astype(np.uint64)).view(np.int64) for e in (end, shortest))
        return doc, first - self.doc_word[doc], end - self.doc_word[doc], value, gate

    def repeated(self, table: np.ndarray, bits: int, width: int, min_words: int):
        """(text, first word, word behind, hash) of the windows whose shortest one is in ``table``."""
        *found, gate = self.windows(width, min_words)
        bit = gate % bits
        at = np.flatnonzero(table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
        return [x[at] for x in found]

    def without(self, doc: np.ndarray, first: np.ndarray, end: np.ndarray):
        """Texts without these words and the white space behind them; lines of each; lines that lost a word."""
        places = np.concatenate([self.word[:-1], [len(self.data)]])
        places[self.doc_word[:-1][np.diff(self.doc_word) > 0]] = self.doc_byte[:-1][np.diff(self.doc_word) > 0]
        depth, words = np.zeros(len(self.data) + 1, np.int64), np.zeros(len(self.word), np.int64)
        first, end = first + self.doc_word[doc], end + self.doc_word[doc]
        stop = np.where(end == self.doc_word[doc + 1], self.doc_byte[doc + 1] - 1, places[end])
        np.add.at(depth, places[first], 1)
        np.add.at(depth, stop, -1)
        np.add.at(words, first, 1)
        np.add.at(words, end, -1)
        stays = np.cumsum(depth)[:-1] == 0
        ends = np.concatenate([[0], np.cumsum(stays)])[self.doc_byte]
        kept = self.data[stays].tobytes()
        texts = [kept[a : b - 1].decode("utf-8", "surrogatepass") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        lines = np.diff(self.doc_line)
        lost = np.concatenate([[0], np.cumsum(np.cumsum(words)[self.line[:-1]] > 0)])[self.doc_line]
        return texts, lines, np.diff(lost)


def window_hashes(rows: DataFrame, width: int, min_words: int) -> DataFrame:
    """(hash) of the shortest windows of numbered rows, one row for each occurrence."""

    def run(batches):
        for batch in byte_slices(batches, 0):
            *_, value, gate = Cut(batch.column(0).to_pylist()).windows(width, min_words)
            yield pa.RecordBatch.from_arrays([pa.array(value[value == gate])], ["hash"])

    return rows.select("text").mapInArrow(run, "hash long")


def repeated_bits(rows: DataFrame, width: int, min_words: int, bits: int = BITS) -> np.ndarray:
    """``bits`` bits as bytes: one is set for each hash that occurs more than once."""
    counts = window_hashes(rows, width, min_words).groupBy("hash").agg(F.count("*").alias("n"))
    bit = F.pmod(F.col("hash"), F.lit(bits))
    maps = counts.filter("n > 1").select(F.bitmap_bucket_number(bit + 1).alias("part"), F.bitmap_bit_position(bit + 1).alias("at"))
    maps = maps.groupBy("part").agg(F.bitmap_construct_agg("at").alias("map")).collect()  # at most 4096 bitmaps of 4 KB
    table = np.zeros(max(bits, _BITMAP) // 8, np.uint8)
    for r in maps:
        at = (r["part"] - 1) * _BITMAP // 8
        table[at : at + _BITMAP // 8] = np.frombuffer(r["map"], np.uint8)
    return table


def windows(rows: DataFrame, width: int, min_words: int, table: np.ndarray, bits: int = BITS) -> DataFrame:
    """(row, doc_id, span, hash) of the windows in ``table``; span is the first word times 2^32 plus the word behind."""
    fields = [rows.schema["row"], rows.schema["doc_id"], T.StructField("span", T.LongType()), T.StructField("hash", T.LongType())]

    def run(batches):
        for batch in byte_slices(batches):
            doc, first, end, value = Cut(batch.column(2).to_pylist()).repeated(table, bits, width, min_words)
            at = pa.array(doc)
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(first << 32 | end), pa.array(value)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))


def first_places(found: DataFrame) -> DataFrame:
    """(row, firsts): the spans at which a window occurs for the first time. A hot window combines before the shuffle."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "span")
    kept = found.groupBy("hash").agg(F.min(place).alias("kept")).select("kept.row", "kept.span")
    return kept.groupBy("row").agg(F.collect_list("span").alias("firsts"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of ``docs`` with its other columns, the text that stays, ``n_lines`` and ``n_removed``.

    Null ids come last in the order of occurrences; rows with equal ids follow their ``row`` name. A null
    text stays null with no lines; a text whose lines all go becomes empty; the row remains. Very long texts are
    cut whole; an empty table gives no rows. New columns of the same names as old ones replace them.
    """
    table = located(docs)
    rows = numbered_in(table, id_col, text_col)
    bits = BITS
    known = repeated_bits(rows, width, min_words, bits)
    firsts = first_places(windows(rows, width, min_words, known, bits))
    kinds = {"text": pa.string(), "lines": pa.int64(), "gone": pa.int64()}
    result = T.StructType([T.StructField("text", T.StringType()), T.StructField("lines", T.LongType()), T.StructField("gone", T.LongType())])

    @F.arrow_udf(result)
    def kept(texts: pa.Array, firsts: pa.Array) -> pa.Array:
        parts = []
        for batch in byte_slices([pa.RecordBatch.from_arrays([texts, firsts], ["text", "firsts"])], 0):
            cut = Cut(["" if t is None else t for t in batch.column(0).to_pylist()])
            doc, first, end, _ = cut.repeated(known, bits, width, min_words)
            stays = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().fill_null(0).to_numpy())
            a, b = np.divmod(batch.column(1).flatten().to_numpy().astype(np.int64), 1 << 32)
            # words of the whole batch are numbered, so that a window is known by its first and its last word
            own, his = (cut.doc_word[d] + x << 32 | cut.doc_word[d] + y for d, x, y in ((doc, first, end), (stays, a, b)))
            gone = ~np.isin(own, his)
            found = cut.without(doc[gone], first[gone], end[gone])
            parts.append(pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(found, kinds.values())], list(kinds)))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(kinds.items())))

    text = F.col("doc")[text_col]
    done = table.join(firsts, "row", "left").withColumn("kept", kept(text, F.col("firsts")))
    done = done.select("doc.*", F.struct(F.when(text.isNotNull(), F.col("kept.text")).alias("text"), "kept.lines", "kept.gone").alias("__kept"))
    return done.withColumns({text_col: F.col("__kept.text"), "n_lines": F.col("__kept.lines"), "n_removed": F.col("__kept.gone")}).drop("__kept")
