"""Two tokenizers aligned over a corpus: which tokens of one stand where tokens of the other do.

Both token sequences of a text spell the same bytes. Offsets where tokens of both end cut them into
groups; within a group every A token is linked with the B tokens whose bytes it overlaps.

Most groups are one A token and the B token of the same bytes. Their links are known from the A id
alone by a table over the vocabulary, so they are counted in a vector of vocabulary length per task.
Only the links of other groups become rows of (pair, count), added up per document, then per task,
then by a shuffle. For the scores of the documents, pairs from a frequency on are looked up in the
tasks (at most ``HEAD``, whatever the corpus), and the rare rest meets its counts by a join.
"""

from __future__ import annotations

import hashlib
import json
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsift.llm.encoding import byte_slices
from poolsift.llm.packing import encoder
from poolsift.llm.texts import numbered
from poolsift.session import pin

A_JSON, A_RANKS, B_MODEL = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Pairs looked up in the tasks at most: those whose count is above a power of 2^(1/16).
HEAD = 1 << 18
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Vocabularies:
    """Bytes and decimal digits of the ids of A and B, and for each A id the B id of the same bytes."""

    def __init__(self, a_json: str, a_ranks: str | None, b_model: str):
        import sentencepiece

        self.encode_a = encoder(a_json, a_ranks, specials_as_text=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_model)
        with open(a_json, encoding="utf-8") as file:
            whole = json.load(file)
        names = whole["model"]["vocab"] | {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.a_bytes = [b""] * (max(names.values()) + 1)
        of_char = _byte_of_char()
        for name, i in names.items():
            self.a_bytes[i] = bytes(of_char[c] for c in name) if all(c in of_char for c in name) else name.encode()
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces]
        by_bytes = {}
        for i, (piece, is_byte) in enumerate(pieces):  # where a byte has a piece of its own, that one is used
            if not is_byte or self.b_bytes[i] not in by_bytes:
                by_bytes[self.b_bytes[i]] = i
        self.same = np.array([by_bytes.get(x, -1) for x in self.a_bytes], np.int64)
        self.a_size, self.b_size = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.digits, self.n_digits = _digits(max(len(self.a_bytes), len(self.b_bytes)))

    def encode(self, text: str, b_ids: list[int]):
        """A and B ids as arrays; empty ones if either does not spell the text."""
        whole = b" " + text.encode("utf-8", "surrogatepass")
        a_ids = self.encode_a(" " + text)
        if text and all(b"".join(map(table.__getitem__, ids)) == whole for table, ids in ((self.a_bytes, a_ids.tolist()), (self.b_bytes, b_ids))):
            return a_ids.astype(np.int64), np.array(b_ids, np.int64)
        return np.empty(0, np.int64), np.empty(0, np.int64)


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


def _digits(n: int):
    """Decimal digits of 0 to n - 1 from the left, with one free place, and how many each has."""
    width = len(str(n - 1)) + 1
    names = np.arange(n).astype(f"S{width}")
    return np.frombuffer(names.tobytes(), np.uint8).reshape(n, width), np.char.str_len(names).astype(np.int64)


@cache
def vocabularies(a_json: str, a_ranks: str | None, b_model: str) -> Vocabularies:
    path = public_tokenizers.path
    return Vocabularies(path(a_json), a_ranks and path(a_ranks), path(b_model))


def aligned(v: Vocabularies, texts: list[str]) -> dict:
    """All that one batch of texts gives, in arrays over its documents or its links.

    The texts' bytes are laid end to end. Tokens are intervals of them, so every link is one stretch
    between neighbouring ends of tokens of either kind.
    """
    n = len(texts)
    encoded = [v.encode(t, b) for t, b in zip(texts, v.b.encode(texts, num_threads=1))]
    a, b = (np.concatenate([e[k] for e in encoded] or [np.empty(0, np.int64)]) for k in (0, 1))
    n_a, n_b = (np.array([len(e[k]) for e in encoded], np.int64) for k in (0, 1))
    a_end, b_end = np.cumsum(v.a_size[a]), np.cumsum(v.b_size[b])
    doc_end = np.concatenate([[0], a_end])[np.cumsum(n_a)]  # a document without tokens ends where it begins
    cuts = a_end[np.isin(a_end, b_end, assume_unique=True)]
    ends = np.sort(np.concatenate([a_end, b_end]), kind="stable")  # two sorted runs
    ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends
    link_a, link_b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
    group = np.searchsorted(cuts, ends)
    single = np.bincount(group, minlength=len(cuts))[group] == 1
    doc = np.searchsorted(doc_end, ends)
    found = {
        "n_a": n_a,
        "n_b": n_b,
        "n_groups": np.bincount(np.searchsorted(doc_end, cuts), minlength=n),
        "n_links": np.bincount(doc, minlength=n),
        "sha": _group_hashes(v, a, b, a_end, b_end, cuts, n_a, n_b),
    }
    same = single & (v.same[a[link_a]] == b[link_b])
    found["same"], found["same_doc"] = a[link_a[same]], doc[same]
    rest = ~same
    keys = np.stack([doc[rest], a[link_a[rest]] * len(v.b_bytes) + b[link_b[rest]]])
    order = np.lexsort(keys[::-1])
    keys = keys[:, order]
    new = np.ones(keys.shape[1], bool)
    new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
    at = np.flatnonzero(new)
    found["pair_doc"], found["pair"] = keys[:, at]
    found["times"] = np.diff(np.append(at, keys.shape[1]))
    return found


def _group_hashes(v, a, b, a_end, b_end, cuts, n_a, n_b) -> list[str]:
    """sha256 of each document's groups as text, ids in decimal; empty without tokens."""
    a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    # A tokens of a group, then its B tokens; a stable sort by (group, kind) puts them in writing order
    order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
    kind = np.concatenate([2 * a_group, 2 * b_group + 1])[order]
    ids = np.concatenate([a, b])[order]
    last = np.append(kind[1:] != kind[:-1], True) if len(kind) else np.empty(0, bool)
    mark = np.where(last, np.where(kind % 2 == 0, ord("|"), ord(";")), ord(",")).astype(np.uint8)
    size = v.n_digits[ids] + 1
    text = v.digits[ids]
    text[np.arange(len(ids)), size - 1] = mark
    flat = text[np.arange(text.shape[1]) < size[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(n_a + n_b)].tolist()
    return [hashlib.sha256(flat[x : y - 1]).hexdigest() if y > x else "" for x, y in zip([0, *ends], ends)]


def _lists(values: np.ndarray, doc: np.ndarray, n: int, kind) -> pa.Array:
    """One list per document of ``values``, which lie in order of ``doc``."""
    offsets = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def encoded(docs: DataFrame, a_json: str, a_ranks: str | None, b_model: str, id_col: str, text_col: str) -> DataFrame:
    """Counts and group hash of each row; A ids of its same-byte groups; other pairs with their times."""
    rows = numbered(docs, id_col, text_col)
    longs = [T.StructField(c, T.LongType()) for c in COUNTS]
    lists = [("same", T.IntegerType()), ("pairs", T.LongType()), ("times", T.IntegerType())]
    fields = [rows.schema["row"], rows.schema["doc_id"], *longs, T.StructField("groups_sha256", T.StringType())]
    fields += [T.StructField(c, T.ArrayType(kind)) for c, kind in lists]

    def run(batches):
        v = vocabularies(a_json, a_ranks, b_model)
        for batch in byte_slices(batches):
            n, x = batch.num_rows, aligned(v, batch.column(2).to_pylist())
            columns = [batch.column(0), batch.column(1), *(pa.array(x[c], pa.int64()) for c in COUNTS), pa.array(x["sha"], pa.string())]
            columns += [_lists(x["same"], x["same_doc"], n, pa.int32()), _lists(x["pair"], x["pair_doc"], n, pa.int64())]
            columns.append(_lists(x["times"], x["pair_doc"], n, pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))


def same_counts(table: DataFrame, v: Vocabularies) -> DataFrame:
    """(pair, n): links of same-byte groups, counted in one vector of vocabulary length per task."""
    size, pair_of = len(v.same), np.arange(len(v.same)) * len(v.b_bytes) + v.same

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair_of[at]), pa.array(total[at])], ["pair", "n"])

    return table.select("same").mapInArrow(run, "pair long, n long")


def pair_counts(table: DataFrame, v: Vocabularies) -> DataFrame:
    """(pair, n, own, best) of every linked id pair of the corpus; pair is A id times B's size plus B id.

    ``own`` marks pairs of same-byte groups, ``best`` those that no other pair of their B id exceeds.
    """
    rest = table.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    rest = rest.select(F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("n"), F.lit(False).alias("own"))
    both = rest.unionByName(same_counts(table, v).withColumn("own", F.lit(True)))
    counts = both.groupBy("pair").agg(F.sum("n").alias("n"), F.max("own").alias("own"))
    counts = pin(counts.withColumn("b", F.col("pair") % len(v.b_bytes)), "pair_counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # one row per B id at most
    return counts.join(F.broadcast(most), "b").select("pair", "n", "own", (F.col("n") == F.col("most")).alias("best"))


def sixteenth(n: str) -> Column:
    return F.floor(F.log2(n) * 16).cast("int")


def lowest_frequent(pairs: DataFrame, limit: int) -> int:
    """The least step of counts from which on there are ``limit`` pairs at most; a table of some hundred steps."""
    sizes = pairs.groupBy(sixteenth("n").alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    lowest, kept = 1 << 30, 0
    for r in sizes:
        kept += r["n"]
        if kept > limit:
            break
        lowest = r["step"]
    return lowest


def _looked_up(pairs: DataFrame):
    """(pair, n, best) of ``pairs`` as arrays in order of pair; for tables of a known bound."""
    found = pairs.select("pair", "n", F.col("best").cast("long").alias("best")).toArrow().sort_by("pair")
    return tuple(found.column(c).to_numpy() for c in ("pair", "n", "best"))


def scored(table: DataFrame, v: Vocabularies, own, head) -> DataFrame:
    """``table`` with n_best and count_sum over links whose counts are given; the other pairs stay in it."""
    width = len(v.b_bytes)
    own_n, own_best = np.zeros(len(v.same), np.int64), np.zeros(len(v.same), np.int64)
    own_n[own[0] // width], own_best[own[0] // width] = own[1:]
    keys, numbers, bests = head
    kept = [f for f in table.schema.fields if f.name not in ("same", "pairs", "times")]
    fields = [*kept, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]
    fields += [table.schema["pairs"], table.schema["times"]]

    def sums(column, values):
        through = np.concatenate([[0], np.cumsum(values)])
        ends = column.offsets.to_numpy() - column.offsets[0].as_py()
        return through[ends[1:]] - through[ends[:-1]]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            same, pairs, times = (batch.column(c) for c in ("same", "pairs", "times"))
            ids, pair, often = (c.flatten().to_numpy() for c in (same, pairs, times))
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            at = np.where(known, at, 0)
            count = np.where(known, numbers[at] * often, 0) if len(keys) else np.zeros(len(pair), np.int64)
            best = np.where(known, bests[at] * often, 0) if len(keys) else np.zeros(len(pair), np.int64)
            doc = np.repeat(np.arange(n), np.diff(pairs.offsets.to_numpy()))[~known]
            columns = [batch.column(f.name) for f in kept]
            columns.append(pa.array(sums(same, own_best[ids]) + sums(pairs, best)))
            columns.append(pa.array(sums(same, own_n[ids]) + sums(pairs, count)))
            columns += [_lists(pair[~known], doc, n, pa.int64()), _lists(often[~known], doc, n, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return table.mapInArrow(run, T.StructType(fields))


def align(
    docs: DataFrame,
    a_json: str = A_JSON,
    a_ranks: str | None = A_RANKS,
    b_model: str = B_MODEL,
    id_col: str = "doc_id",
    text_col: str = "text",
    head: int = HEAD,
) -> tuple[DataFrame, DataFrame]:
    """The rows' digests, and (a, b, n, best) of every id pair that the corpus links.

    Digests: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. A null or empty text
    and one that either tokenizer does not spell has zeros and an empty hash. Rows with equal or null
    ids are documents of their own and all count; very long texts are taken whole; an empty table
    gives no rows and no pairs. Other columns are not read. ``a_ranks`` is the faster form of A.
    """
    table = pin(encoded(docs, a_json, a_ranks, b_model, id_col, text_col), "aligned")
    v = vocabularies(a_json, a_ranks, b_model)
    pairs = pin(pair_counts(table, v), "pairs")
    in_head = sixteenth("n") >= lowest_frequent(pairs, head)
    known = pin(scored(table, v, _looked_up(pairs.filter("own")), _looked_up(pairs.filter(in_head))), "scored")
    left = known.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.*")
    left = left.join(pairs.filter(~in_head).select(F.col("pair").alias("pairs"), "n", "best"), "pairs")
    rest = left.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("times")).alias("_sum")
    )
    digests = known.join(rest, "row", "left").select(
        "doc_id",
        *COUNTS,
        (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
    width = len(v.b_bytes)
    return digests, pairs.select(F.floor(F.col("pair") / width).cast("int").alias("a"), (F.col("pair") % width).cast("int").alias("b"), "n", "best")
