"""Documents packed into training sequences by their length histogram.

Documents are cut into pieces of at most ``seq_len`` tokens. The histogram of piece lengths, at
most ``seq_len`` numbers, is packed shortest pack first: from the longest length down, pieces go
into the packing pattern with the most room, and patterns are counted, not sequences. Patterns
meet documents again by rank: the pieces of a length are numbered, and each pattern owns an
interval of those numbers.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from poolsift.llm.texts import numbered, slices
from poolsift.session import pin

SEQ_LEN = 2048
END_ID = 1
#: A length's pieces are numbered in so many parts, so that a hot length is no single group.
PARTS = 256
#: Texts of these characters alone are cut alike by both libraries; others take the slower one.
PLAIN = re.compile("[\t\n\r -~¡-ɏ–-…€]*")


@cache
def encoder(json_path: str, ranks_path: str | None, specials_as_text: bool = False):
    """A function from text to token ids as an unsigned array, nothing added before or behind.

    A special token's string inside a text is that token, as the library has it by default, or plain text.
    """
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path)
    exact.encode_special_tokens = specials_as_text
    special = [] if specials_as_text else [t.content for t in exact.get_added_tokens_decoder().values()]

    def by_json(text):
        return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)

    if ranks_path is None:
        return by_json
    import tiktoken

    lines = (line.split() for line in open(ranks_path, "rb"))
    ranks = {base64.b64decode(word): int(rank) for word, rank in lines}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def by_ranks(text):
        plain = PLAIN.fullmatch(text) and not any(s in text for s in special)
        return fast.encode_to_numpy(text) if plain else by_json(text)

    return by_ranks


def cut_pieces(
    docs: DataFrame,
    seq_len: int = SEQ_LEN,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    ranks: str | None = "byte_bpe_50k.tiktoken",
    with_ids: bool = False,
) -> DataFrame:
    """(row, doc_id, start, length, ids_crc32, doc_tokens) of each piece, and its ids if wanted.

    A null text is an empty one and yields the end id alone. ``ranks`` names the same vocabulary
    in the form that the faster library reads.
    """
    rows = numbered(docs, id_col, text_col)
    fields = [T.StructField("row", T.LongType()), rows.schema["doc_id"]]
    fields += [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))

    def cut(batches):
        encode = encoder(public_tokenizers.path(tokenizer), ranks and public_tokenizers.path(ranks))
        for batch in slices(batches):
            at, out = [], {n: [] for n in ("start", "length", "ids_crc32", "doc_tokens", "ids")}
            for i, text in enumerate(batch.column(2).to_pylist()):
                ids = np.append(encode(text), END_ID).astype("<u4")
                for start in range(0, len(ids), seq_len):
                    data = ids[start : start + seq_len].tobytes()
                    at.append(i)
                    for name, value in zip(out, (start, len(data) // 4, zlib.crc32(data), len(ids), data if with_ids else None)):
                        out[name].append(value)
            at = pa.array(at, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at)]
            columns += [pa.array(out[f.name], pa.binary() if f.name == "ids" else pa.int64()) for f in fields[2:]]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return rows.mapInArrow(cut, T.StructType(fields))


def shortest_pack_first(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> tuple[list[tuple], int]:
    """Intervals (length, first rank, pieces, per sequence, first sequence, offset); sequences.

    An interval's pieces fill consecutive sequences with so many pieces each, from the offset on.
    A pattern is a run of sequences with equal contents, so it is a range of sequence numbers.
    """
    open_packs: list[tuple[int, int, int]] = []  # (-room, first sequence, sequences)
    intervals, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if open_packs and -open_packs[0][0] >= length:
                room, first, n = heapq.heappop(open_packs)
                room = -room
                # so many at once that the pack is level with the next shortest
                level = -open_packs[0][0] if open_packs else 0
                each = max(1, min(-(-(room - level) // length), room // length, left))
            else:
                room, first, n, each = seq_len, sequences, left, 1
                sequences += left
            used = min(n, left // each)
            if used < n:
                heapq.heappush(open_packs, (-room, first + used, n - used))
            intervals.append((length, rank, used * each, each, first, seq_len - room))
            left, rank = left - used * each, rank + used * each
            if room - length * each:
                heapq.heappush(open_packs, (length * each - room, first, used))
    return intervals, sequences


def ranked(pieces: DataFrame) -> DataFrame:
    """Pieces with ``rank``: gapless from 0 within a length."""
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("row", "start"), F.lit(PARTS)).cast("int"))
    sizes = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "part").orderBy("row", "start")
    joined = pieces.join(offsets, ["length", "part"])
    return joined.withColumn("rank", F.col("before") + F.row_number().over(order) - 1).drop("part", "before")


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, **options) -> DataFrame:
    """Every piece of ``cut_pieces`` with ``sequence_id`` and ``offset``.

    Rows with equal or null ids are documents of their own; an empty table packs to no rows.
    """
    pieces = pin(cut_pieces(docs, seq_len, **options), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    intervals, _ = shortest_pack_first(histogram, seq_len)
    table = {}
    for length, *rest in intervals:  # in order of rank within a length
        table.setdefault(length, []).append(rest)
    table = {length: np.array(rows, np.int64).T for length, rows in table.items()}

    def place(batches):
        for batch in batches:
            lengths, ranks = (batch.column(n).to_numpy() for n in ("length", "rank"))
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                own = lengths == length
                first_rank, _, each, first, base = table[length]
                k = np.searchsorted(first_rank, ranks[own], "right") - 1
                nth = ranks[own] - first_rank[k]
                sequence[own] = first[k] + nth // each[k]
                offset[own] = base[k] + nth % each[k] * length
            columns = [batch.column(n) for n in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    names = pieces.columns
    fields = [T.StructField(n, T.LongType()) for n in ("sequence_id", "offset")]
    return ranked(pieces).mapInArrow(place, T.StructType([*pieces.schema.fields, *fields]))


def sequences(docs: DataFrame, seq_len: int = SEQ_LEN, **options) -> DataFrame:
    """(sequence_id, ids) with the real tokens, as 32-bit little-endian binary without padding."""
    packed = pack(docs, seq_len, with_ids=True, **options)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most seq_len tokens
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda all_, x: F.concat(all_, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
