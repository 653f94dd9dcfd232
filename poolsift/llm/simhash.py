"""Near-duplicates by 64-bit SimHash, candidates by pigeonring filtering.

Two fingerprints link when at most three bits differ. Cut into eight bytes in a ring, a linked
pair has a byte from which every run of k bytes differs in at most floor(3k/8) bits: none in the
first two, at most one in the first five, two in the first six and seven. With at most one bit in
bytes three to five, one half of them is equal, so start, two bytes and that half make a join key
of 28 bits: sixteen keys find every link. The run budgets are checked before the whole distance.

Keys are made from distinct fingerprints, so copies cost nothing. A key that many different
fingerprints share (a large group of near copies) is dealt out as pairs of blocks; each block
pair returns links that span what is linked inside it, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsift.llm.components import components
from poolsift.llm.texts import located, numbered, numbered_in, slices, tokens
from poolsift.session import pin

LIMIT = 3
BYTES = 8
BUDGET = [LIMIT * k // BYTES for k in range(1, BYTES + 1)]
BLOCK = 256


def fingerprint(text: str, width: int = 3) -> int:
    """SimHash of the lowered words' shingles as a signed 64-bit number; zero without words."""
    words = tokens(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends)), np.uint64, len(ends))
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(batches):
    for batch in slices(batches):
        values = pa.array([fingerprint(t) for t in batch.column(2).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], ["row", "doc_id", "fp"])


def fingerprints(rows: DataFrame) -> DataFrame:
    """(row, doc_id, fp) of numbered rows; ``fp`` is the fingerprint as a signed number."""
    schema = T.StructType([rows.schema["row"], rows.schema["doc_id"], T.StructField("fp", T.LongType())])
    return rows.mapInArrow(_fingerprints, schema)


def _turned(fp: Column | str, start: Column) -> Column:
    """The fingerprint turned so that byte ``start`` comes first (lowest)."""
    fp = F.col(fp) if isinstance(fp, str) else fp
    low = F.call_function("shiftrightunsigned", fp, start * 8)
    return F.when(start == 0, fp).otherwise(low.bitwiseOR(F.call_function("shiftleft", fp, 64 - start * 8)))


def _keys(fps: DataFrame) -> DataFrame:
    """(key, start, fp): sixteen keys for each fingerprint."""
    starts = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BYTES - 1))).alias("start"))
    turned = starts.withColumn("turned", _turned("fp", F.col("start")))
    halves = turned.select("fp", "start", "turned", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    half = F.call_function("shiftrightunsigned", F.col("turned"), 16 + 12 * F.col("half")).bitwiseAND(F.lit(0xFFF))
    key = F.col("start") * 2 + F.col("half")
    key = F.shiftleft(key.cast("long"), 28) + F.shiftleft(F.col("turned").bitwiseAND(F.lit(0xFFFF)), 12) + half
    return halves.select(key.alias("key"), "start", "fp")


def _within_budget(difference: Column) -> Column:
    """Run budgets of a turned difference, shortest run first; the last is the whole distance."""
    ok = F.lit(True)
    for k, most in enumerate(BUDGET, 1):
        run = difference if k == BYTES else difference.bitwiseAND(F.lit((1 << 8 * k) - 1))
        ok = ok & (F.bit_count(run) <= most)
    return ok


def spanning_links(fps: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what is linked among fingerprints sharing a key, at most one per node."""
    root = np.arange(len(fps))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    links = []
    turn, back = np.uint64(8 * int(starts[0])), np.uint64((64 - 8 * int(starts[0])) % 64)
    turned = (fps >> turn) | (fps << back) if turn else fps
    for a in range(len(fps) - 1):
        difference = turned[a + 1 :] ^ turned[a]
        near = np.arange(a + 1, len(fps))
        for k, most in enumerate(BUDGET, 1):
            mask = np.uint64((1 << 8 * k) - 1)
            ok = np.bitwise_count(difference & mask) <= most
            near, difference = near[ok], difference[ok]
        for b in near:
            x, y = find(a), find(int(b))
            if x != y:
                root[max(x, y)] = min(x, y)
                links.append((a, int(b)))
    return links


def _block_links(pdf):
    import pandas as pd

    fps = np.unique(pdf["fp"].to_numpy())
    links = spanning_links(fps.view(np.uint64), pdf["start"].to_numpy())
    return pd.DataFrame({"u": [fps[a] for a, _ in links], "v": [fps[b] for _, b in links]}, dtype="int64")


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints that give the same components as all links."""
    keyed = _keys(fps.select("fp").distinct())
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = pin(keyed.join(shared, "key"), "keyed")
    few, many = keyed.filter(F.col("n") <= BLOCK), keyed.filter(F.col("n") > BLOCK)
    other = few.select("key", F.col("fp").alias("v"))
    mine = few.select("key", "start", F.col("fp").alias("u"))
    pairs = mine.join(other, "key").filter("u < v")
    pairs = pairs.filter(_within_budget(_turned(F.col("u").bitwiseXOR(F.col("v")), F.col("start"))))
    blocks = F.ceil(F.col("n") / (BLOCK // 2)).cast("int")
    block = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    dealt = many.select("key", "start", "fp", block.alias("b"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("c"))
    dealt = dealt.select("key", "start", "fp", F.least("b", "c").alias("b"), F.greatest("b", "c").alias("c"))
    hot = dealt.groupBy("key", "b", "c").applyInPandas(_block_links, "u long, v long")
    return pairs.select("u", "v").union(hot)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, fp, component_id, stays) of every row of ``docs``.

    ``component_id`` is the smallest id among rows reachable over links, itself included; null if
    all those ids are null. ``stays`` marks one row of each component: the smallest id, nulls
    last, and the first such row. Empty and null texts share the fingerprint zero and so one
    group. Rows with equal ids are rows of their own.
    """
    return _near_duplicates(numbered(docs, id_col, text_col))


def _near_duplicates(rows: DataFrame) -> DataFrame:
    prints = pin(fingerprints(rows), "fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    groups = pin(prints.groupBy("fp").agg(best.alias("best")), "groups")
    roots = components(fingerprint_links(groups))
    tied = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "best", F.coalesce("root", "fp").alias("root"))
    heads = tied.groupBy("root").agg(F.min("best").alias("head"))
    named = pin(tied.join(heads, "root").select("fp", "head"), "named")
    return prints.join(named, "fp").select(
        "row", "doc_id", "fp", F.col("head.doc_id").alias("component_id"), (F.col("row") == F.col("head.row")).alias("stays")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with one row of each near-duplicate component; columns stay as they are."""
    table = located(docs)
    stay = _near_duplicates(numbered_in(table, id_col, text_col)).filter("stays").select("row")
    return table.join(stay, "row", "left_semi").select("doc.*")
