"""Rows dealt to shards on a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2^16 cells. Every shard owns the arcs that end at its virtual nodes, and a row belongs
to the arc of the cell that its id and text hash to. No shard takes more than its bound: rows that
find a shard full continue clockwise to the next virtual node whose shard has room. Only the number
of rows in each cell is needed for that walk; it decides which ranks of a cell go where, and the
rows learn their rank by a window over their cell. Nothing but the cell counts meets in one place.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolsift.session import pin

SHARDS = 24
VIRTUAL = 128
CELL_BITS = 16


def ring(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes, clockwise; of nodes in one cell the smaller shard's stays."""
    nodes = {}
    for shard in range(shards):
        for k in range(virtual):
            cell = int(hashlib.md5(f"{shard}:{k}".encode()).hexdigest()[:8], 16) >> (32 - CELL_BITS)
            nodes.setdefault(cell, shard)
    return sorted(nodes.items())


def walk(counts: dict[int, int], shards: int, slack: float, virtual: int = VIRTUAL) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): where each cell's rows go.

    Each shard takes ceil((1 + slack) * rows / shards) rows at most; without slack the loads are
    the two integers next to the mean.
    """
    total = sum(counts.values())
    bound = [total // shards + (s < total % shards) for s in range(shards)] if not slack else [ceil((1 + slack) * total / shards)] * shards
    nodes = ring(shards, virtual)
    cells = [cell for cell, _ in nodes]
    waiting = [(cell, 0, bisect_left(cells, cell) % len(nodes)) for cell in sorted(counts)]  # first rank left, its arc
    taken, pieces, step = [0] * shards, [], 0
    while waiting:
        still = []
        for cell, rank, arc in waiting:
            shard = nodes[(arc + step) % len(nodes)][1]
            n = min(bound[shard] - taken[shard], counts[cell] - rank)
            if n:
                pieces.append((cell, rank, rank + n, shard, taken[shard]))
                taken[shard] += n
            if rank + n < counts[cell]:
                still.append((cell, rank + n, arc))
        waiting, step = still, step + 1
    return pieces


def assign(docs: DataFrame, shards: int = SHARDS, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row.

    ``size`` is the text's UTF-8 bytes plus 8, ``slot`` is gapless from 0 within a shard. A null
    text has no bytes, a null id hashes as none. Rows equal in id and text share a ring position;
    they stay rows of their own, in either order. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    point = F.xxhash64(F.col(id_col).cast("string"), text)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.shiftrightunsigned(point, 64 - CELL_BITS).cast("int").alias("cell"),
        point.alias("point"),
    )
    rows = pin(rows, "points")
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most 2^16
    pieces = docs.sparkSession.createDataFrame(
        walk(counts, shards, slack), "cell int, first_rank long, end_rank long, shard int, first_slot long"
    )
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("point", "doc_id", "text_crc32")) - 1
    ranked = rows.withColumn("rank", rank)
    # at most one piece for each cell, and one more for each time that a shard is full on the way
    placed = ranked.join(F.broadcast(pieces), "cell").filter("rank >= first_rank and rank < end_rank")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("rank") - F.col("first_rank")).alias("slot"))
