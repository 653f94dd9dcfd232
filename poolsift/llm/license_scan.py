"""Licence notices found by diagonal voting, with DataFrame functions alone.

All word pairs of a document are hashed and joined with the pairs of the licence templates. A pair
at word i of the text and j of a template votes for the diagonal i - j. A template that stands in
the text whole gets all its votes on one diagonal; a copy with words added or left out spreads them
over neighbouring diagonals, which are merged. A span is verified by the share of the template's
pairs that voted for it, each counted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolsift.llm.texts import WORD, lowered, numbered, once

#: Phrases that count wherever they stand, exactly. Fixed values.
BASE = {
    "cc-by": "cc by",
    "gpl": "general public license",
    "reserved": "all rights reserved",
}
#: Notices by label; matched approximately.
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2.0",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "lgpl": "gnu lesser general public license",
    "agpl": "gnu affero general public license",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2.0",
    "cc-by-notice": "licensed under cc by 4.0",
    "cc-by-nc": "licensed under cc by nc 4.0",
    "cc-by-sa": "licensed under cc by sa 4.0",
    "cc-attribution": "this work is licensed under a creative commons attribution license",
    "cc0": "to the extent possible under law the author has waived all copyright and related rights",
    "public-domain": "this work is in the public domain",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
}
#: Diagonals so far apart still belong to one copy; share of a notice's pairs that verifies it.
DRIFT, COVER = 3, 0.75


def _words(notice: str) -> list[str]:
    """The notice's words as texts are cut: a version number is several words."""
    return notice.replace(".", " ").split()


def pair_table(base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> list[tuple[str, bool, int, int, str, str]]:
    """(label, exact, pairs, place, word, next word) of all templates."""
    rows = []
    for exact, templates in ((True, base), (False, notices)):
        for label, text in templates.items():
            words = _words(text)
            rows += [(label, exact, len(words) - 1, j, a, b) for j, (a, b) in enumerate(zip(words, words[1:]))]
    return rows


def scan(
    docs: DataFrame,
    base: dict[str, str] = BASE,
    notices: dict[str, str] = NOTICES,
    cover: float = COVER,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(row, doc_id, n_words, spans) of every row; a span is (label, exact, first, last, cover).

    ``first`` and ``last`` are word places of the template's first and last matching pair,
    ``cover`` the share of the template's pairs found. A span of a base phrase is one exact place;
    of a notice, one copy. A null text has no words; rows with equal ids are scanned one by one.
    Templates need two words at least.
    """
    table = docs.sparkSession.createDataFrame(
        pair_table(base, notices), "label string, exact boolean, pairs int, place int, word string, next string"
    )
    table = table.select("label", "exact", "pairs", "place", F.xxhash64("word", "next").alias("pair"))
    # a mark for every document, so that it stays in whether or not a pair of it is found
    mark = docs.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("label"), F.lit(True).alias("exact"), F.lit(0).alias("pairs"), F.lit(-1).alias("place"), F.lit(0).cast("long").alias("pair")
    )
    rows = numbered(docs, id_col, text_col)
    words = rows.select("row", "doc_id", F.regexp_extract_all(lowered("text"), F.lit(WORD), F.lit(0)).alias("words"))

    def pairs(ws):
        hashes = F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1)))
        return F.concat(F.array(F.lit(0).cast("long")), hashes)

    hashed = words.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), once(F.col("words"), pairs).alias("pairs_of"))
    at = hashed.select("row", "doc_id", "n_words", F.posexplode("pairs_of").alias("at", "pair")).withColumn("at", F.col("at") - 1)
    met = at.join(F.broadcast(table.union(mark)), "pair")  # as large as the templates, whatever the corpus
    votes = met.select("row", "doc_id", "n_words", "label", "exact", "pairs", "place", "at", (F.col("at") - F.col("place")).alias("diagonal"))
    votes = votes.repartition("row")
    keys = ["row", "doc_id", "n_words", "label", "exact", "pairs"]
    order = Window.partitionBy(*keys).orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order)
    fresh = F.when(apart.isNull() | (apart > F.when(F.col("exact"), 0).otherwise(DRIFT)), 1).otherwise(0)
    merged = votes.withColumn("fresh", fresh).withColumn("copy", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    copies = merged.groupBy(*keys, "copy").agg(F.min("at").alias("first"), (F.max("at") + 1).alias("last"), F.count_distinct("place").alias("found"))
    share = F.col("found") / F.greatest(F.col("pairs"), F.lit(1))
    real = F.col("label").isNotNull() & (share >= F.when(F.col("exact"), 1.0).otherwise(cover))
    span = F.when(real, F.struct("label", "exact", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), share.alias("cover")))
    return copies.groupBy("row", "doc_id", "n_words").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def labels_of(spans):
    """Distinct labels of spans, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
