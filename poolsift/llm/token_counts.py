"""Token counts of whole texts: encoded in Arrow functions that return lengths only.

A task takes its texts in batches of equal bytes, not of equal rows, and cuts long texts at
boundaries over which no token reaches, so that neither one long text nor many of them in a row
need more memory than a batch. Nothing is shuffled.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsift.llm.encoding import BATCH_BYTES, LONG, byte_slices, counter, text_bytes
from poolsift.llm.texts import numbered

TOKENIZER = "piece_bpe_32k.model"
#: Texts of more tokens are over the limit.
LIMIT = 4096


def count_tokens(
    docs: DataFrame,
    tokenizer: str = TOKENIZER,
    limit: int = LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = BATCH_BYTES,
    long: int = LONG,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    Special strings inside texts are what the library makes of them by default. A null or empty
    text has 0 bytes and 0 tokens. Repeated and null ids give a row each, an empty table none;
    very long texts are counted whole. Other columns are not read.
    """
    rows = numbered(docs, id_col, text_col).select("doc_id", "text")
    fields = [rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]

    def count(batches):
        lengths = counter(public_tokenizers.path(tokenizer))
        for batch in byte_slices(batches, 1, batch_bytes):
            found = pa.array(lengths(batch.column(1).to_pylist(), long), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), text_bytes(batch.column(1)), found], [f.name for f in fields])

    counted = rows.mapInArrow(count, T.StructType(fields))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
