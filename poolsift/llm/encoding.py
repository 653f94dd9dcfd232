"""Whole texts handed to tokenizer libraries: batches of equal bytes, long texts cut where it changes nothing."""

from __future__ import annotations

import json
import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes of the texts that are encoded at a time; a longer text is a batch of its own.
BATCH_BYTES = 1 << 18
#: Characters from which on a text is cut, where it has a safe boundary.
LONG = 1 << 15
# A space between two characters that are no white space, nor the sign that pieces have for a space. No
# token of the tokenizers that are cut here reaches from a character into a space behind it, so both
# sides are encoded as in the whole.
_BOUNDARY = re.compile(r"(?<=[^\s▁]) (?=\S)")


def byte_slices(batches, column: int = 2, limit: int = BATCH_BYTES):
    """Arrow batches cut so that the texts of a slice have ``limit`` bytes at most, or are one text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        through = np.cumsum(sizes, dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            before = through[first - 1] if first else 0
            end = max(first + 1, int(np.searchsorted(through, before + limit, "right")))
            yield batch.slice(first, end - first)
            first = end


def safe_pieces(text: str, keep_space: bool, long: int = LONG) -> list[str]:
    """``text`` in pieces of about ``long`` characters that are encoded as in the whole text.

    The space at a cut begins the next piece, or is dropped where the tokenizer puts one before
    every text. Without a boundary the text stays whole from there on.
    """
    pieces, first = [], 0
    while len(text) - first > long:
        cut = _BOUNDARY.search(text, first + long)
        if cut is None:
            break
        pieces.append(text[first : cut.start()])
        first = cut.start() if keep_space else cut.end()
    return [*pieces, text[first:]]


@cache
def counter(path: str):
    """A function from a list of texts to their numbers of tokens, nothing added before or behind.

    ``path`` ends in ``.json`` for ``tokenizers`` and in ``.model`` for ``sentencepiece``. Only byte-level
    patterns, and vocabularies without a space inside a piece, have their long texts cut.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = any(re.search("[^▁]▁", model.id_to_piece(i)) for i in range(model.get_piece_size()))
        safe, keep = not crossing and model.encode("x  y") == model.encode("x") + model.encode(" y"), False

        def encode(texts):
            return map(len, model.encode(texts, num_threads=1))
    else:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        exact = Tokenizer.from_file(path)
        exact.no_truncation()
        exact.no_padding()
        with open(path, encoding="utf-8") as file:
            before = json.load(file).get("pre_tokenizer") or {}
        safe, keep = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space"), True

        def encode(texts):
            return map(len, exact.encode_batch_fast(texts, add_special_tokens=False))

    def lengths(texts: list[str], long: int = LONG) -> np.ndarray:
        pieces, owner = [], []
        for i, text in enumerate(texts):
            own = safe_pieces(text, keep, long) if safe else [text]
            pieces += own
            owner += [i] * len(own)
        found = np.fromiter(encode(pieces), np.int64, len(pieces))
        return np.bincount(np.array(owner, np.int64), found, len(texts)).astype(np.int64) if texts else found

    return lengths


def text_bytes(texts: pa.Array) -> pa.Array:
    """UTF-8 bytes of every text as longs."""
    return pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
