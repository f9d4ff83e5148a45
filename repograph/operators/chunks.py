"""Overlapping word chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from repograph.operators.once import compute_once

# Chunk length and overlap in words.
CHUNK_WORDS = 350
OVERLAP_WORDS = 100


def split_documents(docs: DataFrame, text: str = "text", words: int = CHUNK_WORDS,
                    overlap: int = OVERLAP_WORDS) -> DataFrame:
    """One row per chunk with `chunk_no`; all other columns are kept.

    Words are what single spaces separate. A chunk starts every `words - overlap` words until
    one reaches the end of the text.
    """
    step = words - overlap
    count = lambda w: F.greatest(F.ceil((F.size(w) - words) / step), F.lit(0)) + 1
    cut = lambda w: F.transform(
        F.sequence(F.lit(0), (count(w) - 1).cast("int")),
        lambda i: F.array_join(F.slice(w, i * step + 1, words), " "))
    # The outer one-entry transform binds the word array, so the text is split once per row.
    pieces = F.get(F.transform(F.array(F.split(text, " ")), cut), F.lit(0))
    others = [c for c in docs.columns if c != text]
    cut_once = compute_once(docs, text, pieces)
    return cut_once.select(*others, F.posexplode(text).alias("chunk_no", text))
