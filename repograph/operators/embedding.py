"""Attach vectors to texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from repograph.functions.text import nonempty
from repograph.operators.once import compute_once
from repograph.operators.skew import split_join
from repograph.stage import staged

Embedder = Callable[[list[str]], list[list[float]]]

# Texts per call and vector size of the default embedder.
BATCH_TEXTS = 500
VECTOR_SIZE = 256
# Words whose position a worker keeps, about 30 MB.
KEPT_WORDS = 200_000

_EMBEDDED = (T.StructType().add("vector", T.ArrayType(T.FloatType()))
             .add("error", T.StringType()).add("batch", T.StringType()))


class HashingEmbedder:
    """Deterministic offline embedder: hashed word counts, scaled to length one."""

    def __init__(self, size: int = VECTOR_SIZE):
        self.size = size
        self._buckets: dict[str, int] = {}

    def _bucket(self, word: str) -> int:
        found = self._buckets.get(word)
        if found is None:
            if len(self._buckets) >= KEPT_WORDS:  # bounds the memory of a long-lived worker
                self._buckets.clear()
            digest = hashlib.md5(word.encode()).digest()
            found = self._buckets[word] = int.from_bytes(digest[:4], "big") % self.size
        return found

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            counts = np.bincount([self._bucket(w) for w in t.split()], minlength=self.size)
            length = np.sqrt(float((counts * counts).sum()))
            out.append((counts / length if length else counts).astype(np.float32).tolist())
        return out


# Embedders by type; a provider's client plugs in as another callable.
EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hashing": HashingEmbedder}


def get_embedder(kind: str = "hashing") -> Embedder:
    if kind not in EMBEDDERS:
        raise ValueError(f"unknown embedder {kind!r}; known: {sorted(EMBEDDERS)}")
    return EMBEDDERS[kind]()


def embed(chunks: DataFrame, embedder: Embedder | None = None, text: str = "text",
          batch_texts: int = BATCH_TEXTS) -> DataFrame:
    """Add `vector`, `embed_error` and `batch`.

    Only the text column travels to Python. A batch whose call fails gets empty vectors and the
    error, and the job goes on. A worker holds the vectors of one batch at a time.
    """
    call = embedder or get_embedder()

    @F.pandas_udf(_EMBEDDED)
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        context, number = TaskContext.get(), 0
        for part in parts:
            for start in range(0, len(part), batch_texts):
                texts = part.iloc[start:start + batch_texts].tolist()
                name = f"{context.partitionId() if context else 0}-{number}"
                number += 1
                try:
                    got, error = [list(v) for v in call([t or "" for t in texts])], None
                except Exception as e:  # a provider may fail in any way
                    got, error = [], str(e) or type(e).__name__
                got = got[:len(texts)] + [[] for _ in range(len(texts) - len(got))]
                yield pd.DataFrame([(v, error, name) for v in got],
                                   columns=["vector", "error", "batch"])

    # Marked as not deterministic, so that a filter on the vector does not call it again.
    call_once = vectors.asNondeterministic()
    return chunks.withColumn("_e", call_once(F.col(text))).select(
        *chunks.columns, F.col("_e.vector").alias("vector"),
        F.col("_e.error").alias("embed_error"), F.col("_e.batch").alias("batch"))


def embedding_statistics(embedded: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Valid and empty vectors and the number of failed batches."""
    filled = F.coalesce(F.size("vector"), F.lit(0)) > 0
    return embedded.groupBy(*(keys or [])).agg(
        F.count_if(filled).alias("valid"), F.count_if(~filled).alias("empty"),
        F.count_distinct(F.when(F.col("embed_error").isNotNull(), F.col("batch")))
        .alias("error_batches"))


def embed_with_cache(chunks: DataFrame, cache: DataFrame, embedder: Embedder | None = None,
                     force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Chunks with vectors, and the cache rows `(text_hash, vector)` this added.

    Each distinct text that the cache lacks is embedded once. Failed texts are not cached.
    The new rows are written out before use: the embedder runs once for them. Texts are made
    distinct before they meet the cache, so a text of very many chunks is one row there.
    """
    keyed = chunks.withColumn("text_hash", F.sha2("text", 256))
    known = cache.limit(0) if force else cache
    missing = keyed.groupBy("text_hash").agg(F.first("text").alias("text")).join(
        known.select("text_hash"), "text_hash", "left_anti")
    added = staged(embed(missing, embedder).where(F.size("vector") > 0).select(
        "text_hash", "vector"))
    return with_cached_vectors(keyed, known.unionByName(added)).drop("text_hash"), added


def with_cached_vectors(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """Vectors by text hash; an empty vector where the text has none. One text may have most chunks."""
    none = F.array().cast("array<float>")
    return split_join(keyed, cache.select("text_hash", "vector"), ["text_hash"], "left").withColumn(
        "vector", F.coalesce("vector", none))


def parse_responses(responses: DataFrame, column: str = "response") -> DataFrame:
    """Vectors `(index, vector)` in provider responses held as JSON text.

    The value under `embedding`, else `embeddings`, is one vector, a list of vectors or a list
    of objects that hold vectors. Empty vectors are dropped.
    """
    held = lambda c: F.coalesce(F.get_json_object(c, "$.embedding"),
                                F.get_json_object(c, "$.embeddings"))
    floats = lambda c: F.from_json(c, "array<float>")
    parsed = compute_once(responses, "_value", held(F.col(column)))
    parsed = compute_once(parsed, "_items", F.from_json("_value", "array<string>"))
    first = F.get("_items", F.lit(0))
    numbered = F.transform("_items", lambda x, i: F.struct(i.alias("index"), F.when(
        x.startswith("["), floats(x)).alias("vector")))
    objects = F.filter(F.transform("_items", lambda x: F.when(
        x.startswith("{"), floats(held(x)))), lambda v: F.size(v) > 0)
    one = F.array(F.struct(F.lit(0).alias("index"), floats(F.col("_value")).alias("vector")))
    found = (F.when(first.startswith("["), F.filter(numbered, lambda s: F.size(s["vector"]) > 0))
             .when(first.startswith("{"), F.transform(objects, lambda v, i: F.struct(
                 i.alias("index"), v.alias("vector"))))
             .when(nonempty(first).isNotNull(), one))
    return compute_once(parsed, "_found", found).select(
        *responses.columns, F.explode("_found").alias("_v")).select(
        *responses.columns, F.col("_v.index").alias("index"), F.col("_v.vector").alias("vector"))
