"""Vector validation and exact nearest-neighbour search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from repograph.operators.ordering import first_n
from repograph.operators.skew import salted_join
from repograph.stage import staged

# Fixed value: chunks retrieved per question.
TOP_K = 20
# Scores are rounded so that copies of a text tie whatever block they are scored in.
SCORE_DIGITS = 6


def vector_size() -> Column:
    return F.greatest(F.coalesce(F.size("vector"), F.lit(0)), F.lit(0))


def size_counts(chunks: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """How often each vector size occurs, and where first. Empty vectors do not count."""
    sized = chunks.select(*keys, F.col(ordinal).alias("ordinal"), vector_size().alias("size"))
    return sized.where(F.col("size") > 0).groupBy(*keys, "size").agg(
        F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"))


def modal_size(chunks: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Most frequent vector size per group; the first seen wins a tie."""
    return size_counts(chunks, keys, ordinal).groupBy(*keys).agg(
        F.min_by("size", F.struct(-F.col("n"), F.col("first"))).alias("target"))


def first_size(chunks: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Size of the first vector of each group that is not empty."""
    return size_counts(chunks, keys, ordinal).groupBy(*keys).agg(
        F.min_by("size", "first").alias("target"))


def keep_size(chunks: DataFrame, targets: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Chunks whose vector has the target size of their group. Targets are one row per group."""
    sized = chunks.withColumn("_size", vector_size())
    wanted = targets.withColumnRenamed("target", "_size")
    return salted_join(sized, wanted, [*keys, "_size"], [ordinal], "left_semi").drop("_size")


def valid_vectors(chunks: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Drop chunks without vector or with an unusual vector size."""
    return keep_size(chunks, modal_size(chunks, keys, ordinal), keys, ordinal)


def first_size_vectors(chunks: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Alternative gate: keep the size of the first vector."""
    return keep_size(chunks, first_size(chunks, keys, ordinal), keys, ordinal)


def vector_statistics(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Non-empty and empty vectors and the three smallest sizes per group.

    Sizes are counted first, so the set of sizes is small.
    """
    counts = chunks.select(*keys, vector_size().alias("size")).groupBy(*keys, "size").agg(
        F.count(F.lit(1)).alias("n"))
    some = F.col("size") > 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    stats = counts.groupBy(*keys).agg(total(some).alias("non_empty"), total(~some).alias("empty"))
    samples = first_n(counts.where(some), keys, ["size"], 3).groupBy(*keys).agg(
        F.array_sort(F.collect_list("size")).alias("sizes"))
    return stats.join(samples, keys, "left").withColumn(
        "sizes", F.coalesce("sizes", F.array().cast("array<int>")))


class _Best:
    """The k best chunks of some questions, kept while chunks of their repository stream past.

    Chunks come in the order of their ids, so of equal scores the earlier one stands.
    """

    _NONE = np.iinfo(np.int64).max

    def __init__(self, ids: pa.Array, matrix: np.ndarray, k: int):
        self.questions, self.matrix, self.k = ids, matrix, k
        self.scores = np.full((len(ids), k), -np.inf)
        self.places = np.full((len(ids), k), self._NONE)
        self.ids = np.full((len(ids), k), None, object)
        self.seen = 0

    def add(self, ids: pa.Array, matrix: np.ndarray, rows: int) -> None:
        """Meet a block of chunks; so many questions at a time."""
        names = np.empty(len(ids), object)
        names[:] = ids.to_pylist()
        for at in range(0, len(self.matrix), rows):
            some = slice(at, at + rows)
            scores = np.round(self.matrix[some] @ matrix.T, SCORE_DIGITS) + 0.0
            scores[np.isnan(scores)] = -np.inf
            better = np.flatnonzero(scores.max(1) > self.scores[some, -1])
            if len(better):
                self._merge(better + at, scores[better], names)
        self.seen += len(ids)

    def _merge(self, at: np.ndarray, scores: np.ndarray, names: np.ndarray) -> None:
        k = self.k
        both = np.concatenate([self.scores[at], scores], 1)
        least = -np.partition(-both, k - 1, axis=1)[:, k - 1]
        row, column = np.nonzero(both >= least[:, None])
        value, old = both[row, column], column < k
        kept = np.minimum(column, k - 1)
        place = np.where(old, self.places[at[row], kept], self.seen + column - k)
        name = np.where(old, self.ids[at[row], kept], names[np.maximum(column - k, 0)])
        order = np.lexsort((place, -value, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        first = rank < k
        row, rank, order = row[first], rank[first], order[first]
        for table, new in ((self.scores, value), (self.places, place), (self.ids, name)):
            table[at[row], rank] = new[order]

    def rows(self, repo: str, schema: pa.Schema) -> pa.RecordBatch:
        question, rank = np.nonzero((self.places != self._NONE) & (self.scores > -np.inf))
        return pa.RecordBatch.from_arrays(
            [pa.array([repo] * len(question), pa.string()),
             self.questions.take(pa.array(question)),
             pa.array(self.ids[question, rank].tolist(), schema.field("chunk_id").type),
             pa.array(self.scores[question, rank])], schema=schema)


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, size)


_GROUP = ["repo", "size", "shard", "part"]


def _streamed(k: int, question_block: int, chunk_block: int, schema: pa.Schema):
    """From rows sorted by group, kind and chunk id, questions before chunks, to the best chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, best = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            if best is not None:
                yield best.rows(group[0], schema)

        for batch in batches:
            change = np.zeros(max(batch.num_rows - 1, 0), bool)
            for name in (*_GROUP, "kind"):
                column = batch.column(name)
                change |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                here = tuple(part.column(c)[0].as_py() for c in _GROUP)
                if here != group:
                    yield from done()
                    group, asked, best = here, [], None
                if part.column("kind")[0].as_py() == 0:
                    asked.append((part.column("question_id"), _matrix(part.column("vector"), here[1])))
                    continue
                if best is None:
                    if not asked:
                        continue
                    best = _Best(pa.concat_arrays([i for i, _ in asked]),
                                 np.concatenate([m for _, m in asked]), k)
                for at in range(0, part.num_rows, chunk_block):
                    block = part.slice(at, chunk_block)
                    best.add(block.column("chunk_id"), _matrix(block.column("vector"), here[1]),
                             question_block)
        yield from done()
    return run


def nearest_chunks(questions: DataFrame, chunks: DataFrame, k: int = TOP_K,
                   question_block: int = 512, chunk_block: int = 1024,
                   shard_rows: int = 8192, part_rows: int = 4096) -> DataFrame:
    """The k chunks of the question's repository with the largest inner product.

    Inputs are `questions(repo, question_id, vector)` and `chunks(repo, chunk_id, vector)`; the
    result is `(repo, question_id, chunk_id, score, rank)`, ties by chunk id. Exact, without an
    index.

    Questions and chunks of a repository and vector size meet in one group. There the questions
    are held and the chunks stream past them in blocks, each a matrix product; a question keeps its
    k best, so a group sends k rows per question, once. A repository with more chunks than
    `shard_rows` is dealt over shards, each meeting all its questions; one with more questions than
    `part_rows` over parts, each meeting all its chunks. Both bounds grow with the tables, so that
    at most 100,000 repositories are dealt and broadcasting how is always cheap.

    Both inputs are read twice, first to be counted: pass stored tables, not lazy embeddings.
    """
    spark = questions.sparkSession
    sized = lambda df, name: df.select(
        "repo", vector_size().alias("size"), F.col(name), "vector").where(F.col("size") > 0)
    asked, stored = sized(questions, "question_id"), sized(chunks, "chunk_id")
    both = asked.select("repo", "size", F.lit(1).alias("q"), F.lit(0).alias("c")).unionByName(
        stored.select("repo", "size", F.lit(0).alias("q"), F.lit(1).alias("c")))
    counts = staged(both.groupBy("repo", "size").agg(F.sum("q").alias("q"), F.sum("c").alias("c")))
    total = counts.agg(F.sum("q").alias("q"), F.sum("c").alias("c")).first()
    dealt = lambda n, rows, all_rows: F.ceil(
        F.col(n) / max(rows, -(-(all_rows or 0) // 50_000))).cast("int")
    grid = counts.select("repo", "size", dealt("c", shard_rows, total["c"]).alias("shards"),
                         dealt("q", part_rows, total["q"]).alias("parts")).where(
        "shards > 1 OR parts > 1")

    def placed(df, own, other, name):
        """Each row in one slot of its own dimension and in all of the other one."""
        wide = df.join(F.broadcast(grid), ["repo", "size"], "left")
        count = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
        slot = {"shards": "shard", "parts": "part"}
        return wide.withColumns({
            slot[own]: F.pmod(F.xxhash64(name), count(own)).cast("int"),
            slot[other]: F.explode(F.sequence(F.lit(0), count(other) - 1))}).drop("shards", "parts")

    rows = placed(asked, "parts", "shards", "question_id").withColumn("kind", F.lit(0)).unionByName(
        placed(stored, "shards", "parts", "chunk_id").withColumn("kind", F.lit(1)),
        allowMissingColumns=True)
    schema = T.StructType([T.StructField("repo", T.StringType()), asked.schema["question_id"],
                           stored.schema["chunk_id"], T.StructField("score", T.DoubleType())])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scored = (rows.repartition(tasks, *_GROUP).sortWithinPartitions(*_GROUP, "kind", "chunk_id")
              .mapInArrow(_streamed(k, question_block, chunk_block, to_arrow_schema(schema)), schema))
    return first_n(scored, ["repo", "question_id"], [F.desc("score"), "chunk_id"], k, "rank")


def retrieve(questions: DataFrame, chunks: DataFrame, k: int = TOP_K) -> DataFrame:
    """Nearest chunks with their rows; the large chunk text is joined only for the hits.

    Chunks are read three times: pass a stored table.
    """
    hits = nearest_chunks(questions, chunks.select("repo", "chunk_id", "vector"), k)
    return hits.join(chunks.drop("vector"), ["repo", "chunk_id"])


def retrieval_question(query: Column, file_path: Column) -> Column:
    """Text to search for: the file when one is named, otherwise the query."""
    named = file_path.isNotNull() & (file_path != "")
    return F.when(named, F.concat(F.lit("Contexts related to "), file_path)).otherwise(query)
