"""Exact search against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from repograph.operators import embedding, vectors
from repograph.operators.chunks import split_documents


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    chunks = [(f"r{i % 3 if i % 2 else 0}", i, rng.normal(size=8).round(2).tolist())
              for i in range(400)]
    chunks += [("r0", 400 + i, chunks[0][2]) for i in range(40)]  # copies tie
    chunks += [("r0", 900, [1.0, 2.0]), ("r1", 901, [])]
    questions = [(f"r{i % 3}", i, rng.normal(size=8).round(2).tolist()) for i in range(7)]
    return questions, chunks


def brute(questions, chunks, k):
    out = set()
    for repo, q, v in questions:
        scored = [(-round(float(np.dot(np.float32(v).astype(float), np.float32(c).astype(float))), 6),
                   cid) for r, cid, c in chunks if r == repo and len(c) == len(v)]
        out |= {(q, cid, rank + 1) for rank, (_, cid) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("bounds", [
    {}, {"shard_rows": 50, "part_rows": 2}, {"shard_rows": 1, "part_rows": 1},
    {"question_block": 2, "chunk_block": 7}])
@pytest.mark.parametrize("k", [1, 20])
def test_nearest_matches_brute_force(spark, data, bounds, k):
    questions, chunks = data
    q = spark.createDataFrame(questions, "repo string, question_id bigint, vector array<float>")
    c = spark.createDataFrame(chunks, "repo string, chunk_id bigint, vector array<float>")
    got = vectors.nearest_chunks(q, c.repartition(3), k=k, **bounds).collect()
    assert {(r.question_id, r.chunk_id, r["rank"]) for r in got} == brute(questions, chunks, k)


def test_nearest_of_many_repositories(spark):
    rng = np.random.default_rng(5)
    chunks = [(f"r{i % 5000}", i, rng.normal(size=4).round(2).tolist()) for i in range(15_000)]
    chunks += [("r7", 20_000 + i, rng.normal(size=4).round(2).tolist()) for i in range(15_000)]
    questions = [(f"r{i}", f"q{i}", rng.normal(size=4).round(2).tolist()) for i in range(0, 5000, 7)]
    questions += [("r7", f"hot{i}", rng.normal(size=4).round(2).tolist()) for i in range(40)]
    questions += [("absent", "none", [1.0] * 4)]
    q = spark.createDataFrame(questions, "repo string, question_id string, vector array<float>")
    c = spark.createDataFrame(chunks, "repo string, chunk_id bigint, vector array<float>")
    out = vectors.nearest_chunks(q, c, k=3, shard_rows=2000, part_rows=16)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    got = {(r.question_id, r.chunk_id, r["rank"]) for r in out.collect()}
    own = {}
    for r, *chunk in chunks:
        own.setdefault(r, []).append((r, *chunk))
    want = set()
    for one in questions:
        want |= brute([one], own.get(one[0], []), 3)
    assert got == want


def test_nearest_with_odd_vectors(spark):
    nan = float("nan")
    q = spark.createDataFrame([("r", 1, [1.0, 1.0]), ("r", 2, [nan, 1.0]), ("r", 3, None), ("r", 4, [])],
                              "repo string, question_id int, vector array<float>")
    c = spark.createDataFrame([("r", ("b", 1), [1.0, 0.0]), ("r", ("a", 2), [0.0, 1.0]),
                               ("r", ("c", 0), [nan, 1.0]), ("r", ("d", 0), None)],
                              "repo string, chunk_id struct<d:string,n:int>, vector array<float>")
    got = vectors.nearest_chunks(q, c).collect()
    # Structs order the tie; a product that is not a number is no score.
    assert [(r.question_id, tuple(r.chunk_id), r.score, r["rank"]) for r in got] == [
        (1, ("a", 2), 1.0, 1), (1, ("b", 1), 1.0, 2)]
    assert vectors.nearest_chunks(q.limit(0), c).collect() == []


def test_best_keeps_the_first_of_equal_scores():
    rng = np.random.default_rng(1)
    scores = rng.integers(-3, 4, size=(5, 300)).astype(float)
    best = vectors._Best(pa.array(range(5)), np.eye(5), 7)
    for at in range(0, 300, 11):
        best.add(pa.array(range(at, min(at + 11, 300))), scores[:, at:at + 11].T, 2)
    for row, line in enumerate(scores):
        assert best.ids[row].tolist() == np.lexsort((np.arange(300), -line))[:7].tolist()


@pytest.mark.parametrize("words,chunks", [(0, 1), (1, 1), (350, 1), (351, 2), (600, 2), (601, 3)])
def test_chunk_count(spark, words, chunks):
    text = " ".join(str(i) for i in range(words))
    out = split_documents(spark.createDataFrame([("d", text)], "id string, text string"))
    rows = out.orderBy("chunk_no").collect()
    assert len(rows) == chunks
    assert rows[-1].text.split(" ")[-1] == (str(words - 1) if words else "")
    if chunks > 1:
        assert rows[1].text.split(" ")[0] == "250"


def test_failed_batches_and_short_answers(spark):
    def fussy(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[1.0]] * (len(texts) - 1)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", "c", "d"])],
                               "id int, text string").coalesce(1)
    rows = embedding.embed(df, fussy, batch_texts=2).orderBy("id").collect()
    assert [list(r.vector) for r in rows] == [[], [], [1.0], []]
    assert [r.embed_error for r in rows] == ["no", "no", None, None]


def test_cache_embeds_only_new_texts(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, text string")
    cache = chunks.where("id = 1").selectExpr("sha2(text, 256) text_hash",
                                              "array(7f) vector")
    out, added = embedding.embed_with_cache(chunks, cache, lambda ts: [[1.0] for _ in ts])
    assert {r.id: list(r.vector) for r in out.collect()} == {1: [7.0], 2: [1.0], 3: [1.0]}
    assert added.count() == 1
    forced, added = embedding.embed_with_cache(chunks, cache, lambda ts: [[1.0] for _ in ts], True)
    assert {r.id: list(r.vector) for r in forced.collect()}[1] == [1.0] and added.count() == 2


def test_unknown_embedder():
    with pytest.raises(ValueError):
        embedding.get_embedder("nope")


def test_chunks_of_a_long_document_are_not_mistaken_for_the_next_ones(spark, tmp_path):
    from catalog.vector_queries import retrieved
    long, asked = " ".join(["w"] * (250 * 1003)), "what is this about"
    spark.createDataFrame([(0, "src0", long), (1, "src0", asked)], "doc_id bigint, source string, text string"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, asked)], "item_id bigint, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    rows = retrieved(spark, str(tmp_path)).collect()
    assert len(rows) == 20 and [(r.doc_id, r.chunk_no) for r in rows if r["rank"] == 1] == [(1, 0)]


def test_questions_reach_every_source(spark, tmp_path):
    from catalog.vector_queries import retrieved_chunks_all
    spark.createDataFrame([(i, f"src{i}", "a b") for i in range(8)], "doc_id bigint, source string, text string"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, "a") for i in range(8)], "item_id bigint, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    assert len({r.repo for r in retrieved_chunks_all(spark, str(tmp_path)).collect()}) == 8


def test_a_worker_holds_the_vectors_of_one_batch(spark):
    class Watching:
        def __call__(self, texts):
            import tracemalloc
            if not tracemalloc.is_tracing():
                tracemalloc.start()
            if tracemalloc.get_traced_memory()[0] > 30 << 20:
                raise MemoryError("vectors of earlier batches are still held")
            return [[len(t) + k / 7 for k in range(1000)] for t in texts]

    texts = spark.range(0, 3000, 1, 1).select(F.concat(F.lit("text "), "id").alias("text"))
    out = embedding.embed(texts, Watching(), batch_texts=100)
    stats = out.select(F.size("vector").alias("n"), "embed_error").groupBy("n", "embed_error").count().collect()
    assert [tuple(r) for r in stats] == [(1000, None, 3000)]


def test_words_kept_by_the_embedder_are_bounded(monkeypatch):
    monkeypatch.setattr(embedding, "KEPT_WORDS", 50)
    own = embedding.HashingEmbedder()
    plain = [embedding.HashingEmbedder()([f"w{k} w{k + 1}"])[0] for k in range(200)]
    assert own([f"w{k} w{k + 1}" for k in range(200)]) == plain
    assert len(own._buckets) <= 50
