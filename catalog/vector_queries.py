"""Queries over chunks, embeddings and retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import views
from catalog.registry import ORACLES, query, spread, table
from catalog.views import FILES
from repograph.operators import embedding, vectors
from repograph.operators.chunks import split_documents
from repograph.sources.chunk_store import load_chunks, save_chunks
from repograph.stage import stage_folder, staged

c = F.col

CHUNKS = """split AS (SELECT doc_id, source AS repo, string_split(text, ' ') AS words FROM documents),
starts AS (SELECT doc_id, repo, words, unnest(generate_series(0,
  greatest(ceil((len(words) - 350) / 250.0), 0)::BIGINT)) AS chunk_no FROM split),
chunks AS (SELECT doc_id, repo, chunk_no::INT AS chunk_no,
  array_to_string(words[chunk_no * 250 + 1 : chunk_no * 250 + 350], ' ') AS text FROM starts)"""
# Sparse vectors of the hashing embedder: one row per filled position.
def sparse(source, keys, name):
    return f"""{name}_words AS (SELECT {keys}, unnest([x for x in regexp_split_to_array(text, '\\s+')
    if x <> '']) AS word FROM {source}),
{name}_counts AS (SELECT {keys}, ('0x' || left(md5(word), 8))::UBIGINT % 256 AS bucket,
    count(*) AS n FROM {name}_words GROUP BY ALL),
{name} AS (SELECT *, (n / sqrt(sum(n * n) OVER (PARTITION BY {keys})))::FLOAT::DOUBLE AS value
    FROM {name}_counts)"""


def document_chunks(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    return split_documents(docs.select("doc_id", c("source").alias("repo"), "text"))


@query("document_chunks", f"""WITH {CHUNKS}
SELECT doc_id, repo, chunk_no, md5(text) AS digest, len(string_split(text, ' '))::INT AS words
FROM chunks""")
def document_chunks_query(spark, sf):
    return document_chunks(spark, sf).select(
        "doc_id", "repo", "chunk_no", F.md5(c("text").cast("binary")).alias("digest"),
        F.size(F.split("text", " ")).alias("words"))


@query("embedded_chunks", f"""WITH {CHUNKS}, {sparse('chunks', 'doc_id, chunk_no', 'vec')}
SELECT doc_id, chunk_no, bucket::INT AS bucket, value FROM vec""")
def embedded_chunks(spark, sf):
    out = embedding.embed(document_chunks(spark, sf).select("doc_id", "chunk_no", "text"))
    return out.select("doc_id", "chunk_no", F.posexplode("vector").alias("bucket", "value")).where(
        c("value") > 0).withColumn("value", c("value").cast("double"))


class Refusing:
    """Embedder that refuses some texts."""

    def __call__(self, texts):
        if any(t.startswith(("E", "T")) for t in texts):
            raise RuntimeError("refused")
        return [[1.0, 2.0] for _ in texts]


@query("embedding_statistics", f"""WITH {CHUNKS}
SELECT repo, count(*) FILTER (left(text, 1) NOT IN ('E', 'T')) AS valid,
  count(*) FILTER (left(text, 1) IN ('E', 'T')) AS empty,
  count(*) FILTER (left(text, 1) IN ('E', 'T')) AS error_batches FROM chunks GROUP BY repo""")
def embedding_statistics(spark, sf):
    # Batches of one text make the number of failed batches independent of partitioning.
    out = embedding.embed(document_chunks(spark, sf), Refusing(), batch_texts=1)
    return embedding.embedding_statistics(out, ["repo"])


# FIXTURES-style ragged vectors: some missing, some of half the size.
VECTORS = """SELECT vec_id, label, concat('l', cast(label AS string)) AS repo, CASE
  WHEN vec_id % 17 = 0 THEN NULL WHEN vec_id % 13 = 0 OR label = 3 AND vec_id % 3 > 0
  THEN {slice}(embedding, 1, 32) ELSE embedding END AS vector FROM embeddings"""
VECTORS_V = "WITH vectors_v AS (" + VECTORS.format(slice="list_slice") + ")"


def ragged_vectors(spark, sf):
    return views._sql(spark, sf, VECTORS.format(slice="slice"), "embeddings")


@query("vector_statistics", VECTORS_V + """
SELECT repo, count(vector) AS non_empty, count(*) - count(vector) AS empty,
  (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT len(vector) AS s FROM vectors_v w
    WHERE w.repo = v.repo AND vector IS NOT NULL)) AS sizes FROM vectors_v v GROUP BY repo""")
def vector_statistics(spark, sf):
    return vectors.vector_statistics(ragged_vectors(spark, sf), ["repo"]).withColumn(
        "sizes", F.array_join(c("sizes").cast("array<string>"), ","))


MODAL = """,
sizes AS (SELECT repo, len(vector) AS size, count(*) AS n, min(vec_id) AS first FROM vectors_v
  WHERE vector IS NOT NULL GROUP BY ALL),
modal AS (SELECT repo, size FROM sizes QUALIFY row_number() OVER (PARTITION BY repo
  ORDER BY n DESC, first) = 1)"""


@query("modal_vector_size", VECTORS_V + MODAL + """
SELECT repo, size::INT AS target FROM modal""")
def modal_vector_size(spark, sf):
    return vectors.modal_size(ragged_vectors(spark, sf), ["repo"], "vec_id")


@query("valid_vectors", VECTORS_V + MODAL + """
SELECT vec_id, v.repo FROM vectors_v v JOIN modal m ON m.repo = v.repo AND len(vector) = size""")
def valid_vectors(spark, sf):
    return vectors.valid_vectors(ragged_vectors(spark, sf), ["repo"], "vec_id").select(
        "vec_id", "repo")


@query("first_size_vectors", VECTORS_V + """,
firsts AS (SELECT repo, arg_min(len(vector), vec_id) AS size FROM vectors_v
  WHERE vector IS NOT NULL GROUP BY repo)
SELECT vec_id, v.repo FROM vectors_v v JOIN firsts f ON f.repo = v.repo AND len(vector) = size""")
def first_size_vectors(spark, sf):
    return vectors.first_size_vectors(ragged_vectors(spark, sf), ["repo"], "vec_id").select(
        "vec_id", "repo")


@query("parsed_responses", """
SELECT vec_id, CASE WHEN vec_id % 5 = 1 THEN i ELSE 0 END::INT AS "index",
  64 AS dims, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last
FROM embeddings, (SELECT unnest([0, 2]) AS i) WHERE vec_id % 5 <> 3 AND (vec_id % 5 = 1 OR i = 0)""")
def parsed_responses(spark, sf):
    v = F.to_json("embedding")
    held = lambda key, body: F.concat(F.lit(f'{{"{key}":'), body, F.lit("}"))
    kind = c("vec_id") % 5
    response = (F.when(kind == 0, held("embedding", v))
                .when(kind == 1, held("embeddings", F.concat(
                    F.lit("["), v, F.lit(",[],"), v, F.lit("]"))))
                .when(kind == 2, held("embeddings", F.concat(
                    F.lit('[{"embedding":[]},'), held("embedding", v), F.lit("]"))))
                .when(kind == 3, F.lit('{"data":[1]}'))
                .otherwise(held("embedding", v)))
    raw = table(spark, sf, "embeddings").select("vec_id", response.alias("response"))
    return embedding.parse_responses(raw).select(
        "vec_id", "index", F.size("vector").alias("dims"),
        F.get("vector", F.lit(0)).cast("double").alias("first"),
        F.get("vector", F.lit(63)).cast("double").alias("last"))


@query("nearest_vectors", VECTORS_V + """,
asked AS (SELECT label, arg_min(vector, vec_id) AS q FROM vectors_v WHERE len(vector) = 64
  GROUP BY label),
scored AS (SELECT asked.label AS question_id, v.vec_id AS chunk_id, round(list_sum(
    [z[1]::DOUBLE * z[2]::DOUBLE for z in list_zip(q, vector)]), 6) AS score
  FROM asked, vectors_v v WHERE len(vector) = 64)
SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id
  ORDER BY score DESC, chunk_id)::INT AS rank FROM scored
QUALIFY rank <= 20""")
def nearest_vectors(spark, sf):
    ragged = ragged_vectors(spark, sf).withColumn("repo", F.lit("all"))
    # One question per label: its first vector of full size.
    asked = ragged.where(F.size("vector") == 64).groupBy("repo", "label").agg(
        F.min_by("vector", "vec_id").alias("vector")).withColumnRenamed("label", "question_id")
    return vectors.nearest_chunks(asked, ragged.withColumnRenamed("vec_id", "chunk_id")).drop("repo")


def _benchmark_questions(spark, sf):
    # Every question goes to one repository, the questions together to all of them.
    asked = spark.sql(
        "SELECT item_id AS question_id, text, concat('src', item_id % (SELECT count(DISTINCT source) "
        "FROM {documents})) AS repo FROM {items}",
        documents=table(spark, sf, "documents"), items=table(spark, sf, "benchmark"))
    return embedding.embed(asked).drop("embed_error", "batch", "text")


RETRIEVED = f"""WITH {CHUNKS}, {sparse('chunks', 'doc_id, chunk_no', 'vec')},
items AS (SELECT item_id, text FROM benchmark), {sparse('items', 'item_id', 'q')},
dots AS (SELECT item_id, doc_id, chunk_no, sum(q.value * vec.value) AS dot FROM q JOIN vec
  USING (bucket) GROUP BY ALL),
scored AS (SELECT i.item_id AS question_id, c.repo, c.doc_id, c.chunk_no, c.text,
  doc_id * 1000 + chunk_no AS chunk_id, coalesce((SELECT round(dot, 6) FROM dots d
    WHERE d.item_id = i.item_id AND d.doc_id = c.doc_id AND d.chunk_no = c.chunk_no), 0) AS score
  FROM items i JOIN chunks c ON c.repo = 'src' || (i.item_id % (SELECT count(DISTINCT source) FROM documents))),
hits AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id)::INT
  AS rank FROM scored QUALIFY rank <= 20)"""


# Unique for documents of more than 1,000 chunks too; in the order of the SQL's number below that.
def chunk_id():
    return F.shiftleft(c("doc_id").cast("bigint"), 24) + c("chunk_no")


def retrieved(spark, sf):
    stored = staged(embedding.embed(document_chunks(spark, sf).withColumn("chunk_id", chunk_id()))
                    .drop("embed_error", "batch"))
    hits = vectors.retrieve(staged(_benchmark_questions(spark, sf)), stored)
    return hits.withColumn("chunk_id", c("doc_id") * 1000 + c("chunk_no"))


@query("retrieved_chunks", RETRIEVED + """
SELECT question_id, repo, chunk_id, score, rank, md5(text) AS digest FROM hits""")
def retrieved_chunks(spark, sf):
    return retrieved(spark, sf).select("question_id", "repo", "chunk_id", "score", "rank",
                                       F.md5(c("text").cast("binary")).alias("digest"))


# The same query under the name it had beside one over five sources.
retrieved_chunks_all = query("retrieved_chunks_all", ORACLES["retrieved_chunks"])(retrieved_chunks)


@query("refreshed_chunks", f"""WITH {CHUNKS}
SELECT repo, doc_id, chunk_no, CASE WHEN repo IN ('src1', 'src2', 'src3') THEN 'stored' ELSE 'fresh'
  END AS origin FROM chunks""")
def refreshed_chunks(spark, sf):
    from repograph.sources.chunk_store import refreshed_chunks as refresh
    # Repositories 1 to 3 are stored with vectors, number 4 with empty ones only.
    one = F.when(c("repo") != "src4", F.array(F.lit(9.0))).otherwise(F.array()).cast("array<float>")
    stored = document_chunks(spark, sf).where(c("repo").isin("src1", "src2", "src3", "src4")).select(
        "repo", "doc_id", "chunk_no", "text", one.alias("vector"))
    docs = spread(table(spark, sf, "documents")).select("doc_id", c("source").alias("repo"), "text")
    return refresh(stored, docs).select("repo", "doc_id", "chunk_no", F.when(
        F.size("vector") == 1, "stored").otherwise("fresh").alias("origin"))


@query("stored_chunks", f"""WITH {CHUNKS}
SELECT repo, doc_id, chunk_no, md5(text) AS digest, CASE WHEN repo IN ('src1', 'src2') THEN 9 ELSE 1
  END::DOUBLE AS value FROM chunks WHERE repo <> 'src3'""")
def stored_chunks(spark, sf):
    """Chunks saved, those of two repositories replaced, and read back but for one repository."""
    path = f"{stage_folder(spark)}/chunks-{uuid.uuid4().hex}"
    chunks = document_chunks(spark, sf)
    valued = lambda df, x: df.withColumn("vector", F.array(F.lit(x)).cast("array<float>"))
    save_chunks(valued(chunks, 1.0), path)
    save_chunks(valued(chunks.where(c("repo").isin("src1", "src2")), 9.0), path)
    repos = [r["repo"] for r in load_chunks(spark, path).select("repo").distinct().collect()]
    return load_chunks(spark, path, [r for r in repos if r != "src3"]).select(
        "repo", "doc_id", "chunk_no", F.md5(c("text").cast("binary")).alias("digest"),
        F.get("vector", F.lit(0)).cast("double").alias("value"))


@query("cached_embeddings", f"""WITH {CHUNKS}, known AS (SELECT DISTINCT text FROM chunks
  WHERE repo IN ('src1', 'src2'))
SELECT repo, count(*) FILTER (text IN (SELECT text FROM known)) AS hits,
  count(*) FILTER (text NOT IN (SELECT text FROM known) AND trim(text, ' ' || chr(10)) <> '') AS embedded
FROM chunks GROUP BY repo""")
def cached_embeddings(spark, sf):
    chunks = document_chunks(spark, sf)
    cache = chunks.where(c("repo").isin("src1", "src2")).select(
        F.sha2("text", 256).alias("text_hash"),
        F.array(F.lit(9.0)).cast("array<float>").alias("vector")).distinct()
    out, _ = embedding.embed_with_cache(chunks, cache)
    return out.groupBy("repo").agg(F.count_if(F.size("vector") == 1).alias("hits"),
                                   F.count_if(F.size("vector") == 256).alias("embedded"))


@query("corpus_index", f"""WITH files_v AS ({FILES}),
kept AS (SELECT *, regexp_extract(path, '\\.([a-z]+)$', 1) AS type FROM files_v
  WHERE NOT regexp_matches(path, '\\.(sh|png)$') AND lang <> 'fr' AND length(content) // 4 <=
    CASE WHEN regexp_matches(path, '\\.(py|ts|rs)$') THEN 81920 ELSE 8192 END),
split AS (SELECT *, string_split(content, ' ') AS words FROM kept)
SELECT source AS repo, path, type, unnest(generate_series(0,
  greatest(ceil((len(words) - 350) / 250.0), 0)::BIGINT))::INT AS chunk_no, 256 AS size FROM split""")
def corpus_index(spark, sf):
    from repograph.plans.corpus_index import corpus_index as index
    files = spread(views.files(spark, sf)).withColumnRenamed("source", "repo")
    limits = {"max_code_tokens": 81_920, "max_text_tokens": 8_192}
    return index(files, limits=limits, excluded_dirs=["fr"]).select(
        "repo", "path", "type", "chunk_no", F.size("vector").alias("size"))
