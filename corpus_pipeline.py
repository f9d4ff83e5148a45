"""A training corpus from `documents`: filters, deduplication and packing, stage by stage.

Each stage takes (spark, docs, sf_dir); `run` writes what a stage returns and reads it back as the
next one's documents. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from repograph.llm.language_id import identify
from repograph.llm.ngram_join import ngram_join
from repograph.llm.packing import pack
from repograph.llm.substrings import remove_repeats
from repograph.llm.toxicity import score_toxicity
from repograph.ship import ship_packages
from repograph.stage import staged

_PACKAGE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "repograph")
TOXIC_AT = 0.3
#: Rows that one Arrow batch takes to a Python worker. Here a row carries its text twice, so
#: Spark's default of 10,000 rows is tens of megabytes a batch, in the executor and in the worker.
BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _rows(docs: DataFrame) -> DataFrame:
    """The row as one column, so that no operator's column can clash with one of its own."""
    return docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", "lang")


def _prepare(spark: SparkSession) -> None:
    """The package on the workers, and small batches to them."""
    ship_packages(spark, _PACKAGE)
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity, learned from all labels, is below the threshold."""
    _prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(_rows(docs), labels, ["_row"], F.lit(True))
    return scored.filter(F.col("score") < TOXIC_AT).select("_row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters go."""
    _prepare(spark)
    found = identify(_rows(docs), ["_row"], F.lit(True))
    return found.filter(F.col("lang_pred") != "und").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by n-gram similarity the one with the least doc_id.

    Documents without a doc_id stay; of rows with one doc_id and one text one stays.
    """
    _prepare(spark)
    first = (ngram_join(docs).filter(F.col("doc_id") == F.col("class_id"))
             .select("doc_id").distinct())
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id",
                       F.xxhash64("text").alias("_same"))
    kept = (rows.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "_same"])
            .select("_row.*"))
    return kept.unionByName(docs.filter("doc_id IS NULL"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier documents hold.

    A document that loses words gets the others joined by one space; n_chars follows.
    """
    _prepare(spark)
    changed = (remove_repeats(docs).filter("n_removed > 0")
               .select("doc_id", F.col("text_hash").alias("_hash"), F.col("kept_text").alias("_kept"))
               .dropDuplicates(["doc_id", "_hash"]))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id",
                       F.xxhash64("text").alias("_hash"))
    joined = rows.join(changed, ["doc_id", "_hash"], "left")
    changes = {"text": F.coalesce("_kept", "_row.text")}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(F.col("_kept").isNull(), F.col("_row.n_chars")).otherwise(
            F.length("_kept")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[changes.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and place."""
    _prepare(spark)
    # The same workers serve the other stages, which need the memory.
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_words=False)


STAGES = [("toxicity", toxicity), ("language ID", language), ("n-gram Jaccard join", near_duplicates),
          ("substring dedup", substrings), ("best-fit packing", packing)]

#: Trained models, Unicode letters and a tokenizer take part: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
