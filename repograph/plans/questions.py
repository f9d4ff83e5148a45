"""Prompt tables for a batch of conversations about repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from repograph.operators import chat
from repograph.operators.embedding import Embedder, embed
from repograph.operators.vectors import retrieval_question, retrieve
from repograph.stage import staged


def asked_requests(messages: DataFrame, about: DataFrame, templates: DataFrame,
                   max_question_tokens: int | None = None) -> DataFrame:
    """Valid requests with their instructions.

    `about(conv_id, repo, repo_url, repo_type, language [, file_path, file_content])` says what
    each conversation is about.
    """
    valid = chat.requests(messages, max_question_tokens).where("valid")
    return chat.system_prompts(valid.join(about, "conv_id"), templates)


def contexts(asked: DataFrame, chunks: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Context of each question that is not too large, from its repository's chunks."""
    path = F.col("file_path") if "file_path" in asked.columns else F.lit(None).cast("string")
    searched = asked.where(~F.col("too_large")).select(
        "repo", F.col("conv_id").alias("question_id"),
        retrieval_question(F.col("query"), path).alias("text"))
    # The search counts the questions first; written out, they are embedded once.
    vectors = staged(embed(searched, embedder).select("repo", "question_id", "vector"))
    hits = retrieve(vectors, chunks)
    return chat.context_by_file(hits).withColumnRenamed("question_id", "conv_id")


def prompts(messages: DataFrame, about: DataFrame, templates: DataFrame, chunks: DataFrame | None,
            embedder: Embedder | None = None,
            max_question_tokens: int | None = None) -> DataFrame:
    """Prompt fragments of all valid conversations; without chunks, the fallback prompts.

    The requests are written out: nearly every kind of fragment reads them.
    """
    asked = staged(asked_requests(messages, about, templates, max_question_tokens))
    found = contexts(asked, chunks, embedder) if chunks is not None else None
    return chat.prompt_fragments(asked, chat.dialog_turns(messages), found)
