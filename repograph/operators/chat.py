"""Prompts for batches of conversations `(conv_id, pos, role, text)`, positions from zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from repograph.functions.research import FINAL_ITERATION, RESEARCH_TAG, without_tag
from repograph.functions.text import nonempty, strip, token_count
from repograph.functions.urls import short_name
from repograph.operators.ordering import ordered_text
from repograph.operators.skew import salted_join

# Fixed value: questions above this many tokens are answered without retrieval.
MAX_QUESTION_TOKENS = 8000
# Languages answers may be asked in.
LANGUAGES = {
    "en": "English", "ja": "Japanese (日本語)", "zh": "Mandarin Chinese (中文)",
    "zh-tw": "Traditional Chinese (繁體中文)", "es": "Spanish (Español)", "kr": "Korean (한국어)",
    "vi": "Vietnamese (Tiếng Việt)", "pt-br": "Brazilian Portuguese (Português Brasileiro)",
    "fr": "Français (French)", "ru": "Русский (Russian)",
}
DEFAULT_LANGUAGE = "en"
# Instructions by stage. A job may bring its own table with the same placeholders.
TEMPLATES = {
    "chat": "Answer questions about the {repo_type} repository {repo_url} ({repo_name}) directly. "
            "Answer in {language_name}.",
    "first": "Plan research on one topic in the {repo_type} repository {repo_url} ({repo_name}). "
             "Start with \"## Research Plan\". Answer in {language_name}.",
    "middle": "Continue research on one topic in the {repo_type} repository {repo_url} "
              "({repo_name}). Start with \"## Research Update {research_iteration}\". "
              "Answer in {language_name}.",
    "final": "Conclude research on one topic in the {repo_type} repository {repo_url} "
             "({repo_name}) after iteration {research_iteration}. Start with "
             "\"## Final Conclusion\". Answer in {language_name}.",
}


def dialog_turns(messages: DataFrame) -> DataFrame:
    """User/assistant pairs at positions (0,1), (2,3), ...; other pairs are no turns.

    Pairs are groups of two rows, so a long conversation spreads over tasks.
    """
    at = lambda parity, c: F.max(F.when(F.col("pos") % 2 == parity, F.col(c)))
    pairs = messages.groupBy("conv_id", F.floor(F.col("pos") / 2).cast("bigint").alias(
        "turn_no")).agg(at(0, "role").alias("r0"), at(1, "role").alias("r1"),
                        at(0, "text").alias("user_text"), at(1, "text").alias("assistant_text"))
    return pairs.where((F.col("r0") == "user") & (F.col("r1") == "assistant")).drop("r0", "r1")


def requests(messages: DataFrame, max_question_tokens: int | None = None) -> DataFrame:
    """One row per conversation: what is asked, and how.

    `valid` says whether the last message is the user's. A research request that only says to
    continue asks for its topic: the first user message without that word. `too_large` marks last
    messages above `max_question_tokens`, for which nothing is retrieved; without it there are none.
    """
    text, role = F.col("text"), F.col("role")
    fresh_user = (role == "user") & ~F.lower(text).contains("continue")
    facts = messages.groupBy("conv_id").agg(
        F.max_by(F.struct("role", "text"), "pos").alias("last"),
        F.bool_or(text.contains(RESEARCH_TAG)).alias("is_research"),
        (F.count_if(role == "assistant") + 1).alias("assistant_turns"),
        F.min_by(F.when(fresh_user, text), F.when(fresh_user, F.col("pos"))).alias("first_topic"))
    asked = F.when(F.col("last.text").contains(RESEARCH_TAG), without_tag(
        F.col("last.text"))).otherwise(F.col("last.text"))
    goes_on = (F.col("is_research") & F.lower(asked).contains("continue")
               & F.lower(asked).contains("research"))
    topic = nonempty(without_tag(F.col("first_topic")))
    return facts.select(
        "conv_id", (F.col("last.role") == "user").alias("valid"), "is_research",
        F.when(F.col("is_research"), F.col("assistant_turns")).otherwise(1).cast("bigint")
        .alias("iteration"),
        F.when(goes_on, F.coalesce(topic, asked)).otherwise(asked).alias("query"),
        (F.lit(False) if max_question_tokens is None else
         token_count(F.col("last.text")) > max_question_tokens).alias("too_large"))


def prompt_stage() -> Column:
    """Which instructions a request needs."""
    return (F.when(~F.col("is_research"), "chat").when(F.col("iteration") == 1, "first")
            .when(F.col("iteration") >= FINAL_ITERATION, "final").otherwise("middle"))


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(list((templates or TEMPLATES).items()),
                                 "stage string, template string")


def language_name(code: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(
        nonempty(code), F.lit(DEFAULT_LANGUAGE))), F.lit("English"))


def system_prompts(asked: DataFrame, templates: DataFrame) -> DataFrame:
    """Add `system_prompt` to requests that carry repo_url, repo_type and language.

    Doubled braces in a template stand for single ones.
    """
    values = {
        "repo_type": F.col("repo_type"), "repo_url": F.col("repo_url"),
        "repo_name": short_name(F.col("repo_url")),
        "language_name": language_name(F.col("language")),
        "research_iteration": F.col("iteration").cast("string"),
    }
    swap = lambda c, old, new: F.replace(c, F.lit(old), new if isinstance(new, Column) else F.lit(new))
    body = swap(swap(F.col("template"), "{{", "\x01"), "}}", "\x02")
    for name, value in values.items():
        body = swap(body, f"{{{name}}}", F.coalesce(value, F.lit("")))
    body = swap(swap(body, "\x01", "{"), "\x02", "}")
    staged = asked.withColumn("stage", prompt_stage())
    # The table has one template per stage.
    return staged.join(templates, "stage", "left").withColumn("system_prompt", body).drop(
        "template")


def context_by_file(hits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Retrieved chunks `(question_id, rank, path, text)` as one context text per question.

    Files come in order of their best chunk. A question has at most k chunks.
    """
    keys = keys or ["question_id"]
    path = F.coalesce("path", F.lit("unknown"))
    files = hits.groupBy(*keys, path.alias("path")).agg(
        F.min("rank").alias("best"),
        ordered_text(F.collect_list(F.struct("rank", "text")), "\n\n").alias("body"))
    part = F.concat(F.lit("## File Path: "), F.col("path"), F.lit("\n\n"), F.col("body"))
    joined = ordered_text(F.collect_list(F.struct("best", part.alias("text"))), "\n\n")
    # The dashed line stands once, before the first file.
    return files.groupBy(*keys).agg(F.concat(F.lit("\n\n" + "-" * 10), joined).alias("context"))


def history_fragments(turns: DataFrame) -> DataFrame:
    """Each turn as prompt text, in turn order by `seq`."""
    return turns.select("conv_id", F.col("turn_no").alias("seq"), F.concat(
        F.lit("<turn>\n<user>"), "user_text", F.lit("</user>\n<assistant>"), "assistant_text",
        F.lit("</assistant>\n</turn>\n")).alias("text"))


_SYSTEM, _OPEN, _TURNS, _CLOSE, _FILE, _CONTEXT, _QUERY = range(7)
_NOTE = "<note>Answering without retrieval augmentation.</note>\n\n"
_SHORT_NOTE = ("<note>Answering without retrieval augmentation due to input size constraints."
               "</note>\n\n")


def prompt_fragments(asked: DataFrame, turns: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """Prompts as ordered fragments `(conv_id, part, seq, text)`.

    `asked` has system_prompt and query and may have file_path and file_content; `contexts` is
    `(conv_id, context)`. Without contexts this is the fallback prompt for a question that did not
    fit. A long history stays many rows.
    """
    def piece(df, part, text, seq=None):
        return df.select("conv_id", F.lit(part).alias("part"), (F.lit(0) if seq is None else seq)
                         .cast("bigint").alias("seq"), text.alias("text"))

    history = history_fragments(turns)
    talked = history.select("conv_id").distinct()
    with_history = asked.select("conv_id").join(talked, "conv_id", "left_semi")
    out = piece(asked, _SYSTEM, F.concat(F.lit("/no_think "), "system_prompt", F.lit("\n\n")))
    out = out.unionByName(piece(with_history, _OPEN, F.lit("<conversation_history>\n")))
    told = salted_join(history, asked.select("conv_id"), ["conv_id"], ["seq"], "left_semi")
    out = out.unionByName(piece(told, _TURNS, F.col("text"), F.col("seq")))
    out = out.unionByName(piece(with_history, _CLOSE, F.lit("</conversation_history>\n\n")))
    if "file_content" in asked.columns:
        shown = asked.where(nonempty(F.col("file_path")).isNotNull()
                            & nonempty(F.col("file_content")).isNotNull())
        out = out.unionByName(piece(shown, _FILE, F.concat(
            F.lit('<currentFileContent path="'), "file_path", F.lit('">\n'), "file_content",
            F.lit("\n</currentFileContent>\n\n"))))
    if contexts is None:
        out = out.unionByName(piece(asked, _CONTEXT, F.lit(_SHORT_NOTE)))
    else:
        given = asked.select("conv_id").join(contexts, "conv_id", "left")
        filled = F.col("context").isNotNull() & (strip(F.col("context")) != "")
        out = out.unionByName(piece(given, _CONTEXT, F.when(filled, F.concat(
            F.lit("<START_OF_CONTEXT>\n"), F.col("context"), F.lit("\n<END_OF_CONTEXT>\n\n")))
            .otherwise(_NOTE)))
    return out.unionByName(piece(asked, _QUERY, F.concat(
        F.lit("<query>\n"), "query", F.lit("\n</query>\n\nAssistant: "))))


def assemble_prompts(fragments: DataFrame) -> DataFrame:
    """Whole prompts `(conv_id, prompt)`, each as one row.

    For prompts beyond what a row can hold (2 GB) write the fragments in order instead.
    """
    return fragments.groupBy("conv_id").agg(
        ordered_text(F.collect_list(F.struct("part", "seq", "text")), "").alias("prompt"))


def rendered_template(system_prompt: Column, output_format: Column, contexts: Column, query: Column,
                      history: Column | None = None) -> Column:
    """Retrieval prompt with numbered contexts.

    `contexts` is an array of (path, text) structs, `history` one of (key, user, assistant).
    """
    def block(name, body):
        return F.concat(F.lit(f"<START_OF_{name}>\n"), body, F.lit(f"<END_OF_{name}>\n"))

    def optional(name, items, line):
        body = F.array_join(F.transform(items, line), "")
        return F.when(F.size(items) > 0, block(name, body)).otherwise("")

    numbered = lambda c, i: F.concat(
        (i + 1).cast("string"), F.lit(".\nFile Path: "), F.coalesce(c["path"], F.lit("unknown")),
        F.lit("\nContent: "), c["text"], F.lit("\n"))
    said = lambda t: F.concat(t["key"], F.lit(".\nUser: "), t["user"], F.lit("\nYou: "),
                              t["assistant"], F.lit("\n"))
    return F.concat(
        block("SYS_PROMPT", F.concat(system_prompt, F.lit("\n"), output_format, F.lit("\n"))),
        optional("CONVERSATION_HISTORY", history, said) if history is not None else F.lit(""),
        optional("CONTEXT", contexts, numbered),
        block("USER_PROMPT", F.concat(query, F.lit("\n"))))
