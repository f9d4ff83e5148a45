"""Queries over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views
from catalog.registry import query, table
from catalog.vector_queries import CHUNKS, RETRIEVED, chunk_id, document_chunks, retrieved, sparse
from repograph.functions import research
from repograph.operators import chat, embedding
from repograph.plans import questions
from repograph.stage import staged

c = F.col

# Conversations with research tags, stage headings and, mostly, a closing user message.
MESSAGES = """SELECT conv_id, turn AS pos, role, CASE
    WHEN conv_id % 3 = 0 AND turn = 0 THEN concat('[DEEP RESEARCH] ', text)
    WHEN role = 'assistant' AND conv_id % 3 = 0 THEN concat(CASE turn WHEN 1 THEN '## Research Plan'
      WHEN 3 THEN '## Research Update 2' WHEN 5 THEN '## Conclusion' ELSE '## Final Conclusion' END,
      chr(10), text)
    WHEN role = 'assistant' AND turn = 3 THEN concat('## Summary', chr(10), text, ' Next Steps')
    ELSE text END AS text FROM conversations
UNION ALL SELECT conv_id, max(turn) + 1, 'user', CASE WHEN conv_id % 6 = 0
    THEN 'Please Continue the research' WHEN conv_id % 6 = 1 THEN 'What about [DEEP RESEARCH] it?'
    WHEN conv_id % 10 = 2 THEN concat('Long ', repeat('word ', 7000))
    ELSE concat('Where is item ', cast(conv_id AS string), ' and the of a') END
  FROM conversations GROUP BY conv_id HAVING conv_id % 4 <> 3"""

M = f"messages AS ({MESSAGES})"
TURNS = f"""{M}, pairs AS (SELECT a.conv_id, a.pos // 2 AS turn_no, a.text AS user_text,
    b.text AS assistant_text FROM messages a JOIN messages b ON a.conv_id = b.conv_id
    AND b.pos = a.pos + 1 WHERE a.pos % 2 = 0 AND a.role = 'user' AND b.role = 'assistant')"""
REQUESTS = """last_pos AS (SELECT conv_id, max(pos) AS pos FROM messages GROUP BY conv_id),
tops AS (SELECT m.conv_id, m.role, m.text, trim(replace(m.text, '[DEEP RESEARCH]', '')) AS bare
  FROM messages m JOIN last_pos USING (conv_id, pos)),
firsts AS (SELECT conv_id, min(pos) AS pos FROM messages WHERE role = 'user'
  AND NOT contains(lower(text), 'continue') GROUP BY conv_id),
research AS (SELECT conv_id, count(*) FILTER (contains(text, '[DEEP RESEARCH]')) > 0 AS is_research,
  count(*) FILTER (role = 'assistant') + 1 AS n FROM messages GROUP BY conv_id),
requests AS (SELECT t.conv_id, t.role = 'user' AS valid, is_research,
  CASE WHEN is_research THEN n ELSE 1 END AS iteration,
  CASE WHEN is_research AND contains(lower(t.bare), 'continue') AND contains(lower(t.bare), 'research')
    THEN coalesce(nullif(trim(replace(m.text, '[DEEP RESEARCH]', '')), ''), t.bare)
    WHEN contains(t.text, '[DEEP RESEARCH]') THEN t.bare ELSE t.text END AS query,
  length(t.text) // 4 > 8000 AS too_large
  FROM tops t JOIN research r ON r.conv_id = t.conv_id LEFT JOIN firsts f ON f.conv_id = t.conv_id
  LEFT JOIN messages m ON m.conv_id = f.conv_id AND m.pos = f.pos)"""
SYSTEM = """about AS (SELECT *, 'https://host/o/r' || (conv_id % (SELECT count(DISTINCT source) FROM documents)) AS repo_url,
  CASE conv_id % 3 WHEN 0 THEN 'Français (French)' ELSE 'English' END AS language FROM requests
  WHERE valid),
asked AS (SELECT *, CASE WHEN NOT is_research THEN 'chat' WHEN iteration = 1 THEN 'first'
    WHEN iteration >= 5 THEN 'final' ELSE 'middle' END AS stage FROM about),
system AS (SELECT *, stage || ' ' || repo_url || ' ' || split_part(repo_url, '/', 5) || ' web ' || language
  || CASE stage WHEN 'middle' THEN ' {iteration} ' || iteration ELSE '' END AS system_prompt
  FROM asked)"""


def messages(spark, sf):
    return views._sql(spark, sf, MESSAGES, "conversations")


def _templates(spark):
    base = "{repo_url} {repo_name} {repo_type} {language_name}"
    return chat.template_table(spark, {
        "chat": f"chat {base}", "first": f"first {base}", "final": f"final {base}",
        "middle": f"middle {base} {{{{iteration}}}} {{research_iteration}}"})


def _about(spark, sf):
    """Conversations dealt over all sources of the documents."""
    return spark.sql("""
SELECT conv_id, concat('src', n) AS repo, concat('https://host/o/r', n) AS repo_url, 'web' AS repo_type,
  CASE conv_id % 3 WHEN 0 THEN 'fr' WHEN 1 THEN 'xx' END AS language
FROM (SELECT DISTINCT conv_id, conv_id % (SELECT count(DISTINCT source) FROM {documents}) AS n
  FROM {messages})""", documents=table(spark, sf, "documents"), messages=messages(spark, sf))


@query("dialog_turns", f"""WITH {TURNS}
SELECT conv_id, turn_no::BIGINT AS turn_no, user_text, assistant_text FROM pairs""")
def dialog_turns(spark, sf):
    return chat.dialog_turns(messages(spark, sf))


@query("history_texts", f"""WITH {TURNS}
SELECT conv_id, turn_no::BIGINT AS seq, '<turn>' || chr(10) || '<user>' || user_text || '</user>'
  || chr(10) || '<assistant>' || assistant_text || '</assistant>' || chr(10) || '</turn>' || chr(10)
  AS text FROM pairs""")
def history_texts(spark, sf):
    return chat.history_fragments(chat.dialog_turns(messages(spark, sf)))


@query("chat_requests", f"""WITH {M}, {REQUESTS}
SELECT * FROM requests""")
def chat_requests(spark, sf):
    return chat.requests(messages(spark, sf), chat.MAX_QUESTION_TOKENS)


@query("system_prompts", f"""WITH {M}, {REQUESTS}, {SYSTEM}
SELECT conv_id, stage, system_prompt FROM system""")
def system_prompts(spark, sf):
    return questions.asked_requests(messages(spark, sf), _about(spark, sf), _templates(
        spark)).select("conv_id", "stage", "system_prompt")


@query("research_progress", f"""WITH {M}
SELECT conv_id, pos, text LIKE '## Conclusion%' OR text LIKE '## Final Conclusion%' AS complete,
  CASE WHEN pos = 1 AND text LIKE '## Research Plan%' THEN 'plan' WHEN pos = 3 AND text LIKE
    '## Research Update%' THEN 'update' WHEN text LIKE '## Final%' THEN 'conclusion' END AS stage,
  CASE WHEN pos = 1 AND text LIKE '## Research Plan%' THEN 'Research Plan' WHEN pos = 3 AND text LIKE
    '## Research Update%' THEN 'Research Update 2' WHEN text LIKE '## Final%'
    THEN 'Final Conclusion' END AS title
FROM messages WHERE role = 'assistant'""")
def research_progress(spark, sf):
    answers = messages(spark, sf).where("role = 'assistant'")
    iteration = F.floor((c("pos") + 1) / 2).cast("int")
    stage = research.research_stage(c("text"), iteration)
    return answers.select("conv_id", "pos", research.research_complete(c("text")).alias("complete"),
                          stage["type"].alias("stage"), stage["title"].alias("title"))


@query("retrieval_questions", f"""WITH {M}, {REQUESTS}
SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'Contexts related to src/f' || conv_id || '.py'
  ELSE query END AS text FROM requests WHERE NOT too_large""")
def retrieval_questions(spark, sf):
    from repograph.operators.vectors import retrieval_question
    path = F.when(c("conv_id") % 2 == 0, F.concat(F.lit("src/f"), c("conv_id"), F.lit(".py")))
    return chat.requests(messages(spark, sf), chat.MAX_QUESTION_TOKENS).where(~c("too_large")).select(
        "conv_id", retrieval_question(c("query"), F.coalesce(path, F.lit(""))).alias("text"))


CONTEXT = """grouped AS (SELECT question_id, path, min(rank) AS best,
    '## File Path: ' || path || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY rank)
    AS body FROM placed GROUP BY question_id, path),
contexts AS (SELECT question_id, chr(10) || chr(10) || '----------' || string_agg(body, chr(10)
  || chr(10) ORDER BY best) AS context FROM grouped GROUP BY question_id)"""


@query("question_contexts", RETRIEVED + f""",
placed AS (SELECT *, repo || '/d' || (doc_id % 7) AS path FROM hits), {CONTEXT}
SELECT question_id, context FROM contexts""")
def question_contexts(spark, sf):
    hits = retrieved(spark, sf).withColumn("path", F.concat(
        "repo", F.lit("/d"), (c("doc_id") % 7).cast("string")))
    return chat.context_by_file(hits)


PROMPTS = f"""WITH {TURNS}, {REQUESTS}, {SYSTEM}, {CHUNKS},
{sparse('chunks', 'doc_id, chunk_no', 'vec')}, items AS (SELECT conv_id, query AS text FROM system
  WHERE NOT too_large), {sparse('items', 'conv_id', 'q')},
dots AS (SELECT conv_id, doc_id, chunk_no, sum(q.value * vec.value) AS dot FROM q JOIN vec
  USING (bucket) GROUP BY ALL),
scored AS (SELECT i.conv_id AS question_id, c.repo || '/' || c.doc_id AS path, c.text,
  c.doc_id * 1000 + c.chunk_no AS chunk_id, coalesce(round(dot, 6), 0) AS score
  FROM items i JOIN chunks c ON c.repo = 'src' || (i.conv_id % (SELECT count(DISTINCT source) FROM documents)) LEFT JOIN dots d
  ON d.conv_id = i.conv_id AND d.doc_id = c.doc_id AND d.chunk_no = c.chunk_no),
placed AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id)
  AS rank FROM scored QUALIFY rank <= 20), {CONTEXT},
histories AS (SELECT conv_id, string_agg('<turn>' || chr(10) || '<user>' || user_text || '</user>'
  || chr(10) || '<assistant>' || assistant_text || '</assistant>' || chr(10) || '</turn>' || chr(10),
  '' ORDER BY turn_no) AS history FROM pairs GROUP BY conv_id)
SELECT s.conv_id, sha256('/no_think ' || system_prompt || chr(10) || chr(10)
  || CASE WHEN history IS NULL THEN '' ELSE '<conversation_history>' || chr(10) || history
    || '</conversation_history>' || chr(10) || chr(10) END
  || @CONTEXT || '<query>' || chr(10) || query || chr(10) || '</query>' || chr(10)
  || chr(10) || 'Assistant: ') AS digest
FROM system s LEFT JOIN histories h ON h.conv_id = s.conv_id
LEFT JOIN contexts c ON c.question_id = s.conv_id"""


def _digests(fragments):
    return chat.assemble_prompts(fragments).select("conv_id", F.sha2("prompt", 256).alias("digest"))


@query("prompts", PROMPTS.replace("@CONTEXT", """CASE WHEN context IS NULL
    THEN '<note>Answering without retrieval augmentation.</note>' ELSE '<START_OF_CONTEXT>' || chr(10)
    || context || chr(10) || '<END_OF_CONTEXT>' END || chr(10) || chr(10)"""))
def prompts(spark, sf):
    chunks = document_chunks(spark, sf).withColumns({
        "chunk_id": chunk_id(),
        "path": F.concat_ws("/", "repo", c("doc_id").cast("string"))})
    stored = staged(embedding.embed(chunks).drop("embed_error", "batch"))
    return _digests(questions.prompts(messages(spark, sf), _about(spark, sf), _templates(spark),
                                      stored,
                                      max_question_tokens=chat.MAX_QUESTION_TOKENS))


@query("fallback_prompts", PROMPTS.replace("@CONTEXT", (
    "'<note>Answering without retrieval augmentation due to input size constraints.</note>' "
    "|| chr(10) || chr(10)")))
def fallback_prompts(spark, sf):
    return _digests(questions.prompts(messages(spark, sf), _about(spark, sf), _templates(spark),
                                      None))


@query("rendered_templates", RETRIEVED + """,
listed AS (SELECT question_id, string_agg(rank || '.' || chr(10) || 'File Path: ' || CASE WHEN
    doc_id % 2 = 0 THEN 'unknown' ELSE repo END || chr(10) || 'Content: ' || text || chr(10), ''
    ORDER BY rank) AS contexts FROM hits GROUP BY question_id)
SELECT question_id, sha256('<START_OF_SYS_PROMPT>' || chr(10) || 'sys' || chr(10) || 'fmt' || chr(10)
  || '<END_OF_SYS_PROMPT>' || chr(10) || '<START_OF_CONTEXT>' || chr(10) || contexts
  || '<END_OF_CONTEXT>' || chr(10) || '<START_OF_USER_PROMPT>' || chr(10) || i.text || chr(10)
  || '<END_OF_USER_PROMPT>' || chr(10)) AS digest
FROM listed JOIN items i ON i.item_id = question_id""")
def rendered_templates(spark, sf):
    path = F.when(c("doc_id") % 2 == 1, c("repo")).alias("path")
    listed = retrieved(spark, sf).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", path, "text"))).alias("contexts"))
    items = table(spark, sf, "benchmark").select(c("item_id").alias("question_id"), "text")
    return listed.join(items, "question_id").select("question_id", F.sha2(chat.rendered_template(
        F.lit("sys"), F.lit("fmt"), c("contexts"), c("text")), 256).alias("digest"))
