"""Registered queries of this subpackage, each applying one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    """crc32 of the doc_id as text, modulo n; null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


_RULES = """VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
 ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')"""


@_query("op10_url_filter", rf"""
WITH p AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
    row_number() OVER () AS k FROM pages),
  r AS (SELECT * FROM ({_RULES}) AS r(rhost, rpath, verdict)),
  m AS (SELECT k, arg_max(r, length(rhost || rpath) * 10000 + length(rhost)) AS r
    FROM p JOIN r ON starts_with(path, rpath) AND (host = rhost OR ends_with(host, '.' || rhost))
    GROUP BY k)
SELECT page_id, host, path, r.rhost || r.rpath AS rule, coalesce(r.verdict, 'allow') AS verdict
FROM p LEFT JOIN m USING (k)""")
def op10_url_filter(spark, sf):
    from repograph.llm.url_filter import judge_urls
    rules = spark.sql(f"SELECT * FROM {_RULES} AS r(host, path, verdict)")
    return judge_urls(_table(spark, sf, "pages"), rules, ["page_id"])


@_query("op7_host_rules", r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text
    FROM documents),
  w AS (SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
  t AS (SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
    FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
  again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM t)
    WHERE n > 1),
  rep AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words
    FROM again, (VALUES (0), (1), (2)) AS o(j) GROUP BY k),
  ln AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
  m AS (SELECT d.k, doc_id, source, len(ws) AS n_words,
      length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM d JOIN w USING (k) LEFT JOIN rep USING (k) LEFT JOIN ln USING (k)),
  f AS (SELECT *, 10 * n_symbols > n_words AS f1, 10 * n_dup_lines > 3 * n_lines AS f2,
      word_chars < 3 * n_words AS f3, word_chars > 10 * n_words AS f4,
      n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
  rates AS (SELECT source, rule, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS s
    FROM (SELECT source, unnest(['f1', 'f2', 'f3', 'f4']) AS rule,
        unnest([f1, f2, f3, f4]) AS failed FROM f WHERE source IS NOT NULL)
    GROUP BY source, rule),
  moments AS (SELECT rule, sum(s) / sum(n) AS raw, least(greatest(sum(s) / sum(n), 1e-6), 1 - 1e-6)
      AS mean, sum(n * (s / n) * (s / n)) / sum(n) AS q, count(*) / sum(n) AS hosts_per_doc
    FROM rates GROUP BY rule),
  priors AS (SELECT rule, mean, least(greatest(mean * (1 - mean) / greatest(q - raw * raw
      - mean * (1 - mean) * hosts_per_doc, 1e-9) - 1, 1.0), 1e6) AS strength FROM moments),
  binds AS (SELECT source, list(rule) AS rules FROM rates JOIN priors USING (rule)
    WHERE (s + mean * strength) / (n + strength) > 0.5 GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(
    (f1 AND list_contains(rules, 'f1')) OR (f2 AND list_contains(rules, 'f2'))
    OR (f3 AND list_contains(rules, 'f3')) OR (f4 AND list_contains(rules, 'f4')), false) AS kept
FROM f LEFT JOIN binds USING (source)""")
def op7_host_rules(spark, sf):
    from repograph.llm.host_rules import apply_host_rules
    return apply_host_rules(_table(spark, sf, "documents"), ["doc_id", "source"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


@_query("op9_best_fit_packing")
def op9_best_fit_packing(spark, sf):
    import public_tokenizers
    from repograph.llm.packing import pack
    return pack(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op2_pivot_search", """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
    FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 5""")
def op2_pivot_search(spark, sf):
    from repograph.llm.pivot_search import top_k
    return top_k(_table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@_query("op3_toxicity")
def op3_toxicity(spark, sf):
    from repograph.llm.toxicity import score_toxicity
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    scored = score_toxicity(_table(spark, sf, "documents"), _table(spark, sf, "labels"),
                            ["doc_id"], _remainder(4) != 2)
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query("op5_substring_dedup", r"""
WITH w AS (SELECT row_number() OVER () AS k, doc_id,
    coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
  win AS (SELECT k, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
    FROM (SELECT k, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
  hit AS (SELECT k, i FROM (SELECT k, i, doc_id, min(doc_id) OVER (PARTITION BY h) AS first FROM win)
    WHERE first < doc_id),
  pos AS (SELECT k, i, ws[i] AS word FROM (SELECT k, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
  cov AS (SELECT DISTINCT k, i + j AS i FROM hit, range(0, 50) AS r(j)),
  kept AS (SELECT p.k, string_agg(word, ' ' ORDER BY p.i) AS t, count(*) AS n
    FROM pos p LEFT JOIN cov c ON p.k = c.k AND p.i = c.i WHERE c.i IS NULL GROUP BY p.k)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (k)""")
def op5_substring_dedup(spark, sf):
    from repograph.llm.substrings import remove_repeats
    return remove_repeats(_table(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


@_query("op4_ngram_join")
def op4_ngram_join(spark, sf):
    from repograph.llm.ngram_join import ngram_join
    return ngram_join(_table(spark, sf, "documents"))


@_query("op8_language_id")
def op8_language_id(spark, sf):
    from repograph.llm.language_id import identify
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False))
    found = identify(_table(spark, sf, "documents"), ["doc_id"], _remainder(3) != 1)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@_query("op6_katz")
def op6_katz(spark, sf):
    from repograph.llm.katz import score
    return score(_table(spark, sf, "documents"), _remainder(7) != 2).select(
        "doc_id", F.coalesce(_remainder(7) == 2, F.lit(False)).alias("held_out"), "n_tokens",
        "n_known", "train_tokens", "base_score", "score")


@_query("op1_sentencepiece")
def op1_sentencepiece(spark, sf):
    import public_tokenizers
    from repograph.llm.pieces import encode
    return encode(_table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"),
                  ["doc_id"])


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_query("op11_decontaminate", rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(
      {_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
  b AS (SELECT item_id, regexp_extract_all(
      {_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
  g AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n,
      array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS gram
    FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
  w AS (SELECT k, n, i, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM (
    SELECT k, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
    FROM d, (SELECT DISTINCT n FROM g) WHERE len(ws) >= n)),
  h AS (SELECT DISTINCT k, i, n, item_id FROM w JOIN g USING (n, gram)),
  cov AS (SELECT k, count(DISTINCT p) AS n_hit
    FROM (SELECT k, unnest(range(i, i + n)) AS p FROM h) GROUP BY k),
  its AS (SELECT k, list_sort(list_distinct(list(item_id::VARCHAR))) AS items FROM h GROUP BY k)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), ''))
    AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (k) LEFT JOIN its USING (k)""")
def op11_decontaminate(spark, sf):
    from repograph.llm.decontaminate import find_contamination
    found = find_contamination(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"),
                               ["doc_id"])
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def _part_codes_sql(rounds: int = 4) -> str:
    """Training unrolled: c0 holds the first codebooks, c{k} those after k rounds."""
    nearest = """a{k} AS MATERIALIZED (SELECT vec_id, part, v, first(entry ORDER BY d, entry) AS entry,
      min(d) AS d FROM (SELECT vec_id, p.part, p.v, entry, (list_inner_product(p.v, p.v)
        - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v))::BIGINT AS d
      FROM p JOIN c{k} c ON p.part = c.part) GROUP BY vec_id, part, v)"""
    steps = ["""v AS (SELECT vec_id, label, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v
    FROM embeddings WHERE embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
             """p AS MATERIALIZED (SELECT vec_id, part,
      v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] AS v FROM v, range(0, 4) AS r(part))""",
             """c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id)
      - 1 AS entry, v FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256))"""]
    for k in range(rounds):
        steps += [nearest.format(k=k), f"""c{k + 1} AS MATERIALIZED (SELECT part, entry,
      coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (SELECT part, entry, list(x ORDER BY i) AS v
        FROM (SELECT part, entry, i, floor(sum(x) / count(*)) AS x FROM (
          SELECT part, entry, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM a{k})
          GROUP BY part, entry, i) GROUP BY part, entry) m USING (part, entry))"""]
    steps += [nearest.format(k=rounds), f"""h AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ','
      ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(v) AS x,
        unnest(range(1, len(v) + 1)) AS i FROM c{rounds}))""",
              f"""e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code,
      sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)"""]
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  codebooks_sha256 FROM e JOIN v USING (vec_id), h"""


@_query("op13_part_codes", _part_codes_sql())
def op13_part_codes(spark, sf):
    from repograph.llm.part_codes import codebooks_text, compress
    coded, books = compress(_table(spark, sf, "embeddings"), "embedding", "vec_id", "label")
    digits = F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    return coded.select("row.vec_id", F.array_join(digits, "").alias("code"), "error", "label_error",
                        F.sha2(F.lit(codebooks_text(books)), 256).alias("codebooks_sha256"))


@_query("op12_source_divergence", r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang,
    coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
  o AS (SELECT k, lang, source, term, count(*) AS n
    FROM (SELECT k, lang, source, unnest(ts) AS term FROM d) GROUP BY ALL),
  lt AS (SELECT lang, term, sum(n)::HUGEINT AS lc FROM o GROUP BY lang, term HAVING count(*) >= 30),
  l AS (SELECT lang, count(*) AS v, sum(lc) AS lt FROM lt GROUP BY lang),
  c AS (SELECT lang, source, term, sum(n)::HUGEINT AS c FROM o SEMI JOIN lt USING (lang, term)
    GROUP BY ALL),
  g AS (SELECT lang, source, coalesce(t, 0) AS t FROM (SELECT DISTINCT lang, source FROM d)
    LEFT JOIN (SELECT lang, source, sum(c) AS t FROM c GROUP BY ALL) USING (lang, source)),
  p AS (SELECT g.lang, g.source, lt.term, coalesce(c, 0) AS c,
      1 + 1000000000 * (coalesce(c, 0) + 5) // (t + 5 * v) AS p, 1 + 1000000000 * (lc + 5) // (l.lt + 5 * v) AS q
    FROM g JOIN lt ON g.lang = lt.lang JOIN l ON l.lang = g.lang
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = lt.term),
  f AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
    FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
    LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
      GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM f) WHERE part = 'pair' OR rank <= 50""")
def op12_source_divergence(spark, sf):
    from repograph.llm.divergence import source_divergence
    return source_divergence(_table(spark, sf, "documents"))
