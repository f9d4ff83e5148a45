"""Queries over files, paths and repository addresses."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import views
from catalog.registry import ORACLES, query, table
from catalog.views import CODE_FILES, FILE_FINDINGS, FILES, LEVELLED, TOOL_RESULTS
from repograph.functions import paths, text, urls
from repograph.operators import corpus, detect, findings as ops, graph, modules, report
from repograph.sources import folders, repository
from repograph.stage import stage_folder

c = F.col
V = f"WITH files_v AS ({FILES})"
# Suffix after the last dot, as DuckDB writes it.
_LIMITS = {"max_code_tokens": corpus.MAX_CODE_TOKENS, "max_text_tokens": corpus.MAX_TEXT_TOKENS}
EXT = "regexp_extract(path, '\\.[^./]+$')"


@query("corpus_excluding", V + """
SELECT path FROM files_v WHERE NOT (source IN ('src1', 'src2') OR lang = 'fr'
  OR regexp_matches(path, '/mod_(5|11)\\.[a-z]+$'))""")
def corpus_excluding(spark, sf):
    # `./.src1/` is cleaned to `src1`; a two-part directory and a star match nothing.
    return corpus.select_files(
        views.files(spark, sf), excluded_dirs=["./.src1/", "src2/", "src/src3", "fr"],
        excluded_files=["mod_5.sh", "mod_11.rs", "*.py"]).select("path")


@query("corpus_including", V + """
SELECT path FROM files_v WHERE source = 'src4' OR lang = 'de' OR path LIKE '%.rs'
  OR path LIKE '%7.json'""")
def corpus_including(spark, sf):
    return corpus.select_files(
        views.files(spark, sf), included_dirs=["./src4/", "de", "src/src5"],
        included_files=[".rs", "7.json"]).select("path")


@query("corpus_documents", V + f""", kept AS (SELECT path, replace({EXT}, '.', '') AS type,
  length(content) // 4 AS token_count FROM files_v)
SELECT path, type, type IN ('py', 'ts', 'rs') AS is_code,
  type IN ('py', 'ts', 'rs') AND NOT contains(lower(path), 'test') AS is_implementation,
  path AS title, token_count FROM kept WHERE type NOT IN ('sh', 'png')
  AND token_count <= CASE WHEN type IN ('py', 'ts', 'rs') THEN 81920 ELSE 8192 END""")
def corpus_documents(spark, sf):
    return corpus.documents(views.files(spark, sf), **_LIMITS).select(
        "path", "type", "is_code", "is_implementation", "title", "token_count")


@query("scanned_repository", V + """
SELECT 'src' AS repo, substr(path, 5) AS path, octet_length(encode(content)) + (doc_id % 11 = 0)::INT
    AS n_bytes, CASE WHEN doc_id % 11 <> 0 THEN md5(content) END AS text_md5,
  CASE WHEN doc_id % 11 = 0 THEN 'not valid UTF-8' END AS reason
FROM files_v WHERE doc_id % 8 IN (0, 2, 7)""")
def scanned_repository(spark, sf):
    """Every document written as a file, listed, and three kinds of them read back.

    Every eleventh has a byte that is not UTF-8.
    """
    root = f"{stage_folder(spark)}/files-{uuid.uuid4().hex}"
    bytes_of = F.encode(F.coalesce("content", F.lit("")), "utf-8")
    folders.write_files(views.files(spark, sf).select("path", F.when(
        c("doc_id") % 11 == 0, F.concat(F.unhex(F.lit("FF")), bytes_of)).otherwise(
        bytes_of).alias("content")), root)
    files = repository.read_files(spark, root, [".py", ".md", ".json"])
    sized = files.withColumn("n_bytes", F.octet_length("content").cast("bigint"))
    return repository.decoded(sized).select(
        "repo", "path", "n_bytes", F.md5("content").alias("text_md5"), "reason")


@query("token_gate", V + f""", t AS (SELECT {EXT} IN ('.py', '.ts', '.rs') AS is_code,
  length(content) // 4 * 20 AS n FROM files_v WHERE {EXT} NOT IN ('.sh', '.png'))
SELECT is_code, count(*) AS kept, sum(n)::BIGINT AS tokens FROM t
WHERE n <= CASE WHEN is_code THEN 81920 ELSE 8192 END GROUP BY is_code""")
def token_gate(spark, sf):
    # A counter of twenty tokens per four characters makes the limits bite.
    kept = corpus.documents(views.files(spark, sf), lambda t: text.token_count(t) * 20,
                            **_LIMITS)
    return kept.groupBy("is_code").agg(F.count(F.lit(1)).alias("kept"),
                                       F.sum("token_count").alias("tokens"))


@query("word_estimates", "SELECT doc_id, len([x for x in regexp_split_to_array(text, '\\s+') "
                         "if x <> ''])::BIGINT AS words FROM documents")
def word_estimates(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.word_count(c("text")).alias("words"))


@query("file_classes", V + f"""
SELECT path, CASE WHEN contains(path, 'test') OR contains(path, 'spec') THEN 'test'
    WHEN {EXT} IN ('.yaml', '.json') THEN 'config' WHEN {EXT} = '.md' THEN 'docs' ELSE 'source' END
    AS file_class,
  left(path, length(path) - strpos(reverse(path), '/')) AS directory,
  CASE {EXT} WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.rs' THEN 'rust'
    WHEN '.yaml' THEN 'yaml' WHEN '.json' THEN 'json' WHEN '.sh' THEN 'bash' ELSE 'text' END
    AS highlight FROM files_v""")
def file_classes(spark, sf):
    return views.files(spark, sf).select(
        "path", paths.classify_file(c("path")).alias("file_class"),
        paths.directory(c("path")).alias("directory"),
        paths.highlight_language(c("path")).alias("highlight"))


SHAPED = """ SELECT doc_id, source AS repo, CASE doc_id % 12 WHEN 1 THEN replace(path, '/mod_', '/.mod_')
  WHEN 5 THEN concat('node_modules/', path) WHEN 7 THEN replace(path, '/en/', '/.en/')
  WHEN 10 THEN concat(replace(path, '.md', ''), '/ReadMe.md')
  WHEN 11 THEN concat('build', substr(path, 4)) ELSE path END AS path, content
FROM ({files}) files_v"""


def shaped_files(spark, sf):
    """Files some of which lie in hidden or skipped places."""
    return views._sql(spark, sf, SHAPED.format(files=FILES), "documents")


SHAPED_V = f"WITH shaped AS ({SHAPED.format(files=FILES)})"


@query("scannable_files", SHAPED_V + """
SELECT repo, path FROM shaped WHERE NOT regexp_matches(path, '(^|/)\\.') AND path NOT LIKE '%.png'
  AND NOT regexp_matches(path, '(^|/)(node_modules|build|es)/')""")
def scannable_files(spark, sf):
    return corpus.scannable(shaped_files(spark, sf), ["es"]).select("repo", "path")


@query("tree_listing", SHAPED_V + """
SELECT repo, path FROM shaped WHERE NOT regexp_matches(path, '(^|/)\\.')
  AND NOT regexp_matches(path, '(^|/)node_modules/')""")
def tree_listing(spark, sf):
    return corpus.tree_listing(shaped_files(spark, sf))


@query("readmes", SHAPED_V + """
SELECT repo, arg_min(content, path) AS readme FROM shaped
WHERE path LIKE '%/ReadMe.md' AND NOT regexp_matches(path, '(^|/)\\.') GROUP BY repo""")
def readmes(spark, sf):
    return corpus.readme(shaped_files(spark, sf))


@query("hosted_listing", V + """
SELECT source AS repo, path FROM files_v WHERE doc_id % 4 IN (0, 1)""")
def hosted_listing(spark, sf):
    from repograph.sources.repository import listed_paths
    kinds = F.array(*[F.lit(x) for x in ("blob", "commit_file", "tree", "commit_directory")])
    listing = views.files(spark, sf).select(
        c("source").alias("repo"), "path",
        F.element_at(kinds, (c("doc_id") % 4 + 1).cast("int")).alias("type"))
    return listed_paths(listing)


@query("ignored_files", V + """
SELECT source AS repo, path FROM files_v WHERE (path LIKE '%.png' AND NOT
    regexp_matches(path, '/test_1[0-9]*\\.')) OR (regexp_matches(path, '/test_[0-9]+\\.') AND NOT regexp_matches(path, '/test_1[0-9]*\\.'))
  OR (lang = 'es' AND source <> 'src1') OR (lang = 'en' AND path LIKE '%.json')
  OR (lang = 'en' AND regexp_matches(path, '/mod_[0-9]\\.rs$'))
  OR regexp_matches(path, '^src/[^/]+/d./app_.*\\.py$')""")
def ignored_files(spark, sf):
    files = views.files(spark, sf).withColumnRenamed("source", "repo")
    repos = files.select("repo").distinct()
    # An ignore file at each root and one in each English directory.
    root = repos.select("repo", F.lit("").alias("dir"), F.concat(
        F.lit("# build\n*.png\ntest_*\n!test_1*\n\nsrc/**/d?/app_*.py\n!src/src1/es\n"),
        F.when(c("repo") != "src1", "es/\n").otherwise("")).alias("content"))
    english = repos.select("repo", F.concat(F.lit("src/"), "repo", F.lit("/en")).alias("dir"),
                           F.lit("*.json\n/mod_[0-9].rs\n").alias("content"))
    return corpus.ignored_files(files, corpus.ignore_rules(root.unionByName(english)))


MARKED = """SELECT source AS repo, CASE doc_id % 30 WHEN 3 THEN 'package.json' WHEN 9 THEN 'Cargo.toml'
  WHEN 21 THEN 'docs/Dockerfile' WHEN 27 THEN concat('vendor/', path) ELSE path END AS path
FROM ({files}) files_v"""


def marked_files(spark, sf):
    return views._sql(spark, sf, MARKED.format(files=FILES), "documents")


LANGUAGES = f"""WITH marked AS ({MARKED.format(files=FILES)}),
pairs AS (SELECT DISTINCT repo, unnest([CASE path WHEN 'package.json' THEN 'javascript'
    WHEN 'Cargo.toml' THEN 'rust' END, CASE WHEN path LIKE 'vendor/%' THEN NULL
    WHEN path LIKE '%Dockerfile' THEN 'docker' ELSE CASE {EXT} WHEN '.py' THEN 'python'
    WHEN '.ts' THEN 'typescript' WHEN '.rs' THEN 'rust' WHEN '.yaml' THEN 'yaml'
    WHEN '.json' THEN 'json' WHEN '.toml' THEN 'toml' WHEN '.sh' THEN 'shell' END END]) AS language
  FROM marked)"""


@query("detected_languages", LANGUAGES + """
SELECT repo, coalesce(string_agg(language, ',' ORDER BY language), '') AS languages FROM pairs
GROUP BY repo""")
def detected_languages(spark, sf):
    return detect.detected_languages(marked_files(spark, sf)).select(
        "repo", F.array_join("languages", ",").alias("languages"))


@query("detected_frameworks", f"""WITH marked AS ({MARKED.format(files=FILES)})
SELECT repo, string_agg(DISTINCT path, ',' ORDER BY path) AS frameworks FROM marked
WHERE path IN ('package.json', 'Cargo.toml') GROUP BY repo""")
def detected_frameworks(spark, sf):
    return detect.detected_frameworks(marked_files(spark, sf)).select(
        "repo", F.array_join("frameworks", ",").alias("frameworks"))


TOOL_SQL = LANGUAGES + """,
fits AS (SELECT * FROM (VALUES ('python', 'semgrep bandit ruff pyright lizard detect-secrets trivy checkov'),
  ('javascript', 'semgrep eslint lizard detect-secrets trivy'),
  ('typescript', 'semgrep eslint lizard detect-secrets trivy'),
  ('rust', 'semgrep clippy cargo-audit cargo-deny cargo-udeps lizard detect-secrets trivy'),
  ('docker', 'hadolint checkov trivy kics'), ('yaml', 'checkov kics'), ('toml', 'taplo'),
  ('shell', 'shellcheck detect-secrets')) t(language, tools)),
chosen AS (SELECT DISTINCT repo, unnest(string_split(tools, ' ')) AS tool FROM pairs JOIN fits
  USING (language) UNION SELECT repo, unnest(['trufflehog', 'horusec']) FROM pairs)"""


@query("selected_tools", TOOL_SQL + """
SELECT repo, string_agg(tool, ',' ORDER BY tool) AS tools FROM chosen GROUP BY repo""")
def selected_tools(spark, sf):
    languages = detect.detected_languages(marked_files(spark, sf))
    return detect.select_tools(languages).select("repo", F.array_join("tools", ",").alias("tools"))


@query("requested_tools", f"""WITH files_v AS ({FILES})
SELECT DISTINCT source AS repo, CASE source WHEN 'src1' THEN 'bandit'
  ELSE 'horusec,taplo,trufflehog' END AS tools FROM files_v""")
def requested_tools(spark, sf):
    languages = detect.detected_languages(marked_files(spark, sf)).withColumns({
        "requested_languages": F.array(F.lit("TOML"), F.lit("cobol")),
        "requested_tools": F.when(c("repo") == "src1", F.array(F.lit("bandit")))})
    return detect.select_tools(languages).select("repo", F.array_join("tools", ",").alias("tools"))


@query("registered_tools", TOOL_SQL + """
SELECT repo, tool AS name, tool IN ('semgrep', 'bandit', 'trivy', 'ruff', 'eslint', 'hadolint',
  'checkov', 'kics') AS sarif_native FROM chosen""")
def registered_tools(spark, sf):
    selected = detect.select_tools(detect.detected_languages(marked_files(spark, sf)))
    return detect.registered_tools(selected, detect.tool_registry(spark))[0].select(
        "repo", "name", "sarif_native")


@query("unregistered_tools", V + """
SELECT DISTINCT source AS repo, 'clang-sa' AS name FROM files_v""")
def unregistered_tools(spark, sf):
    languages = detect.detected_languages(marked_files(spark, sf)).select(
        "repo", F.array(F.lit("cpp")).alias("languages"))
    selected = detect.select_tools(languages)
    return detect.registered_tools(selected, detect.tool_registry(spark))[1]


@query("tools_per_language", LANGUAGES + """,
known AS (SELECT * FROM (VALUES ('bandit', 'python'), ('ruff', 'python'), ('pyright', 'python'),
  ('eslint', 'javascript'), ('eslint', 'typescript'), ('clippy', 'rust'), ('cargo-audit', 'rust'),
  ('cargo-deny', 'rust'), ('cargo-udeps', 'rust'), ('taplo', 'toml'), ('hadolint', 'docker'),
  ('shellcheck', 'shell'), ('checkov', 'yaml'), ('checkov', 'json'), ('checkov', 'docker'),
  ('kics', 'yaml'), ('kics', 'json'), ('kics', 'docker'), ('pmd-cpd', 'python'),
  ('pmd-cpd', 'javascript'), ('pmd-cpd', 'typescript'), ('dependency-check', 'javascript'),
  ('dependency-check', 'python')) t(name, language))
SELECT DISTINCT repo, name FROM pairs JOIN known USING (language) UNION
SELECT repo, unnest(['semgrep', 'trivy', 'horusec', 'lizard', 'trufflehog', 'detect-secrets',
  'ggshield']) FROM pairs""")
def tools_per_language(spark, sf):
    languages = detect.detected_languages(marked_files(spark, sf))
    # The registry has 32 rows by definition.
    return detect.tools_per_language(languages, detect.tool_registry(spark))


@query("tool_lookups", f"""WITH findings_v AS ({views.FINDINGS}),
counts AS (SELECT tool AS name, count(*) AS findings FROM findings_v GROUP BY tool)
SELECT lookup, name, findings FROM counts JOIN (VALUES ('name', 'clippy'), ('security', 'trivy'),
  ('security', 'bandit'), ('security', 'horusec'), ('quality', 'pyright'), ('quality', 'clippy'),
  ('python or go', 'bandit'), ('python or go', 'pyright'), ('python or go', 'trivy'),
  ('python or go', 'horusec')) AS found(lookup, name) USING (name)""")
def tool_lookups(spark, sf):
    """Findings of the tools that the registry finds by name, category and language."""
    known = detect.tool_registry(spark)
    found = {"name": detect.tools_by_name(known, "clippy"),
             "security": detect.tools_by_category(known, "security"),
             "quality": detect.tools_by_category(known, "quality"),
             "python or go": detect.tools_for_languages(known, F.array(F.lit("python"), F.lit("go")))}
    counts = views.raw_findings(spark, sf).groupBy(c("tool").alias("name")).agg(
        F.count(F.lit(1)).alias("findings"))
    parts = [tools.select(F.lit(label).alias("lookup"), "name") for label, tools in found.items()]
    listed = parts[0]
    for p in parts[1:]:
        listed = listed.unionByName(p)
    return counts.join(F.broadcast(listed), "name").select("lookup", "name", "findings")


@query("import_edges", f"""WITH {LEVELLED}, {FILE_FINDINGS},
known AS (SELECT DISTINCT run_id, file FROM file_findings WHERE level = 'error'),
edges AS (SELECT run_id, path AS source, unnest(['os/path.py', 'src/' || repo || '/' || lang ||
    '/mod_' || doc_id || '.py']) AS target FROM code_files WHERE path LIKE '%.py')
SELECT run_id, source, target, 'import' AS type FROM edges e
WHERE EXISTS (SELECT 1 FROM known k WHERE k.run_id = e.run_id AND k.file = e.source)
  OR EXISTS (SELECT 1 FROM known k WHERE k.run_id = e.run_id AND k.file = e.target)""")
def import_edges(spark, sf):
    known = ops.file_nodes(views.file_findings(spark, sf).where("level = 'error'"))
    return graph.import_edges(views.code_files(spark, sf), known)


import_edges_all = query("import_edges_all", ORACLES["import_edges"])(import_edges)    # its name beside one over fewer documents


MODULES = """
purposes AS (SELECT run_id, left(path, length(path) - strpos(reverse(path), '/')) AS module,
    split_part(path, '/', -1) AS name, CASE WHEN doc_id % 8 = 0 AND doc_id % 3 = 0
    THEN 'Doc ' || doc_id || '.' WHEN doc_id % 8 = 1 AND doc_id % 3 <> 0 THEN 'Script ' || doc_id
    END AS purpose FROM code_files),
told AS (SELECT run_id, module, string_agg(name || ': ' || purpose, ';' ORDER BY name)
    AS file_summaries FROM (SELECT *, row_number() OVER (PARTITION BY run_id, module ORDER BY name)
    AS rn FROM purposes WHERE purpose IS NOT NULL) WHERE rn <= 20 GROUP BY ALL),
placed AS (SELECT *, left(file, length(file) - strpos(reverse(file), '/')) AS module
    FROM file_findings),
samples AS (SELECT run_id, module, count(*) AS finding_count, string_agg(message, ';' ORDER BY tool,
    seq) FILTER (rn <= 5) AS sample_findings FROM (SELECT *, row_number() OVER (PARTITION BY run_id,
    module ORDER BY tool, seq) AS rn FROM placed) GROUP BY ALL),
summaries AS (SELECT coalesce(t.run_id, s.run_id) AS run_id, coalesce(t.module, s.module) AS module,
    '' AS module_doc, coalesce(file_summaries, '') AS file_summaries,
    coalesce(finding_count, 0) AS finding_count, coalesce(sample_findings, '') AS sample_findings
  FROM told t FULL JOIN samples s ON t.run_id = s.run_id AND t.module = s.module)"""


@query("module_summaries", f"""WITH {LEVELLED}, {FILE_FINDINGS}, {MODULES}
SELECT * FROM summaries""")
def module_summaries(spark, sf):
    found = views.file_findings(spark, sf)
    out = modules.module_summaries(views.code_files(spark, sf), found, 20, 5).drop("file_count")
    return out.withColumns({k: F.array_join(k, ";") for k in ("file_summaries",
                                                              "sample_findings")})


module_summaries_all = query("module_summaries_all", ORACLES["module_summaries"])(module_summaries)    # its name beside one over fewer documents


@query("analysis_report", f"""WITH {LEVELLED}, {FILE_FINDINGS}, {MODULES},
nl AS (SELECT chr(10) AS n),
counts AS (SELECT run_id, count(*) AS total, count(*) FILTER (level = 'error') AS errors,
  count(*) FILTER (level = 'warning') AS warnings, count(*) FILTER (level = 'note') AS notes,
  count(DISTINCT tool) AS tools, count(DISTINCT file) AS files FROM file_findings GROUP BY run_id),
nodes AS (SELECT run_id, file, CASE WHEN contains(file, 'test') OR contains(file, 'spec') THEN 'test'
    WHEN file LIKE '%.yaml' OR file LIKE '%.json' THEN 'config' WHEN file LIKE '%.md' THEN 'docs'
    ELSE 'source' END AS type, min(tool || lpad(seq::VARCHAR, 12, '0')) AS place
  FROM file_findings GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, type ORDER BY place) AS rn,
  count(*) OVER (PARTITION BY run_id, type) AS c FROM nodes),
edges AS (SELECT run_id, 2 * count(*) AS edges FROM code_files WHERE path LIKE '%.py'
  AND doc_id IN (SELECT seq % {views.DOCUMENT_COUNT} FROM file_findings) GROUP BY run_id),
serious AS (SELECT *, row_number() OVER (PARTITION BY run_id, level ORDER BY tool, seq) AS rn,
  count(*) OVER (PARTITION BY run_id, level) AS c FROM file_findings
  WHERE level IN ('error', 'warning'))
SELECT run_id, 0 AS section, '' AS part, 0::BIGINT AS position, '# Code Analysis Report' || n || n
  || 'Target: `/repos/' || run_id || '`' || n || '## Summary' || n || '- **Tools executed**: '
  || tools || n || '- **Total findings**: ' || total || n || '- **Errors**: ' || errors || n
  || '- **Warnings**: ' || warnings || n || '- **Notes**: ' || notes || n AS text FROM counts, nl
UNION ALL SELECT c.run_id, 1, '', 0, '## Architecture' || n || '- **Files analyzed**: ' || files || n
  || '- **Dependency edges**: ' || coalesce(edges, 0) || n FROM nl, counts c
  LEFT JOIN edges e ON e.run_id = c.run_id
UNION ALL SELECT run_id, 1, type, 0, n || '### ' || upper(left(type, 1)) || substr(type, 2)
  || ' files (' || c || ')' || n FROM ranked, nl WHERE rn = 1
UNION ALL SELECT run_id, 1, type, rn, '- `' || file || '`' || n FROM ranked, nl WHERE rn <= 20
UNION ALL SELECT run_id, 1, type, 21, '- ... and ' || (c - 20) || ' more' || n FROM ranked, nl
  WHERE rn = 1 AND c > 20
UNION ALL SELECT run_id, 2, '', 0, n || '## Module Analysis' || n FROM counts, nl
UNION ALL SELECT run_id, 2, module, 1, n || '### ' || module || n || CASE WHEN file_summaries = ''
  THEN '' ELSE n || 'Files:' || n || '- ' || replace(file_summaries, ';', n || '- ') || n END
  || CASE WHEN finding_count > 0 THEN n || 'Findings: ' || finding_count || n ELSE '' END
  FROM summaries, nl
UNION ALL SELECT run_id, 3, '', 0, n || '## Key Findings' || n FROM counts, nl
UNION ALL SELECT run_id, 3, level, 0, n || '### ' || CASE level WHEN 'error' THEN 'Errors' ELSE
  'Warnings' END || ' (' || c || ')' || n FROM serious, nl WHERE rn = 1
UNION ALL SELECT run_id, 3, level, rn, '- **' || rule_id || '** in `' || file || ':' || line
  || '` -- ' || message || n FROM serious, nl WHERE rn <= 20
UNION ALL SELECT run_id, 3, level, 21, '- ... and ' || (c - 20) || ' more' || n FROM serious, nl
  WHERE rn = 1 AND c > 20""")
def analysis_report(spark, sf):
    from repograph.plans.code_report import code_report
    findings, files = views.file_findings(spark, sf), views.code_files(spark, sf)
    targets = findings.select("run_id").distinct().withColumn(
        "target", F.concat(F.lit("/repos/"), "run_id"))
    return code_report(findings, findings.select("run_id", "tool").distinct(), files, targets)


analysis_report_all = query("analysis_report_all", ORACLES["analysis_report"])(analysis_report)    # its name beside one over fewer documents


# --- addresses ---------------------------------------------------------------------------

ADDRESSES = """SELECT page_id, CASE page_id % 8
    WHEN 0 THEN concat('https://github.com/owner', cast(page_id AS string), '/repo.git/')
    WHEN 1 THEN concat('gitlab.example.org/group/sub/repo', cast(page_id AS string))
    WHEN 2 THEN concat('/srv/repos/r', cast(page_id AS string), '.git')
    WHEN 3 THEN concat('C:\\work\\r', cast(page_id AS string))
    WHEN 4 THEN concat('  https://Bitbucket.org:8443/o/r', cast(page_id AS string), ' ')
    WHEN 5 THEN 'nonsense' ELSE url END AS address,
  CASE page_id % 8 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' WHEN 4 THEN 'bitbucket'
    ELSE 'local' END AS repo_type
FROM pages"""


def addresses(spark, sf):
    return views._sql(spark, sf, ADDRESSES.replace("\\", "\\\\"), "pages")


A = f"WITH a AS ({ADDRESSES})"


@query("repository_names", A + """, t AS (SELECT *, rtrim(address, '/') AS trimmed FROM a),
p AS (SELECT *, string_split(trimmed, '/') AS parts FROM t)
SELECT page_id, CASE WHEN repo_type <> 'local' AND len(parts) >= 5
  THEN parts[len(parts) - 1] || '_' ELSE '' END || replace(parts[len(parts)], '.git', '') AS name,
  string_split(address, '/')[-1] AS short_name FROM p""")
def repository_names(spark, sf):
    return addresses(spark, sf).select(
        "page_id", urls.repository_name(c("address"), c("repo_type")).alias("name"),
        urls.short_name(c("address")).alias("short_name"))


@query("url_parts", """SELECT page_id,
  regexp_extract(lower(url), '^[a-z]+://[^/?#]+') AS origin,
  regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1), '/$', '') AS path FROM pages
""")
def url_parts(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", urls.url_origin(c("url")).alias("origin"), urls.url_path(c("url")).alias("path"))


@query("parsed_repositories", A + """, s AS (SELECT *, trim(address) AS t FROM a),
w AS (SELECT *, regexp_replace(regexp_extract(t, '^(?:[a-z]+://)?[^/?#]+/?([^?#]*)', 1), '/$', '')
  AS path FROM s)
SELECT page_id, CASE page_id % 8 WHEN 2 THEN 'local' WHEN 3 THEN 'local'
    ELSE string_split(path, '/')[-2] END AS owner,
  CASE page_id % 8 WHEN 2 THEN 'r' || page_id WHEN 3 THEN 'r' || page_id
    ELSE regexp_replace(string_split(path, '/')[-1], '\\.git$', '') END AS repo,
  CASE page_id % 8 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' WHEN 2 THEN 'local' WHEN 3 THEN 'local'
    WHEN 4 THEN 'bitbucket' ELSE 'web' END AS type,
  CASE WHEN page_id % 8 NOT IN (2, 3) THEN regexp_replace(path, '\\.git$', '') END AS full_path,
  CASE WHEN page_id % 8 IN (2, 3) THEN t END AS local_path FROM w WHERE page_id % 8 <> 5""")
def parsed_repositories(spark, sf):
    return addresses(spark, sf).select(
        "page_id", urls.parse_repository(c("address")).alias("r")).where(
        c("r").isNotNull()).select("page_id", "r.*")


@query("file_links", A + """
SELECT page_id, CASE WHEN page_id % 8 IN (0, 1, 4) THEN trim(address) || CASE page_id % 8
    WHEN 0 THEN '/blob/' WHEN 1 THEN '/-/blob/' ELSE '/src/' END || 'main/a/b.py'
  ELSE 'a/b.py' END AS link,
  CASE WHEN repo_type = 'local' THEN trim(address) WHEN page_id % 16 < 8 THEN trim(address)
    ELSE 'http://example/o/r' END AS repo_url FROM a""".replace(
    "trim(address) || CASE", "CASE page_id % 8 WHEN 1 THEN 'https://' ELSE '' END || trim(address) || CASE"))
def file_links(spark, sf):
    trimmed = F.trim("address")
    web = F.when(c("page_id") % 8 == 1, F.concat(F.lit("https://"), trimmed)).otherwise(trimmed)
    known = F.when(c("page_id") % 16 < 8, trimmed)
    return addresses(spark, sf).select(
        "page_id", urls.file_url(web, c("repo_type"), F.lit("main"), F.lit("a/b.py")).alias("link"),
        urls.repository_url(c("repo_type"), trimmed, known, F.lit("o"), F.lit("r")).alias(
            "repo_url"))


@query("repository_profiles", TOOL_SQL + """,
languages AS (SELECT repo, coalesce(string_agg(language, ',' ORDER BY language), '') AS languages
  FROM pairs GROUP BY repo)
SELECT l.repo, languages, coalesce((SELECT string_agg(DISTINCT path, ',' ORDER BY path) FROM marked m
    WHERE m.repo = l.repo AND path IN ('package.json', 'Cargo.toml')), '') AS frameworks,
  (SELECT string_agg(tool, ',' ORDER BY tool) FROM chosen c WHERE c.repo = l.repo) AS tools
FROM languages l""")
def repository_profiles(spark, sf):
    from repograph.plans.detection import detection
    return detection(marked_files(spark, sf)).select("repo", *[
        F.array_join(x, ",").alias(x) for x in ("languages", "frameworks", "tools")])


@query("duration_labels", f"""WITH r AS ({TOOL_RESULTS})
SELECT run_id, tool, CASE WHEN duration_seconds * 3 < 60 THEN printf('%.1fs', duration_seconds * 3)
  ELSE printf('%.1fm', duration_seconds / 20) END AS label FROM r""")
def duration_labels(spark, sf):
    return views.tool_results(spark, sf).select(
        "run_id", "tool", text.duration_label(c("duration_seconds") * 3).alias("label"))


@query("decoded_lists", V + """
SELECT path, path || '|a b+c|é' AS decoded FROM files_v""")
def decoded_lists(spark, sf):
    encoded = F.concat(F.url_encode("path"), F.lit("\n  \na%20b+c\n\n%C3%A9"))
    return views.files(spark, sf).select(
        "path", F.array_join(text.decode_list_parameter(encoded), "|").alias("decoded"))
