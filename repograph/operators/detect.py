"""Languages and frameworks of a repository, and the tools that fit them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from repograph.functions import paths

# Language of a file extension.
EXTENSIONS = {
    ".py": "python", ".pyi": "python", ".pyx": "python",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala",
    ".go": "go", ".rs": "rust",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cxx": "cpp",
    ".hh": "cpp", ".hxx": "cpp",
    ".rb": "ruby", ".erb": "ruby", ".php": "php", ".cs": "csharp", ".swift": "swift",
    ".sol": "solidity",
    ".tex": "latex", ".sty": "latex", ".cls": "latex", ".bib": "latex",
    ".tf": "terraform", ".hcl": "terraform", ".yaml": "yaml", ".yml": "yaml", ".json": "json",
    ".toml": "toml", ".sh": "shell", ".bash": "shell", ".zsh": "shell",
}
# Language of an exact file name.
FILE_NAMES = {
    "Dockerfile": "docker", "docker-compose.yml": "docker", "docker-compose.yaml": "docker",
    "Containerfile": "docker", "Makefile": "make", "CMakeLists.txt": "cpp", ".bashrc": "shell",
    ".zshrc": "shell", ".profile": "shell", ".bash_profile": "shell",
}
# Language a marker file at the root stands for.
MARKERS = {
    "package.json": "javascript", "package-lock.json": "javascript", "yarn.lock": "javascript",
    "pnpm-lock.yaml": "javascript",
    "requirements.txt": "python", "pyproject.toml": "python", "setup.py": "python",
    "setup.cfg": "python", "Pipfile": "python", "poetry.lock": "python",
    "go.mod": "go", "go.sum": "go", "Cargo.toml": "rust", "Cargo.lock": "rust",
    "Gemfile": "ruby", "Gemfile.lock": "ruby", "composer.json": "php", "composer.lock": "php",
    "pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "java",
    "settings.gradle": "java", "settings.gradle.kts": "java", "tsconfig.json": "typescript",
    "hardhat.config.js": "solidity", "hardhat.config.ts": "solidity",
    "foundry.toml": "solidity", "brownie-config.yaml": "solidity",
}
# Directories never searched for languages.
SKIPPED_DIRS = [".git", "node_modules", "__pycache__", ".tox", ".mypy_cache", ".ruff_cache",
                "venv", ".venv", "vendor", "dist", "build", ".next", ".nuxt"]
# Tools that fit a language, and tools that always fit.
LANGUAGE_TOOLS = {
    "python": ["semgrep", "bandit", "ruff", "pyright", "lizard", "detect-secrets", "trivy",
               "checkov"],
    "javascript": ["semgrep", "eslint", "lizard", "detect-secrets", "trivy"],
    "typescript": ["semgrep", "eslint", "lizard", "detect-secrets", "trivy"],
    "java": ["semgrep", "pmd", "pmd-cpd", "lizard", "detect-secrets", "trivy",
             "owasp-dependency-check"],
    "go": ["semgrep", "gosec", "lizard", "detect-secrets", "trivy"],
    "c": ["semgrep", "cppcheck", "clang-sa", "lizard", "detect-secrets"],
    "cpp": ["semgrep", "cppcheck", "clang-sa", "lizard", "detect-secrets"],
    "ruby": ["semgrep", "brakeman", "lizard", "detect-secrets", "trivy"],
    "php": ["semgrep", "phpcs", "deptrac", "lizard", "detect-secrets"],
    "rust": ["semgrep", "clippy", "cargo-audit", "cargo-deny", "cargo-udeps", "lizard",
             "detect-secrets", "trivy"],
    "csharp": ["semgrep", "lizard", "detect-secrets"],
    "solidity": ["slither", "detect-secrets"],
    "terraform": ["checkov", "kics", "trivy"],
    "docker": ["hadolint", "checkov", "trivy", "kics"],
    "yaml": ["checkov", "kics"], "latex": ["chktex", "lacheck"], "toml": ["taplo"],
    "shell": ["shellcheck", "detect-secrets"],
}
UNIVERSAL_TOOLS = ["trufflehog", "horusec"]
# The tool registry (name, category, languages, prints SARIF, optional, timeout).
TOOLS = [
    ("semgrep", "security", "*", True, False, 600),
    ("bandit", "security", "python", True, False, 600),
    ("gosec", "security", "go", True, False, 300),
    ("trivy", "security", "*", True, False, 600),
    ("dependency-check", "security", "java javascript python ruby php", True, True, 900),
    ("brakeman", "security", "ruby", True, True, 300),
    ("phpcs", "security", "php", False, True, 300),
    ("horusec", "security", "*", False, False, 900),
    ("cargo-audit", "security", "rust", False, False, 120),
    ("cargo-deny", "security", "rust", False, False, 300),
    ("ruff", "quality", "python", True, False, 300),
    ("eslint", "quality", "javascript typescript", True, False, 300),
    ("pyright", "quality", "python", False, False, 300),
    ("cppcheck", "quality", "c cpp", True, False, 900),
    ("clang-analyzer", "quality", "c cpp", False, True, 300),
    ("pmd", "quality", "java", True, True, 300),
    ("clippy", "quality", "rust", False, False, 600),
    ("cargo-udeps", "quality", "rust", False, False, 600),
    ("chktex", "quality", "latex", False, False, 120),
    ("lacheck", "quality", "latex", False, False, 120),
    ("taplo", "quality", "toml", False, False, 120),
    ("hadolint", "quality", "docker", True, False, 60),
    ("shellcheck", "quality", "shell", False, False, 120),
    ("pmd-cpd", "complexity", "java python javascript typescript cpp c", False, True, 300),
    ("deptrac", "complexity", "php", False, True, 300),
    ("lizard", "complexity", "*", False, False, 300),
    ("checkov", "secrets", "terraform yaml json docker", True, False, 900),
    ("kics", "secrets", "terraform yaml json docker", True, False, 600),
    ("slither", "secrets", "solidity", True, True, 300),
    ("trufflehog", "secrets", "*", False, False, 600),
    ("detect-secrets", "secrets", "*", False, False, 300),
    ("ggshield", "secrets", "*", False, False, 300),
]


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def file_language(path: Column) -> Column:
    """Language by exact file name, else by extension. The tables are literals: no join."""
    return F.coalesce(_lookup(FILE_NAMES, paths.file_name(path)),
                      _lookup(EXTENSIONS, paths.extension(path)))


def detected_languages(files: DataFrame) -> DataFrame:
    """Languages of each repository from root markers and from all files outside skipped dirs.

    Distinct pairs first: the sets then hold at most one entry per known language.
    """
    path = F.col("path")
    marker = F.when(~path.contains("/"), _lookup(MARKERS, path))
    skipped = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in SKIPPED_DIRS]))
    found = F.array_compact(F.array(marker, F.when(~skipped, file_language(path))))
    pairs = files.select("repo", F.explode(found).alias("language")).distinct()
    some = pairs.groupBy("repo").agg(F.array_sort(F.collect_set("language")).alias("languages"))
    repos = files.select("repo").distinct()
    return repos.join(some, "repo", "left").select("repo", F.coalesce(
        "languages", F.array().cast("array<string>")).alias("languages"))


def detected_frameworks(files: DataFrame) -> DataFrame:
    """Marker files present at the root of each repository."""
    markers = files.where(F.col("path").isin(*MARKERS)).groupBy("repo").agg(
        F.array_sort(F.collect_set("path")).alias("frameworks"))
    return markers


def select_tools(languages: DataFrame) -> DataFrame:
    """Tools for `(repo, languages [, requested_languages] [, requested_tools])`.

    Requested languages replace the detected ones; requested tools replace the selection.
    """
    have = languages.columns
    asked = lambda name: (F.when(F.size(name) > 0, F.col(name)) if name in have
                          else F.lit(None).cast("array<string>"))
    chosen = F.coalesce(asked("requested_languages"), F.col("languages"))
    table = F.create_map(*[x for lang, tools in LANGUAGE_TOOLS.items() for x in (
        F.lit(lang), F.array(*[F.lit(t) for t in tools]))])
    per_language = F.transform(chosen, lambda lang: F.coalesce(
        F.try_element_at(table, F.lower(lang)), F.array().cast("array<string>")))
    every = F.flatten(F.array_append(per_language, F.array(*[F.lit(t) for t in UNIVERSAL_TOOLS])))
    auto = F.array_sort(F.array_distinct(every))
    return languages.select("repo", F.coalesce(asked("requested_tools"), auto).alias("tools"))


def tool_registry(spark: SparkSession) -> DataFrame:
    """The known tools as a table."""
    rows = [(i, n, c, langs.split(), native, optional, timeout)
            for i, (n, c, langs, native, optional, timeout) in enumerate(TOOLS)]
    return spark.createDataFrame(rows, "tool_no int, name string, category string, languages "
                                       "array<string>, sarif_native boolean, optional boolean, "
                                       "timeout int")


def tools_by_name(registry: DataFrame, name: str) -> DataFrame:
    return registry.where(F.col("name") == name)


def tools_by_category(registry: DataFrame, category: str) -> DataFrame:
    return registry.where(F.col("category") == category)


def tools_for_languages(registry: DataFrame, languages: Column) -> DataFrame:
    """Tools that fit any of the languages; a star fits all."""
    return registry.where(F.array_contains("languages", "*")
                          | F.arrays_overlap("languages", languages))


def tools_per_language(languages: DataFrame, registry: DataFrame) -> DataFrame:
    """Tools `(repo, name)` that fit any language of `(repo, languages)`; a star fits all.

    The languages of both sides meet as keys, so no repository is compared with every tool.
    """
    fits = registry.select("name", F.explode("languages").alias("language"))
    own = languages.select("repo", F.explode(F.array_append("languages", F.lit("*"))).alias("language"))
    return own.join(F.broadcast(fits), "language").select("repo", "name").distinct()


def registered_tools(selected: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Selected tools with their definitions, and the selected names nobody defined."""
    names = selected.select("repo", F.explode("tools").alias("name"))
    return names.join(registry, "name"), names.join(registry, "name", "left_anti")
