"""Which files of a repository count, and what is known about each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from repograph.functions import paths
from repograph.functions.ignore import compiled_pattern
from repograph.functions.text import lines, token_count
from repograph.operators.once import compute_once
from repograph.operators.skew import salted_join

# Directories and files left out of the corpus by default.
EXCLUDED_DIRS = [
    "./.venv/", "./venv/", "./env/", "./virtualenv/",
    "./node_modules/", "./bower_components/", "./jspm_packages/",
    "./.git/", "./.svn/", "./.hg/", "./.bzr/",
    "./__pycache__/", "./.pytest_cache/", "./.mypy_cache/", "./.ruff_cache/", "./.coverage/",
    "./dist/", "./build/", "./out/", "./target/", "./bin/", "./obj/",
    "./docs/", "./_docs/", "./site-docs/", "./_site/",
    "./.idea/", "./.vscode/", "./.vs/", "./.eclipse/", "./.settings/",
    "./logs/", "./log/", "./tmp/", "./temp/",
]
# File names are compared for equality, so the entries with a star never match a real name;
# they are kept because the list is the documented default.
EXCLUDED_FILES = [
    "yarn.lock", "pnpm-lock.yaml", "npm-shrinkwrap.json", "poetry.lock", "Pipfile.lock",
    "requirements.txt.lock", "Cargo.lock", "composer.lock", ".lock", ".DS_Store", "Thumbs.db",
    "desktop.ini", "*.lnk", ".env", ".env.*", "*.env", "*.cfg", "*.ini", ".flaskenv",
    ".gitignore", ".gitattributes", ".gitmodules", ".github", ".gitlab-ci.yml", ".prettierrc",
    ".eslintrc", ".eslintignore", ".stylelintrc", ".editorconfig", ".jshintrc", ".pylintrc",
    ".flake8", "mypy.ini", "pyproject.toml", "tsconfig.json", "webpack.config.js",
    "babel.config.js", "rollup.config.js", "jest.config.js", "karma.conf.js", "vite.config.js",
    "next.config.js", "*.min.js", "*.min.css", "*.bundle.js", "*.bundle.css", "*.map", "*.gz",
    "*.zip", "*.tar", "*.tgz", "*.rar", "*.7z", "*.iso", "*.dmg", "*.img", "*.msix", "*.appx",
    "*.appxbundle", "*.xap", "*.ipa", "*.deb", "*.rpm", "*.msi", "*.exe", "*.dll", "*.so",
    "*.dylib", "*.o", "*.obj", "*.jar", "*.war", "*.ear", "*.jsm", "*.class", "*.pyc", "*.pyd",
    "*.pyo", "__pycache__", "*.a", "*.lib", "*.lo", "*.la", "*.slo", "*.dSYM", "*.egg",
    "*.egg-info", "*.dist-info", "*.eggs", "node_modules", "bower_components", "jspm_packages",
    "lib-cov", "coverage", "htmlcov", ".nyc_output", ".tox", "dist", "build", "bld", "out",
    "bin", "target", "packages/*/dist", "packages/*/build", ".output",
]
# Directories and extensions a directory scan skips.
SKIPPED_DIRS = [".git", ".svn", ".hg", "__pycache__", "node_modules", ".venv", "venv", ".tox",
                ".eggs", "dist", "build"]
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".woff", ".woff2", ".ttf", ".eot",
    ".otf", ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar", ".exe", ".dll", ".so", ".dylib", ".o",
    ".obj", ".pyc", ".pyo", ".class", ".jar", ".war", ".pdf", ".doc", ".docx", ".xls", ".xlsx",
    ".mp3", ".mp4", ".wav", ".avi", ".mov", ".sqlite", ".db", ".pkl",
]
# Usual limits, in tokens, of files that are still embedded.
MAX_CODE_TOKENS = 81_920
MAX_TEXT_TOKENS = 8_192


def clean_directory(name: str) -> str:
    """Directory entry without dots and slashes at its ends (`./.venv/` becomes `venv`)."""
    return name.strip("./").rstrip("/")


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def included(path: Column, dirs: list[str] | None, files: list[str] | None) -> Column:
    """A path component equals a listed directory, or the name ends with a listed file."""
    parts = paths.path_parts(path)
    in_dir = F.arrays_overlap(parts, _words(sorted({clean_directory(d) for d in dirs or []})))
    return in_dir | paths.ends_with_any(paths.file_name(path), sorted(set(files or [])))


def excluded(path: Column, dirs: list[str] | None, files: list[str] | None) -> Column:
    """A path component equals a listed directory, or the name equals a listed file."""
    parts = paths.path_parts(path)
    all_dirs = sorted({clean_directory(d) for d in [*EXCLUDED_DIRS, *(dirs or [])]})
    all_files = sorted({*EXCLUDED_FILES, *(files or [])})
    return F.arrays_overlap(parts, _words(all_dirs)) | paths.file_name(path).isin(*all_files)


def select_files(files: DataFrame, included_dirs=None, included_files=None, excluded_dirs=None,
                 excluded_files=None) -> DataFrame:
    """Include mode when any include list is given, otherwise exclude mode over the defaults."""
    path = F.col("path")
    if included_dirs or included_files:
        return files.where(included(path, included_dirs, included_files))
    return files.where(~excluded(path, excluded_dirs, excluded_files))


def _told(files: DataFrame, count) -> DataFrame:
    path = F.col("path")
    known = files.where(paths.corpus_type(path).isNotNull() & F.col("content").isNotNull())
    return known.withColumns({
        "type": F.substr(paths.corpus_type(path), F.lit(2)), "is_code": paths.is_code(path),
        "is_implementation": paths.is_implementation(path), "title": path,
        "token_count": count(F.col("content"))})


def _within(max_code_tokens: int | None, max_text_tokens: int | None) -> Column:
    limit = F.when(F.col("is_code"), F.lit(max_code_tokens)).otherwise(F.lit(max_text_tokens))
    return limit.isNull() | (F.col("token_count") <= limit)


def documents(files: DataFrame, count=token_count, max_code_tokens: int | None = None,
              max_text_tokens: int | None = None) -> DataFrame:
    """Corpus files with metadata, of any size unless limits in tokens are given.

    `count` is a column function from text to tokens. `oversized` returns what limits leave out.
    """
    return _told(files, count).where(_within(max_code_tokens, max_text_tokens))


def oversized(files: DataFrame, count=token_count, max_code_tokens: int | None = None,
              max_text_tokens: int | None = None) -> DataFrame:
    """Files that `documents` leaves out under the same limits, with the reason."""
    return (_told(files, count).where(~_within(max_code_tokens, max_text_tokens)).drop("content")
            .withColumn("reason", F.lit("more tokens than the limit of its kind")))


def scannable(files: DataFrame, extra_dirs: list[str] | None = None) -> DataFrame:
    """Files outside hidden and skipped directories that are neither hidden nor binary."""
    parts = paths.path_parts(F.col("path"))
    skip = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))),
                    lambda d: d.startswith(".") | d.isin(*SKIPPED_DIRS, *(extra_dirs or [])))
    hidden = paths.file_name(F.col("path")).startswith(".")
    return files.where(~skip & ~hidden & ~paths.extension(F.col("path")).isin(*BINARY_EXTENSIONS))


def ignore_rules(ignore_files: DataFrame) -> DataFrame:
    """Compiled patterns of each ignore file `(repo, dir, content)`; the root's `dir` is empty."""
    patterns = ignore_files.select("repo", "dir", F.posexplode(lines(F.col("content"))).alias(
        "n", "line")).withColumn("p", compiled_pattern.asNondeterministic()("line"))
    # One file's patterns make one array, kept in file order.
    return patterns.where(F.col("p.regex").isNotNull()).groupBy("repo", "dir").agg(
        F.array_sort(F.collect_list(F.struct("n", "p.regex", "p.negated"))).alias("patterns"))


def ignored_files(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files matched by an ignore file of any directory above them.

    The last matching pattern decides. A file is also ignored when a directory between the
    ignore file and itself is, which no later pattern can undo.
    """
    parts = F.split("path", "/")
    depth = F.size(parts)
    above = F.transform(F.sequence(F.lit(0), depth - 1), lambda i: F.struct(
        F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir"),
        F.transform(F.sequence(i + 1, depth), lambda j: F.concat(
            F.array_join(F.slice(parts, i + 1, j - i), "/"),
            F.when(j < depth, "/").otherwise(""))).alias("targets")))
    asked = compute_once(files.select("repo", "path"), "above", above).select(
        "repo", "path", F.explode("above").alias("a")).select(
        "repo", "path", "a.dir", "a.targets")
    decide = lambda t: F.aggregate("patterns", F.lit(False), lambda hit, p: F.when(
        F.regexp_like(t, p["regex"]), ~p["negated"]).otherwise(hit))
    # All files of a repository ask its root directory.
    return salted_join(asked, rules, ["repo", "dir"], ["path"]).where(F.exists("targets", decide)).select(
        "repo", "path").distinct()


def respect_ignore_files(files: DataFrame, ignore_files: DataFrame) -> DataFrame:
    return files.join(ignored_files(files, ignore_rules(ignore_files)), ["repo", "path"],
                      "left_anti")


def tree_listing(files: DataFrame) -> DataFrame:
    """Paths shown in a repository's file tree, sorted. One row per path: trees can be large."""
    parts = paths.path_parts(F.col("path"))
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    hidden_dir = F.exists(dirs, lambda d: d.startswith(".") | d.isin("__pycache__", "node_modules"))
    name = paths.file_name(F.col("path"))
    return files.where(~hidden_dir & ~name.startswith(".") & (name != "__init__.py")).select(
        "repo", "path").orderBy("repo", "path")


def readme(files: DataFrame) -> DataFrame:
    """The README of each repository: the one with the lowest path."""
    mine = files.where(F.lower(paths.file_name(F.col("path"))) == "readme.md")
    shown = mine.join(tree_listing(mine), ["repo", "path"], "left_semi")
    return shown.groupBy("repo").agg(F.min_by("content", "path").alias("readme"))
