"""File paths: classification, directories, metadata."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Suffix classes of analysed files.
CONFIG_SUFFIXES = (".json", ".yaml", ".yml", ".toml", ".ini", ".cfg")
DOC_SUFFIXES = (".md", ".rst", ".txt")
# File types read into the corpus.
CODE_TYPES = (".py", ".js", ".ts", ".java", ".cpp", ".c", ".h", ".hpp", ".go", ".rs", ".jsx",
              ".tsx", ".html", ".css", ".php", ".swift", ".cs")
TEXT_TYPES = (".md", ".txt", ".rst", ".json", ".yaml", ".yml")
# Highlighting language of a file extension.
HIGHLIGHT = {
    "py": "python", "js": "javascript", "ts": "typescript", "tsx": "tsx", "jsx": "jsx",
    "go": "go", "rs": "rust", "java": "java", "rb": "ruby", "php": "php", "c": "c",
    "cpp": "cpp", "h": "c", "yml": "yaml", "yaml": "yaml", "json": "json", "toml": "toml",
    "sh": "bash", "bash": "bash",
}


def ends_with_any(c: Column, suffixes) -> Column:
    test = F.lit(False)
    for s in suffixes:
        test = test | c.endswith(s)
    return test


def classify_file(path: Column) -> Column:
    """test, config, docs or source; any `test` or `spec` in the path makes it a test."""
    low = F.lower(path)
    return (F.when(low.contains("test") | low.contains("spec"), "test")
            .when(ends_with_any(low, CONFIG_SUFFIXES), "config")
            .when(ends_with_any(low, DOC_SUFFIXES), "docs")
            .otherwise("source"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """Directory part, `(root)` when there is none."""
    d = F.regexp_extract(path, r"(?s)\A(.*?)/*[^/]*\z", 1)
    d = F.when(path.contains("/") & (d == "") & path.startswith("/"), F.lit("/")).otherwise(d)
    return F.coalesce(F.nullif(d, F.lit("")), F.lit("(root)"))


def path_parts(path: Column) -> Column:
    """Path components after removing empty and `.` parts."""
    return F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))


def extension(path: Column) -> Column:
    """Lower-case extension of the file name, empty for dot files and bare names."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)[^.].*?(\.[^.]+)\z", 1))


def highlight_language(path: Column) -> Column:
    """Highlighting language by the text after the last dot of the whole path."""
    pairs = [F.lit(x) for kv in HIGHLIGHT.items() for x in kv]
    ext = F.element_at(F.split(path, r"\."), -1)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), ext), F.lit("text"))


def corpus_type(path: Column) -> Column:
    """Suffix of a corpus file, null for files that are not read."""
    ext = F.regexp_extract(path, r"(\.[^./]+)\z", 1)
    return F.when(ext.isin(*CODE_TYPES, *TEXT_TYPES), ext)


def is_code(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)\z", 1).isin(*CODE_TYPES)


def is_implementation(path: Column) -> Column:
    """Code that is not a test; only the start of the whole path counts as a prefix."""
    return (is_code(path) & ~path.startswith("test_") & ~path.startswith("app_")
            & ~F.lower(path).contains("test"))
