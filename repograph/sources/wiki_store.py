"""Stored wikis, and the catalogue of processed projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from repograph.operators.chat import DEFAULT_LANGUAGE, LANGUAGES

KEYS = ["repo_type", "owner", "repo", "language"]


def supported_language(code: Column) -> Column:
    """The language when it is supported, otherwise the default."""
    return F.when(code.isin(*LANGUAGES), code).otherwise(DEFAULT_LANGUAGE)


def save_wikis(pages: DataFrame, path: str) -> None:
    """Replace the stored wikis at hand and leave all others alone.

    Pages carry KEYS. Rows of one wiki are spread over tasks by page id.
    """
    keyed = pages.withColumn("language", supported_language(F.col("language"))).withColumn(
        "_part", F.pmod(F.xxhash64("id"), F.lit(16)))
    keyed.repartition(*KEYS, "_part").drop("_part").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)


def read_wikis(spark: SparkSession, path: str) -> DataFrame:
    """Pages of all stored wikis."""
    stored = spark.read.option("basePath", path).parquet(path)
    return stored.withColumns({k: F.col(k).cast("string") for k in KEYS})


def read_wiki(spark: SparkSession, path: str, repo_type: str, owner: str, repo: str,
              language: str) -> DataFrame:
    """Pages of one wiki; only its partition is scanned. Empty when it is not stored."""
    asked = language if language in LANGUAGES else DEFAULT_LANGUAGE
    return read_wikis(spark, path).where((F.col("repo_type") == repo_type) & (F.col("owner") == owner)
                       & (F.col("repo") == repo) & (F.col("language") == asked))


def delete_wiki(spark: SparkSession, path: str, repo_type: str, owner: str, repo: str,
                language: str) -> None:
    """Remove one stored wiki. An unsupported language or an unknown wiki is an error."""
    if language not in LANGUAGES:
        raise ValueError(f"language {language!r} is not supported")
    folder = "/".join([path.rstrip("/"), *(
        f"{k}={v}" for k, v in zip(KEYS, (repo_type, owner, repo, language)))])
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        raise LookupError(f"no stored wiki {repo_type}/{owner}/{repo} ({language})")
    files.delete(target, True)


def parse_projects(files: DataFrame, prefix: str = "wiki_cache_") -> DataFrame:
    """Projects named by files `(file_name, modified)`: `<prefix><type>_<owner>_<repo>_<language>.json`.

    The repository part may contain underscores. Newest first.
    """
    name = F.col("file_name")
    bare = F.replace(F.replace(name, F.lit(prefix), F.lit("")), F.lit(".json"), F.lit(""))
    parts = F.split(bare, "_")
    repo = F.array_join(F.slice(parts, F.lit(3), F.size(parts) - 3), "_")
    named = files.where(name.startswith(prefix) & name.endswith(".json")).where(F.size(parts) >= 4)
    return named.select(
        name.alias("id"), F.get(parts, F.lit(1)).alias("owner"), repo.alias("repo"),
        F.concat(F.get(parts, F.lit(1)), F.lit("/"), repo).alias("name"),
        F.get(parts, F.lit(0)).alias("repo_type"),
        F.unix_millis("modified").alias("submitted_at"),
        F.element_at(parts, -1).alias("language")).orderBy(F.desc("submitted_at"), "id")


def list_projects(spark: SparkSession, root: str, prefix: str = "wiki_cache_") -> DataFrame:
    """Projects by the files of a folder; file contents are not read."""
    files = spark.read.format("binaryFile").load(root).select(
        F.col("_metadata.file_name").alias("file_name"),
        F.col("modificationTime").alias("modified"))
    return parse_projects(files, prefix)


def search_projects(projects: DataFrame, text: str = "", limit: int | None = None) -> DataFrame:
    """Projects with the text in name, owner, repository or type, ignoring case."""
    found = projects
    if text.strip():
        hit = F.lit(False)
        for c in ("name", "owner", "repo", "repo_type"):
            hit = hit | F.lower(c).contains(text.lower())
        found = projects.where(hit)
    found = found.orderBy(F.desc("submitted_at"), "id")
    return found.limit(limit) if limit else found
