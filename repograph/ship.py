"""Make packages importable in Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship_packages(spark: SparkSession, *folders: str) -> None:
    """Send package folders to the workers, once per Spark context.

    Needed when the packages are neither installed nor passed with `--py-files`.
    """
    context = spark.sparkContext
    sent = getattr(context, "_shipped_packages", set())
    missing = [f for f in folders if f not in sent]
    if not missing:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="packages-"), f"packages_{len(sent)}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder in missing:
            parent = os.path.dirname(folder)
            for where, _, names in os.walk(folder):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(where, name)
                        out.write(path, os.path.relpath(path, parent))
    context.addPyFile(archive)
    context._shipped_packages = sent | set(missing)
