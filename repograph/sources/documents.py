"""Write long documents that live as ordered text fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_documents(fragments: DataFrame, path: str, key: str, order: list[str],
                    text: str = "text") -> None:
    """Write each document as one or more part files whose concatenation is its text.

    Rows are range-partitioned on (key, order): a large document spreads over several tasks and
    its part files sort in document order. Every fragment ends its line in the file; the Markdown
    fragments do so anyway, and between JSON fragments a line end has no meaning.
    """
    placed = fragments.repartitionByRange(F.col(key), *[F.col(c) for c in order])
    rows = placed.sortWithinPartitions(key, *order).select(
        key, F.regexp_replace(text, r"\n\z", "").alias("value"))
    rows.write.mode("overwrite").partitionBy(key).text(path)


def read_document(spark: SparkSession, path: str, key: str, value: str) -> str:
    """Text of one stored document. Brings it to the driver: for documents of modest size."""
    parts = spark.read.text(f"{path}/{key}={value}", wholetext=True).select(
        "value", F.col("_metadata.file_name").alias("file"))
    # Task numbers are padded to five digits; longer names belong to later tasks.
    return "".join(r.value for r in parts.orderBy(F.length("file"), "file").toLocalIterator())
