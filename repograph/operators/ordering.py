"""Order-dependent building blocks that keep hot groups out of single tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from repograph.stage import staged


def first_n(df: DataFrame, keys: list[str], order: list, n: int, rank: str | None = None) -> DataFrame:
    """First n rows of each group.

    Spark prunes each input partition to n rows per group before the shuffle
    (WindowGroupLimit) for n up to `spark.sql.optimizer.windowGroupLimitThreshold`, so a
    hot group sends at most n rows per task. Use `first_n_salted` above that threshold.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def first_n_salted(df: DataFrame, keys: list[str], order: list, n: int, spread: Column,
                   salts: int = 64) -> DataFrame:
    """First n rows of each group for large n: a pass per salt, then one over the survivors."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    local = first_n(salted, keys + ["_salt"], order, n).drop("_salt")
    return first_n(local, keys, order, n)


def running_totals(counts: DataFrame, group: list[str], order: list[str], n: str,
                   name: str = "before") -> DataFrame:
    """Add to each row the sum of `n` over the rows before it in its group.

    (group, order) is unique. The rows are range-partitioned on it, so that a group of any size is
    spread. A first pass sums within each partition; a second one sums the partitions' totals, of
    which a group has one per partition it touches. No task holds more than a partition of rows or
    one total per partition.
    """
    ranged = counts.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    # The number holds the partition and the place in it. Written, since another run of the range
    # partitioning may draw other bounds.
    placed = staged(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    keys = [*group, "_part"]
    placed = placed.withColumn("_part", part)
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys).agg(F.sum(n).alias("_total")).select(
        *keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    # The window and the join share their keys: the rows are shuffled once.
    summed = placed.withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return summed.join(totals, keys).select(
        *counts.columns, (F.col("_earlier") + F.col("_inside")).cast("bigint").alias(name))


def dense_index(df: DataFrame, group: list[str], major: list[str], minor: str, name: str = "index",
                block_rows: int = 4096) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... in (major, minor) order.

    `minor` is an integer unique within (group, major); no key is null. Rows fall into blocks of at
    most `block_rows` consecutive minor values, so no task sorts a whole group. Where a block
    begins is a running total of the blocks' counts, which with sparse minor values are as many as
    the rows; see `running_totals`. `df` is read twice, once for the counts.
    """
    blocked = df.withColumn("_block", F.floor(F.col(minor) / block_rows).cast("bigint"))
    keys = [*group, *major, "_block"]
    offsets = running_totals(blocked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")),
                             group, [*major, "_block"], "_n", "_offset").drop("_n")
    rows = blocked.withColumn(
        "_row", F.row_number().over(Window.partitionBy(*keys).orderBy(minor)) - 1)
    # The window above and this join share their keys: the rows are shuffled once.
    return rows.join(offsets, keys).select(
        *df.columns, (F.col("_offset") + F.col("_row")).cast("bigint").alias(name))


def ordered_text(parts: Column, separator: str) -> Column:
    """Join collected `struct(order..., text)` entries in order."""
    return F.array_join(F.transform(F.array_sort(parts), lambda p: p["text"]), separator)
