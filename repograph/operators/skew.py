"""Joins in which one key may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def salted_join(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: list[str],
                how: str = "inner", salts: int = 16) -> DataFrame:
    """Join rows to a lookup that has one slim entry per key, spreading each key over salts.

    Every entry of the lookup is repeated per salt and every row picks one by its `spread`
    columns, so a key's rows meet the lookup in `salts` tasks. Spark's own skew handling only
    splits a side that comes straight from a shuffle, which an aggregated lookup does not.
    The copies are broadcast only if all of them are small: they come from a cross join, whose size
    Spark estimates too high, not from an explode, of which it counts an entry once; and they are
    shuffled before the join, which tells their real size.
    `how` is inner, left, left_semi or left_anti.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    every = rows.sparkSession.range(0, salts, 1, 1).select(F.col("id").cast("int").alias("_salt"))
    copies = lookup.crossJoin(F.broadcast(every)).repartition(*keys, "_salt")
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def split_join(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner",
               share: float = 0.001) -> DataFrame:
    """Join rows to a lookup that has one entry per key, however many rows a key has.

    The rows of each key are counted first. Keys that hold at least `share` of all rows are fewer
    than 1/share in tables of any size: their entries are broadcast and their rows meet them where
    they are. The other keys, each small, meet in a shuffle. Rows that need nothing from the shuffle,
    those of hot keys and of null ones, pass through it spread evenly. `rows` is read twice.
    `how` is inner, left, left_semi or left_anti; null keys match nothing.
    """
    values = [c for c in lookup.columns if c not in keys]
    entry = F.struct(F.lit(True).alias("found"), *values).alias("_entry")
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot_keys = rows.sparkSession.sql(
        "SELECT * FROM {counts} WHERE _n >= greatest(1000, {share} * (SELECT sum(_n) FROM {counts}))",
        counts=counts, share=share).drop("_n")
    entries = lookup.select(*keys, entry)
    hot_entries = entries.join(F.broadcast(hot_keys), keys, "left_semi")
    hot = hot_keys.join(F.broadcast(hot_entries), keys, "left").select(
        *keys, F.lit(True).alias("_hot"), F.col("_entry").alias("_hot_entry"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    settled = F.coalesce("_hot", F.lit(False))
    for k in keys:
        settled = settled | F.col(k).isNull()
    spread = F.when(settled, F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16)) + 1)
    # Always 0. A literal would be taken out of the join's keys, and the spread with it.
    zero = F.pmod(F.xxhash64(*keys), F.lit(1).cast("bigint"))
    joined = marked.withColumn("_slot", F.coalesce(spread, F.lit(0))).join(
        entries.withColumn("_slot", zero), [*keys, "_slot"], "left").withColumn(
        "_entry", F.when(F.col("_hot"), F.col("_hot_entry")).otherwise(F.col("_entry")))
    found = F.col("_entry.found")
    if how in ("inner", "left_semi"):
        joined = joined.where(found)
    elif how == "left_anti":
        joined = joined.where(found.isNull())
    kept = [F.col(f"`{c}`") for c in rows.columns]
    if how in ("inner", "left"):
        kept += [F.col(f"_entry.`{v}`").alias(v) for v in values]
    return joined.select(*kept)
