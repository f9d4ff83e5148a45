"""A join to a lookup in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def join_counted(rows: DataFrame, lookup: DataFrame, keys: list[str], count: str, total: int,
                 how: str = "left", share: float = 0.001) -> DataFrame:
    """Join rows to a lookup that has one entry per key and the key's number of rows in `count`.

    Keys that hold at least `share` of the `total` rows are fewer than 1/share, whatever the size
    of the tables; their entries are broadcast and their rows stay where they are. All other keys
    meet in a shuffle, in which no key is larger than `share`. `how` is left or inner. Null keys
    match nothing.
    """
    least = max(1.0, share * total)
    hot = lookup.filter(F.col(count) >= F.lit(least))
    cold = lookup.filter(F.col(count) < F.lit(least))
    marked = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    in_hot = marked.filter("_hot").drop("_hot").join(F.broadcast(hot), keys, "inner")
    in_cold = marked.filter("_hot IS NULL").drop("_hot").join(cold, keys, how)
    return in_hot.unionByName(in_cold)
