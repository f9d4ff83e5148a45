"""Keep costly expressions from being evaluated more than once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters read instead of recomputing.

    A filter on a projected column is pushed below the projection with the column's expression
    in it, and a generator over it gets an inferred filter: a parse step would run again for
    each mention. Neither passes a generator's output, so the value comes from a generator of
    one row.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))
