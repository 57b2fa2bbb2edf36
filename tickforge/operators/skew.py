"""Totals per key that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def balanced_totals(df: DataFrame, keys: list[str], **states: Column) -> DataFrame:
    """Per-key results by map-side combining.

    ``states`` are algebraic aggregates (count, sum, min, max, min_by, ...). Each map task folds its rows into a
    bounded hash table of key states (Spark's partial HashAggregate, which falls back to sort-based spilling when the
    table is full), so one task ships one state per key however many rows the key has: a key with a third of all
    rows costs the reducer one state per map task. Null keys form a group of their own; an empty table gives no rows.
    """
    return df.groupBy(*keys).agg(*[c.alias(name) for name, c in states.items()])


def heavy_keys(df: DataFrame, source: str, key: str, share: float) -> DataFrame:
    """Keys holding at least ``share`` of all rows of their ``source``, as (source, key, n_rows).

    All rows count towards the whole, those with a null key too; a null key itself is never listed, nor is a null
    source. The totals are sums of the compact per-key states, and both sides of the join share one exchange of these, so
    the rows are read and shuffled once.
    """
    per_key = balanced_totals(df, [source, key], n_rows=F.count(F.lit(1)))
    totals = per_key.groupBy(F.col(source).alias("__source")).agg(F.sum("n_rows").alias("__total"))
    # one condition on both, as a filter on the key alone would be pushed into one side and the rows read twice
    heavy = F.when(F.col("n_rows") >= F.lit(share) * F.col("__total"), F.col(key).isNotNull()).otherwise(F.lit(False))
    return per_key.join(totals, F.col(source) == F.col("__source")).where(heavy).select(source, key, "n_rows")
