"""Exact medians per key from value counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_medians(counts: DataFrame, keys: list[str], value: str, n: str, name: str = "median") -> DataFrame:
    """(keys, ``name``): the median of each key's values; of an even number, the mean of the middle two.

    ``counts`` holds finite values with their counts, in any number of partial rows. Two steps, so that no task sorts
    all values of one key: logarithmic bins of 1/32 octave are counted and cumulated first (at most some thousands per
    key), then only the values of the one or two bins that hold the middle ranks. Rows with a null value or a count of 0
    or less don't count; a key without values has no row.
    """
    usable = counts.where(F.col(value).isNotNull() & (F.col(n) > 0))
    size = F.floor(F.log2(F.greatest(F.abs(F.col(value)), F.lit(1e-300))) * 32)
    binned = usable.withColumn("__bin", F.when(F.col(value) == 0, F.lit(0.0)).otherwise(F.signum(F.col(value)) * (size + 40_000)))
    bins = binned.groupBy(*keys, "__bin").agg(F.sum(n).alias("__n"))
    up = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = bins.withColumns({"__to": F.sum("__n").over(up), "__all": F.sum("__n").over(Window.partitionBy(*keys))})
    low, high = F.expr("(__all - 1) div 2"), F.expr("__all div 2")
    middle = ranked.where((F.col("__to") > low) & (F.col("__to") - F.col("__n") <= high)).select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__bin").alias("__b"), (F.col("__to") - F.col("__n")).alias("__before"), "__all"
    )
    same = F.col("__bin") == F.col("__b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    values = binned.join(middle, same).groupBy(*keys, "__before", "__all", F.col(value).alias("__v")).agg(F.sum(n).alias("__n"))
    # rows of one key lie in at most two bins, so this window is as small as they are
    inner = Window.partitionBy(*keys, "__before").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    placed = values.withColumn("__to", F.col("__before") + F.sum("__n").over(inner))
    hits = lambda rank: F.max(F.when((F.col("__to") > rank) & (F.col("__to") - F.col("__n") <= rank), F.col("__v")))
    return placed.groupBy(*keys).agg(((hits(low) + hits(high)) / 2).alias(name))
