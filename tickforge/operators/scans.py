"""Running maxima, last values and row numbers per key that stay spread when one key holds most rows.

A window over a whole key is one task, however many rows the key has. Here the key is cut into slices of its order
column: the window runs inside slices, and what comes from earlier slices is a window over one compact row per slice,
joined back. The order column must be an integer; ``width`` is in its units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 65_536


def _sliced(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("__slice", F.expr(f"(`{order}` - pmod(`{order}`, {width}L)) div {width}L"))


def _carry(df: DataFrame, sums: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``df`` with what came before its slice; every slice of ``df`` has its row in ``sums``, so an inner join does."""
    right = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__slice").alias("__s"), *names)
    same = F.col("__slice") == F.col("__s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(right, same).drop("__s", *[f"__k{i}" for i in range(len(keys))])


def running_max_before(df: DataFrame, keys: list[str], order: str, value: str, name: str, width: int = WIDTH) -> DataFrame:
    """``df`` with the largest ``value`` of its key's rows before it in ``order`` (unique); null for the first."""
    cut = _sliced(df, order, width)
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, "__slice").agg(F.max(value).alias("__m")).withColumn("__before", F.max("__m").over(earlier))
    local = Window.partitionBy(*keys, "__slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return _carry(cut, sums, keys, ["__before"]).withColumn(name, F.greatest(F.max(value).over(local), "__before")).drop("__slice", "__before")


def running_last(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], width: int = WIDTH) -> DataFrame:
    """``df`` with, per name, the last non-null value of its key's rows up to and including it in ``order`` (unique)."""
    cut = _sliced(df.withColumns({f"__v_{n}": v for n, v in values.items()}), order, width)
    newest = [F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col(order))).alias(f"__c_{n}") for n in values]
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, "__slice").agg(*newest).withColumns({f"__b_{n}": F.last(f"__c_{n}", ignorenulls=True).over(earlier) for n in values})
    local = Window.partitionBy(*keys, "__slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = _carry(cut, sums, keys, [f"__b_{n}" for n in values])
    out = joined.withColumns({n: F.coalesce(F.last(f"__v_{n}", ignorenulls=True).over(local), F.col(f"__b_{n}")) for n in values})
    return out.drop("__slice", *[f"__v_{n}" for n in values], *[f"__b_{n}" for n in values])


def numbered(df: DataFrame, keys: list[str], order: str, name: str, width: int = WIDTH) -> DataFrame:
    """``df`` with its row's number in its key, from 0, in ``order`` (unique per key)."""
    cut = _sliced(df, order, width)
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    local = Window.partitionBy(*keys, "__slice").orderBy(order)
    return _carry(cut, sums, keys, ["__before"]).withColumn(name, F.row_number().over(local) - 1 + F.col("__before")).drop("__slice", "__before")


def running_total(df: DataFrame, keys: list[str], order: str, value: str, name: str, width: int = WIDTH) -> DataFrame:
    """``df`` with the sum of ``value`` of its key's rows up to and including it in ``order`` (unique); without ``value``."""
    cut = _sliced(df, order, width)
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, "__slice").agg(F.sum(value).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    local = Window.partitionBy(*keys, "__slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return _carry(cut, sums, keys, ["__before"]).withColumn(name, F.coalesce(F.sum(value).over(local), F.lit(0)) + F.col("__before")).drop("__slice", "__before", value)


def previous(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, width: int = WIDTH) -> DataFrame:
    """``df`` with the last non-null ``value`` of its key's rows before it in ``order`` (unique; the first is an integer and sliced)."""
    cut = _sliced(df, order[0], width)
    newest = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__c")
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, "__slice").agg(newest).withColumn("__b", F.last("__c", ignorenulls=True).over(earlier))
    local = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return _carry(cut, sums, keys, ["__b"]).withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(local), F.col("__b"))).drop("__slice", "__b")


def with_rows_before(df: DataFrame, number: str, rows: int, block: int) -> DataFrame:
    """Each row in its block of ``block`` numbers, and again, with ``is_halo``, in the next block if it is among the ``rows`` before that.

    A window of at most ``rows`` rows back can then run per (key, __block) and rows with is_halo be dropped.
    """
    if rows > block:
        raise ValueError("a block must hold the rows that the window looks back on")
    own = F.expr(f"{number} div {block}L")
    copies = F.when(F.pmod(F.col(number), F.lit(block)) >= block - rows, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("__next", F.explode(copies)).withColumns({"__block": own + F.col("__next"), "is_halo": F.col("__next") == 1}).drop("__next")
