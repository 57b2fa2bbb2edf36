"""Per-period aggregates that late records correct, from value-count multisets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW_US, CUT_OFF_US = 300_000_000, 900_000_000


def value_counts(rows: DataFrame, sign: int = 1, window_us: int = WINDOW_US, cut_off_us: int = CUT_OFF_US) -> DataFrame:
    """Change of the multisets by ``rows``: (venue, symbol, window_start_us, price, n, volume), counts times ``sign``.

    A row counts if it has a symbol, event_time_us > 0, a price > 0, a size >= 0 (nulls don't) and arrived by
    ``ingest_time_us`` before the cut-off, window start + ``cut_off_us``. NaN prices and sizes don't count. Counts are
    summed on the map side, so a window of a hot symbol costs one row per price and map task.
    """
    start = F.expr(f"event_time_us - pmod(event_time_us, {window_us}L)")
    return (
        rows.where("symbol is not null and event_time_us > 0 and price > 0 and size >= 0 and not isnan(price) and not isnan(size)")
        .withColumn("window_start_us", start)
        .where(f"ingest_time_us < window_start_us + {cut_off_us}L")
        .groupBy("venue", "symbol", "window_start_us", "price")
        .agg((F.count(F.lit(1)) * sign).alias("n"), (F.sum("size") * sign).alias("volume"))
    )


def merge_counts(*states: DataFrame) -> DataFrame:
    """Sum of multisets: an old state and the changes by late, repeated or withdrawn records, in any order."""
    whole = states[0]
    for s in states[1:]:
        whole = whole.unionByName(s)
    return whole.groupBy("venue", "symbol", "window_start_us", "price").agg(F.sum("n").alias("n"), F.sum("volume").alias("volume")).where("n > 0")


def bars_from_counts(state: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """Bars re-derived from a state: extremes, exact lower median, distinct prices, count, volume, vwap.

    The state of a period holds one row per distinct price, never one per record; the median is the first price at
    which the cumulative count reaches half of the count. Periods without a record have no bar.
    """
    period = ["venue", "symbol", "window_start_us"]
    up = Window.partitionBy(*period).orderBy("price").rowsBetween(Window.unboundedPreceding, 0)
    ranked = state.withColumns({"__upto": F.sum("n").over(up), "__all": F.sum("n").over(Window.partitionBy(*period))})
    return ranked.groupBy(*period).agg(
        F.min("price").alias("low"),
        F.max("price").alias("high"),
        F.min(F.when(F.col("__upto") * 2 >= F.col("__all"), F.col("price"))).alias("median_price"),
        F.count(F.lit(1)).alias("distinct_prices"),
        F.sum("n").alias("trade_count"),
        F.sum("volume").alias("volume"),
        F.sum(F.col("price") * F.col("volume")).alias("notional"),
    ).withColumn("window_end_us", F.col("window_start_us") + window_us)


def corrected_bars(rows: DataFrame, surplus: DataFrame, window_us: int = WINDOW_US, cut_off_us: int = CUT_OFF_US) -> DataFrame:
    """Bars over each message once: all rows are counted, then the surplus deliveries are taken out again.

    As multisets are sums, this needs no join of the rows with the surplus; ``rows`` are read once and combined before
    they are shuffled.
    """
    state = merge_counts(value_counts(rows, 1, window_us, cut_off_us), value_counts(surplus, -1, window_us, cut_off_us))
    return bars_from_counts(state, window_us)


def wrong_bars(published: DataFrame, corrected: DataFrame) -> DataFrame:
    """(venue, symbol, window_start_us) of bars that are missing, or whose count isn't that of the corrected bar.

    A bar published several times is wrong if any of its counts is; a null count is wrong; a published bar without a
    corrected one is wrong whatever it says.
    """
    key = ["venue", "symbol", "window_start_us"]
    told = published.groupBy(*key).agg(F.min("trade_count").alias("__lo"), F.max("trade_count").alias("__hi"), F.count(F.lit(1)).alias("__m"), F.count("trade_count").alias("__k"))
    both = told.join(corrected.select(*key, "trade_count"), key, "full_outer")
    right = (F.col("__lo") == F.col("trade_count")) & (F.col("__hi") == F.col("trade_count")) & (F.col("__m") == F.col("__k"))
    return both.where(~F.coalesce(right, F.lit(False))).select(*key)
