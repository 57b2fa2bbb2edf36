"""Tumbling OHLCV and VWAP bars, for batch and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.functions.market import notional, valid_trade, vwap, window_start


def bar_states(arrival: str = "arrival") -> list[Column]:
    """Mergeable states of a bar: open and close by (event time, arrival), a total order, so merging commutes."""
    order = F.struct("event_time_us", arrival)
    return [
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("size").alias("volume"), F.sum(notional("price", "size")).alias("notional"), F.count(F.lit(1)).alias("trade_count"),
    ]


def bars(trades: DataFrame, seconds: int = 1, arrival: str = "arrival") -> DataFrame:
    """Bars of ``seconds``, epoch-aligned, [start, end), per venue and symbol, from valid trades.

    One map-side combined aggregation; the window is part of the key, so a hot symbol is spread over its windows. A bar
    without volume has a vwap of 0.0. Empty input gives no bars; other columns aren't read.
    """
    span = seconds * 1_000_000
    keyed = trades.where(valid_trade()).withColumn("window_start_us", window_start("event_time_us", seconds))
    return (
        keyed.groupBy("venue", "symbol", "window_start_us").agg(*bar_states(arrival))
        .select("venue", "symbol", "window_start_us", (F.col("window_start_us") + span).alias("window_end_us"), "open", "high", "low", "close", "volume", vwap("notional", "volume").alias("vwap"), "trade_count")
    )


def fold_bar(trades: DataFrame, arrival: str = "arrival") -> DataFrame:
    """One bar per venue and symbol over all of its valid trades."""
    states = trades.where(valid_trade()).groupBy("venue", "symbol").agg(*bar_states(arrival), F.min("event_time_us").alias("first_us"), F.max("event_time_us").alias("last_us"))
    return states.withColumn("vwap", vwap("notional", "volume")).drop("notional")


def rollup(fine: DataFrame, seconds: int = 60) -> DataFrame:
    """Coarser bars from finer ones: the notional is re-derived as vwap * volume, so the vwap is weighted anew."""
    keyed = fine.withColumn("start", window_start("window_start_us", seconds))
    states = keyed.groupBy("symbol", "venue", F.col("start").alias("window_start_us")).agg(
        F.min_by("open", "window_start_us").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "window_start_us").alias("close"),
        F.sum("volume").alias("volume"), F.sum(F.col("vwap") * F.col("volume")).alias("notional"), F.sum("trade_count").alias("trade_count"),
    )
    return states.withColumn("vwap", vwap("notional", "volume")).drop("notional")
