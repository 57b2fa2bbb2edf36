"""Deterministic synthetic feeds and the messages that subscribe to real ones."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Symbols with their base prices.
BASES = {"BTC-USD": 64_000.0, "ETH-USD": 3_100.0, "SOL-USD": 140.0}
VENUES = ("binance", "coinbase", "kraken")


def _unit(*parts: Column | int) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), F.lit(1_000_003)) / 1_000_003


def _base(spark: SparkSession, n: int) -> DataFrame:
    symbols, bases = list(BASES), list(BASES.values())
    i = (F.col("id") % len(symbols)).cast("int")
    return spark.range(n).select(
        "id", F.element_at(F.array(*map(F.lit, symbols)), i + 1).alias("symbol"), F.element_at(F.array(*map(F.lit, VENUES)), ((F.col("id") / len(symbols)).cast("int") % len(VENUES) + 1).cast("int")).alias("venue"),
        F.element_at(F.array(*map(F.lit, bases)), i + 1).alias("base"), (F.lit(1_700_000_000_000_000) + F.col("id") * 3_333).alias("event_time_us"),
    )


def trades(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Prices within 5 basis points of the base, two decimals."""
    price = F.round(F.col("base") * (1 + (_unit(F.col("id"), seed) - 0.5) / 1000), 2)
    return _base(spark, n).select(
        "venue", "symbol", F.col("id").cast("string").alias("trade_id"), price.alias("price"), F.round(_unit(F.col("id"), seed + 1) * 2, 4).alias("size"),
        F.when(_unit(F.col("id"), seed + 2) < 0.5, "BUY").otherwise("SELL").alias("side"), "event_time_us", (F.col("event_time_us") + 20_000).alias("ingest_time_us"), F.col("id").alias("sequence"),
    )


def quotes(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """A spread of one basis point around a mid within 5."""
    mid = F.col("base") * (1 + (_unit(F.col("id"), seed) - 0.5) / 1000)
    return _base(spark, n).select("venue", "symbol", F.round(mid * 0.99995, 2).alias("bid_price"), F.lit(1.0).alias("bid_size"), F.round(mid * 1.00005, 2).alias("ask_price"), F.lit(1.0).alias("ask_size"), "event_time_us", (F.col("event_time_us") + 100_000).alias("emit_time_us"))


def book_deltas(spark: SparkSession, n: int, levels: int = 5, seed: int = 1) -> DataFrame:
    """A snapshot every hundred changes of a book, ``levels`` a side."""
    side = lambda sign: F.transform(F.sequence(F.lit(1), F.lit(levels)), lambda k: F.struct(F.round(F.col("base") * (1 + sign * k / 10_000), 2).alias("price"), F.round(_unit(F.col("id"), k, seed) * 5, 2).alias("size")))
    return _base(spark, n).select("venue", "symbol", ((F.col("id") / 9).cast("int") % 100 == 0).alias("is_snapshot"), side(-1).alias("bids"), side(1).alias("asks"), "event_time_us", (F.col("event_time_us") + 20_000).alias("ingest_time_us"), F.col("id").alias("sequence"), F.col("id").alias("arrival"))


# --- subscriptions ---------------------------------------------------------------------------------------------------


def subscriptions(feed: str, symbols: list[str], depth: int = 100) -> list[str]:
    """The messages to send after connecting to a feed."""
    if feed == "coinbase":
        return [json.dumps({"type": "subscribe", "product_ids": symbols, "channel": c}) for c in ("market_trades", "level2", "heartbeats")]
    if feed == "kraken":
        pairs = [s.replace("-", "/") for s in symbols]
        return [json.dumps({"method": "subscribe", "params": {"channel": "trade", "symbol": pairs}}), json.dumps({"method": "subscribe", "params": {"channel": "book", "symbol": pairs, "depth": depth, "snapshot": True}})]
    if feed == "binance":
        words = [s[:-4] + "-USDT" if s.endswith("-USD") else s for s in symbols]
        return [json.dumps({"method": "SUBSCRIBE", "params": [f"{w.replace('-', '').lower()}@{c}" for w in words for c in ("trade", "depth@100ms")], "id": 1})]
    if feed == "evm":
        from tickforge.operators.decode import TRANSFER_TOPIC

        return [json.dumps({"jsonrpc": "2.0", "id": 1, "method": "eth_subscribe", "params": ["logs", {"address": symbols, "topics": [TRANSFER_TOPIC]}]})]
    raise ValueError(f"unknown feed {feed}")


def backoff(attempt: int, first_s: float = 0.5, most_s: float = 30.0, factor: float = 2.0) -> float:
    """Seconds to wait before the next connection, without jitter."""
    return min(most_s, first_s * factor**attempt)
