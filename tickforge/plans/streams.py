"""Streaming queries over the test tables, run to the end of their input, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions.canonical import canonical_pair, canonical_venue
from tickforge.plans.reference import _BAR, _VALID
from tickforge.sources import shared_dir, table
from tickforge.streaming import jobs


def _source(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The table as a stream of files; the glob fits a single file and a folder of parts alike."""
    schema = table(spark, d, name).schema
    return jobs.file_stream(spark, f"{d}/{name}.parque[t]", schema)


def _finished(spark: SparkSession, query, path: str) -> DataFrame:
    query.awaitTermination()
    return spark.read.parquet(path)


def _paths(spark: SparkSession, name: str) -> tuple[str, str]:
    import uuid

    base = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def stream_bars(spark: SparkSession, d: str) -> DataFrame:
    """One-minute bars that a stream has closed: those whose end the watermark has passed."""
    out, checkpoint = _paths(spark, "bars")
    trades = _source(spark, d, "trades").withColumns({"venue": canonical_venue(F.col("venue")), "symbol": canonical_pair(F.col("symbol"))})
    bars = _finished(spark, jobs.to_files(jobs.bars_stream(trades, 60, "5 seconds", "arrival"), out, checkpoint), out)
    return bars.withColumns({c: F.round(F.col(c) + 1e-10, 6) for c in ("volume", "vwap")})


def stream_latest_quotes(spark: SparkSession, d: str) -> DataFrame:
    """The latest-quote table after the stream's last version."""
    out, checkpoint = _paths(spark, "latest")
    quotes = _source(spark, d, "quotes").where("event_time_us > 0 and symbol is not null").withColumns({"venue": canonical_venue(F.col("venue")), "symbol": canonical_pair(F.col("symbol"))})
    query = jobs.upsert_latest(quotes.select("symbol", "venue", "quote_id", "event_time_us", "bid_price", "ask_price"), out, checkpoint, ["event_time_us", "quote_id"])
    rows = _finished(spark, query, out)
    newest = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == newest).select("symbol", "venue", "quote_id", "event_time_us")


_C = "replace(replace(upper(trim(symbol)), '/', '-'), '_', '-')"

ORACLE = {
    "stream_bars": f"""WITH t AS (SELECT * REPLACE (lower(trim(venue)) AS venue, {_C} AS symbol) FROM trades), v AS (SELECT * FROM t WHERE {_VALID}), m AS (SELECT max(event_time_us) // 1000 * 1000 - 5000000 AS mark FROM v)
SELECT * FROM (SELECT venue, symbol, event_time_us // 60000000 * 60000000 AS window_start_us, event_time_us // 60000000 * 60000000 + 60000000 AS window_end_us, {_BAR}, round(sum(size) + 1e-10, 6) AS volume,
  round(CASE WHEN sum(size) > 0 THEN sum(price * size) / sum(size) ELSE 0.0 END + 1e-10, 6) AS vwap, count(*) AS trade_count FROM v GROUP BY ALL) WHERE window_end_us <= (SELECT mark FROM m)""",
    "stream_latest_quotes": f"""SELECT {_C} AS symbol, lower(trim(venue)) AS venue, arg_max(quote_id, (event_time_us, quote_id)) AS quote_id, max(event_time_us) AS event_time_us FROM quotes WHERE event_time_us > 0 AND symbol IS NOT NULL GROUP BY 1, 2""",
}

QUERIES = {f.__name__: f for f in (stream_bars, stream_latest_quotes)}
