"""The lake of trades: table definition, append, range scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COLUMNS = ("venue", "symbol", "trade_id", "price", "size", "side", "event_time_us", "ingest_time_us", "sequence")


def create_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def create_trades(spark: SparkSession, name: str, path: str) -> None:
    """An external Parquet table, zstd, partitioned by symbol."""
    spark.sql(
        f"""CREATE TABLE IF NOT EXISTS {name} (venue STRING, trade_id STRING, price DOUBLE, size DOUBLE, side STRING, event_time_us BIGINT, ingest_time_us BIGINT,
        sequence BIGINT, event_time TIMESTAMP, symbol STRING) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY (symbol) LOCATION '{path}'"""
    )


def with_event_time(trades: DataFrame) -> DataFrame:
    """``event_time`` at millisecond precision; the microseconds stay in event_time_us alone."""
    return trades.select(*COLUMNS).withColumn("event_time", F.timestamp_millis(F.expr("event_time_us div 1000")))


def append(trades: DataFrame, path: str) -> None:
    """Append by column name. Rows are rebalanced by symbol and sorted by time, so range scans skip row groups."""
    rows = with_event_time(trades).hint("rebalance", "symbol").sortWithinPartitions("symbol", "event_time_us")
    rows.write.mode("append").option("compression", "zstd").partitionBy("symbol").parquet(path)


def scan(spark: SparkSession, path: str, start_us: int, end_us: int, symbol: str | None = None, schema: StructType | None = None) -> DataFrame:
    """start <= event_time_us < end; the range is pushed to Parquet and a symbol prunes partitions."""
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if symbol is not None:
        rows = rows.where(F.col("symbol") == symbol)
    return rows.where((F.col("event_time_us") >= start_us) & (F.col("event_time_us") < end_us)).select(*COLUMNS)


def expired_days(spark: SparkSession, path: str, now_us: int, days: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("event_time_us") < now_us - days * 86_400_000_000)
