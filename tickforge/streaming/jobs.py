"""Streaming jobs: the same operators over unbounded input, with checkpoints and watermarks."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tickforge.functions.market import valid_delta, valid_trade, vwap
from tickforge.operators.bars import bar_states
from tickforge.operators.divergence import Detector, DivergenceRules
from tickforge.operators.folds import Book, GapDetector
from tickforge.operators.latebars import CUT_OFF_US, WINDOW_US, bars_from_counts, merge_counts, value_counts
from tickforge.sources import frames, lake, schemas
from tickforge.sources.config import Config
from tickforge.sources.shared import delete, write_shared

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1_000) -> DataFrame:
    """New Parquet files of a folder, bounded per trigger; the checkpoint remembers which were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, per_trigger: int = 1_000_000) -> DataFrame:
    """(key, value) of a topic's records from the earliest, or from the checkpoint; needs the Kafka connector on the class path."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(per_trigger), "failOnDataLoss": "true"}
    return spark.readStream.format("kafka").options(**options).load().select("key", "value")


def records(framed: DataFrame, registry: schemas.Registry, entity: str) -> DataFrame:
    """Rows of ``entity`` plus ``error`` from framed records; a record that can't be read is a row of nulls with the reason."""
    return frames.decode_frames(framed, registry, schemas.record(entity), schemas.DDL[entity])


def readable(read: DataFrame) -> DataFrame:
    """The rows without an error; poison records are passed over and don't stop the job."""
    return read.where("error is null").drop("error")


def poison(read: DataFrame) -> DataFrame:
    """The reasons of the records that were passed over, to be counted or kept."""
    return read.where("error is not null").select("error")


def framed_stream(df: DataFrame, entity: str, number: int, key: str = "symbol") -> DataFrame:
    """(key, value): rows as framed records of a registered schema, ready for a topic."""
    return frames.encode_rows(df, schemas.record(entity), number, key)


def to_kafka(framed: DataFrame, servers: str, topic: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """At least once with an idempotent producer; a consumer that keeps one delivery per message sees each once. Needs the connector."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.enable.idempotence": "true", "kafka.acks": "all", "kafka.compression.type": "zstd", "checkpointLocation": checkpoint}
    return framed.writeStream.format("kafka").options(**options).outputMode("append").trigger(**_trigger(seconds)).start()


def _trigger(seconds: int | None) -> dict:
    """A batch every so many seconds; without a number the input that is there, and an end."""
    return {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}


def bars_stream(trades: DataFrame, seconds: int = 1, delay: str = "5 seconds", arrival: str = "sequence") -> DataFrame:
    """Bars as in batch, emitted once the watermark passes their end; later trades are dropped.

    Invalid trades are filtered before the watermark, so an unset or absurd time can't move it.
    """
    timed = trades.where(valid_trade()).withColumn("__ts", F.timestamp_micros("event_time_us")).withWatermark("__ts", delay)
    states = timed.groupBy(F.window("__ts", f"{seconds} seconds").alias("w"), "venue", "symbol").agg(*bar_states(arrival))
    return states.select(
        "venue", "symbol", F.unix_micros("w.start").alias("window_start_us"), F.unix_micros("w.end").alias("window_end_us"), "open", "high", "low", "close", "volume", vwap("notional", "volume").alias("vwap"), "trade_count"
    )


def once_stream(messages: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """One delivery per message while repeats come within the delay; beyond it, the batch operator decides."""
    return messages.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


class SequenceProcessor(StatefulProcessor):
    """Status of sequences per key, in order of arrival within each micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        detector = GapDetector()
        if self.last.exists():
            detector.last = self.last.get()[0]
        out = []
        for r in pd.concat(list(rows)).sort_values("arrival").itertuples(index=False):
            out.append((r.venue, r.symbol, int(r.arrival), int(r.sequence), *detector.observe(int(r.sequence))))
        if detector.last is not None:
            self.last.update((detector.last,))
        yield pd.DataFrame(out, columns=["venue", "symbol", "arrival", "sequence", "status", "missing"])

    def close(self) -> None:
        pass


def sequence_stream(messages: DataFrame) -> DataFrame:
    """Needs the RocksDB state store; messages have venue, symbol, arrival and sequence."""
    return (
        messages.select("venue", "symbol", "arrival", F.coalesce("sequence", F.lit(-1)).alias("sequence")).groupBy("venue", "symbol")
        .transformWithStateInPandas(SequenceProcessor(), "venue string, symbol string, arrival bigint, sequence bigint, status string, missing bigint", "Append", "None")
    )


_QUOTE_COLUMNS = ["bid_price", "bid_size", "ask_price", "ask_size", "mid", "spread_bps", "imbalance"]
_COUNTERS = ["quotes_emitted", "quotes_suppressed", "crossed_books", "snapshots_applied"]


class BookProcessor(StatefulProcessor):
    """A book per key, bounded in depth; at each tick of the grid of event time that follows a change, its quote, if that is new and valid.

    What is due at the end of a batch comes with it, so a book that falls silent shows its last state. Counters run on
    over batches and come with each quote.
    """

    def __init__(self, depth: int = 50, grid_us: int = 100_000):
        self.depth, self.grid = depth, grid_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        level = "array<struct<price:double,size:double>>"
        self.book = handle.getValueState("book", f"bids {level}, asks {level}, sequence bigint, event_time_us bigint, arrival bigint, slot bigint, last array<double>, last_us bigint, counters array<bigint>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        book, slot, last, at, counters = Book(self.depth), None, None, 0, [0] * 4
        if self.book.exists():
            bids, asks, sequence, event_us, at, slot, kept, last_us, counters = self.book.get()
            book = Book.restore({"bids": [tuple(x) for x in bids], "asks": [tuple(x) for x in asks], "sequence": sequence, "event_time_us": event_us}, self.depth)
            last, counters = ((tuple(kept), last_us) if kept else None), list(counters)
        out = []
        fresh = False  # whether a change came after the last tick

        def tick() -> None:
            nonlocal last
            q = None if book.crossed else book.quote()
            if q is None:
                counters[1] += book.crossed
            elif (q, book.event_time_us) == last:
                counters[1] += 1
            else:
                last = (q, book.event_time_us)
                counters[0] += 1
                out.append((*key, at, *q, book.event_time_us, (slot + 1) * self.grid, *counters))

        for r in pd.concat(list(rows)).sort_values("arrival").itertuples(index=False):
            now = int(r.event_time_us) // self.grid
            if slot is None or now > slot:
                if fresh:
                    tick()
                slot = now
            at, fresh = int(r.arrival), True
            book.apply(bool(r.is_snapshot), r.bids, r.asks, int(r.sequence), int(r.event_time_us))
            counters[2] += book.crossed
            counters[3] += bool(r.is_snapshot)
        if fresh:
            tick()
        s = book.snapshot()
        self.book.update((s["bids"], s["asks"], s["sequence"], s["event_time_us"], at, slot, list(last[0]) if last else [], last[1] if last else 0, counters))
        yield pd.DataFrame(out, columns=["session_id", "venue", "symbol", "arrival", *_QUOTE_COLUMNS, "event_time_us", "emit_time_us", *_COUNTERS])

    def close(self) -> None:
        pass


def quote_stream(deltas: DataFrame, depth: int = 50, grid_us: int = 100_000) -> DataFrame:
    """Quotes of books per session, venue and symbol (without a session_id there is one session). Needs the RocksDB state store."""
    schema = f"session_id bigint, venue string, symbol string, arrival bigint, {', '.join(f'{c} double' for c in _QUOTE_COLUMNS)}, event_time_us bigint, emit_time_us bigint, {', '.join(f'{c} bigint' for c in _COUNTERS)}"
    session = F.coalesce(F.col("session_id"), F.lit(-1)).cast("bigint") if "session_id" in deltas.columns else F.lit(-1).cast("bigint")
    cols = deltas.where(valid_delta()).select(session.alias("session_id"), "venue", "symbol", "arrival", F.coalesce("is_snapshot", F.lit(False)).alias("is_snapshot"), "bids", "asks", F.coalesce("sequence", F.lit(-1)).alias("sequence"), "event_time_us")
    return cols.groupBy("session_id", "venue", "symbol").transformWithStateInPandas(BookProcessor(depth, grid_us), schema, "Append", "None")


class DivergenceProcessor(StatefulProcessor):
    """The divergence detector of a symbol; newest quotes and rings live in the state store."""

    def __init__(self, rules: DivergenceRules = DivergenceRules()):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.quotes = handle.getMapState("quotes", "venue string", "event_time_us bigint, mid double, ok boolean")
        self.rings = handle.getMapState("rings", "venue_a string, venue_b string", "bps array<double>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        detector = Detector(self.rules)
        detector.quotes = {k[0]: tuple(v) for k, v in self.quotes.iterator()}
        detector.rings = {tuple(k): deque(v[0], self.rules.ring) for k, v in self.rings.iterator()}
        out = []
        for r in pd.concat(list(rows)).sort_values("arrival").itertuples(index=False):
            out.extend((key[0], int(r.arrival), *e) for e in detector.observe(r.venue, float(r.bid_price), float(r.ask_price), int(r.event_time_us)))
        for venue, state in detector.quotes.items():
            self.quotes.updateValue((venue,), state)
        for pair, ring in detector.rings.items():
            self.rings.updateValue(pair, (list(ring),))
        yield pd.DataFrame(out, columns=["symbol", "arrival", "venue_a", "venue_b", "price_a", "price_b", "divergence_bps", "zscore", "window_start_us", "event_time_us"])

    def close(self) -> None:
        pass


def divergence_stream(quotes: DataFrame, rules: DivergenceRules = DivergenceRules()) -> DataFrame:
    """Needs the RocksDB state store; quotes have symbol, venue, arrival, prices and event_time_us. Quotes without a price are passed over."""
    schema = "symbol string, arrival bigint, venue_a string, venue_b string, price_a double, price_b double, divergence_bps double, zscore double, window_start_us bigint, event_time_us bigint"
    cols = quotes.where("bid_price is not null and ask_price is not null and event_time_us is not null").select("symbol", "venue", "arrival", "bid_price", "ask_price", "event_time_us")
    return cols.groupBy("symbol").transformWithStateInPandas(DivergenceProcessor(rules), schema, "Append", "None")


def corrected_bars_stream(trades: DataFrame, path: str, checkpoint: str, window_us: int = WINDOW_US, cut_off_us: int = CUT_OFF_US, seconds: int | None = None) -> StreamingQuery:
    """Bars that late trades correct: each batch's value counts are added to the state, and the state's bars are the result.

    ``trades`` hold each message once (see ``once_stream``) and come by ingest_time_us from batch to batch. A batch writes
    a new version of the state, named by its number, from the version before; a repeated batch writes the same again.
    Windows whose cut-off lies before the newest receipt can't change any more: they leave the state for ``closed``, so the
    state holds open windows only. Versions older than the one before are deleted. Trades past the cut-off change nothing.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        change = value_counts(rows, 1, window_us, cut_off_us)
        state = merge_counts(change, spark.read.parquet(f"{path}/open/version={number - 1}")) if number else merge_counts(change)
        state = spark.read.parquet(write_shared(state, "late-state"))
        newest = rows.agg(F.max("ingest_time_us")).first()[0]
        over = F.lit(False) if newest is None else F.col("window_start_us") + cut_off_us <= newest
        state.where(over).write.mode("overwrite").parquet(f"{path}/closed/version={number}")
        state.where(~over).write.mode("overwrite").parquet(f"{path}/open/version={number}")
        if number > 1:
            delete(spark, f"{path}/open/version={number - 2}")

    return trades.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**_trigger(seconds)).start()


def corrected_bars_at(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The bars of a version of the state: the last or the one before."""
    closed = spark.read.parquet(f"{path}/closed").where(F.col("version") <= version).drop("version")
    return bars_from_counts(merge_counts(spark.read.parquet(f"{path}/open/version={version}"), closed))


# --- sinks -----------------------------------------------------------------------------------------------------------


def to_files(df: DataFrame, path: str, checkpoint: str, *partition: str, seconds: int | None = None) -> StreamingQuery:
    """Exactly once: a file counts only when the sink's log lists it."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**_trigger(seconds))
    return (writer.partitionBy(*partition) if partition else writer).start()


def to_lake(trades: DataFrame, path: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    return to_files(lake.with_event_time(trades), path, checkpoint, "symbol", seconds=seconds)


def upsert_latest(df: DataFrame, path: str, checkpoint: str, order: list[str], seconds: int | None = None) -> StreamingQuery:
    """The newest row per symbol and venue: each batch writes a new version of the table, named by the batch.

    A repeated batch writes the same version again, so at-least-once delivery leaves the result right. The table has a row
    per symbol and venue, however long the stream; of its versions, the last and the one before stay.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        both = rows
        if number:
            both = rows.unionByName(spark.read.parquet(f"{path}/version={number - 1}"))
        cols = [c for c in rows.columns if c not in ("symbol", "venue")]
        newest = both.groupBy("symbol", "venue").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("q")).select("symbol", "venue", "q.*")
        newest.write.mode("overwrite").parquet(f"{path}/version={number}")
        if number > 1:
            delete(spark, f"{path}/version={number - 2}")

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**_trigger(seconds)).start()


def to_memory(df: DataFrame, name: str) -> StreamingQuery:
    return df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()


# --- jobs ------------------------------------------------------------------------------------------------------------


def _trades_job(source: DataFrame, config: Config, out: str, seconds: int | None) -> list[StreamingQuery]:
    return [to_files(bars_stream(source, config.window_seconds, f"{config.watermark_seconds} seconds"), f"{out}/bars", f"{config.checkpoint_path}/bars", seconds=seconds)]


def _rules(config: Config) -> DivergenceRules:
    return DivergenceRules(config.max_quote_age_us, config.baseline_ring, config.baseline_warm, config.min_bps, config.min_zscore)


def _book_job(source: DataFrame, config: Config, out: str, seconds: int | None) -> list[StreamingQuery]:
    return [to_files(quote_stream(source, config.book_depth, config.quote_grid_ms * 1_000), f"{out}/quotes", f"{config.checkpoint_path}/quotes", seconds=seconds)]


def _lake_job(source: DataFrame, config: Config, out: str, seconds: int | None) -> list[StreamingQuery]:
    return [to_lake(source.where(valid_trade()), config.lake_path or f"{out}/lake", f"{config.checkpoint_path}/lake", seconds)]


def _divergence_job(source: DataFrame, config: Config, out: str, seconds: int | None) -> list[StreamingQuery]:
    return [to_files(divergence_stream(source, _rules(config)), f"{out}/divergence", f"{config.checkpoint_path}/divergence", seconds=seconds)]


def _late_job(source: DataFrame, config: Config, out: str, seconds: int | None) -> list[StreamingQuery]:
    return [corrected_bars_stream(source, f"{out}/late-bars", f"{config.checkpoint_path}/late-bars", seconds=seconds)]


def _latest_job(source: DataFrame, config: Config, out: str, seconds: int | None) -> list[StreamingQuery]:
    return [upsert_latest(source, f"{out}/latest", f"{config.checkpoint_path}/latest", ["event_time_us"], seconds)]


def _replay_job(source: DataFrame, config: Config, out: str, seconds: int | None) -> list[StreamingQuery]:
    """The lake's range through the same bars, with a watermark that waits for a day of disorder."""
    ranged = source.where((F.col("event_time_us") >= config.replay_start_us) & (F.col("event_time_us") < config.replay_end_us))
    return [to_files(bars_stream(ranged, config.window_seconds, f"{config.replay_watermark_hours} hours"), f"{out}/replayed", f"{config.checkpoint_path}/replayed", seconds=seconds)]


def monolith(trades: DataFrame, deltas: DataFrame, config: Config, out: str, seconds: int | None = None) -> list[StreamingQuery]:
    """All in one application: trades to bars and lake, and, as one query, book changes to quotes to divergences.

    Quotes go on to the detector without a topic or a file between them.
    """
    quotes = quote_stream(deltas, config.book_depth, config.quote_grid_ms * 1_000)
    fused = to_files(divergence_stream(quotes, _rules(config)), f"{out}/divergence", f"{config.checkpoint_path}/fused", seconds=seconds)
    return [*_trades_job(trades, config, out, seconds), *_lake_job(trades, config, out, seconds), fused]


JOBS: dict[str, Callable[[DataFrame, Config, str, int | None], list[StreamingQuery]]] = {
    "trades": _trades_job, "book": _book_job, "divergence": _divergence_job, "late": _late_job, "lakehouse": _lake_job, "quotes": _latest_job, "backfill": _replay_job,
}


def run_job(name: str, source: DataFrame | tuple[DataFrame, DataFrame], config: Config, out: str, continuous: bool = False) -> list[StreamingQuery]:
    """Start a job by name; stateful ones use the RocksDB state store. ``monolith`` takes (trades, book changes).

    A continuous job runs a batch every ``config.trigger_seconds``, until it is stopped; else it ends with its input.
    """
    if name != "monolith" and name not in JOBS:
        raise ValueError(f"unknown job {name}; there are {', '.join(sorted([*JOBS, 'monolith']))}")
    seconds = config.trigger_seconds if continuous else None
    spark = (source[0] if isinstance(source, tuple) else source).sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return monolith(*source, config, out, seconds) if name == "monolith" else JOBS[name](source, config, out, seconds)


def health(progress: dict) -> dict:
    """What the alerts watch in a query's progress: batch duration and state size."""
    return {"batch": progress["batchId"], "duration_ms": progress["durationMs"].get("triggerExecution", 0), "rows": progress["numInputRows"], "state_rows": sum(s["numRowsTotal"] for s in progress.get("stateOperators", []))}
