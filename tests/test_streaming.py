import random

import pytest
from pyspark.sql import functions as F

from tickforge.operators import bars as b
from tickforge.operators import folds
from tickforge.operators.divergence import DivergenceRules, divergences
from tickforge.sources import generate
from tickforge.sources.config import Config
from tickforge.streaming import jobs


@pytest.fixture
def feed(spark, tmp_path):
    """Trades and book changes as folders of files, written in order."""

    def write(df, name, parts):
        path = f"file://{tmp_path}/{name}"
        for i in range(parts):
            df.where(F.col("sequence") % parts == i).coalesce(1).write.mode("append").parquet(path)
        return jobs.file_stream(df.sparkSession, path, df.schema, 1)

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    return write


def done(queries):
    for q in queries:
        q.awaitTermination()


def test_closed_bars_equal_batch(spark, rows, feed, tmp_path):
    t = generate.trades(spark, 2000)
    config = Config(window_seconds=1, watermark_seconds=60, checkpoint_path=f"{tmp_path}/c")
    done(jobs.run_job("trades", feed(t, "t", 2), config, f"file://{tmp_path}/out"))
    got = {(x.venue, x.symbol, x.window_start_us): (x.open, x.close, x.trade_count) for x in spark.read.parquet(f"file://{tmp_path}/out/bars").collect()}
    last = t.agg(F.max("event_time_us")).first()[0] // 1000 * 1000 - 60_000_000
    want = {(x.venue, x.symbol, x.window_start_us): (x.open, x.close, x.trade_count) for x in b.bars(t, 1, "sequence").where(F.col("window_end_us") <= last).collect()}
    assert got == want
    assert last > 0


def test_sequence_state_outlives_batches(spark, rows, feed):
    m = generate.trades(spark, 90).withColumn("arrival", F.col("sequence"))
    q = jobs.to_memory(jobs.sequence_stream(feed(m, "s", 3)), "seq")
    done([q])
    got = spark.table("seq")
    assert got.count() == 90 and got.where("status = 'first'").count() == 9


def test_quotes_equal_the_fold(spark, rows, feed):
    d = generate.book_deltas(spark, 300).withColumn("session_id", F.lit(None).cast("bigint")).coalesce(1)
    done([jobs.to_memory(jobs.quote_stream(feed(d, "b", 1), grid_us=30_000), "quotes")])
    states = folds.book_states(d)
    ticks = folds.book_ticks(states, 30_000)
    cols = ("session_id", "venue", "symbol", "bid_price", "ask_price", "imbalance", "event_time_us", "emit_time_us")
    got = spark.table("quotes")
    assert rows(got, *cols) == rows(ticks.where("not suppressed"), *cols) and got.count() > 50
    last = got.groupBy("session_id", "venue", "symbol").agg(*[F.max(c).alias(c) for c in jobs._COUNTERS])
    assert rows(last, "venue", "symbol", *jobs._COUNTERS) == rows(folds.book_counters(states, ticks), "venue", "symbol", *jobs._COUNTERS)


def test_book_state_outlives_batches(spark, rows, feed):
    d = generate.book_deltas(spark, 90)
    slow = d.withColumns({"event_time_us": F.col("event_time_us") * 1_000, "sequence": F.expr("sequence div 30")})  # each change in a tick of its own
    done([jobs.to_memory(jobs.quote_stream(feed(slow, "b3", 3)), "quotes3")])
    want = folds.book_ticks(folds.book_states(slow.withColumn("session_id", F.lit(-1))))
    assert rows(spark.table("quotes3"), "venue", "symbol", "bid_price", "emit_time_us") == rows(want.where("not suppressed"), "venue", "symbol", "bid_price", "emit_time_us")


def test_monolith_and_records(spark, rows, feed, tmp_path):
    from tickforge.sources.schemas import Registry, record

    deltas, t = generate.book_deltas(spark, 600), generate.trades(spark, 300)
    config = Config(window_seconds=1, checkpoint_path=f"{tmp_path}/m", baseline_ring=5, baseline_warm=2, min_bps=0.0, min_zscore=0.5, max_quote_age_us=60_000_000)
    done(jobs.run_job("monolith", (feed(t, "mt", 1), feed(deltas.coalesce(1), "mb", 1)), config, f"file://{tmp_path}/mono"))
    quotes = folds.book_ticks(folds.book_states(deltas.withColumn("session_id", F.lit(-1)))).where("not suppressed")
    assert quotes.count() > 0 and spark.read.parquet(f"file://{tmp_path}/mono/lake").count() == 300
    spark.read.parquet(f"file://{tmp_path}/mono/divergence").count()
    registry = Registry()
    number = registry.register("book", record("book_delta"))
    framed = jobs.framed_stream(deltas, "book_delta", number).unionByName(spark.createDataFrame([("x", bytearray(b"junk"))], "key string, value binary"))
    framed.withColumn("sequence", F.lit(0)).write.parquet(f"file://{tmp_path}/framed")
    read = jobs.records(jobs.file_stream(spark, f"file://{tmp_path}/framed", "key string, value binary"), registry, "book_delta")
    done([jobs.to_memory(jobs.readable(read), "good"), jobs.to_memory(jobs.poison(read), "bad")])
    assert rows(spark.table("good"), "venue", "symbol", "event_time_us") == rows(deltas, "venue", "symbol", "event_time_us")
    assert spark.table("bad").count() == 1


def test_continuous_jobs_go_on_until_stopped(spark, feed, tmp_path):
    config = Config(trigger_seconds=1, checkpoint_path=f"{tmp_path}/on", lake_path=f"file://{tmp_path}/on-lake")
    (q,) = jobs.run_job("lakehouse", feed(generate.trades(spark, 30), "on", 1), config, f"file://{tmp_path}/o", continuous=True)
    q.processAllAvailable()
    assert q.isActive
    q.stop()
    assert spark.read.parquet(f"file://{tmp_path}/on-lake").count() == 30


def test_latest_table_and_lake(spark, rows, feed, tmp_path):
    t = generate.trades(spark, 60)
    config = Config(checkpoint_path=f"{tmp_path}/c2", lake_path=f"file://{tmp_path}/lake")
    done(jobs.run_job("lakehouse", feed(t, "l", 2), config, f"file://{tmp_path}/o"))
    assert spark.read.parquet(f"file://{tmp_path}/lake").count() == 60
    done(jobs.run_job("quotes", feed(t, "q", 2), config, f"file://{tmp_path}/o"))
    newest = spark.read.parquet(f"file://{tmp_path}/o/latest/version=1")
    assert rows(newest, "symbol", "venue", "event_time_us") == rows(t.groupBy("symbol", "venue").agg(F.max("event_time_us")))


def test_repeats_within_the_delay_and_unknown_job(spark, feed):
    t = generate.trades(spark, 40).withColumn("ts", F.timestamp_micros("event_time_us"))
    q = jobs.to_memory(jobs.once_stream(feed(t.unionByName(t), "d", 1), ["venue", "trade_id"], "ts", "1 hour"), "once")
    done([q])
    assert spark.table("once").count() == 40
    with pytest.raises(ValueError):
        jobs.run_job("nothing", t, Config(), "")
    assert jobs.health({"batchId": 1, "durationMs": {"triggerExecution": 5}, "numInputRows": 2, "stateOperators": [{"numRowsTotal": 3}]}) == {"batch": 1, "duration_ms": 5, "rows": 2, "state_rows": 3}


def test_divergence_stream_equals_batch(spark, rows, feed):
    r = random.Random(8)
    rules = DivergenceRules(max_age_us=50, ring=20, warm=5, min_bps=5, min_zscore=1.5)
    data = [(n, n, r.choice("XY"), r.choice("abc"), m := 100 * (1 + r.gauss(0, 8e-4)), m, 5 * n) for n in range(300)]
    q = spark.createDataFrame(data, "sequence bigint, arrival bigint, symbol string, venue string, bid_price double, ask_price double, event_time_us bigint")
    cols = ("symbol", "arrival", "venue_a", "venue_b", F.round("divergence_bps", 6), F.round("zscore", 6), "window_start_us", "event_time_us")
    path = feed(q.withColumn("sequence", F.expr("sequence div 100")), "dv", 3)  # three batches, in order
    done([jobs.to_memory(jobs.divergence_stream(path, rules), "dv")])
    want = rows(divergences(q, ["a", "b", "c"], "arrival", rules), *cols)
    assert rows(spark.table("dv"), *cols) == want and len(want) > 20


def test_late_trades_correct_bars_up_to_the_cut_off(spark, rows, feed, tmp_path):
    u = 1_000_000
    data = [(0, "v", "X", 5.0, 1.0, 10 * u, 11 * u), (0, "v", "X", 7.0, 1.0, 20 * u, 21 * u), (1, "v", "X", 1.0, 1.0, 30 * u, 800 * u), (1, "v", "X", 9.0, 1.0, 40 * u, 900 * u)]
    t = spark.createDataFrame(data, "sequence bigint, venue string, symbol string, price double, size double, event_time_us bigint, ingest_time_us bigint")
    config = Config(checkpoint_path=f"{tmp_path}/c")
    done(jobs.run_job("late", feed(t, "late", 2), config, f"file://{tmp_path}/o"))
    assert spark.read.parquet(f"file://{tmp_path}/o/late-bars/open/version=1").count() == 0  # past its cut-off
    at = lambda v: rows(jobs.corrected_bars_at(spark, f"file://{tmp_path}/o/late-bars", v), "low", "high", "median_price", "trade_count")
    assert at(0) == [(5.0, 7.0, 5.0, 2)] and at(1) == [(1.0, 7.0, 5.0, 3)]


def test_recorded_frames_as_a_stream(spark, rows, tmp_path):
    from tickforge.operators import decode
    from tickforge.sources.replay import FrameReplay

    frame = '{"channel":"trade","type":"update","data":[{"symbol":"BTC/USD","side":"buy","price":1.5,"qty":2,"trade_id":%d,"timestamp":"x"}]}'
    (tmp_path / "frames").write_text("\n".join([*(frame % i for i in range(5)), "{broken", frame % 9]) + "\n")
    spark.dataSource.register(FrameReplay)
    source = spark.readStream.format("frame_replay").option("path", str(tmp_path / "frames")).option("frames", "3").option("start_us", "100").load()
    q = decode.kraken_trades(source).writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("replayed"), "sequence", "event_time_us") == [(0, 100), (1, 101), (2, 102), (3, 103), (4, 104), (9, 106)]
