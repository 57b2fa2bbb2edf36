"""Queries over the pipeline around the operators (codecs, lake, policies, losses, jobs), and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickforge.functions.canonical import canonical_pair, canonical_venue
from tickforge.operators import bars as b
from tickforge.operators import decode, folds, metrics, serving
from tickforge.operators import divergence as dv
from tickforge.operators.compaction import live_files
from tickforge.operators.redelivery import surplus_deliveries
from tickforge.plans import reference as ref
from tickforge.plans.problems import _MESSAGES, _VS, _canon, canonical
from tickforge.sources import frames, lake, schemas, shared_dir, table
from tickforge.sources.shared import will_vanish

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _within(z):
    """Scores within a million: those of a baseline that is constant but for rounding have no digits in common."""
    return F.round(F.least(F.greatest(z, F.lit(-1e6)), F.lit(1e6)), 3)


_EARLY = dv.DivergenceRules(max_age_us=60_000_000, ring=40, warm=4, min_bps=1.0, min_zscore=1.5)


@query(f"""{ref._D3_.replace("AGE", "60000000")} z AS (SELECT *, count(bps) OVER w n, avg(bps) OVER w mu, stddev_samp(bps) OVER w sd FROM o WINDOW w AS (PARTITION BY symbol, venue_a, venue_b ORDER BY quote_id ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING))
SELECT symbol, quote_id, venue_a, venue_b, round(bps, 4) AS divergence_bps, round(least(greatest((bps - mu) / sd, -1e6), 1e6), 3) AS zscore, window_start_us, event_time_us FROM z WHERE n >= 4 AND abs(bps) >= 1 AND sd > 0 AND abs((bps - mu) / sd) >= 1.5""")
def divergence_events_early(spark, d):
    """The detector with a short baseline and quotes that may be a minute old, so that small tables have events too."""
    q = ref._quotes(spark, d).where("symbol is not null and event_time_us > 0")
    e = dv.divergences(q, dv.venues_of(q), "quote_id", _EARLY)
    return e.select("symbol", "quote_id", "venue_a", "venue_b", F.round("divergence_bps", 4).alias("divergence_bps"), _within(F.col("zscore")).alias("zscore"), "window_start_us", "event_time_us")


def _statuses(spark, d, resync):
    t = ref._trades(spark, d).select("venue", "symbol", "arrival", "sequence").where("symbol is not null")
    return folds.sequence_status(folds.connection_scope(t, ["norvex", "altamar"], "trades"), ["venue", "scope_symbol", "scope_channel"], "arrival", resync=resync)


@query(ref._sequence_sql(False, "SELECT venue, scope_symbol, u.a AS arrival, u.s AS status FROM o WHERE u.s <> 'duplicate'"))
def published_trades(spark, d):
    """The pipeline lets all but repeats through."""
    return folds.without_duplicates(_statuses(spark, d, False)).select("venue", "scope_symbol", "arrival", "status")


@query(ref._sequence_sql(True, "SELECT venue, scope_symbol, u.a AS arrival, u.s AS status FROM o WHERE u.s NOT IN ('duplicate', 'gap', 'regression')"))
def published_without_gaps(spark, d):
    """The stricter policy drops what shows a gap, too, and begins anew."""
    return folds.without_gaps(_statuses(spark, d, True)).select("venue", "scope_symbol", "arrival", "status")


@query(f"""WITH {_VS}, {_canon('trades')}, {_MESSAGES}, live AS (SELECT DISTINCT * EXCLUDE (file_id) FROM lake_trades WHERE file_id IN (SELECT file_id FROM lake_files WHERE committed_at IS NOT NULL AND replaced_by IS NULL)),
x AS (SELECT venue, 1 r, 0 p, 0 s FROM c_trades UNION ALL SELECT venue, 0, 1, 0 FROM c_trades JOIN surplus USING (arrival) UNION ALL SELECT lower(trim(venue)), 0, 0, 1 FROM live)
SELECT venue, CAST(sum(r) AS BIGINT) AS received, CAST(sum(p) AS BIGINT) AS dropped, CAST(sum(s) AS BIGINT) AS stored, CAST(sum(r) - sum(p) - sum(s) AS BIGINT) AS lost FROM x GROUP BY venue""")
def pipeline_losses(spark, d):
    """Trades received, dropped as repeats, and stored in the lake: the lake of the test tables holds a part of them."""
    trades = canonical(spark, d, "trades", "arrival", "venue", "symbol", "trade_id", "sequence", "ingest_time_us")
    rows = table(spark, d, "lake_trades").join(live_files(table(spark, d, "lake_files")).select("file_id"), "file_id", "left_semi").drop("file_id").distinct()
    return metrics.lost_messages(trades, surplus_deliveries(trades, keep=["venue"]), rows.withColumn("venue", canonical_venue(F.col("venue"))), "venue")


@query(ref._quantile_sql(0.5))
def source_lag_p50(spark, d):
    t = table(spark, d, "trades").withColumn("venue", canonical_venue(F.col("venue")))
    return ref._round(metrics.histogram_quantile(t, ref.m.lag_seconds("event_time_us", "ingest_time_us"), 0.5, "venue"), 6, "quantile")


@query("""SELECT CASE WHEN event_type IN ('click', 'purchase') THEN 'monolith' ELSE 'per_topic' END AS layout, round(avg(value) + 1e-10, 6) AS mean_ms, max(value) AS longest_ms,
  CAST(sum(CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS failures, CAST(sum(user_id) AS BIGINT) AS state_bytes FROM events GROUP BY 1""")
def checkpoint_layouts(spark, d):
    """Events as checkpoints of two job layouts."""
    e = table(spark, d, "events").select(F.when(F.col("event_type").isin("click", "purchase"), "monolith").otherwise("per_topic").alias("layout"), "value", (F.col("event_id") % 50 == 0).cast("int").alias("failed"), "user_id")
    return ref._round(metrics.layout_report(e, "layout", "value", "failed", "user_id"), 6, "mean_ms")


_EMPTY = ", ".join(f"coalesce({c}, {z}) AS {c}" for c, z in (("venue", "''"), ("symbol", "''"), ("trade_id", "''"), ("price", "0.0"), ("size", "0.0"), ("side", "''"), ("event_time_us", "0"), ("ingest_time_us", "0"), ("sequence", "0")))


@query(f"SELECT {_EMPTY}, '' AS maker_order_id, 'UNKNOWN' AS liquidity FROM trades")
def framed_trades(spark, d):
    """Trades as framed records of the first schema version, read with the second."""
    registry = schemas.Registry()
    number = registry.register("md.trades-value", schemas.TRADE_V1)
    registry.register("md.trades-value", schemas.TRADE_V2)
    written = frames.encode_rows(table(spark, d, "trades"), schemas.TRADE_V1, number)
    back = frames.decode_frames(written, registry, schemas.TRADE_V2, f"{schemas.DDL['trade']}, maker_order_id string, liquidity string")
    return back.where("error is null").drop("error").fillna("", ["maker_order_id"])


@query("""SELECT venue, symbol, is_snapshot, event_time_us, ingest_time_us, sequence, n_bids, n_asks, round(total + 1e-10, 6) AS total FROM (SELECT coalesce(venue, '') AS venue, coalesce(symbol, '') AS symbol, coalesce(is_snapshot, false) AS is_snapshot, coalesce(event_time_us, 0) AS event_time_us, coalesce(ingest_time_us, 0) AS ingest_time_us, coalesce(sequence, 0) AS sequence,
  CAST(len(coalesce(bids, [])) AS INTEGER) AS n_bids, CAST(len(coalesce(asks, [])) AS INTEGER) AS n_asks, list_sum(list_transform(list_concat(coalesce(bids, []), coalesce(asks, [])), lambda l: coalesce(l.price, 0.0) * coalesce(l.size, 0.0))) AS total FROM book_deltas)""")
def framed_book_deltas(spark, d):
    """Book changes through the same records, with their levels."""
    registry = schemas.Registry()
    schema = schemas.record("book_delta")
    number = registry.register("md.book-value", schema)
    back = frames.decode_frames(frames.encode_rows(table(spark, d, "book_deltas"), schema, number), registry, schema, schemas.DDL["book_delta"]).where("error is null")
    levels = F.transform(F.concat("bids", "asks"), lambda l: l["price"] * l["size"])
    total = F.when(F.size(levels) > 0, F.aggregate(levels, F.lit(0.0), lambda x, y: x + y))
    return back.select("venue", "symbol", "is_snapshot", "event_time_us", "ingest_time_us", "sequence", F.size("bids").alias("n_bids"), F.size("asks").alias("n_asks"), F.round(total + 1e-10, 6).alias("total"))


@query(f"""WITH {_VS}, {_canon('trades')} SELECT venue, symbol, trade_id, price, size, side, event_time_us, ingest_time_us, sequence FROM c_trades WHERE symbol = 'KAXRO-USD' AND {ref._VALID} AND event_time_us >= 1740960000000000 AND event_time_us < 1741003200000000""")
def lake_scan(spark, d):
    """Valid trades appended to a new lake, and half a day of one symbol read back."""
    path = f"{shared_dir(spark)}/lake-{uuid.uuid4().hex}"
    will_vanish(spark, path)
    lake.append(ref._trades(spark, d).where(ref.m.valid_trade()), path)
    return lake.scan(spark, path, 1_740_960_000_000_000, 1_741_003_200_000_000, "KAXRO-USD")


@query("""SELECT feed, arrival AS frame_id, CASE arrival % 3 WHEN 0 THEN 'envelope' ELSE CASE feed WHEN 'kraken' THEN 'subscribe failed: denied' WHEN 'binance' THEN CASE arrival % 2 WHEN 0 THEN 'error 7' ELSE 'malformed level' END ELSE 'rpc error 7' END END AS error
FROM trades, (VALUES ('kraken'), ('binance'), ('evm')) f(feed) WHERE arrival % 3 < 2""")
def frame_errors_of_feeds(spark, d):
    """The errors of the other feeds' frames."""
    t = table(spark, d, "trades").select(F.col("arrival").alias("frame_id"), F.lit(0).cast("bigint").alias("recv_us"))
    broken, even = F.lit("{broken"), F.col("frame_id") % 2 == 0
    error, ok = {
        "kraken": F.lit('{"method":"subscribe","success":false,"error":"denied"}'), "evm": F.lit('{"error":{"code":7,"message":"denied"}}'),
        "binance": F.when(even, '{"error":{"code":7,"msg":"denied"}}').otherwise('{"data":{"e":"depthUpdate","b":[["1.5"]],"a":[]}}'),
    }, {"kraken": '{"method":"subscribe","success":true}', "evm": '{"method":"eth_subscription"}', "binance": '{"data":{"e":"trade","p":"1.5","q":""}}'}
    parts = []
    for feed in error:
        frame = F.when(F.col("frame_id") % 3 == 0, broken).when(F.col("frame_id") % 3 == 1, error[feed]).otherwise(ok[feed])
        parts.append(decode.frame_errors(t.withColumn("frame", frame), feed).select(F.lit(feed).alias("feed"), "frame_id", "error"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {_VS}, {_canon('trades')}, r AS (SELECT venue, symbol, event_time_us // 300000000 * 300000000 AS w, max(price) AS high, min(price) AS low, count(*) AS n FROM c_trades WHERE {ref._VALID} GROUP BY ALL),
s AS (SELECT DISTINCT venue, symbol, window_start_us AS w FROM window_bars), p AS (SELECT count(*) AS shared FROM r JOIN s USING (venue, symbol, w)) SELECT shared, 0::BIGINT AS mismatched, 'equal' AS verdict FROM p""")
def comparison_verdict(spark, d):
    """Bars of the published windows compared with the same bars put together from bars of 1 second: nothing may differ."""
    trades = ref._trades(spark, d)
    whole = b.bars(trades, 300).join(table(spark, d, "window_bars").select("venue", "symbol", "window_start_us").distinct(), ["venue", "symbol", "window_start_us"], "left_semi")
    return serving.comparison_verdict(whole, b.rollup(b.bars(trades, 1), 300))


_C = "replace(replace(upper(trim(symbol)), '/', '-'), '_', '-')"


def _stream(spark, d, name):
    from tickforge.plans.streams import _source

    return _source(spark, d, name).withColumns({"venue": canonical_venue(F.col("venue")), "symbol": canonical_pair(F.col("symbol"))})


def _run(spark, stream, name):
    from tickforge.plans.streams import _finished, _paths
    from tickforge.streaming import jobs

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    out, checkpoint = _paths(spark, name)
    return _finished(spark, jobs.to_files(stream, out, checkpoint), out)


@query(ref._sequence_sql(False, "SELECT venue, scope_symbol AS symbol, u.a AS arrival, u.q AS sequence, u.s AS status, u.m AS missing FROM o").replace("CASE WHEN venue IN ('norvex', 'altamar') THEN '' ELSE symbol END", "symbol").replace(ref._T, f"WITH c_trades AS (SELECT * REPLACE (lower(trim(venue)) AS venue, {_C} AS symbol) FROM trades)").replace("WHERE symbol IS NOT NULL", "WHERE symbol <> ''"))
def stream_sequences(spark, d):
    """Statuses of sequences from a stream, with the state in the state store."""
    from tickforge.streaming import jobs

    return _run(spark, jobs.sequence_stream(_stream(spark, d, "trades").where("symbol is not null")), "sequences")


@query(f"""{ref._D3_.replace(ref._Q, f"WITH c_quotes AS (SELECT * REPLACE (lower(trim(venue)) AS venue, {_C} AS symbol) FROM quotes WHERE bid_price IS NOT NULL AND ask_price IS NOT NULL)").replace("WHERE symbol IS NOT NULL", "WHERE symbol <> ''").replace("AGE", "60000000")} z AS (SELECT *, count(bps) OVER w n, avg(bps) OVER w mu, stddev_samp(bps) OVER w sd FROM o WINDOW w AS (PARTITION BY symbol, venue_a, venue_b ORDER BY quote_id ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING))
SELECT symbol, quote_id AS arrival, venue_a, venue_b, round(bps, 4) AS divergence_bps, round(least(greatest((bps - mu) / sd, -1e6), 1e6), 3) AS zscore, window_start_us, event_time_us FROM z WHERE n >= 4 AND abs(bps) >= 1 AND sd > 0 AND abs((bps - mu) / sd) >= 1.5""")
def stream_divergences(spark, d):
    """The same detector in a stream."""
    from tickforge.streaming import jobs

    q = _stream(spark, d, "quotes").where("symbol is not null and event_time_us > 0").withColumn("arrival", F.col("quote_id"))
    e = _run(spark, jobs.divergence_stream(q, _EARLY), "divergences")
    return e.select("symbol", "arrival", "venue_a", "venue_b", F.round("divergence_bps", 4).alias("divergence_bps"), _within(F.col("zscore")).alias("zscore"), "window_start_us", "event_time_us")


@query(f"""{ref._STATES_SQL.replace(ref._B, f"WITH c_book_deltas AS (SELECT * REPLACE (lower(trim(venue)) AS venue, {_C} AS symbol) FROM book_deltas)")} SELECT session_id, venue, symbol, u.o AS arrival, bp AS bid_price, u.b.size AS bid_size, ap AS ask_price, u.a.size AS ask_size,
  round(CASE WHEN u.bs + u.az > 0 THEN (u.bs - u.az) / (u.bs + u.az) ELSE 0.0 END + 1e-10, 6) AS imbalance, u.e AS event_time_us, emit AS emit_time_us FROM fin WHERE NOT suppressed""")
def stream_quotes(spark, d):
    """Quotes on the grid from a stream of book changes."""
    from tickforge.streaming import jobs

    q = _run(spark, jobs.quote_stream(_stream(spark, d, "book_deltas")), "quotes")
    return q.select("session_id", "venue", "symbol", "arrival", "bid_price", "bid_size", "ask_price", "ask_size", F.round(F.col("imbalance") + 1e-10, 6).alias("imbalance"), "event_time_us", "emit_time_us")


@query("""WITH g AS (SELECT CAST(i AS BIGINT) AS i, ['BTC-USD', 'ETH-USD', 'SOL-USD'][i % 3 + 1] AS symbol, ['binance', 'coinbase', 'kraken'][(i // 3) % 3 + 1] AS venue FROM range(20000) r(i))
SELECT venue, symbol, count(*) AS n, min(1700000000000000 + i * 3333) AS first_us, max(1700000000000000 + i * 3333) AS last_us, CAST(sum(i) AS BIGINT) AS sequence_sum, true AS prices_near, true AS sizes_near, true AS both_sides FROM g GROUP BY ALL""")
def generated_feed(spark, d):
    """A synthetic feed: who trades what and when is fixed; prices lie within 5 basis points of the base, sizes below 2."""
    from tickforge.sources import generate

    base = F.element_at(F.create_map(*[F.lit(x) for kv in generate.BASES.items() for x in kv]), F.col("symbol"))
    return generate.trades(spark, 20_000).groupBy("venue", "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_time_us").alias("first_us"), F.max("event_time_us").alias("last_us"), F.sum("sequence").alias("sequence_sum"),
        F.bool_and(F.abs(F.col("price") / base - 1) <= 0.0006).alias("prices_near"), F.bool_and(F.col("size").between(0, 2)).alias("sizes_near"), (F.countDistinct("side") == 2).alias("both_sides"),
    )
