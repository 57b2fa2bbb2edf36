"""Queries of the market operators over the test tables, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.functions import market as m
from tickforge.functions.canonical import canonical_pair, canonical_venue
from tickforge.operators import bars as b
from tickforge.operators import decode, folds, metrics, scans, serving
from tickforge.operators import divergence as dv
from tickforge.plans.problems import _VS, _canon, canonical
from tickforge.sources import table
from tickforge.sources.shared import write_shared

#: Venues of the test tables, for the SQL alone.
VENUES = ["altamar", "kesto", "norvex", "pirum"]
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _trades(spark: SparkSession, d: str) -> DataFrame:
    return canonical(spark, d, "trades")


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    return canonical(spark, d, "quotes")


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    return canonical(spark, d, "book_deltas")


_T, _Q, _B = (f"WITH {_VS}, {_canon(t)}" for t in ("trades", "quotes", "book_deltas"))
_SIDE = """CASE WHEN side IN ('b', 'B', 'buy', 'BUY', 'Buy', 'bid', 'BID') THEN 'BUY'
  WHEN side IN ('s', 'S', 'sell', 'SELL', 'Sell', 'ask', 'ASK', 'offer', 'OFFER') THEN 'SELL' ELSE 'UNKNOWN' END"""
_VALID = "event_time_us > 0 AND price > 0 AND size >= 0 AND symbol <> ''"
_VALID_DELTA = "event_time_us > 0 AND symbol <> '' AND (coalesce(len(bids), 0) > 0 OR coalesce(len(asks), 0) > 0)"
_BAR = "arg_min(price, (event_time_us, arrival)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (event_time_us, arrival)) AS close"


def _round(df: DataFrame, places: int, *cols: str) -> DataFrame:
    """Rounded in both engines alike: sums differ in the last bits, so exact halves are moved off the edge first."""
    return df.withColumns({c: F.round(F.col(c) + 1e-10, places) for c in cols})


# --- projections and filters -------------------------------------------------------------------------------------------


@query(f"""SELECT arrival, price * size AS notional, {_SIDE} AS side, {_SIDE} = 'BUY' AS is_buy,
  CASE WHEN event_time_us > 0 AND ingest_time_us >= event_time_us THEN (ingest_time_us - event_time_us) / 1000000.0 END AS lag_s FROM trades""")
def trade_columns(spark, d):
    t = table(spark, d, "trades")
    return t.select("arrival", m.notional("price", "size").alias("notional"), m.side("side").alias("side"), m.is_buy("side").alias("is_buy"), m.lag_seconds("event_time_us", "ingest_time_us").alias("lag_s"))


@query("""SELECT quote_id, round((bid_price + ask_price) / 2, 8) AS mid, CASE WHEN bid_price > 0 AND ask_price > 0 THEN round((ask_price - bid_price) / ((bid_price + ask_price) / 2) * 10000, 6) ELSE 0.0 END AS spread_bps,
  coalesce(bid_price > 0 AND ask_price > 0 AND ask_price >= bid_price, false) AS is_valid, coalesce(bid_price >= ask_price, false) AS is_crossed, 1750000000000000 - event_time_us AS age_us FROM quotes""")
def quote_columns(spark, d):
    q = table(spark, d, "quotes")
    return q.select(
        "quote_id", F.round(m.mid("bid_price", "ask_price"), 8).alias("mid"), F.round(m.spread_bps("bid_price", "ask_price"), 6).alias("spread_bps"),
        m.is_valid_quote("bid_price", "ask_price").alias("is_valid"), m.is_crossed("bid_price", "ask_price").alias("is_crossed"), m.quote_age_us(1_750_000_000_000_000, "event_time_us").alias("age_us"),
    )


@query("""SELECT divergence_id, round(CASE WHEN (price_a + price_b) / 2 > 0 THEN (price_b - price_a) / ((price_a + price_b) / 2) * 10000 END, 4) AS bps,
  least(venue_a, venue_b) AS venue_first, greatest(venue_a, venue_b) AS venue_second FROM divergences""")
def divergence_columns(spark, d):
    x = table(spark, d, "divergences").withColumn("p", m.ordered_pair("venue_a", "venue_b"))
    return x.select("divergence_id", F.round(m.divergence_bps("price_a", "price_b"), 4).alias("bps"), F.col("p.first").alias("venue_first"), F.col("p.second").alias("venue_second"))


@query(f"""{_T} SELECT symbol, count(*) AS n, count(DISTINCT venue) AS venues FROM c_trades WHERE {_VALID} GROUP BY symbol""")
def valid_trades(spark, d):
    return _trades(spark, d).where(m.valid_trade()).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("venue").alias("venues"))


@query(f"""{_B} SELECT session_id, venue, count(*) AS n, sum(len(bids)) AS bids, sum(len(asks)) AS asks FROM c_book_deltas WHERE {_VALID_DELTA} GROUP BY ALL""")
def valid_deltas(spark, d):
    return _deltas(spark, d).where(m.valid_delta()).groupBy("session_id", "venue").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("bids").isNotNull(), F.size("bids"))).alias("bids"), F.sum(F.when(F.col("asks").isNotNull(), F.size("asks"))).alias("asks"))


@query("""SELECT symbol, replace(symbol, '-', '/') AS slashed, replace(regexp_replace(symbol, '-USD$', '-USDT'), '-', '') AS joined FROM symbols""")
def symbol_forms(spark, d):
    return table(spark, d, "symbols").select("symbol", m.slashed_symbol("symbol").alias("slashed"), m.joined_symbol("symbol").alias("joined"))


@query("""WITH w AS (SELECT DISTINCT replace(regexp_replace(symbol, '-USD$', '-USDT'), '-', '') w FROM symbols)
SELECT w AS word, CASE WHEN w LIKE '%_USDT' THEN w[:-5] || '-USD' WHEN w LIKE '%_USDC' THEN w[:-5] || '-USDC' WHEN w LIKE '%_TUSD' THEN w[:-5] || '-TUSD' WHEN w LIKE '%_FDUSD' THEN w[:-6] || '-FDUSD'
  WHEN w LIKE '%_BUSD' THEN w[:-5] || '-BUSD' WHEN w LIKE '%_USD' THEN w[:-4] || '-USD' WHEN w LIKE '%_BTC' THEN w[:-4] || '-BTC' WHEN w LIKE '%_ETH' THEN w[:-4] || '-ETH' WHEN w LIKE '%_BNB' THEN w[:-4] || '-BNB' ELSE w END AS symbol FROM w""")
def symbol_split(spark, d):
    return table(spark, d, "symbols").select(m.joined_symbol("symbol").alias("word")).distinct().select("word", m.split_symbol("word").alias("symbol"))


@query("""SELECT v.venue, v.symbol, v.venue_symbol, s.base_asset, s.quote_asset, CAST(s.tick_size AS DOUBLE) AS tick_size, s.active
  FROM venue_symbols v JOIN symbols s ON v.symbol = s.symbol""")
def symbol_mapping(spark, d):
    v, s = table(spark, d, "venue_symbols"), table(spark, d, "symbols")
    return v.join(s, "symbol").select("venue", "symbol", "venue_symbol", "base_asset", "quote_asset", F.col("tick_size").cast("double").alias("tick_size"), "active")


@query("""SELECT arrival, floor(price * 100 + 0.5) / 100 AS rounded, CASE WHEN arrival % 3 = 0 THEN 'trades' WHEN arrival % 3 = 1 THEN 'book' ELSE 'unknown' END AS channel FROM trades""")
def rounding_and_channels(spark, d):
    kind = F.when(F.col("arrival") % 3 == 0, "trade").when(F.col("arrival") % 3 == 1, "book_delta").otherwise("other")
    return table(spark, d, "trades").select("arrival", m.cents("price").alias("rounded"), m.channel(kind).alias("channel"))


# --- bars ---------------------------------------------------------------------------------------------------------------


@query(f"""{_T} SELECT venue, symbol, event_time_us // 60000000 * 60000000 AS window_start_us, event_time_us // 60000000 * 60000000 + 60000000 AS window_end_us, {_BAR},
  round(sum(size) + 1e-10, 6) AS volume, round(CASE WHEN sum(size) > 0 THEN sum(price * size) / sum(size) ELSE 0.0 END + 1e-10, 6) AS vwap, count(*) AS trade_count FROM c_trades WHERE {_VALID} GROUP BY ALL""")
def bars_1m(spark, d):
    return _round(b.bars(_trades(spark, d), 60), 6, "volume", "vwap")


@query(f"""{_T}, f AS (SELECT venue, symbol, event_time_us // 1000000 * 1000000 AS ws, {_BAR}, sum(size) AS volume, CASE WHEN sum(size) > 0 THEN sum(price * size) / sum(size) ELSE 0.0 END AS vwap, count(*) AS n
  FROM c_trades WHERE {_VALID} GROUP BY ALL)
SELECT symbol, venue, ws // 60000000 * 60000000 AS window_start_us, arg_min(open, ws) AS open, max(high) AS high, min(low) AS low, arg_max(close, ws) AS close, round(sum(volume) + 1e-10, 6) AS volume,
  round(CASE WHEN sum(volume) > 0 THEN sum(vwap * volume) / sum(volume) ELSE 0.0 END + 1e-10, 6) AS vwap, CAST(sum(n) AS BIGINT) AS trade_count FROM f GROUP BY ALL""")
def bars_1s_to_1m(spark, d):
    return _round(b.rollup(b.bars(_trades(spark, d), 1), 60), 6, "volume", "vwap")


@query(f"""{_T} SELECT venue, symbol, {_BAR}, round(sum(size) + 1e-10, 6) AS volume, count(*) AS trade_count, min(event_time_us) AS first_us, max(event_time_us) AS last_us,
  round(CASE WHEN sum(size) > 0 THEN sum(price * size) / sum(size) ELSE 0.0 END + 1e-10, 6) AS vwap FROM c_trades WHERE {_VALID} GROUP BY ALL""")
def bars_whole(spark, d):
    return _round(b.fold_bar(_trades(spark, d)), 6, "volume", "vwap")


@query(f"""WITH {_VS}, lake AS (SELECT * REPLACE (coalesce(symbol, '') AS symbol), event_time_us AS arrival0 FROM lake_trades), t AS (SELECT DISTINCT lower(trim(venue)) AS venue,
  replace(replace(upper(trim(symbol)), '/', '-'), '_', '-') AS symbol, trade_id, price, size, event_time_us, sequence FROM lake WHERE event_time_us >= 1740960000000000 AND event_time_us < 1741046400000000
  AND file_id IN (SELECT file_id FROM lake_files WHERE committed_at IS NOT NULL AND replaced_by IS NULL)), a AS (SELECT *, trade_id AS arrival FROM t)
SELECT venue, symbol, event_time_us // 300000000 * 300000000 AS window_start_us, event_time_us // 300000000 * 300000000 + 300000000 AS window_end_us, {_BAR}, round(sum(size) + 1e-10, 6) AS volume,
  round(CASE WHEN sum(size) > 0 THEN sum(price * size) / sum(size) ELSE 0.0 END + 1e-10, 6) AS vwap, count(*) AS trade_count FROM a WHERE {_VALID} GROUP BY ALL""")
def backfill_day(spark, d):
    """Replay of one day from the lake through the same bars function; the range reaches the Parquet scan."""
    from tickforge.operators.compaction import live_files

    lake = table(spark, d, "lake_trades").where("event_time_us >= 1740960000000000 and event_time_us < 1741046400000000")
    live = lake.join(live_files(table(spark, d, "lake_files")).select("file_id"), "file_id", "left_semi")
    rows = live.select(canonical_venue(F.col("venue")).alias("venue"), canonical_pair(F.col("symbol")).alias("symbol"), "trade_id", "price", "size", "event_time_us", "sequence").distinct()
    return _round(b.bars(rows, 300, "trade_id"), 6, "volume", "vwap")


# --- quotes and divergence -----------------------------------------------------------------------------------------------


@query(f"""{_Q} SELECT symbol, venue, arg_max((bid_price, ask_price, quote_id), (event_time_us, quote_id))[3] AS quote_id, max(event_time_us) AS event_time_us FROM c_quotes WHERE symbol IS NOT NULL AND event_time_us > 0 GROUP BY ALL""")
def latest_quotes(spark, d):
    q = _quotes(spark, d).where("symbol is not null and event_time_us > 0").withColumn("tie", F.col("quote_id"))
    return serving.latest_quotes(q, "tie").select("symbol", "venue", "quote_id", "event_time_us")


@query(f"""{_Q}, l AS (SELECT * FROM c_quotes WHERE symbol IS NOT NULL AND event_time_us > 0 QUALIFY row_number() OVER (PARTITION BY symbol, venue ORDER BY event_time_us DESC, quote_id DESC) = 1)
SELECT symbol, venue, quote_id FROM l WHERE bid_price > 0 AND ask_price > 0 AND ask_price >= bid_price QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY event_time_us DESC, venue) = 1""")
def best_quotes(spark, d):
    q = _quotes(spark, d).where("symbol is not null and event_time_us > 0").withColumn("tie", F.col("quote_id"))
    return serving.best_quotes(serving.latest_quotes(q, "tie")).select("symbol", "venue", "quote_id")


_D3_ = f"""{_Q}, q0 AS (SELECT * FROM c_quotes WHERE symbol IS NOT NULL AND event_time_us > 0 AND venue IN ('altamar', 'kesto', 'norvex', 'pirum')),
q1 AS (SELECT *, max(event_time_us) OVER (PARTITION BY symbol, venue ORDER BY quote_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) seen FROM q0),
q AS (SELECT symbol, venue, quote_id, event_time_us t, struct_pack(t := event_time_us, m := (bid_price + ask_price) / 2, ok := coalesce(bid_price > 0 AND ask_price > 0 AND ask_price >= bid_price, false)) s FROM q1 WHERE seen IS NULL OR event_time_us >= seen),
n AS (SELECT symbol, quote_id, t, {", ".join(f"last_value(CASE WHEN venue = '{v}' THEN s END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY quote_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {v}" for v in VENUES)} FROM q),
p AS ({" UNION ALL ".join(f"SELECT symbol, quote_id, t, '{x}' venue_a, '{y}' venue_b, {x} a, {y} b FROM n" for i, x in enumerate(VENUES) for y in VENUES[i + 1:])}),
o AS (SELECT symbol, quote_id, venue_a, venue_b, a.m price_a, b.m price_b, least(a.t, b.t) window_start_us, greatest(a.t, b.t) event_time_us, (b.m - a.m) / ((a.m + b.m) / 2) * 10000 AS bps
  FROM p WHERE a.ok AND b.ok AND t - a.t <= AGE AND t - b.t <= AGE),
"""
_D3 = _D3_.replace("AGE", "5000000")


@query(f"""{_D3} z AS (SELECT 1) SELECT symbol, venue_a, venue_b, count(*) AS n, round(sum(bps), 3) AS bps_sum, min(window_start_us) AS first_us, max(event_time_us) AS last_us FROM o GROUP BY ALL""")
def pair_observations(spark, d):
    q = _quotes(spark, d).where("symbol is not null and event_time_us > 0")
    o = dv.pair_observations(q, dv.venues_of(q), "quote_id")
    return o.groupBy("symbol", "venue_a", "venue_b").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("divergence_bps"), 3).alias("bps_sum"), F.min("window_start_us").alias("first_us"), F.max("event_time_us").alias("last_us"))


@query(f"""{_D3} z AS (SELECT *, count(bps) OVER w n, avg(bps) OVER w mu, stddev_samp(bps) OVER w sd FROM o WINDOW w AS (PARTITION BY symbol, venue_a, venue_b ORDER BY quote_id ROWS BETWEEN 600 PRECEDING AND 1 PRECEDING))
SELECT symbol, quote_id, venue_a, venue_b, round(bps, 4) AS divergence_bps, round((bps - mu) / sd, 3) AS zscore, window_start_us, event_time_us FROM z WHERE n >= 30 AND abs(bps) >= 5 AND sd > 0 AND abs((bps - mu) / sd) >= 3""")
def divergence_events(spark, d):
    q = _quotes(spark, d).where("symbol is not null and event_time_us > 0")
    e = dv.divergences(q, dv.venues_of(q), "quote_id")
    return e.select("symbol", "quote_id", "venue_a", "venue_b", F.round("divergence_bps", 4).alias("divergence_bps"), F.round("zscore", 3).alias("zscore"), "window_start_us", "event_time_us")


@query("""SELECT divergence_id, symbol FROM divergences WHERE abs(divergence_bps) >= 20 AND abs(zscore) >= 4""")
def divergence_subscription(spark, d):
    return dv.subscription(table(spark, d, "divergences"), 20, 4).select("divergence_id", "symbol")


# --- books ----------------------------------------------------------------------------------------------------------------


@query(f"""{_B}, v AS (SELECT session_id, venue, symbol, arrival, coalesce(is_snapshot, false) sn, bids, asks FROM c_book_deltas WHERE {_VALID_DELTA}),
s AS (SELECT session_id, venue, symbol, max(arrival) snap FROM v WHERE sn GROUP BY ALL),
l AS (SELECT session_id, venue, symbol, arrival, 'bid' side, unnest(bids) lv, unnest(range(len(bids))) i FROM v UNION ALL SELECT session_id, venue, symbol, arrival, 'ask', unnest(asks), unnest(range(len(asks))) FROM v),
z AS (SELECT session_id, venue, symbol, side, lv.price price, arg_max(lv.size, (arrival, i)) size FROM l LEFT JOIN s USING (session_id, venue, symbol) WHERE (snap IS NULL OR arrival >= snap) AND lv.price IS NOT NULL GROUP BY ALL)
SELECT session_id, venue, symbol, side, price, size, row_number() OVER (PARTITION BY session_id, venue, symbol, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) AS level FROM z WHERE size > 0""")
def book_levels(spark, d):
    """Books in order of arrival without a depth limit, by the streamed fold."""
    return folds.final_books(_deltas(spark, d), depth=1_000_000)


_LEVEL = "STRUCT(price DOUBLE, size DOUBLE)[]"


def _patched(side: str, best: str) -> str:
    """A side after a change, in SQL: its levels applied one by one, then the best 50."""
    start = f"CASE WHEN x.sn THEN []::{_LEVEL} ELSE acc.{side} END"
    step = "{price: l.price, size: l.size, s: CASE WHEN l.size > 0 THEN list_append(list_filter(b.s, lambda y: y.price <> l.price), {price: l.price, size: l.size}) ELSE list_filter(b.s, lambda y: y.price <> l.price) END}"
    levels = f"list_transform(list_filter(coalesce(x.d_{side}, []), lambda l: l.price IS NOT NULL), lambda l: {{price: l.price, size: coalesce(l.size, 0), s: []::{_LEVEL}}})"
    return f"list_reduce(list_prepend({{price: 0::DOUBLE, size: 0::DOUBLE, s: {start}}}, {levels}), lambda b, l: {step}).s".join(("list_sort(", f", '{best}')[1:50]"))


@query(f"""{_B}, src AS (SELECT session_id, venue, symbol, arrival, coalesce(is_snapshot, false) sn, bids, asks FROM c_book_deltas WHERE {_VALID_DELTA}),
k AS (SELECT session_id, venue, symbol, list({{sn: sn, d_bids: bids, d_asks: asks, bids: []::{_LEVEL}, asks: []::{_LEVEL}}} ORDER BY arrival) xs FROM src GROUP BY ALL),
f AS (SELECT session_id, venue, symbol, list_reduce(list_prepend({{sn: false, d_bids: []::{_LEVEL}, d_asks: []::{_LEVEL}, bids: []::{_LEVEL}, asks: []::{_LEVEL}}}, xs),
  lambda acc, x: {{sn: x.sn, d_bids: x.d_bids, d_asks: x.d_asks, bids: {_patched('bids', 'DESC')}, asks: {_patched('asks', 'ASC')}}}) r FROM k)
SELECT session_id, venue, symbol, 'bid' AS side, unnest(r.bids).price AS price, unnest(r.bids).size AS size, unnest(range(1, len(r.bids) + 1)) AS level FROM f
UNION ALL SELECT session_id, venue, symbol, 'ask', unnest(r.asks).price, unnest(r.asks).size, unnest(range(1, len(r.asks) + 1)) FROM f""")
def book_levels_trimmed(spark, d):
    """The same with the best 50 levels kept after each change, which depends on the path."""
    return folds.final_books(_deltas(spark, d), depth=50)


_TOP = f"b: {{0}}.bids[1], a: {{0}}.asks[1], bs: coalesce(list_sum(list_transform({{0}}.bids[1:5], lambda y: y.size)), 0), az: coalesce(list_sum(list_transform({{0}}.asks[1:5], lambda y: y.size)), 0), o: {{0}}.o, e: {{0}}.e, sn: {{0}}.sn"
_NO_BOOK = f"bids: []::{_LEVEL}, asks: []::{_LEVEL}, out: []::STRUCT(b STRUCT(price DOUBLE, size DOUBLE), a STRUCT(price DOUBLE, size DOUBLE), bs DOUBLE, az DOUBLE, o BIGINT, e BIGINT, sn BOOLEAN)[]"
# Each step adds the book as it was before; the last book is added at the end, the empty one at the begin taken off.
_STATES_SQL = f"""{_B}, src AS (SELECT session_id, venue, symbol, arrival, event_time_us, coalesce(is_snapshot, false) sn, bids, asks FROM c_book_deltas WHERE {_VALID_DELTA}),
k AS (SELECT session_id, venue, symbol, list({{o: arrival, e: event_time_us, sn: sn, d_bids: bids, d_asks: asks, {_NO_BOOK}}} ORDER BY arrival) xs FROM src GROUP BY ALL),
f AS (SELECT session_id, venue, symbol, list_reduce(list_prepend({{o: 0::BIGINT, e: 0::BIGINT, sn: false, d_bids: []::{_LEVEL}, d_asks: []::{_LEVEL}, {_NO_BOOK}}}, xs),
  lambda acc, x: {{o: x.o, e: x.e, sn: x.sn, d_bids: x.d_bids, d_asks: x.d_asks, bids: {_patched('bids', 'DESC')}, asks: {_patched('asks', 'ASC')}, out: list_append(acc.out, {{{_TOP.format('acc')}}})}}) r FROM k),
st AS (SELECT session_id, venue, symbol, unnest(list_append(r.out, {{{_TOP.format('r')}}})[2:]) u FROM f),
tk AS (SELECT *, (max(u.e // 100000) OVER (PARTITION BY session_id, venue, symbol ORDER BY u.o) + 1) * 100000 emit FROM st),
la AS (SELECT session_id, venue, symbol, emit, arg_max(u, u.o) u FROM tk GROUP BY ALL),
qs AS (SELECT *, u.b.price bp, u.a.price ap, coalesce(u.b.price >= u.a.price, false) crossed, coalesce(u.b.price > 0 AND u.b.price <= u.a.price, false) AND NOT coalesce(u.b.price >= u.a.price, false) ok FROM la),
pv AS (SELECT *, lag({{b: u.b, a: u.a, bs: u.bs, az: u.az, e: u.e}}) OVER (PARTITION BY session_id, venue, symbol, ok ORDER BY emit) p FROM qs),
fin AS (SELECT *, crossed OR coalesce(ok AND p = {{b: u.b, a: u.a, bs: u.bs, az: u.az, e: u.e}}, false) suppressed FROM pv WHERE crossed OR ok)"""


@query(f"""{_STATES_SQL} SELECT session_id, venue, symbol, bp AS bid_price, u.b.size AS bid_size, ap AS ask_price, u.a.size AS ask_size, (bp + ap) / 2 AS mid, round((ap - bp) / ((bp + ap) / 2) * 1e4 + 1e-10, 6) AS spread_bps,
  round(CASE WHEN u.bs + u.az > 0 THEN (u.bs - u.az) / (u.bs + u.az) ELSE 0.0 END + 1e-10, 6) AS imbalance, u.e AS event_time_us, emit AS emit_time_us FROM fin WHERE NOT suppressed""")
def book_quotes(spark, d):
    q = folds.book_ticks(folds.book_states(_deltas(spark, d))).where("not suppressed").drop("crossed", "suppressed")
    return q.withColumns({c: F.round(F.col(c) + 1e-10, 6) for c in ("spread_bps", "imbalance")})


@query(f"""{_STATES_SQL}, a AS (SELECT session_id, venue, symbol, count(*) FILTER (WHERE u.b.price >= u.a.price) AS crossed_books, count(*) FILTER (WHERE u.sn) AS snapshots_applied FROM st GROUP BY ALL),
n AS (SELECT session_id, venue, symbol, count(*) FILTER (WHERE NOT suppressed) AS quotes_emitted, count(*) FILTER (WHERE suppressed) AS quotes_suppressed FROM fin GROUP BY ALL)
SELECT session_id, venue, symbol, crossed_books, snapshots_applied, coalesce(quotes_emitted, 0) AS quotes_emitted, coalesce(quotes_suppressed, 0) AS quotes_suppressed FROM a LEFT JOIN n USING (session_id, venue, symbol)""")
def book_counters(spark, d):
    states = spark.read.parquet(write_shared(folds.book_states(_deltas(spark, d)), "states"))  # read twice
    return folds.book_counters(states, folds.book_ticks(states))


_SUM5 = "coalesce(list_sum(list_transform(coalesce({}, [])[1:5], lambda l: coalesce(l.size, 0))), 0)"


@query(f"""WITH x AS (SELECT arrival, {_SUM5.format('bids')} b, {_SUM5.format('asks')} a FROM book_deltas WHERE is_snapshot)
SELECT arrival, round(CASE WHEN a + b > 0 THEN (b - a) / (b + a) ELSE 0.0 END, 9) AS imbalance FROM x""")
def snapshot_imbalance(spark, d):
    return table(spark, d, "book_deltas").where("is_snapshot").select("arrival", F.round(m.depth_imbalance("bids", "asks"), 9).alias("imbalance"))


# --- sequences --------------------------------------------------------------------------------------------------------------


def _fold_sql(source: str, keys: str, order: str, item: str, state: str, start: str, step: str, out: str) -> str:
    """A fold in SQL: the rows of a key as a list, reduced to a state whose ``out`` grows by an element per row."""
    return f"""{source}, k AS (SELECT {keys}, list({{{item}, {start}}} ORDER BY {order}) xs FROM src GROUP BY ALL),
f AS (SELECT {keys}, list_reduce(list_prepend({{{state}, {start}}}, xs), lambda acc, x: {step}) r FROM k), o AS (SELECT {keys}, unnest(r.out) u FROM f) {out}"""


def _sequence_sql(resync: bool, out: str) -> str:
    gap = "NULL" if resync else "x.q"
    source = f"""{_T}, src AS (SELECT venue, CASE WHEN venue IN ('norvex', 'altamar') THEN '' ELSE symbol END AS scope_symbol, CASE WHEN venue IN ('norvex', 'altamar') THEN 'connection' ELSE 'trades' END AS scope_channel,
      arrival, sequence FROM c_trades WHERE symbol IS NOT NULL)"""
    step = f"""{{a: x.a, q: x.q, last: CASE WHEN x.q < 0 THEN acc.last WHEN acc.last IS NULL OR x.q = acc.last + 1 THEN x.q WHEN x.q > acc.last + 1 THEN {gap} WHEN acc.last - x.q <= 1000 THEN acc.last ELSE {gap} END,
      out: list_append(acc.out, {{a: x.a, q: x.q, s: CASE WHEN x.q < 0 THEN 'unsequenced' WHEN acc.last IS NULL THEN 'first' WHEN x.q = acc.last + 1 THEN 'ok' WHEN x.q > acc.last + 1 THEN 'gap'
      WHEN acc.last - x.q <= 1000 THEN 'duplicate' ELSE 'regression' END, m: CASE WHEN x.q >= 0 AND x.q > acc.last + 1 THEN x.q - acc.last - 1 ELSE 0 END}})}}"""
    start = "last: NULL::BIGINT, out: []::STRUCT(a BIGINT, q BIGINT, s VARCHAR, m BIGINT)[]"
    return _fold_sql(source, "venue, scope_symbol, scope_channel", "arrival", "a: arrival, q: sequence", "a: 0::BIGINT, q: 0::BIGINT", start, step, out)


@query(_sequence_sql(False, "SELECT venue, scope_symbol, scope_channel, u.a AS arrival, u.q AS sequence, u.s AS status, u.m AS missing FROM o"))
def sequence_status(spark, d):
    t = _trades(spark, d).select("venue", "symbol", "arrival", "sequence").where("symbol is not null")
    return folds.sequence_status(folds.connection_scope(t, ["norvex", "altamar"], "trades"), ["venue", "scope_symbol", "scope_channel"], "arrival")


@query(_sequence_sql(True, """SELECT venue, scope_channel, count(*) AS received, count(*) FILTER (WHERE u.s <> 'duplicate') AS published, count(*) FILTER (WHERE u.s = 'duplicate') AS duplicates, count(*) FILTER (WHERE u.s = 'gap') AS gaps,
  count(*) FILTER (WHERE u.s = 'regression') AS regressions, CAST(sum(u.m) AS BIGINT) AS missed FROM o GROUP BY ALL"""))
def sequence_stats(spark, d):
    """Counters of the pipeline, where a gap or regression makes the key unknown again."""
    t = _trades(spark, d).select("venue", "symbol", "arrival", "sequence").where("symbol is not null")
    s = folds.sequence_status(folds.connection_scope(t, ["norvex", "altamar"], "trades"), ["venue", "scope_symbol", "scope_channel"], "arrival", resync=True)
    return metrics.pipeline_stats(s, "venue", "scope_channel")


@query(f"""{_T}, r AS (SELECT venue, arrival, sequence, max(sequence) OVER (PARTITION BY venue ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) prior FROM c_trades WHERE sequence >= 0)
SELECT venue, count(*) AS n, count(*) FILTER (WHERE sequence > prior + 1) AS gaps, CAST(coalesce(sum(sequence - prior - 1) FILTER (WHERE sequence > prior + 1), 0) AS BIGINT) AS missing, count(*) FILTER (WHERE sequence <= prior) AS behind FROM r GROUP BY venue""")
def sequence_running_max(spark, d):
    """Gaps against the highest sequence so far, where counters don't restart."""
    r = scans.running_max_before(_trades(spark, d).where("sequence >= 0").select("venue", "arrival", "sequence"), ["venue"], "arrival", "sequence", "prior")
    gap = F.col("sequence") > F.col("prior") + 1
    return r.groupBy("venue").agg(F.count(F.lit(1)).alias("n"), F.count_if(gap).alias("gaps"), F.coalesce(F.sum(F.when(gap, F.col("sequence") - F.col("prior") - 1)), F.lit(0)).alias("missing"), F.count_if(F.col("sequence") <= F.col("prior")).alias("behind"))


@query(_fold_sql(
    f"{_B}, src AS (SELECT session_id, venue, symbol, arrival, sequence u0, sequence + arrival % 3 u1 FROM c_book_deltas WHERE symbol IS NOT NULL AND sequence >= 0)", "session_id, venue, symbol", "arrival",
    "a: arrival, u0: u0, u1: u1", "a: 0::BIGINT, u0: 0::BIGINT, u1: 0::BIGINT", "f: NULL::BIGINT, n: 0::BIGINT, out: []::STRUCT(a BIGINT, n BIGINT)[]",
    """{a: x.a, u0: x.u0, u1: x.u1, f: CASE WHEN acc.f IS NULL OR x.u0 > acc.f THEN x.u1 ELSE greatest(acc.f, x.u1) END,
      n: CASE WHEN acc.f IS NULL THEN 0 WHEN x.u0 = acc.f + 1 THEN acc.n + 1 WHEN x.u0 <= acc.f THEN acc.n ELSE acc.n + greatest(1, x.u0 - acc.f - 1) + 1 END,
      out: list_append(acc.out, {a: x.a, n: CASE WHEN acc.f IS NULL THEN 0 WHEN x.u0 = acc.f + 1 THEN acc.n + 1 WHEN x.u0 <= acc.f THEN acc.n ELSE acc.n + greatest(1, x.u0 - acc.f - 1) + 1 END})}""",
    "SELECT session_id, venue, symbol, u.a AS arrival, u.n AS dense FROM o"))
def dense_sequences(spark, d):
    x = _deltas(spark, d).where("symbol is not null and sequence >= 0").select("session_id", "venue", "symbol", "arrival", F.col("sequence").alias("u0"), (F.col("sequence") + F.col("arrival") % 3).alias("u1"))
    return folds.dense_sequence(x, ["session_id", "venue", "symbol"], "arrival", "u0", "u1")


# --- frames -------------------------------------------------------------------------------------------------------------------

_RFC = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _rfc(us: str) -> Column:
    return F.date_format(F.timestamp_micros(us), _RFC)


def coinbase_frames(trades: DataFrame) -> DataFrame:
    """Five deliveries a frame, as one event."""
    trade = F.struct(F.col("trade_id"), F.col("symbol").alias("product_id"), F.col("price").cast("string").alias("price"), F.col("size").cast("string").alias("size"), F.col("side"), _rfc("event_time_us").alias("time"))
    frames = trades.groupBy(F.expr("arrival div 5").alias("frame_id")).agg(F.max("ingest_time_us").alias("recv_us"), F.array_sort(F.collect_list(F.struct("arrival", trade.alias("t")))).alias("ts"))
    return frames.select("frame_id", "recv_us", F.to_json(F.struct(F.lit("market_trades").alias("channel"), F.col("frame_id").alias("sequence_num"), F.array(F.struct(F.lit("update").alias("type"), F.col("ts.t").alias("trades"))).alias("events"))).alias("frame"))


@query(f"""WITH f AS (SELECT *, arrival // 5 frame_id, max(ingest_time_us) OVER (PARTITION BY arrival // 5) recv, arrival = min(arrival) OVER (PARTITION BY arrival // 5) first FROM trades)
SELECT 'coinbase' AS venue, nullif(replace(replace(upper(trim(symbol)), '/', '-'), '_', '-'), '') AS symbol, trade_id, coalesce(price, 0.0) AS price, coalesce(size, 0.0) AS size, {_SIDE} AS side, event_time_us, recv AS ingest_time_us, CASE WHEN first THEN frame_id ELSE -1 END AS sequence FROM f""")
def decoded_coinbase_trades(spark, d):
    return decode.coinbase_trades(coinbase_frames(table(spark, d, "trades")))


@query(f"""SELECT 'kraken' AS venue, nullif(replace(replace(upper(trim(symbol)), '/', '-'), '_', '-'), '') AS symbol, CAST(arrival AS VARCHAR) AS trade_id, coalesce(price, 0.0) AS price, coalesce(size, 0.0) AS size, {_SIDE} AS side,
  event_time_us, ingest_time_us, arrival AS sequence FROM trades""")
def decoded_kraken_trades(spark, d):
    data = F.array(F.struct("symbol", "side", "price", F.col("size").alias("qty"), F.col("arrival").alias("trade_id"), _rfc("event_time_us").alias("timestamp")))
    frames = table(spark, d, "trades").select(F.col("arrival").alias("frame_id"), F.col("ingest_time_us").alias("recv_us"), F.to_json(F.struct(F.lit("trade").alias("channel"), F.lit("update").alias("type"), data.alias("data"))).alias("frame"))
    return decode.kraken_trades(frames)


@query("""SELECT 'binance' AS venue, CAST(arrival AS VARCHAR) AS trade_id, coalesce(price, 0.0) AS price, coalesce(size, 0.0) AS size, CASE WHEN arrival % 2 = 0 THEN 'SELL' ELSE 'BUY' END AS side,
  event_time_us // 1000 * 1000 AS event_time_us, ingest_time_us, arrival AS sequence FROM trades WHERE event_time_us > 1000""")
def decoded_binance_trades(spark, d):
    """The ignored flag M contradicts m in every frame."""
    e = F.struct(
        F.lit("trade").alias("e"), F.expr("ingest_time_us div 1000").alias("E"), F.lit("BTCUSDT").alias("s"), F.col("arrival").alias("t"), F.col("price").cast("string").alias("p"), F.col("size").cast("string").alias("q"),
        F.expr("event_time_us div 1000").alias("T"), (F.col("arrival") % 2 == 0).alias("m"), (F.col("arrival") % 2 == 1).alias("M"),
    )
    frames = table(spark, d, "trades").where("event_time_us > 1000").select(F.col("arrival").alias("frame_id"), F.col("ingest_time_us").alias("recv_us"), F.to_json(F.struct(e.alias("data"))).alias("frame"))
    return decode.binance_trades(frames).drop("symbol")


_LEVELS = "count(*) AS n, sum(coalesce(len(bids), 0)) AS bids, sum(coalesce(len(asks), 0)) AS asks, round(sum(coalesce(list_sum(list_transform(coalesce(bids, []), lambda l: coalesce(l.price * l.size, 0))), 0)) + 1e-6, 2) AS bid_value"


def _book_summary(df: DataFrame) -> DataFrame:
    value = F.aggregate("bids", F.lit(0.0), lambda a, l: a + F.coalesce(l["price"] * l["size"], F.lit(0.0)))
    return df.groupBy("symbol", "is_snapshot").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("bids")).alias("bids"), F.sum(F.size("asks")).alias("asks"), F.round(F.sum(value) + 1e-6, 2).alias("bid_value"))


@query(f"""SELECT nullif(replace(replace(upper(trim(symbol)), '/', '-'), '_', '-'), '') AS symbol, is_snapshot, {_LEVELS} FROM book_deltas WHERE is_snapshot IS NOT NULL AND event_time_us > 0 GROUP BY 1, 2""")
def decoded_kraken_books(spark, d):
    side = lambda c: F.transform(F.coalesce(F.col(c), F.array()), lambda l: F.struct(l["price"].alias("price"), l["size"].alias("qty"))).alias(c)
    data = F.array(F.struct("symbol", side("bids"), side("asks"), _rfc("event_time_us").alias("timestamp")))
    frames = table(spark, d, "book_deltas").where("is_snapshot is not null and event_time_us > 0").select(
        F.col("arrival").alias("frame_id"), F.col("ingest_time_us").alias("recv_us"), F.to_json(F.struct(F.lit("book").alias("channel"), F.when(F.col("is_snapshot"), "snapshot").otherwise("update").alias("type"), data.alias("data"))).alias("frame"))
    return _book_summary(decode.kraken_book(frames))


@query(f"""SELECT nullif(replace(replace(upper(trim(symbol)), '/', '-'), '_', '-'), '') AS symbol, is_snapshot, {_LEVELS} FROM book_deltas WHERE is_snapshot IS NOT NULL AND event_time_us > 0 AND coalesce(len(bids), 0) + coalesce(len(asks), 0) > 0 GROUP BY 1, 2""")
def decoded_coinbase_books(spark, d):
    up = lambda c, s: F.transform(F.coalesce(F.col(c), F.array()), lambda l: F.struct(F.lit(s).alias("side"), _rfc("event_time_us").alias("event_time"), l["price"].cast("string").alias("price_level"), l["size"].cast("string").alias("new_quantity")))
    event = F.struct(F.when(F.col("is_snapshot"), "snapshot").otherwise("update").alias("type"), F.col("symbol").alias("product_id"), F.concat(up("bids", "bid"), up("asks", "offer")).alias("updates"))
    frames = table(spark, d, "book_deltas").where("is_snapshot is not null and event_time_us > 0").select(
        F.col("arrival").alias("frame_id"), F.col("ingest_time_us").alias("recv_us"), F.to_json(F.struct(F.lit("l2_data").alias("channel"), F.col("arrival").alias("sequence_num"), F.array(event).alias("events"))).alias("frame"))
    return _book_summary(decode.coinbase_book(frames))


@query(f"""SELECT 'BTC-USD' AS symbol, false AS is_snapshot, {_LEVELS} FROM book_deltas WHERE event_time_us > 0""")
def decoded_binance_books(spark, d):
    side = lambda c: F.transform(F.coalesce(F.col(c), F.array()), lambda l: F.array(l["price"].cast("string"), l["size"].cast("string")))
    e = F.struct(F.lit("depthUpdate").alias("e"), F.expr("event_time_us div 1000").alias("E"), F.lit("BTCUSDT").alias("s"), F.col("sequence").alias("U"), F.col("sequence").alias("u"), side("bids").alias("b"), side("asks").alias("a"))
    frames = table(spark, d, "book_deltas").where("event_time_us > 0").select(F.col("arrival").alias("frame_id"), F.col("ingest_time_us").alias("recv_us"), F.to_json(F.struct(e.alias("data"))).alias("frame"))
    return _book_summary(decode.binance_book(frames))


_TOKENS = ", ".join(f"({i}, '{a}', '{s}', {n})" for i, (a, s, n) in enumerate(decode.TOKENS))


def evm_frames(trades: DataFrame) -> DataFrame:
    """A log per delivery: seven contracts in turn, the last unknown; a block per ten; amounts beyond 64 bits; every eleventh removed."""
    address = F.element_at(F.array(*[F.lit(a.upper().replace("0X", "0x")) for a, _, _ in decode.TOKENS], F.lit("0x" + "9" * 40)), (F.col("arrival") % 7 + 1).cast("int"))
    topic = lambda x: F.concat(F.lit("0x"), F.lpad(F.hex(x), 64, "0"))
    log = F.struct(
        address.alias("address"), F.array(F.lit(decode.TRANSFER_TOPIC), topic(F.col("arrival")), topic(F.col("batch_id"))).alias("topics"), F.concat(F.lit("0x"), F.hex("arrival"), F.repeat(F.lit("0"), F.lit(16))).alias("data"),
        F.concat(F.lit("0x"), F.hex(F.expr("arrival div 10"))).alias("blockNumber"), F.concat(F.lit("0xAB"), F.hex("arrival")).alias("transactionHash"), F.concat(F.lit("0x"), F.hex(F.col("arrival") % 10)).alias("logIndex"), (F.col("arrival") % 11 == 0).alias("removed"),
    )
    return trades.select(F.col("arrival").alias("frame_id"), F.col("ingest_time_us").alias("recv_us"), F.to_json(F.struct(F.lit("eth_subscription").alias("method"), F.struct(log.alias("result")).alias("params"))).alias("frame"))


@query(f"""WITH k(i, a, s, n) AS (VALUES {_TOKENS}), t AS (SELECT *, arrival // 10 blk, min(arrival) OVER (PARTITION BY arrival // 10) f FROM trades WHERE arrival % 11 <> 0)
SELECT coalesce(a, '0x' || repeat('9', 40)) AS token, coalesce(s, '0x' || repeat('9', 40)) AS symbol, '0x' || lpad(lower(to_hex(arrival)), 40, '0') AS from_addr, CAST(CAST(arrival AS HUGEINT) * 18446744073709551616 AS VARCHAR) AS amount_raw,
  CAST(coalesce(n, 0) AS INTEGER) AS decimals, blk AS block_number, CAST(arrival % 10 AS INTEGER) AS log_index, '0xab' || lower(to_hex(arrival)) AS tx_hash, ingest_time_us AS event_time_us, CASE WHEN arrival = f THEN blk ELSE -1 END AS sequence
FROM t LEFT JOIN k ON t.arrival % 7 = k.i""")
def decoded_transfers(spark, d):
    return decode.evm_transfers(evm_frames(table(spark, d, "trades"))).drop("chain", "to_addr", "ingest_time_us")


@query("""SELECT arrival AS frame_id, CASE arrival % 4 WHEN 0 THEN 'envelope' WHEN 1 THEN 'error frame: denied' ELSE 'malformed number' END AS error FROM trades WHERE arrival % 4 < 3""")
def frame_errors(spark, d):
    ok = F.lit('{"channel":"market_trades","sequence_num":1,"events":[{"trades":[{"price":"1.5","size":"2"}]}]}')
    frame = (
        F.when(F.col("arrival") % 4 == 0, F.concat(F.lit("{broken "), F.col("arrival").cast("string"))).when(F.col("arrival") % 4 == 1, '{"type":"error","message":"denied"}')
        .when(F.col("arrival") % 4 == 2, '{"channel":"market_trades","events":[{"trades":[{"price":"abc","size":"2"}]}]}').otherwise(ok)
    )
    return decode.frame_errors(table(spark, d, "trades").select(F.col("arrival").alias("frame_id"), F.lit(0).cast("bigint").alias("recv_us"), frame.alias("frame")), "coinbase")


# --- serving ----------------------------------------------------------------------------------------------------------------------


@query("""SELECT DISTINCT ON (window_start_us, venue) * FROM window_bars WHERE symbol = 'KAXRO-USD' AND window_start_us >= 1740960000000000 AND window_start_us < 1741046400000000 ORDER BY window_start_us, venue LIMIT 1000""")
def range_query(spark, d):
    return serving.bars_in_range(table(spark, d, "window_bars").distinct(), "KAXRO-USD", 1_740_960_000_000_000, 1_741_046_400_000_000)


@query("""SELECT DISTINCT *, 'lakehouse' AS served_from FROM window_bars WHERE symbol = 'XYGGO-USD' AND venue = 'kesto' AND window_start_us >= 1740960000000000 AND window_start_us < 1740999600000000 ORDER BY window_start_us LIMIT 50000""")
def range_query_cold(spark, d):
    w = table(spark, d, "window_bars").distinct()
    return serving.routed_range(w.limit(0), w, 1_750_000_000_000_000, "XYGGO-USD", 1_740_960_000_000_000, 1_740_999_600_000_000, "kesto", 60_000)


@query("""SELECT (SELECT count(*) FROM window_bars WHERE window_start_us >= 1741130000000000 - 86400000000) AS bars, (SELECT count(*) FROM divergences WHERE event_time_us >= 1741130000000000 - 90 * 86400000000) AS events""")
def retention(spark, d):
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name), F.lit(1).alias("k"))
    bars = serving.unexpired(table(spark, d, "window_bars"), "window_start_us", 1_741_130_000_000_000, 1)
    events = serving.unexpired(table(spark, d, "divergences"), "event_time_us", 1_741_130_000_000_000, serving.DIVERGENCE_TTL_DAYS)
    return n(bars, "bars").join(n(events, "events"), "k").drop("k")


_REPLAY = f"""{_T}, r AS (SELECT symbol, venue, event_time_us // 300000000 * 300000000 AS window_start_us, {_BAR}, sum(size) volume, CASE WHEN sum(size) > 0 THEN sum(price * size) / sum(size) ELSE 0.0 END vwap, count(*) trade_count
  FROM c_trades WHERE {_VALID} GROUP BY ALL), l AS (SELECT DISTINCT * FROM window_bars)"""


@query(f"""{_REPLAY} SELECT symbol, venue, window_start_us, CASE WHEN l.close IS NULL THEN 'replay_only' WHEN r.close IS NULL THEN 'live_only' ELSE 'mismatch' END AS verdict FROM l FULL JOIN r USING (symbol, venue, window_start_us)
WHERE l.close IS NULL OR r.close IS NULL OR abs(l.vwap - r.vwap) > 0.00001 OR l.close <> r.close OR l.trade_count <> r.trade_count""")
def reconciliation(spark, d):
    """Published bars carry six decimals, so the tolerance is wider than for two computed ones."""
    return serving.reconcile(table(spark, d, "window_bars").distinct(), b.bars(_trades(spark, d), 300), 1e-5)


@query(f"""{_REPLAY} SELECT symbol, venue, window_start_us, f AS field, round(x + 1e-10, 6) AS live, round(y + 1e-10, 6) AS replay FROM (SELECT symbol, venue, window_start_us, unnest(['open', 'high', 'low', 'close', 'volume', 'vwap', 'trade_count']) f,
  unnest([l.open, l.high, l.low, l.close, l.volume, l.vwap, l.trade_count::DOUBLE]) x, unnest([r.open, r.high, r.low, r.close, r.volume, r.vwap, r.trade_count::DOUBLE]) y FROM l JOIN r USING (symbol, venue, window_start_us))
WHERE abs(x - y) / greatest(abs(x), abs(y), 1e-300) > 1e-5""")
def field_comparison(spark, d):
    c = serving.compare_fields(table(spark, d, "window_bars").distinct(), b.bars(_trades(spark, d), 300), 1e-5)
    return _round(c, 6, "live", "replay")


@query(f"""{_REPLAY} SELECT symbol, venue, window_start_us FROM r ANTI JOIN l USING (symbol, venue, window_start_us)""")
def replay_only_windows(spark, d):
    return serving.one_sided(b.bars(_trades(spark, d), 300), table(spark, d, "window_bars"))


@query("""SELECT kind, venue, count(*) AS n FROM (SELECT 'trade' kind, lower(trim(venue)) venue FROM trades UNION ALL SELECT 'book_delta', lower(trim(venue)) FROM book_deltas UNION ALL SELECT 'quote', lower(trim(venue)) FROM quotes) GROUP BY ALL""")
def fan_in(spark, d):
    kinds = {"trades": "trade", "book_deltas": "book_delta", "quotes": "quote"}
    parts = [table(spark, d, t).select(F.lit(k).alias("kind"), canonical_venue(F.col("venue")).alias("venue")) for t, k in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind", "venue").agg(F.count(F.lit(1)).alias("n"))


# --- requests (events as requests) ---------------------------------------------------------------------------------------------------


def _requests(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        "event_id", F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key_id"), F.concat(F.lit("n"), (F.col("event_id") % 3).cast("string")).alias("nonce"), F.expr("unix_micros(cast(ts as timestamp)) div 2000000000").alias("now_s"),
        F.expr("unix_micros(cast(ts as timestamp)) div 2000000000 - event_id % 40").alias("timestamp_s"), F.lit("GET").alias("method"), F.concat(F.lit("/v1/"), F.col("event_type")).alias("path"), F.col("props").alias("body"),
    )


_R = """r AS (SELECT event_id, 'k' || user_id AS key_id, 'n' || (event_id % 3) AS nonce, event_id % 40 AS age, epoch_us(ts) // 2000000000 AS t FROM events)"""


def _claimed_sql(source: str, out: str) -> str:
    """A nonce is claimed by the first request in order of time and free again 60 seconds later."""
    free = "acc.c IS NULL OR x.t - acc.c >= 60"
    step = f"{{i: x.i, t: x.t, c: CASE WHEN {free} THEN x.t ELSE acc.c END, out: list_append(acc.out, {{i: x.i, ok: {free}}})}}"
    return _fold_sql(source, "key_id, nonce", "t, event_id", "i: event_id, t: t", "i: 0::BIGINT, t: 0::BIGINT", "c: NULL::BIGINT, out: []::STRUCT(i BIGINT, ok BOOLEAN)[]", step, out)


def _bucket_sql(source: str, keys: str, order: str, capacity: float, refill: float, out: str) -> str:
    """Tokens ``u.k`` that a request with cost ``u.c`` finds; ``src`` has event_id, ms and cost."""
    found = f"least({capacity}, acc.k + coalesce(greatest(0, x.ms - acc.t), 0) / 1e3 * {refill})"
    step = f"{{a: x.a, ms: x.ms, c: x.c, t: x.ms, k: CASE WHEN {found} >= x.c THEN {found} - x.c ELSE {found} END, out: list_append(acc.out, {{a: x.a, k: {found}, c: x.c}})}}"
    return _fold_sql(source, keys, order, "a: event_id, ms: ms::BIGINT, c: cost::DOUBLE", "a: 0::BIGINT, ms: 0::BIGINT, c: 0::DOUBLE", f"t: NULL::BIGINT, k: {capacity}::DOUBLE, out: []::STRUCT(a BIGINT, k DOUBLE, c DOUBLE)[]", step, out)


@query(_claimed_sql(f"WITH {_R}, src AS (SELECT * FROM r WHERE age <= 30)", "SELECT event_id, CASE WHEN age > 30 THEN 'TIMESTAMP_OUT_OF_WINDOW' WHEN u.ok THEN 'OK' ELSE 'NONCE_REUSED' END AS verdict FROM r LEFT JOIN o ON event_id = u.i"))
def replay_guard(spark, d):
    """Three nonces a key and a clock 2,000 times as fast as the events', so that nonces come again within their lifetime and after it."""
    return serving.replay_verdicts(_requests(spark, d), "event_id").select("event_id", "verdict")


@query("""SELECT event_id, sha256(props) AS body_sha, 'GET' || chr(10) || '/v1/' || event_type || chr(10) || CAST(CAST(epoch_us(ts) // 2000000000 - event_id % 40 AS BIGINT) AS VARCHAR) || chr(10) || 'n' || (event_id % 3) || chr(10) || sha256(props) AS text FROM events""")
def signed_text(spark, d):
    return _requests(spark, d).select("event_id", F.sha2("body", 256).alias("body_sha"), m.canonical_request("method", "path", "timestamp_s", "nonce", "body").alias("text"))


_EARLY = f"""{_R}, v AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'MISSING_CREDENTIALS' WHEN TRY_CAST(key_id[2:] AS BIGINT) % 5 = 0 THEN 'UNKNOWN_KEY' WHEN TRY_CAST(key_id[2:] AS BIGINT) % 5 = 1 THEN 'DISABLED_KEY' WHEN event_id % 7 = 0 THEN 'BAD_SIGNATURE' END early FROM r)"""


@query(f"""WITH {_EARLY}, cl AS ({_claimed_sql("WITH src AS (SELECT * FROM v WHERE early IS NULL AND age <= 30)", "SELECT u.i AS event_id, u.ok FROM o")}),
li AS ({_bucket_sql("WITH src AS (SELECT key_id, event_id, t * 1000 AS ms, 1.0 AS cost, t FROM v JOIN cl USING (event_id) WHERE ok)", "key_id", "t, event_id", 2.0, 0.01, "SELECT u.a AS event_id, u.k >= u.c AS allowed FROM o")})
SELECT event_id, coalesce(early, CASE WHEN age > 30 THEN 'TIMESTAMP_OUT_OF_WINDOW' WHEN NOT ok THEN 'NONCE_REUSED' WHEN allowed THEN 'OK' ELSE 'RATE_LIMITED' END) AS verdict FROM v LEFT JOIN cl USING (event_id) LEFT JOIN li USING (event_id)""")
def authentication(spark, d):
    """Keys of users divisible by 5 don't exist, those that leave 1 are disabled; every seventh signature is wrong, every thirteenth missing."""
    r = _requests(spark, d)
    users = table(spark, d, "events").select("user_id").distinct().where("user_id % 5 <> 0")
    keys = users.select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key_id"), F.concat(F.lit("secret"), F.col("user_id").cast("string")).alias("secret"), (F.col("user_id") % 5 != 1).alias("enabled"), F.lit(2).alias("rate_limit_capacity"), F.lit(0.01).alias("rate_limit_refill_per_second"))
    text = m.canonical_request("method", "path", "timestamp_s", "nonce", "body")
    signed = r.withColumn("signature", F.when(F.col("event_id") % 13 == 0, None).when(F.col("event_id") % 7 == 0, "wrong").otherwise(_sign(F.concat(F.lit("secret"), F.substring("key_id", 2, 20)), text)))
    return serving.authenticated(signed, keys, "event_id").select("event_id", "verdict")


@F.pandas_udf(T.StringType())
def _sign(secret: pd.Series, text: pd.Series) -> pd.Series:
    return (secret + "\x01" + text).map(lambda x: serving.sign(*x.split("\x01", 1)) if isinstance(x, str) else None)


@query(_bucket_sql("WITH src AS (SELECT user_id, event_id, epoch_us(ts) // 1000 // 1000 ms, CASE WHEN event_type = 'purchase' THEN 10.0 ELSE 1.0 END cost FROM events)", "user_id", "event_id", 20.0, 1e-2,
    """SELECT user_id, u.a AS event_id, u.k >= u.c AS allowed, CAST(floor(CASE WHEN u.k >= u.c THEN u.k - u.c ELSE u.k END) AS BIGINT) AS remaining, CAST(CASE WHEN u.k >= u.c THEN 0 ELSE ceil((u.c - u.k) / 1e-2) END AS BIGINT) AS retry_after_s FROM o"""))
def rate_limits(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000 div 1000").alias("ms"), F.when(F.col("event_type") == "purchase", 10.0).otherwise(1.0).alias("cost"))
    return folds.rate_limited(e, "user_id", ["event_id"], "ms", "cost", 20.0, 0.01)


@query(_fold_sql(
    f"{_Q}, src AS (SELECT venue, emit_time_us, quote_id FROM c_quotes WHERE emit_time_us IS NOT NULL)", "venue", "emit_time_us, quote_id", "a: quote_id, e: emit_time_us", "a: 0::BIGINT, e: 0::BIGINT", "t: NULL::BIGINT, out: []::STRUCT(a BIGINT, e BIGINT)[]",
    """{a: x.a, e: x.e, t: CASE WHEN x.e - acc.t < 100000 THEN acc.t ELSE x.e END, out: CASE WHEN x.e - acc.t < 100000 THEN acc.out ELSE list_append(acc.out, {a: x.a, e: x.e}) END}""",
    "SELECT venue, u.e AS emit_time_us, u.a AS quote_id FROM o"))
def coalesced_quotes(spark, d):
    """What a subscriber of all symbols of a venue gets at 10 quotes a second."""
    return folds.coalesced(_quotes(spark, d).where("emit_time_us is not null"), "venue", ["emit_time_us", "quote_id"], "emit_time_us", 10)


# --- metrics ---------------------------------------------------------------------------------------------------------------------------


@query("""SELECT lower(trim(venue)) AS venue, ingest_time_us // 60000000 * 60000000 AS bucket_us, count(*) AS n, count(*) / 60.0 AS per_second FROM trades GROUP BY 1, 2""")
def events_per_second(spark, d):
    return metrics.event_rate(table(spark, d, "trades").withColumn("venue", canonical_venue(F.col("venue"))), "ingest_time_us", 60, "venue")


def _quantile_sql(q: float) -> str:
    bounds = metrics.LAG_BUCKETS
    cases = " ".join(f"WHEN b{i} >= n * {q} THEN {bounds[i - 1] if i else 0.0} + ({b} - {bounds[i - 1] if i else 0.0}) * coalesce((n * {q} - {f'b{i - 1}' if i else 0}) / nullif(b{i} - {f'b{i - 1}' if i else 0}, 0), 0)" for i, b in enumerate(bounds))
    return f"""WITH l AS (SELECT lower(trim(venue)) venue, (ingest_time_us - event_time_us) / 1000000.0 v FROM trades WHERE event_time_us > 0 AND ingest_time_us >= event_time_us),
    c AS (SELECT venue, count(*) n, {", ".join(f"count(*) FILTER (WHERE v <= {b}) b{i}" for i, b in enumerate(bounds))} FROM l GROUP BY venue) SELECT venue, n, round(CASE {cases} ELSE {bounds[-1]} END + 1e-10, 6) AS quantile FROM c"""


@query(_quantile_sql(0.99))
def source_lag_p99(spark, d):
    t = table(spark, d, "trades").withColumn("venue", canonical_venue(F.col("venue")))
    return _round(metrics.histogram_quantile(t, m.lag_seconds("event_time_us", "ingest_time_us"), 0.99, "venue"), 6, "quantile")


@query("""WITH l AS (SELECT lower(trim(venue)) venue, ingest_time_us - event_time_us v, row_number() OVER (PARTITION BY lower(trim(venue)) ORDER BY ingest_time_us - event_time_us) - 1 r, count(*) OVER (PARTITION BY lower(trim(venue))) n FROM trades WHERE event_time_us > 0)
SELECT venue, v AS value, n FROM l WHERE r = round_even(0.95 * (n - 1), 0)""")
def source_lag_nearest_rank(spark, d):
    t = table(spark, d, "trades").where("event_time_us > 0").select(canonical_venue(F.col("venue")).alias("venue"), (F.col("ingest_time_us") - F.col("event_time_us")).alias("lag_us"))
    return metrics.nearest_rank(t, "lag_us", 95, "venue")


@query(f"""{_T}, l AS (SELECT symbol, ingest_time_us t, lag(ingest_time_us) OVER (PARTITION BY symbol ORDER BY ingest_time_us) p FROM c_trades WHERE symbol IS NOT NULL) SELECT symbol, p AS from_us, t AS to_us FROM l WHERE t - p >= 7200000000""")
def silent_symbols(spark, d):
    return metrics.silent_periods(_trades(spark, d).where("symbol is not null"), "ingest_time_us", 7_200_000_000, "symbol")


@query("""WITH s AS (SELECT lower(trim(venue)) venue, ingest_time_us // 60000000 * 60 AS t, count(*) n FROM trades GROUP BY 1, 2), c AS (SELECT venue, t, CAST(sum(n) OVER (PARTITION BY venue ORDER BY t) % 5000 AS BIGINT) v FROM s),
x AS (SELECT *, coalesce(CASE WHEN v < lag(v) OVER w THEN v ELSE v - lag(v) OVER w END, 0) step FROM c WINDOW w AS (PARTITION BY venue ORDER BY t)),
y AS (SELECT venue, t, v, CAST(sum(step) OVER r - first_value(step) OVER r AS BIGINT) increase, t - min(t) OVER r span FROM x WINDOW r AS (PARTITION BY venue ORDER BY t RANGE BETWEEN 300 PRECEDING AND CURRENT ROW))
SELECT venue, t, v, increase, round(CASE WHEN span > 0 THEN increase / span END + 1e-10, 9) AS rate FROM y""")
def counter_rates(spark, d):
    """A counter per venue that starts anew at 5,000."""
    s = table(spark, d, "trades").groupBy(canonical_venue(F.col("venue")).alias("venue"), F.expr("ingest_time_us div 60000000 * 60").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    c = s.withColumn("v", F.sum("n").over(Window.partitionBy("venue").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)) % 5000).drop("n")
    return _round(metrics.counter_increase(c, "v", "t", 300, "venue"), 9, "rate")


@query("""WITH k AS (SELECT 'trade' kind, 120 b FROM trades UNION ALL SELECT 'book', 900 FROM book_deltas UNION ALL SELECT 'quote', 180 FROM quotes), s AS (SELECT sum(b) a, sum(CASE WHEN kind = 'trade' THEN b ELSE 0 END) w FROM k)
SELECT CAST(a AS BIGINT) AS bytes_all, CAST(w AS BIGINT) AS bytes_wanted, round(a / w + 1e-10, 6) AS amplification, round(1 - w / a + 1e-10, 6) AS waste FROM s""")
def topic_amplification(spark, d):
    sizes = {"trades": ("trade", 120), "book_deltas": ("book", 900), "quotes": ("quote", 180)}
    parts = [table(spark, d, t).select(F.lit(k).alias("kind"), F.lit(n).cast("bigint").alias("b")) for t, (k, n) in sizes.items()]
    return _round(metrics.read_amplification(parts[0].unionByName(parts[1]).unionByName(parts[2]), "kind", "b", ["trade"]), 6, "amplification", "waste")
