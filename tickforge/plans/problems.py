"""Queries pN_... of the general data problems over the market tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions.canonical import canonical_pair, canonical_venue, canonicalise
from tickforge.operators.anomalies import implausible
from tickforge.operators.changefeed import closing_books
from tickforge.operators.compaction import compact
from tickforge.operators.latebars import corrected_bars, wrong_bars
from tickforge.operators.nearest import nearest_in_time
from tickforge.operators.redelivery import surplus_deliveries
from tickforge.operators.skew import balanced_totals, heavy_keys
from tickforge.sources import table


def canonical(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    df = table(spark, d, name)
    return canonicalise(df.select(*cols) if cols else df, table(spark, d, "venue_symbols"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    trades = canonical(spark, d, "trades", "arrival", "venue", "symbol", "event_time_us").where("event_time_us > 0")
    quotes = canonical(spark, d, "quotes", "quote_id", "venue", "symbol", "event_time_us").where("event_time_us > 0")
    return nearest_in_time(trades, quotes, ["venue", "symbol"], "event_time_us", "event_time_us", "arrival", "quote_id", 5_000_000, ("trade_arrival", "quote_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    both = [canonical(spark, d, t, "venue", "symbol").select(F.lit(t).alias("source_table"), "symbol") for t in ("trades", "book_deltas")]
    return heavy_keys(both[0].unionByName(both[1]), "source_table", "symbol", 0.05).select("source_table", "symbol")


def p2_symbol_totals(spark: SparkSession, d: str) -> DataFrame:
    trades = canonical(spark, d, "trades", "arrival", "venue", "symbol", "price", "size", "event_time_us").where("symbol is not null")
    ok = (F.col("price") > 0) & (F.col("size") >= 0)
    totals = balanced_totals(
        trades, ["symbol"],
        n_rows=F.count(F.lit(1)), n_priced=F.count_if(ok), low=F.min(F.when(ok, F.col("price"))), high=F.max(F.when(ok, F.col("price"))),
        volume=F.sum(F.when(ok, F.col("size"))), notional=F.sum(F.when(ok, F.col("price") * F.col("size"))),
        last_price=F.max_by(F.when(ok, F.col("price")), F.when(ok, F.struct("event_time_us", "arrival"))),
    )
    return totals.withColumns({"volume": F.round("volume", 3), "notional": F.round("notional", 2)})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    trades = canonical(spark, d, "trades", "arrival", "venue", "symbol", "trade_id", "sequence", "ingest_time_us")
    return surplus_deliveries(trades, keep=[]).select("first_arrival", "arrival")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    books = closing_books(canonical(spark, d, "book_deltas"))
    e4 = lambda c: F.round(F.col(c) * 10000).cast("bigint").alias(f"{c}_e4")
    return books.select("session_id", "venue", "symbol", "side", e4("price"), e4("size"))


def _bars(spark: SparkSession, d: str) -> DataFrame:
    trades = canonical(spark, d, "trades", "arrival", "venue", "symbol", "trade_id", "price", "size", "event_time_us", "ingest_time_us", "sequence")
    return corrected_bars(trades, surplus_deliveries(trades, keep=["venue", "symbol", "price", "size", "event_time_us", "ingest_time_us"]))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return wrong_bars(table(spark, d, "window_bars").select("venue", "symbol", "window_start_us", "trade_count"), _bars(spark, d))


def p5_bars(spark: SparkSession, d: str) -> DataFrame:
    bars = _bars(spark, d)
    return bars.select("venue", "symbol", "window_start_us", "low", "high", "median_price", "distinct_prices", "trade_count", F.round("volume", 3).alias("volume"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    quotes = canonical(spark, d, "quotes", "quote_id", "venue", "symbol", "bid_price", "ask_price", "mid", "spread_bps", "event_time_us")
    pairs = table(spark, d, "divergences").withColumns(
        {"symbol": canonical_pair(F.col("symbol")), "venue_a": canonical_venue(F.col("venue_a")), "venue_b": canonical_venue(F.col("venue_b"))}
    )
    return implausible(quotes, pairs)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    manifest, _ = compact(table(spark, d, "lake_trades"), table(spark, d, "lake_files"))
    return manifest.select("file_id")


def p7_lake(spark: SparkSession, d: str) -> DataFrame:
    """What the lake holds after compaction, per venue and day."""
    _, lake = compact(table(spark, d, "lake_trades"), table(spark, d, "lake_files"))
    venue = canonical_venue(F.col("venue")).alias("venue")
    return lake.groupBy(venue, F.to_date("event_time").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("trade_id").alias("trade_ids"), F.round(F.sum("size"), 3).alias("volume"), F.sum(F.col("event_time_us") % 1000003).alias("time_sum")
    )


# --- SQL ---------------------------------------------------------------------------------------------------------

_VS = "vs AS (SELECT lower(trim(venue)) v, upper(trim(venue_symbol)) x, min(symbol) s FROM venue_symbols GROUP BY 1, 2)"


def _canon(name: str) -> str:
    return f"""c_{name} AS (SELECT t.* REPLACE (lower(trim(t.venue)) AS venue,
      CASE WHEN trim(coalesce(t.symbol, '')) = '' THEN NULL
           ELSE coalesce(vs.s, replace(replace(upper(trim(t.symbol)), '/', '-'), '_', '-')) END AS symbol)
      FROM {name} t LEFT JOIN vs ON lower(trim(t.venue)) = vs.v AND upper(trim(t.symbol)) = vs.x)"""


_MESSAGES = """
k AS (SELECT *, nullif(lower(trim(trade_id)), '') AS id, CASE WHEN sequence >= 0 THEN sequence END AS seq FROM c_trades),
g AS (SELECT *, arg_min(CASE WHEN id IS NOT NULL THEN seq END, CASE WHEN seq IS NOT NULL THEN arrival END)
        OVER (PARTITION BY venue, id) AS main FROM k WHERE id IS NOT NULL OR seq IS NOT NULL),
m AS (SELECT *, min(arrival) OVER (PARTITION BY venue, id, CASE WHEN id IS NULL THEN symbol END,
        CASE WHEN id IS NULL THEN seq ELSE coalesce(seq, main, -1) END) AS first_arrival FROM g),
surplus AS (SELECT first_arrival, arrival FROM m WHERE arrival <> first_arrival)"""

_ACCEPTED = """
accepted AS (SELECT *, event_time_us // 300000000 * 300000000 AS window_start_us FROM c_trades
  WHERE symbol IS NOT NULL AND event_time_us > 0 AND price > 0 AND size >= 0
    AND ingest_time_us < event_time_us // 300000000 * 300000000 + 900000000
    AND arrival NOT IN (SELECT arrival FROM surplus))"""

_SPANS = [(b, a) for b in range(1, 6) for a in range(1, 6) if a + b <= 6]


def _off(b: int, a: int) -> str:
    """The readings between the b-th before and the a-th after all lie off both, to one side."""
    inner = range(1 - b, a)
    x = lambda i: "v" if i == 0 else f"lag(v, {-i}) OVER w" if i < 0 else f"lead(v, {i}) OVER w"
    ends = (x(-b), x(a))
    tests = [f"abs(({ends[0]}) - ({ends[1]})) < 12 * med"]
    tests += [f"abs(({x(i)}) - ({e})) >= 25 * med" for i in inner for e in ends]
    tests += [f"sign(({x(i)}) - ({ends[0]})) = sign(({x(i)}) - ({ends[1]}))" for i in inner]
    return "(" + " AND ".join(tests) + ")"


# A plain statement of the rules: spikes by comparing neighbours, ordinary runs by the first large gap in run lengths.
_P6_SQL = f"""WITH {_VS}, {_canon('quotes')},
q AS (SELECT *, concat('q', venue, '|', symbol) e FROM c_quotes WHERE event_time_us > 0 QUALIFY row_number() OVER (PARTITION BY venue, symbol, event_time_us ORDER BY quote_id) = 1),
d AS (SELECT *, concat('d', symbol, '|', venue_a, '|', venue_b) e FROM divergences WHERE event_time_us > 0 QUALIFY row_number() OVER (PARTITION BY symbol, venue_a, venue_b, event_time_us ORDER BY divergence_id) = 1),
r AS (SELECT e, 'mid' f, quote_id id, event_time_us t, mid v, NOT isfinite(mid) OR mid <= 0 bad FROM q WHERE mid IS NOT NULL
  UNION ALL SELECT e, 'spread_bps', quote_id, event_time_us, spread_bps, NOT isfinite(spread_bps) OR spread_bps > 20000 OR (spread_bps < 0 AND coalesce(ask_price >= bid_price, false)) FROM q WHERE spread_bps IS NOT NULL
  UNION ALL SELECT e, 'divergence_bps', divergence_id, event_time_us, divergence_bps, NOT isfinite(divergence_bps) OR abs(divergence_bps) > 20000 FROM d WHERE divergence_bps IS NOT NULL),
o AS (SELECT *, lag(v) OVER (PARTITION BY e, f ORDER BY t) p FROM r WHERE NOT bad),
m AS (SELECT e, f, count(*) n, CASE f WHEN 'mid' THEN median(abs(v - p)) FILTER (WHERE v <> p) WHEN 'spread_bps' THEN median(v) ELSE median(abs(v)) END med FROM o GROUP BY e, f),
j AS (SELECT o.*, med FROM o JOIN m USING (e, f) WHERE n >= CASE f WHEN 'divergence_bps' THEN 30 ELSE 40 END),
s AS (SELECT e, f, id FROM j WHERE med > 0 AND (f = 'spread_bps' AND v >= 6 * med OR f = 'divergence_bps' AND abs(v) >= 10 * med)
  UNION ALL SELECT e, f, id FROM j WHERE f = 'mid' WINDOW w AS (PARTITION BY e, f ORDER BY t) QUALIFY med > 0 AND ({' OR '.join(_off(b, a) for b, a in _SPANS)})),
c AS (SELECT *, sum(CASE WHEN p IS NULL OR v <> p THEN 1 ELSE 0 END) OVER (PARTITION BY e, f ORDER BY t) run FROM j WHERE f <> 'spread_bps'),
l AS (SELECT e, f, run, count(*) len FROM c GROUP BY ALL),
y AS (SELECT e, f, len, lag(len) OVER (PARTITION BY e, f ORDER BY len) below FROM (SELECT DISTINCT e, f, len FROM l)),
z AS (SELECT e, f, min(len) least FROM y WHERE len >= 3 * coalesce(below, 1) AND len >= 8 GROUP BY ALL),
st AS (SELECT c.e, c.f, c.id FROM c JOIN l USING (e, f, run) LEFT JOIN z USING (e, f) WHERE CASE f WHEN 'mid' THEN len >= least ELSE len >= 5 END)
SELECT DISTINCT CASE f WHEN 'divergence_bps' THEN 'divergences' ELSE 'quotes' END AS source_table, id AS record_id, f AS field_name
FROM (SELECT e, f, id FROM r WHERE bad UNION ALL SELECT * FROM s UNION ALL SELECT * FROM st)"""

ORACLE = {
    "p1_found": f"""WITH {_VS}, {_canon('trades')}, {_canon('quotes')},
      l AS (SELECT arrival, venue, symbol, event_time_us t FROM c_trades WHERE symbol IS NOT NULL AND event_time_us > 0),
      r AS (SELECT venue, symbol, event_time_us t, min(quote_id) quote_id FROM c_quotes WHERE symbol IS NOT NULL AND event_time_us > 0 GROUP BY ALL),
      b AS (SELECT l.*, r.t bt, r.quote_id bq FROM l ASOF LEFT JOIN r ON l.venue = r.venue AND l.symbol = r.symbol AND l.t >= r.t),
      a AS (SELECT b.*, r.t at_, r.quote_id aq FROM b ASOF LEFT JOIN r ON b.venue = r.venue AND b.symbol = r.symbol AND b.t <= r.t)
      SELECT arrival AS trade_arrival, CASE WHEN at_ IS NULL OR t - bt <= at_ - t THEN bq ELSE aq END AS quote_id FROM a
      WHERE least(coalesce(t - bt, 1000000000000), coalesce(at_ - t, 1000000000000)) <= 5000000""",
    "p2_found": f"""WITH {_VS}, {_canon('trades')}, {_canon('book_deltas')},
      u AS (SELECT 'trades' AS source_table, symbol FROM c_trades UNION ALL SELECT 'book_deltas', symbol FROM c_book_deltas),
      n AS (SELECT source_table, symbol, count(*) n, sum(count(*)) OVER (PARTITION BY source_table) total FROM u GROUP BY 1, 2)
      SELECT source_table, symbol FROM n WHERE symbol IS NOT NULL AND n >= 0.05 * total""",
    "p2_symbol_totals": f"""WITH {_VS}, {_canon('trades')},
      t AS (SELECT *, price > 0 AND size >= 0 AS ok FROM c_trades WHERE symbol IS NOT NULL)
      SELECT symbol, count(*) AS n_rows, count(*) FILTER (WHERE ok) AS n_priced, min(price) FILTER (WHERE ok) AS low, max(price) FILTER (WHERE ok) AS high,
        round(sum(size) FILTER (WHERE ok), 3) AS volume, round(sum(price * size) FILTER (WHERE ok), 2) AS notional,
        arg_max(price, (event_time_us, arrival)) FILTER (WHERE ok) AS last_price FROM t GROUP BY symbol""",
    "p3_found": f"WITH {_VS}, {_canon('trades')}, {_MESSAGES} SELECT first_arrival, arrival FROM surplus",
    "p4_found": f"""WITH {_VS}, {_canon('book_deltas')},
      o AS (SELECT *, CASE WHEN sequence >= 0 THEN sequence ELSE event_time_us END AS ord FROM c_book_deltas WHERE symbol IS NOT NULL),
      c AS (SELECT session_id, venue, symbol, ord, arg_min((is_snapshot, bids, asks), arrival) x FROM o GROUP BY ALL),
      s AS (SELECT session_id, venue, symbol, max(ord) snap FROM c WHERE x[1] GROUP BY ALL),
      l AS (SELECT session_id, venue, symbol, ord, 'bid' AS side, unnest(x[2]) lv, unnest(range(len(x[2]))) i FROM c
            UNION ALL SELECT session_id, venue, symbol, ord, 'ask', unnest(x[3]), unnest(range(len(x[3]))) FROM c),
      z AS (SELECT session_id, venue, symbol, side, lv.price AS price, arg_max(lv.size, (ord, i)) AS size FROM l LEFT JOIN s USING (session_id, venue, symbol)
            WHERE snap IS NULL OR ord >= snap GROUP BY ALL)
      SELECT session_id, venue, symbol, side, CAST(round(price * 10000) AS BIGINT) AS price_e4, CAST(round(size * 10000) AS BIGINT) AS size_e4 FROM z WHERE size > 0""",
    "p5_found": f"""WITH {_VS}, {_canon('trades')}, {_MESSAGES}, {_ACCEPTED},
      n AS (SELECT venue, symbol, window_start_us, count(*) n FROM accepted GROUP BY ALL),
      w AS (SELECT venue, symbol, window_start_us, min(trade_count) lo, max(trade_count) hi FROM window_bars GROUP BY ALL)
      SELECT venue, symbol, window_start_us FROM n FULL JOIN w USING (venue, symbol, window_start_us)
      WHERE n IS NULL OR lo IS NULL OR lo <> n OR hi <> n""",
    "p5_bars": f"""WITH {_VS}, {_canon('trades')}, {_MESSAGES}, {_ACCEPTED}
      SELECT venue, symbol, window_start_us, min(price) AS low, max(price) AS high, quantile_disc(price, 0.5) AS median_price,
        count(DISTINCT price) AS distinct_prices, count(*) AS trade_count, round(sum(size), 3) AS volume FROM accepted GROUP BY ALL""",
    "p6_found": _P6_SQL,
    "p7_found": """WITH f AS (SELECT file_id, n_bytes, replace(replace(upper(trim(symbol)), '/', '-'), '_', '-') s, CAST(min_event_time AS DATE) d
        FROM lake_files WHERE committed_at IS NOT NULL AND replaced_by IS NULL AND n_bytes < 16384)
      SELECT file_id FROM f WHERE s <> '' AND d IS NOT NULL QUALIFY count(*) OVER (PARTITION BY s, d) >= 2""",
    "p7_lake": """SELECT lower(trim(venue)) AS venue, CAST(CAST(event_time AS DATE) AS VARCHAR) AS day, count(*) AS n, count(DISTINCT trade_id) AS trade_ids,
        round(sum(size), 3) AS volume, CAST(sum(event_time_us % 1000003) AS BIGINT) AS time_sum
      FROM (SELECT DISTINCT * EXCLUDE (file_id) FROM lake_trades WHERE file_id IN (SELECT file_id FROM lake_files WHERE committed_at IS NOT NULL AND replaced_by IS NULL)) GROUP BY 1, 2""",
}

QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_symbol_totals, p3_found, p4_found, p5_found, p5_bars, p6_found, p7_found, p7_lake)}
