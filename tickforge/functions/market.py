"""Scalar rules of the market data model, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Spellings of the sides, contracts of known tokens, quote assets in order of trial.
BUY_SPELLINGS = ("b", "B", "buy", "BUY", "Buy", "bid", "BID")
SELL_SPELLINGS = ("s", "S", "sell", "SELL", "Sell", "ask", "ASK", "offer", "OFFER")
QUOTE_ASSETS = ("USDT", "USDC", "TUSD", "FDUSD", "BUSD", "USD", "BTC", "ETH", "BNB")
CHANNELS = {"trade": "trades", "book_delta": "book", "chain_transfer": "chain"}
TOPICS = {"trades": "md.trades.v1", "book": "md.book.v1", "chain": "md.chain.v1", "quotes": "md.quotes.v1", "divergence": "md.divergence.v1", "bars": "md.bars.v1"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def notional(price: Column | str, size: Column | str) -> Column:
    return _c(price) * _c(size)


def side(raw: Column | str) -> Column:
    """BUY, SELL or UNKNOWN; spellings are matched exactly, null is UNKNOWN."""
    return F.when(_c(raw).isin(*BUY_SPELLINGS), "BUY").when(_c(raw).isin(*SELL_SPELLINGS), "SELL").otherwise("UNKNOWN")


def is_buy(raw: Column | str) -> Column:
    return side(raw) == "BUY"


def mid(bid: Column | str, ask: Column | str) -> Column:
    return (_c(bid) + _c(ask)) / 2


def spread_bps(bid: Column | str, ask: Column | str) -> Column:
    """Basis points of the mid; 0.0, the published form, where a price isn't positive or missing; negative if crossed."""
    b, a = _c(bid), _c(ask)
    return F.when((b > 0) & (a > 0), (a - b) / mid(b, a) * 10_000).otherwise(0.0)


def is_valid_quote(bid: Column | str, ask: Column | str) -> Column:
    """Both prices positive and not crossed; a locked quote is valid; nulls are not."""
    b, a = _c(bid), _c(ask)
    return F.coalesce((b > 0) & (a > 0) & (a >= b), F.lit(False))


def is_crossed(bid: Column | str, ask: Column | str) -> Column:
    """Best bid at or above best ask: for a book, locked counts as crossed."""
    return F.coalesce(_c(bid) >= _c(ask), F.lit(False))


def divergence_bps(mid_a: Column | str, mid_b: Column | str) -> Column:
    """Signed difference of b from a in basis points of their mean; null where the mean isn't positive."""
    a, b = _c(mid_a), _c(mid_b)
    return F.when((a + b) / 2 > 0, (b - a) / ((a + b) / 2) * 10_000)


def ordered_pair(a: Column | str, b: Column | str) -> Column:
    return F.struct(F.least(_c(a), _c(b)).alias("first"), F.greatest(_c(a), _c(b)).alias("second"))


def vwap(notional_sum: Column | str, volume: Column | str) -> Column:
    """Published form: 0.0 without volume."""
    return F.when(_c(volume) > 0, _c(notional_sum) / _c(volume)).otherwise(0.0)


def lag_seconds(event_us: Column | str, ingest_us: Column | str) -> Column:
    """Seconds from event to receipt; null for unset event times and clocks that run ahead."""
    e, i = _c(event_us), _c(ingest_us)
    return F.when((e > 0) & (i >= e), (i - e) / 1e6)


def window_start(us: Column | str, seconds: int) -> Column:
    return _c(us) - F.pmod(_c(us), F.lit(seconds * 1_000_000))


def cents(price: Column | str) -> Column:
    """Rounded to two places, halves up."""
    return F.floor(_c(price) * 100 + 0.5) / 100


def quote_age_us(now_us: int, event_us: Column | str) -> Column:
    return F.lit(now_us) - _c(event_us)


def strict_double(text: Column | str) -> Column:
    """Null and empty are 0.0, a malformed number is null, for the caller to turn into an error row."""
    return F.when(F.coalesce(_c(text), F.lit("")) == "", 0.0).otherwise(_c(text).try_cast("double"))


def lenient_double(text: Column | str) -> Column:
    """'' and malformed numbers are 0.0."""
    return F.coalesce(_c(text).try_cast("double"), F.lit(0.0))


def rfc3339_us(text: Column | str, otherwise_us: Column | str) -> Column:
    return F.coalesce(F.unix_micros(F.try_to_timestamp(_c(text))), _c(otherwise_us))


def ms_to_us(first: Column | str, fallback: Column | str) -> Column:
    """Milliseconds to microseconds; a first of 0 or null gives way to the fallback."""
    return F.when(F.coalesce(_c(first), F.lit(0)) == 0, _c(fallback)).otherwise(_c(first)) * 1000


def slashed_symbol(symbol: Column | str) -> Column:
    """BASE-QUOTE as BASE/QUOTE."""
    return F.replace(_c(symbol), F.lit("-"), F.lit("/"))


def joined_symbol(symbol: Column | str) -> Column:
    """BASE-QUOTE as one word, with USD traded as USDT."""
    return F.replace(F.regexp_replace(_c(symbol), "-USD$", "-USDT"), F.lit("-"), F.lit(""))


def split_symbol(word: Column | str) -> Column:
    """One word as BASE-QUOTE by the first quote asset in order that ends it; USDT becomes USD; unknown ones stay."""
    w, out = F.upper(_c(word)), None
    for q in QUOTE_ASSETS:
        hit = w.endswith(q) & (F.length(w) > len(q))
        value = F.concat(F.substring(w, F.lit(1), F.length(w) - len(q)), F.lit("-USD" if q == "USDT" else f"-{q}"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(w)


def maker_side(buyer_is_maker: Column | str) -> Column:
    """Aggressor of a trade whose flag tells if the buyer was the maker."""
    return F.when(_c(buyer_is_maker), "SELL").otherwise("BUY")


def topic_address(topic: Column | str) -> Column:
    """Last 40 hex digits, lower case, with 0x; shorter input stays."""
    hexes = F.regexp_replace(F.lower(_c(topic)), "^0x", "")
    return F.when(F.length(hexes) < 40, _c(topic)).otherwise(F.concat(F.lit("0x"), F.right(hexes, F.lit(40))))


def hex_to_long(text: Column | str) -> Column:
    return F.coalesce(F.conv(F.regexp_replace(_c(text), "^0x", ""), 16, 10).try_cast("bigint"), F.lit(0).cast("bigint"))


@pandas_udf(T.StringType())
def hex_to_decimal(text: pd.Series) -> pd.Series:
    """Hex of any length (uint256) as a decimal string; null, empty and malformed give '0'."""

    def one(x):
        try:
            return str(int(x, 16))
        except (TypeError, ValueError):
            return "0"

    return text.map(one)


def channel(kind: Column | str) -> Column:
    out = F.lit("unknown")
    for k, v in CHANNELS.items():
        out = F.when(_c(kind) == k, v).otherwise(out)
    return out


def valid_trade() -> Column:
    """event_time_us > 0, price > 0, size >= 0 (0 is kept) and a symbol."""
    return F.expr("coalesce(event_time_us > 0 and price > 0 and size >= 0 and symbol <> '', false)")


def valid_delta() -> Column:
    """event_time_us > 0, a symbol and at least one level."""
    return F.expr("coalesce(event_time_us > 0 and symbol <> '' and (coalesce(size(bids), 0) > 0 or coalesce(size(asks), 0) > 0), false)")


def depth_imbalance(bids: Column | str, asks: Column | str, depth: int = 5) -> Column:
    """(bid size - ask size) / (both) over the best levels of sorted sides; 0.0 if there is none."""
    total = lambda c: F.aggregate(F.slice(F.coalesce(_c(c), F.array().cast("array<struct<price:double,size:double>>")), 1, depth), F.lit(0.0), lambda a, l: a + F.coalesce(l["size"], F.lit(0.0)))
    b, a = total(bids), total(asks)
    return F.when(b + a > 0, (b - a) / (b + a)).otherwise(0.0)


def canonical_request(method: Column | str, path: Column | str, timestamp: Column | str, nonce: Column | str, body: Column | str) -> Column:
    """The text that is signed: parts by line, the body as its SHA-256."""
    return F.concat_ws("\n", _c(method), _c(path), _c(timestamp).cast("string"), _c(nonce), F.sha2(F.coalesce(_c(body), F.lit("")), 256))
