"""Queries over results: ranges of bars, latest quotes, reconciliation, requests."""

from __future__ import annotations

import base64
import hashlib
import hmac

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tickforge.functions.market import canonical_request, is_valid_quote
from tickforge.operators.folds import paced, rate_limited
from tickforge.sources.shared import write_shared

DEFAULT_LIMIT, MAX_LIMIT, MAX_SYMBOLS, DEFAULT_HZ, MAX_HZ = 1_000, 50_000, 64, 10, 100
BARS_TTL_DAYS, DIVERGENCE_TTL_DAYS, QUOTE_TTL_S, SKEW_S = 7, 90, 300, 30
DAY_S, DAY_US = 86_400, 86_400_000_000


def checked_limit(limit: int | None) -> int:
    """A missing or non-positive limit is the default; a large one is cut to the maximum."""
    return DEFAULT_LIMIT if not limit or limit <= 0 else min(limit, MAX_LIMIT)


def checked_rate(hz: int | None) -> int:
    return DEFAULT_HZ if not hz or hz <= 0 else min(hz, MAX_HZ)


def checked_symbols(symbols: list[str]) -> list[str]:
    if not symbols or any(not s or not s.strip() for s in symbols):
        raise ValueError("at least one symbol is needed, none of them blank")
    if len(symbols) > MAX_SYMBOLS:
        raise ValueError(f"at most {MAX_SYMBOLS} symbols")
    return symbols


def bars_in_range(bars: DataFrame, symbol: str, start_us: int, end_us: int, venue: str = "", limit: int | None = None) -> DataFrame:
    """Bars of a symbol with start <= window start < end, in order of time and venue, up to the limit (a top-k report)."""
    checked_symbols([symbol])
    if end_us <= start_us:
        raise ValueError("the end must be after the start")
    hit = (F.col("symbol") == symbol) & (F.col("window_start_us") >= start_us) & (F.col("window_start_us") < end_us)
    if venue:
        hit = hit & (F.col("venue") == venue)
    return bars.where(hit).orderBy("window_start_us", "venue").limit(checked_limit(limit))


def routed_range(hot: DataFrame, cold: DataFrame, now_us: int, symbol: str, start_us: int, end_us: int, venue: str = "", limit: int | None = None) -> DataFrame:
    """The hot table while the range begins within its retention, the cold one before; ``served_from`` tells which."""
    is_hot = start_us >= now_us - BARS_TTL_DAYS * DAY_US
    return bars_in_range(hot if is_hot else cold, symbol, start_us, end_us, venue, limit).withColumn("served_from", F.lit("olap" if is_hot else "lakehouse"))


def unexpired(df: DataFrame, time_us: str, now_us: int, days: int) -> DataFrame:
    return df.where(F.col(time_us) >= now_us - days * DAY_US)


def latest_quotes(quotes: DataFrame, tie: str, ttl_us: int | None = None, now_us: int | None = None) -> DataFrame:
    """The newest quote per symbol and venue, as a latest-value store holds it; map-side combined."""
    cols = [c for c in quotes.columns if c not in ("symbol", "venue")]
    latest = quotes.groupBy("symbol", "venue").agg(F.max_by(F.struct(*cols), F.struct("event_time_us", tie)).alias("q")).select("symbol", "venue", "q.*")
    return latest if ttl_us is None else latest.where(F.col("event_time_us") >= now_us - ttl_us)


def best_quotes(latest: DataFrame) -> DataFrame:
    """Per symbol the freshest valid quote of all venues; equal times: the first venue by name."""
    ok = latest.where(is_valid_quote("bid_price", "ask_price"))
    first = Window.partitionBy("symbol").orderBy(F.desc("event_time_us"), "venue")
    return ok.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


_KEY = ["symbol", "venue", "window_start_us"]


def reconcile(live: DataFrame, replay: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Full outer comparison of bars: keys on one side only, or with another vwap, close or count."""
    a = live.select(*_KEY, F.struct("vwap", "close", "trade_count").alias("l"))
    b = replay.select(*_KEY, F.struct("vwap", "close", "trade_count").alias("r"))
    both = a.join(b, _KEY, "full_outer")
    verdict = (
        F.when(F.col("l").isNull(), "replay_only").when(F.col("r").isNull(), "live_only")
        .when((F.abs(F.col("l.vwap") - F.col("r.vwap")) > tolerance) | (F.col("l.close") != F.col("r.close")) | (F.col("l.trade_count") != F.col("r.trade_count")), "mismatch")
    )
    return both.select(*_KEY, verdict.alias("verdict")).where("verdict is not null")


FIELDS = ("open", "high", "low", "close", "volume", "vwap", "trade_count")


def compare_fields(live: DataFrame, replay: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(key, field, live, replay) of shared windows whose field differs by more than the relative tolerance."""
    long = lambda df, name: df.select(*_KEY, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias(name)) for f in FIELDS])).alias("f")).select(*_KEY, "f.*")
    both = long(live, "live").join(long(replay, "replay"), [*_KEY, "field"])
    scale = F.greatest(F.abs("live"), F.abs("replay"), F.lit(1e-300))
    return both.where(F.abs(F.col("live") - F.col("replay")) / scale > tolerance)


LEAST_SHARED = 5


def comparison_verdict(live: DataFrame, replay: DataFrame, tolerance: float = 1e-9, least: int = LEAST_SHARED) -> DataFrame:
    """One row (shared, mismatched, verdict): too_few shared windows prove nothing, else mismatch or equal."""
    shared = live.select(*_KEY).distinct().join(replay.select(*_KEY).distinct(), _KEY).agg(F.count(F.lit(1)).alias("shared"))
    wrong = compare_fields(live, replay, tolerance).agg(F.count(F.lit(1)).alias("mismatched"))
    verdict = F.when(F.col("shared") < least, "too_few").when(F.col("mismatched") > 0, "mismatch").otherwise("equal")
    one = F.lit(1).alias("one")
    return shared.select("shared", one).join(wrong.select("mismatched", one), "one").select("shared", "mismatched", verdict.alias("verdict"))


def one_sided(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of ``a`` that ``b`` lacks."""
    return a.select(*_KEY).distinct().join(b.select(*_KEY), _KEY, "left_anti")


# --- requests --------------------------------------------------------------------------------------------------------


def sign(secret: str, text: str) -> str:
    return base64.b64encode(hmac.new(secret.encode(), text.encode(), hashlib.sha256).digest()).decode()


@pandas_udf(T.BooleanType())
def signature_ok(secret: pd.Series, text: pd.Series, signature: pd.Series) -> pd.Series:
    """Constant-time comparison of an HMAC-SHA256; nulls are no signature."""
    return (secret + "\x01" + text + "\x01" + signature).map(_matches)


def _matches(joined: object) -> bool:
    if not isinstance(joined, str):
        return False
    secret, text, signature = joined.split("\x01", 2)
    return hmac.compare_digest(sign(secret, text), signature)


def replay_verdicts(requests: DataFrame, order: str, skew_s: int = SKEW_S) -> DataFrame:
    """TIMESTAMP_OUT_OF_WINDOW beyond the skew (the nonce isn't used up), else OK where the nonce is free, else NONCE_REUSED.

    A nonce is claimed per key, in order of now_s and ``order`` (a unique integer), for twice the skew; then it's free again.
    """
    fresh = F.abs(F.col("now_s") - F.col("timestamp_s")) <= skew_s
    claims = paced(requests.where(fresh).select("key_id", "nonce", "now_s", order), ["key_id", "nonce"], ["now_s", order], "now_s", 2 * skew_s, DAY_S)
    claims = claims.select(F.col(order).alias("__order"), "due")
    verdict = F.when(~F.coalesce(fresh, F.lit(False)), "TIMESTAMP_OUT_OF_WINDOW").when(F.col("due"), "OK").otherwise("NONCE_REUSED")
    return requests.join(claims, F.col(order) == F.col("__order"), "left").withColumn("verdict", verdict).drop("__order", "due")


def authenticated(requests: DataFrame, keys: DataFrame, order: str) -> DataFrame:
    """Verdict of each request in this order: credentials, key, usable key, signature, replay, rate. Later checks see only what passed.

    ``keys`` has key_id, secret, enabled, rate_limit_capacity and rate_limit_refill_per_second; it is joined without a
    hint, so Catalyst broadcasts it while it is known to be small. ``order`` is a unique integer; only what passed the
    replay check takes a token, in order of time.
    """
    r = requests.join(keys.select("key_id", "secret", "enabled", "rate_limit_capacity", "rate_limit_refill_per_second"), "key_id", "left")
    text = canonical_request("method", "path", "timestamp_s", "nonce", "body")
    absent = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    early = (
        F.when(absent("key_id") | absent("signature") | absent("nonce") | ~F.coalesce(F.col("timestamp_s") > 0, F.lit(False)), "MISSING_CREDENTIALS").when(F.col("secret").isNull(), "UNKNOWN_KEY")
        .when(~F.coalesce("enabled", F.lit(False)), "DISABLED_KEY").when(~signature_ok(F.coalesce("secret", F.lit("")), text, F.coalesce("signature", F.lit(""))), "BAD_SIGNATURE")
    )
    limits = ["rate_limit_capacity", "rate_limit_refill_per_second"]
    checked = r.withColumn("early", early).drop("secret", "enabled")
    checked = checked.sparkSession.read.parquet(write_shared(checked, "requests"))  # read thrice, signatures are dear
    passed = replay_verdicts(checked.where("early is null"), order)
    passed = passed.sparkSession.read.parquet(write_shared(passed, "passed"))
    spent = rate_limited(passed.where("verdict = 'OK'").select("key_id", "now_s", order, (F.col("now_s") * 1000).alias("__ms"), F.lit(1.0).alias("__cost"), *limits), "key_id", ["now_s", order], "__ms", "__cost", *limits, width=DAY_S)
    spent = spent.where("not allowed").select(F.col(order).alias("__order"), F.lit("RATE_LIMITED").alias("__late"))
    late = passed.join(spent, F.col(order) == F.col("__order"), "left").withColumn("verdict", F.coalesce("__late", "verdict")).drop("early", "__order", "__late", *limits)
    return late.unionByName(checked.where("early is not null").withColumn("verdict", F.col("early")).drop("early", *limits))
