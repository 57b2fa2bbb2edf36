import random

import pytest
from pyspark.sql import functions as F

from tickforge.functions import market as m
from tickforge.operators import bars as b
from tickforge.operators import divergence as dv

T = "venue string, symbol string, price double, size double, event_time_us bigint, arrival bigint, notional string"


def test_scalar_rules(spark):
    df = spark.createDataFrame([("b", 100.0, 101.0, "BTCUSDT", "0x" + "0" * 24 + "AB" * 20, "0x2540be400", "2024-01-01T00:00:00.5Z", "")], "s string, bid double, ask double, w string, topic string, hex string, time string, empty string")
    r = df.select(
        m.side("s").alias("side"), m.mid("bid", "ask").alias("mid"), m.spread_bps("bid", "ask").alias("spread"), m.is_valid_quote("bid", "bid").alias("locked_valid"), m.is_crossed("bid", "bid").alias("locked_crossed"),
        m.split_symbol("w").alias("symbol"), m.topic_address("topic").alias("address"), m.hex_to_long("hex").alias("n"), m.hex_to_decimal(F.lit("0x" + "f" * 64)).alias("big"), m.rfc3339_us("time", F.lit(7)).alias("us"),
        m.rfc3339_us("empty", F.lit(7)).alias("fallback"), m.strict_double("empty").alias("zero"), m.strict_double("w").alias("bad"), m.lenient_double("w").alias("lenient"), m.divergence_bps(F.lit(100.0), F.lit(101.0)).alias("d"),
        m.divergence_bps(F.lit(101.0), F.lit(100.0)).alias("back"), m.hex_to_long("empty").alias("none"), m.slashed_symbol(F.lit("A-B")).alias("slashed"), m.channel(F.lit("trade")).alias("channel"), m.side(F.lit("bUy")).alias("odd"),
    ).first()
    assert (r.side, r.mid, r.locked_valid, r.locked_crossed, r.symbol, r.n, r.us, r.fallback, r.zero, r.bad, r.lenient, r.none, r.slashed, r.channel, r.odd) == ("BUY", 100.5, True, True, "BTC-USD", 10_000_000_000, 1_704_067_200_500_000, 7, 0.0, None, 0.0, 0, "A/B", "trades", "UNKNOWN")
    assert r.spread == pytest.approx(1 / 100.5 * 1e4) and r.d == -r.back
    assert r.address == "0x" + "ab" * 20 and r.big == str(2**256 - 1)


def test_bar_of_known_trades(spark):
    data = [("v", "X", p, s, t, i, "") for i, (p, s, t) in enumerate([(150.0, 1.0, 5000), (100.0, 1.0, 1000), (200.0, 9.0, 9000), (175.0, 0.0, 7000)])]
    r = b.fold_bar(spark.createDataFrame(data, T)).first()
    assert (r.open, r.high, r.low, r.close, r.trade_count) == (100.0, 200.0, 100.0, 200.0, 4)
    assert r.vwap == pytest.approx((150 + 100 + 1800) / 11)


def test_bars_dont_depend_on_order_and_ties_follow_arrival(spark, rows):
    data = [("v", "X", 100.0 + i % 17, 0.1 * (i % 5 + 1), 1 + (i // 2) * 1000, i, "") for i in range(200)]
    df = spark.createDataFrame(data, T)
    back = spark.createDataFrame(data[::-1], T)
    cols = ("open", "high", "low", "close", "trade_count")
    assert rows(b.bars(df), *cols) == rows(b.bars(back.repartition(3)), *cols)
    first = b.fold_bar(df).first()
    assert (first.open, first.close) == (data[0][2], data[-1][2])


def test_zero_volume_invalid_and_empty(spark, rows):
    data = [("v", "X", 5.0, 0.0, 10, 1, ""), ("v", "X", 0.0, 1.0, 10, 2, ""), ("v", None, 5.0, 1.0, 10, 3, ""), ("v", "", 5.0, 1.0, 10, 4, ""), ("v", "X", None, 1.0, 10, 5, ""), ("v", "X", 5.0, -1.0, 10, 6, ""), ("v", "X", 5.0, 1.0, 0, 7, "")]
    df = spark.createDataFrame(data, T)
    assert rows(b.bars(df), "vwap", "volume", "trade_count") == [(0.0, 0.0, 1)]
    assert rows(b.bars(df.limit(0))) == []


def test_rollup_equals_direct_bars(spark):
    r = random.Random(2)
    df = spark.createDataFrame([("v", r.choice("XY"), r.randrange(1, 99) / 4, r.randrange(0, 9) / 2, r.randrange(1, 300_000_000), i, "") for i in range(300)], T)
    key = lambda x: (x.symbol, x.window_start_us)
    direct = {key(x): x for x in b.bars(df, 60).collect()}
    rolled = {key(x): x for x in b.rollup(b.bars(df, 1), 60).collect()}
    assert direct.keys() == rolled.keys()
    for k, x in direct.items():
        assert rolled[k].vwap == pytest.approx(x.vwap) and (rolled[k].open, rolled[k].close, rolled[k].trade_count) == (x.open, x.close, x.trade_count)


Q = "n bigint, symbol string, venue string, bid_price double, ask_price double, event_time_us bigint"


def fold_divergence(quotes, rules):
    """The detector as a plain loop over quotes."""
    state, rings, out = {}, {}, []
    for n, s, v, bid, ask, t in quotes:
        held = state.setdefault(s, {})
        if v in held and held[v][0] > t:
            continue
        held[v] = (t, (bid + ask) / 2, bid > 0 and ask > 0 and ask >= bid)
        fresh = sorted(x for x, (u, _, ok) in held.items() if ok and t - u <= rules.max_age_us)
        for i, a in enumerate(fresh):
            for c in fresh[i + 1 :]:
                (ta, ma, _), (tb, mb, _) = held[a], held[c]
                bps = (mb - ma) / ((ma + mb) / 2) * 1e4
                ring = rings.setdefault((s, a, c), [])
                k = len(ring)
                if k >= max(2, rules.warm):
                    mean = sum(ring) / k
                    sd = (sum((x - mean) ** 2 for x in ring) / (k - 1)) ** 0.5
                    z = (bps - mean) / sd if sd > 0 else 0.0
                    if abs(bps) >= rules.min_bps and abs(z) >= rules.min_zscore:
                        out.append((n, s, a, c, round(bps, 6), round(z, 6), min(ta, tb), max(ta, tb)))
                ring.append(bps)
                del ring[: max(0, len(ring) - rules.ring)]
    return sorted(out)


def test_divergence_against_the_plain_loop(spark, rows):
    r = random.Random(5)
    rules = dv.DivergenceRules(max_age_us=50, ring=20, warm=5, min_bps=5, min_zscore=1.5)
    quotes, t = [], 0
    for n in range(500):
        t += r.randrange(0, 12)
        mid = 100 * (1 + r.gauss(0, 3e-4) + (2e-3 if r.random() < 0.04 else 0))
        bid, ask = (mid * 1.001, mid * 0.999) if r.random() < 0.05 else (mid * 0.9999, mid * 1.0001)
        quotes.append((n, r.choice("XY"), r.choice("abc"), bid, ask, t - (30 if r.random() < 0.1 else 0)))
    got = dv.divergences(spark.createDataFrame(quotes, Q), ["a", "b", "c"], "n", rules)
    got = rows(got.select("n", "symbol", "venue_a", "venue_b", F.round("divergence_bps", 6), F.round("zscore", 6), "window_start_us", "event_time_us"))
    want = fold_divergence(quotes, rules)
    assert len(want) > 10 and got == want


def test_constant_baseline_never_fires(spark, rows):
    quotes = [(i, "X", "ab"[i % 2], 100.0, 100.0, i) for i in range(100)] + [(100, "X", "a", 110.0, 110.0, 100)]
    assert rows(dv.divergences(spark.createDataFrame(quotes, Q), ["a", "b"], "n")) == []
