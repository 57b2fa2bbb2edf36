import pytest
from pyspark.sql import functions as F

from tickforge.operators import metrics, serving

B = "symbol string, venue string, window_start_us bigint, open double, high double, low double, close double, volume double, vwap double, trade_count bigint"


def bar(s, v, w, x=1.0, n=1):
    return (s, v, w, x, x, x, x, x, x, n)


def test_range_queries(spark, rows):
    bars = spark.createDataFrame([bar("X", v, w) for w in (0, 10, 20) for v in "ba"] + [bar("Y", "a", 10)], B)
    assert [(r.window_start_us, r.venue) for r in serving.bars_in_range(bars, "X", 0, 20).collect()] == [(0, "a"), (0, "b"), (10, "a"), (10, "b")]
    assert serving.bars_in_range(bars, "X", 0, 99, "b", 2).count() == 2
    for bad in (("X", 5, 5), ("", 0, 1), (" ", 0, 1)):
        with pytest.raises(ValueError):
            serving.bars_in_range(bars, *bad)
    assert serving.checked_limit(None) == 1000 and serving.checked_limit(10**6) == 50_000 and serving.checked_rate(0) == 10 and serving.checked_rate(500) == 100
    with pytest.raises(ValueError):
        serving.checked_symbols(["s"] * 65)
    day = serving.DAY_US
    assert serving.routed_range(bars, bars, 8 * day, "X", 0, 20).first().served_from == "lakehouse"
    assert serving.routed_range(bars, bars, 7 * day, "X", 0, 20).first().served_from == "olap"


def test_latest_and_best(spark, rows):
    q = spark.createDataFrame([("X", "a", 1.0, 2.0, 5, 1), ("X", "a", 3.0, 2.0, 9, 2), ("X", "b", 1.0, 2.0, 9, 3), ("X", "c", 1.0, 1.0, 9, 4), ("Y", "a", None, 2.0, 9, 5)], "symbol string, venue string, bid_price double, ask_price double, event_time_us bigint, n bigint")
    latest = serving.latest_quotes(q, "n")
    assert rows(latest, "symbol", "venue", "n") == [("X", "a", 2), ("X", "b", 3), ("X", "c", 4), ("Y", "a", 5)]
    assert rows(serving.best_quotes(latest), "symbol", "venue") == [("X", "b")]
    assert serving.latest_quotes(q, "n", 3, 12).count() == 4 and serving.latest_quotes(q, "n", 2, 12).count() == 0


def test_reconciliation(spark, rows):
    live = spark.createDataFrame([bar("X", "a", 0), bar("X", "a", 1), bar("X", "a", 2)], B)
    replay = spark.createDataFrame([bar("X", "a", 1), bar("X", "a", 2, 1.5), bar("X", "a", 3)], B)
    assert rows(serving.reconcile(live, replay), "window_start_us", "verdict") == [(0, "live_only"), (2, "mismatch"), (3, "replay_only")]
    assert {r.field for r in serving.compare_fields(live, replay).collect()} == set(serving.FIELDS) - {"trade_count"}
    assert rows(serving.one_sided(live, replay), "window_start_us") == [(0,)]
    assert rows(serving.comparison_verdict(live, replay), "shared", "mismatched", "verdict") == [(2, 6, "too_few")]
    assert rows(serving.comparison_verdict(live, replay, least=1), "verdict") == [("mismatch",)]
    assert rows(serving.comparison_verdict(live, live, least=3), "verdict") == [("equal",)]
    assert rows(serving.reconcile(live.limit(0), replay.limit(0))) == []


def test_requests(spark, rows):
    text = "\n".join(["GET", "/x", "100", "n", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"])
    good = serving.sign("s", text)
    r = spark.createDataFrame(
        [(1, "k", "n", 100, 100, "GET", "/x", None, good), (2, "k", "n", 100, 100, "GET", "/x", "", good), (3, "k", "n", 100, 131, "GET", "/x", None, good), (4, "k", "n", 100, 100, "GET", "/y", None, good), (5, "z", "n", 100, 100, "GET", "/x", None, good), (6, "off", "n", 100, 100, "GET", "/x", None, good), (7, None, "n", 100, 100, "GET", "/x", None, None)],
        "i bigint, key_id string, nonce string, timestamp_s bigint, now_s bigint, method string, path string, body string, signature string")
    keys = spark.createDataFrame([("k", "s", True, 9, 1.0), ("off", "s", False, 9, 1.0)], "key_id string, secret string, enabled boolean, rate_limit_capacity int, rate_limit_refill_per_second double")
    assert [x[1] for x in rows(serving.authenticated(r, keys, "i"), "i", "verdict")] == ["OK", "NONCE_REUSED", "TIMESTAMP_OUT_OF_WINDOW", "BAD_SIGNATURE", "UNKNOWN_KEY", "DISABLED_KEY", "MISSING_CREDENTIALS"]


def test_a_nonce_is_free_again_after_its_lifetime(spark, rows):
    r = spark.createDataFrame([(i, "k", "n", t, t) for i, t in enumerate([1000, 1059, 1060, 1061, 5000])] + [(9, "z", "n", 1059, 1059), (8, "z", "n", 1000, 1031), (7, None, "n", 5, None)], "i bigint, key_id string, nonce string, timestamp_s bigint, now_s bigint")
    assert rows(serving.replay_verdicts(r, "i"), "i", "verdict") == [(0, "OK"), (1, "NONCE_REUSED"), (2, "OK"), (3, "NONCE_REUSED"), (4, "OK"), (7, "TIMESTAMP_OUT_OF_WINDOW"), (8, "TIMESTAMP_OUT_OF_WINDOW"), (9, "OK")]


def test_rate_comes_last(spark, rows):
    from tickforge.functions.market import canonical_request

    r = spark.createDataFrame([(i, "k", f"n{max(i, 1)}", 100 + i // 3, 100 + i // 3, "GET", "/x", None) for i in range(6)], "i bigint, key_id string, nonce string, timestamp_s bigint, now_s bigint, method string, path string, body string")
    texts = {x.i: x.t for x in r.select("i", canonical_request("method", "path", "timestamp_s", "nonce", "body").alias("t")).collect()}
    signed = spark.createDataFrame([(*x, serving.sign("s", texts[x.i])) for x in r.collect()], f"{', '.join(f'{c} {t}' for c, t in r.dtypes)}, signature string")
    keys = spark.createDataFrame([("k", "s", True, 2, 1.0)], "key_id string, secret string, enabled boolean, rate_limit_capacity int, rate_limit_refill_per_second double")
    got = [x[1] for x in rows(serving.authenticated(signed, keys, "i"), "i", "verdict")]
    assert got == ["OK", "NONCE_REUSED", "OK", "OK", "RATE_LIMITED", "RATE_LIMITED"]


def test_metrics(spark, rows):
    df = spark.createDataFrame([("a", i * 1_000_000, i / 100) for i in range(100)] + [("a", 500_000_000, None)], "v string, t bigint, lag double")
    assert rows(metrics.event_rate(df.where("t < 60000000"), "t", 60, "v"), "n", "per_second") == [(60, 1.0)]
    assert rows(metrics.silent_periods(df, "t", 300_000_000, "v")) == [("a", 99_000_000, 500_000_000)]
    assert rows(metrics.nearest_rank(df, "lag", 50, "v"), "value") == [(0.5,)]  # round(49.5), to even
    h = metrics.histogram_quantile(df, F.col("lag"), 0.5, "v").first()
    assert h.quantile == pytest.approx(0.25 + 0.25 * (50 - 26) / (51 - 26))
    c = spark.createDataFrame([("a", 0, 10), ("a", 60, 15), ("a", 120, 3), ("a", 180, 8)], "v string, s bigint, c bigint")
    assert rows(metrics.counter_increase(c, "c", "s", 120, "v"), "s", "increase") == [(0, 0), (60, 5), (120, 8), (180, 8)]
    st = spark.createDataFrame([("a", "ok", 0), ("a", "duplicate", 0), ("a", "gap", 3)], "v string, status string, missing bigint")
    assert rows(metrics.pipeline_stats(st, "v"), "received", "published", "duplicates", "gaps", "missed") == [(3, 2, 1, 1, 3)]
    assert rows(metrics.lost_messages(df, st, st.limit(1), "v"), "v", "received", "dropped", "stored", "lost") == [("a", 101, 3, 1, 97)]
    amp = metrics.read_amplification(spark.createDataFrame([("t", 1), ("b", 9)], "k string, n bigint"), "k", "n", ["t"]).first()
    assert amp.amplification == 10.0 and amp.waste == pytest.approx(0.9)
    jobs = spark.createDataFrame([("one", 100, 0, 5), ("one", 300, 1, 7), ("per_topic", 60, 0, 2)], "l string, ms bigint, f bigint, s bigint")
    assert rows(metrics.layout_report(jobs, "l", "ms", "f", "s")) == [("one", 200.0, 300, 1, 12), ("per_topic", 60.0, 60, 0, 2)]
