import random
import statistics

from tickforge.operators.latebars import bars_from_counts, corrected_bars, merge_counts, value_counts, wrong_bars

S = "arrival bigint, venue string, symbol string, price double, size double, event_time_us bigint, ingest_time_us bigint, n bigint"
U = 1_000_000


def data(seed, n=300):
    r = random.Random(seed)
    return [(i, "v", r.choice(["X", "X", "Y", None]), r.choice([None, float("nan"), -1.0, 0.0, *map(float, range(1, 9))]), r.choice([None, -1.0, 0.0, 1.5, 2.0]), t := r.choice([-1, 0, *range(1, 1500 * U, 7 * U)]), t + r.choice([0, 5 * U, 400 * U, 900 * U, 1200 * U]), 1) for i in range(n)]


def brute(rows):
    out = {}
    for _, v, s, p, z, t, g, _ in rows:
        if s is None or p is None or z is None or not (t > 0 and p > 0 and z >= 0):
            continue
        w = t // (300 * U) * 300 * U
        if g < w + 900 * U:
            out.setdefault((v, s, w), []).append(p)
    return {k: (min(p), max(p), statistics.median_low(p), len(set(p)), len(p)) for k, p in out.items()}


def as_dict(df):
    return {(r.venue, r.symbol, r.window_start_us): (r.low, r.high, r.median_price, r.distinct_prices, r.trade_count) for r in df.collect()}


def test_against_brute_force_with_surplus(spark):
    all_rows = data(1)
    df = spark.createDataFrame(all_rows, S)
    surplus = df.where("arrival % 5 = 0")
    assert as_dict(corrected_bars(df, surplus)) == brute([x for x in all_rows if x[0] % 5])


def test_late_batches_correct_a_state_in_any_order(spark):
    all_rows = data(2)
    parts = [value_counts(spark.createDataFrame(all_rows[i::3], S)) for i in range(3)]
    assert as_dict(bars_from_counts(merge_counts(*parts))) == brute(all_rows)
    assert as_dict(bars_from_counts(merge_counts(merge_counts(parts[2], parts[0]), parts[1]))) == brute(all_rows)


def test_wrong_bars(spark, rows):
    df = spark.createDataFrame([(1, "v", "X", 1.0, 1.0, 1, 2, 0), (2, "v", "X", 1.0, 1.0, 301 * U, 302 * U, 0), (3, "v", "Z", 1.0, 1.0, 5, 6, 0)], S)
    bars = corrected_bars(df, df.limit(0))
    k = "venue string, symbol string, window_start_us bigint, trade_count bigint"
    published = spark.createDataFrame([("v", "X", 0, 1), ("v", "X", 0, 1), ("v", "X", 300 * U, 2), ("v", "Y", 0, 0), ("v", "Z", 0, None)], k)
    assert rows(wrong_bars(published, bars)) == [("v", "X", 300 * U), ("v", "Y", 0), ("v", "Z", 0)]
    assert rows(wrong_bars(published.limit(0), bars)) == [("v", "X", 0), ("v", "X", 300 * U), ("v", "Z", 0)]
    assert rows(wrong_bars(published.limit(0), corrected_bars(df.limit(0), df.limit(0)))) == []
