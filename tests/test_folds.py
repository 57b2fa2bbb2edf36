import random

import pytest

from tickforge.operators import folds
from tickforge.operators.folds import Book, DenseSequence, GapDetector, TokenBucket


@pytest.mark.parametrize(
    ("sequence", "want"),
    [
        ([10, 11, 12, 13], ["first", "ok", "ok", "ok"]), ([1, 3], ["first", "gap"]), ([5, 6, 6, 7], ["first", "ok", "duplicate", "ok"]),
        ([900_000, 900_001, 5, 6], ["first", "ok", "regression", "ok"]), ([-1, -1, -1], ["unsequenced"] * 3), ([10, 5, 11], ["first", "duplicate", "ok"]),
    ],
)
def test_gap_lifecycles(sequence, want):
    d = GapDetector()
    assert [d.observe(s)[0] for s in sequence] == want


def test_gap_counts_and_resync():
    d = GapDetector()
    assert [d.observe(s) for s in (100, 5000)] == [("first", 0), ("gap", 4899)]
    d = GapDetector(resync=True)
    assert [d.observe(s)[0] for s in (1, 3, 5)] == ["first", "gap", "first"]


def test_gap_fold_over_a_frame(spark, rows):
    r = random.Random(0)
    data = [(v, s, i, r.choice([None, -1, i, i + 2, max(0, i - 3), 5000 + i])) for i in range(300) for v, s in [(r.choice("ab"), r.choice(["X", None]))]]
    got = rows(folds.sequence_status(spark.createDataFrame(data, "venue string, symbol string, arrival bigint, sequence bigint"), ["venue", "symbol"], "arrival"))
    want, state = [], {}
    for v, s, i, q in data:
        q = -1 if q is None else q
        want.append((v, s or "", i, q, *state.setdefault((v, s), GapDetector()).observe(q)))
    assert got == sorted(want)


def test_connection_scope(spark, rows):
    df = spark.createDataFrame([("coinbase", "X"), ("kraken", "X"), ("kraken", None)], "venue string, symbol string")
    assert rows(folds.connection_scope(df, ["coinbase"], "trades"), "scope_symbol", "scope_channel") == [("", "connection"), ("", "trades"), ("X", "trades")]


def test_dense_sequence():
    d = DenseSequence()
    assert [d.next(*x) for x in [(100, 110), (111, 130), (131, 131), (141, 150), (145, 150)]] == [0, 1, 2, 12, 12]
    assert DenseSequence().next(9, 9) == 0


def lv(*pairs):
    return [{"price": float(p), "size": float(s)} for p, s in pairs]


def test_book_laws():
    book = Book(3)
    book.apply(True, lv((100, 1), (99, 2), (98, 3)), lv((101, 1), (102, 2)), 1, 10)
    book.apply(False, lv((99, 7), (98, 0), (97, 4)), lv((101, 0), (555, 0)), 2, 20)
    assert book.side(0) == [(100, 1), (99, 7), (97, 4)] and book.best(1) == (102, 2) and (book.sequence, book.event_time_us) == (2, 20)
    book.apply(False, lv((100.5, 1)), None, 3, 30)
    assert [p for p, _ in book.side(0)] == [100.5, 100, 99]  # trimmed to three
    assert Book.restore(book.snapshot(), 3).snapshot() == book.snapshot()
    book.apply(False, lv((102, 1)), None, 4, 40)
    assert book.crossed and book.quote()[0] == 102  # locked: crossed as a book, valid as a quote
    book.apply(True, lv((1, 9)), lv((2, 1)), 5, 50)
    assert book.imbalance() == pytest.approx(0.8)
    book.apply(True, [], lv((2, 1)), 6, 60)
    assert book.quote() is None and book.imbalance() == -1.0
    assert Book().imbalance() == 0.0


S = "arrival bigint, session_id bigint, venue string, symbol string, is_snapshot boolean, bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>, event_time_us bigint, sequence bigint"


def test_final_books(spark, rows):
    data = [(1, 1, "a", "X", True, [(1.0, 1.0), (0.9, 2.0)], [(1.1, 1.0)], 10, 1), (2, 1, "a", "X", False, [(1.0, 0.0), (0.8, 5.0)], None, 20, 2), (3, 1, "a", None, False, [(9.0, 9.0)], None, 30, 3)]
    got = rows(folds.final_books(spark.createDataFrame(data, S)), "side", "price", "size", "level")
    assert got == [("ask", 1.1, 1.0, 1), ("bid", 0.8, 5.0, 2), ("bid", 0.9, 2.0, 1)]
    assert rows(folds.final_books(spark.createDataFrame([], S))) == []


def test_emission_only_of_changed_valid_tops(spark, rows):
    step = 100_000
    mk = lambda a, snap, bid, ask: (a, 1, "a", "X", snap, [(bid, 1.0)], [(ask, 1.0)], a * step + 1, a)
    data = [mk(1, True, 1.0, 2.0), mk(2, True, 1.0, 2.0), mk(3, True, 1.5, 2.0), mk(4, True, 3.0, 2.0), mk(5, True, 1.2, 2.0), mk(6, True, 1.2, 2.0)]
    states = folds.book_states(spark.createDataFrame(data, S))
    q = folds.book_ticks(states, top_only=True)
    assert rows(q.where("not suppressed"), "emit_time_us", "bid_price") == [(2 * step, 1.0), (4 * step, 1.5), (6 * step, 1.2)]
    assert q.where("suppressed").count() == 3  # two unchanged, the last tick among them, and one crossed
    assert rows(folds.book_counters(states, q), "crossed_books", "snapshots_applied", "quotes_emitted", "quotes_suppressed") == [(1, 6, 3, 3)]


def test_the_last_tick_of_a_book_comes(spark, rows):
    one = [(1, 1, "a", "X", True, [(1.0, 1.0)], [(2.0, 1.0)], 5, 1)]
    two = [*one, (2, 1, "a", "X", False, [(1.5, 1.0)], None, 250_000, 2)]
    assert rows(folds.book_ticks(folds.book_states(spark.createDataFrame(one, S))), "bid_price", "emit_time_us") == [(1.0, 100_000)]
    assert rows(folds.book_ticks(folds.book_states(spark.createDataFrame(two, S))), "bid_price", "emit_time_us") == [(1.0, 100_000), (1.5, 300_000)]
    assert rows(folds.book_ticks(folds.book_states(spark.createDataFrame([], S)))) == []


def in_one_pass(states, data, names, keys):
    from collections import namedtuple

    make, out = namedtuple("Row", names)._make, []
    kept = {}
    for d in data:
        r = make(d)
        key = tuple(getattr(r, k) for k in keys)
        out += kept.setdefault(key, states()).row(r)
    return sorted(out)


@pytest.mark.parametrize("resync", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_slices_of_a_key_give_what_one_pass_gives(spark, rows, seed, resync):
    r, q, data = random.Random(seed), 5_000, []
    for i in range(3_000):
        q = max(0, q + r.choice([1] * 12 + [0, -1, 2, 3, -500, 700, -1500, 2000, -3]))
        data.append((r.choice("aab"), i, r.choice([q] * 9 + [-1])))
    df = spark.createDataFrame(data, "venue string, arrival bigint, sequence bigint")
    got = rows(folds.sequence_status(df, ["venue"], "arrival", resync=resync, width=37))
    assert got == in_one_pass(lambda: folds._Sequences(["venue"], "arrival", GapDetector(resync)), data, ["venue", "arrival", "sequence"], ["venue"])


@pytest.mark.parametrize("resync", [False, True])
def test_slices_soon_know_their_state(resync):
    states = folds.GapStates(resync)
    seen = [states.observe(q) for q in range(100, 1_300)]
    at = next(i for i, s in enumerate(seen) if s)
    assert at <= 1_002 and seen[at].last == 100 + at


@pytest.mark.parametrize("seed", range(3))
def test_sliced_books_limits_and_streams(spark, rows, seed):
    r = random.Random(seed)
    lv = lambda: [(r.choice([1.0, 1.5, 2.0, 2.5]), r.choice([0.0, 1.0, 2.0])) for _ in range(r.randrange(1, 4))]
    deltas = [(i, 1, r.choice("aab"), "X", r.random() < 0.1, lv(), lv(), i * 30_000 + r.randrange(100_000), i) for i in range(400)]
    df = spark.createDataFrame(deltas, S)
    wide, narrow = (folds.book_states(df, depth=2, width=w) for w in (1_000_000, 7))
    assert rows(narrow) == rows(wide) and len(rows(wide)) == 400
    assert rows(folds.book_ticks(narrow, width=5)) == rows(folds.book_ticks(wide, width=1_000_000))
    ms, requests = 0, []
    for i in range(400):
        ms += r.choice([0, 100, 400, -50, 5_000])
        requests.append((r.choice("kkz"), i, ms, 1.0))
    df = spark.createDataFrame(requests, "k string, i bigint, now_ms bigint, cost double")
    got = rows(folds.rate_limited(df, "k", ["i"], "now_ms", "cost", 3, 1, width=9))
    assert got == in_one_pass(lambda: folds._Limits("k", ["i"]), [(*x, 3.0, 1.0) for x in requests], ["k", "i", "now_ms", "cost", "capacity", "refill"], ["k"])
    updates = sorted((r.randrange(20_000_000), i, r.choice("sst")) for i in range(300))
    df = spark.createDataFrame([(s, t, i) for t, i, s in updates], "s string, us bigint, i bigint")
    got = rows(folds.paced(df, ["s"], ["us", "i"], "us", 100_000, width=1_000_000))
    assert rows(folds.coalesced(df, "s", ["us", "i"], "us", 10)) == [x[:3] for x in got if x[3]]
    assert got == in_one_pass(lambda: folds._Paced(["s"], ["us", "i"], 100_000), [(s, t, i, t) for t, i, s in updates], ["s", "us", "i", "at"], ["s"])
    ranges = [("a", i, q, q + r.randrange(4)) for i, q in enumerate(sorted(r.randrange(2_000) for _ in range(300)))]
    r.shuffle(ranges)
    ranges = [(k, i, a, b) for i, (k, _, a, b) in enumerate(ranges)]
    d = DenseSequence()
    want = [("a", i, d.next(a, b)) for _, i, a, b in ranges]
    assert rows(folds.dense_sequence(spark.createDataFrame(ranges, "k string, i bigint, a bigint, b bigint"), ["k"], "i", "a", "b", width=11)) == want


def test_token_bucket():
    b = TokenBucket(2, 1)
    assert [b.take(t, 1) for t in (0, 0, 0, 500, 2000)] == [(True, 1, 0), (True, 0, 0), (False, 0, 1), (False, 0, 1), (True, 1, 0)]
    assert TokenBucket(5, 0.5).take(0, 10) == (False, 5, 10)
    assert b.take(1000, 1)[0]  # a clock that goes back refills nothing


def test_rate_limits_and_coalescing(spark, rows):
    req = spark.createDataFrame([("k", i, i * 100, 1.0) for i in range(5)] + [("z", 9, 0, 1.0)], "k string, i bigint, ms bigint, cost double")
    assert [x[2] for x in rows(folds.rate_limited(req, "k", ["i"], "ms", "cost", 3, 1))] == [True, True, True, False, False, True]
    up = spark.createDataFrame([("s", i, i * 40_000) for i in range(6)], "s string, i bigint, us bigint")
    assert [x[1] for x in rows(folds.coalesced(up, "s", ["us"], "us", 10))] == [0, 120_000]


def test_keys_may_be_null_and_numbers_large(spark, rows):
    big = 2**62 + 1
    req = spark.createDataFrame([(None, big + i, 0, 1.0) for i in range(3)] + [(big, 1, 0, None), (big, 2, None, 1.0)], "k bigint, i bigint, ms bigint, cost double")
    got = rows(folds.rate_limited(req, "k", ["i"], "ms", "cost", 2, 1), "k", "i", "allowed")
    assert got == [(None, big, True), (None, big + 1, True), (None, big + 2, False), (big, 1, True)]
