import random

import pytest

from tickforge.operators.changefeed import BookStore, closing_books

S = "arrival bigint, session_id bigint, venue string, symbol string, is_snapshot boolean, bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>, event_time_us bigint, sequence bigint, file string, pos bigint"


def brute(data):
    changes = {}
    for a, s, v, y, snap, bids, asks, t, q, *_ in sorted(data, key=lambda d: d[0]):
        if y is not None:
            changes.setdefault((s, v, y), {}).setdefault(q if q is not None and q >= 0 else t, (snap, bids, asks))
    out = []
    for key, by_order in changes.items():
        book = {}
        for o in sorted(by_order):
            snap, bids, asks = by_order[o]
            if snap:
                book = {}
            for side, levels in (("bid", bids), ("ask", asks)):
                for level in levels or []:
                    if level is None or level[0] is None:
                        continue
                    if level[1] is not None and level[1] > 0:
                        book[side, level[0]] = level[1]
                    else:
                        book.pop((side, level[0]), None)
        out += [(*key, side, p, z) for (side, p), z in book.items()]
    return sorted(out)


def level(r):
    return None if r.random() < 0.03 else (r.choice([None, 1.0, 2.0, 3.0, 4.0]), r.choice([None, -1.0, 0.0, 1.0, 2.0, 3.0]))


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, rows, seed):
    r = random.Random(seed)
    side = lambda: None if r.random() < 0.15 else [level(r) for _ in range(r.randrange(4))]
    data = [(i, r.choice([1, 2]), r.choice("ab"), r.choice(["X", "X", "Y", None]), r.choice([True, False, False, False, None]), side(), side(), r.randrange(1000), r.choice([-1, r.randrange(60)]) if i % 2 else r.randrange(60), "f", 7) for i in range(220)]
    data += [(1000 + d[0], *d[1:]) for d in data[:40]]  # repeats
    assert rows(closing_books(spark.createDataFrame(data, S))) == brute(data)


def test_snapshot_with_empty_sides_clears(spark, rows):
    data = [(1, 1, "a", "X", False, [(1.0, 2.0)], None, 0, 1, "", 0), (2, 1, "a", "X", True, None, [], 0, 2, "", 0)]
    assert rows(closing_books(spark.createDataFrame(data, S))) == []


def test_empty(spark, rows):
    assert rows(closing_books(spark.createDataFrame([], S))) == []


@pytest.mark.parametrize("seed", range(2))
def test_batches_in_any_order_give_one_result(spark, rows, seed):
    r = random.Random(10 + seed)
    side = lambda: None if r.random() < 0.15 else [level(r) for _ in range(r.randrange(4))]
    data = [(i, 1, r.choice("ab"), r.choice(["X", None]), r.choice([True, *[False] * 6]), side(), side(), 0, i, "f", 7) for i in range(120)]
    data += r.sample(data, 30)  # repeats, in other batches too
    whole = rows(closing_books(spark.createDataFrame(data, S), 1))
    assert whole == brute(data)
    assert rows(closing_books(spark.createDataFrame(data, S), 3)) == whole
    r.shuffle(data)
    store = BookStore(spark)
    for i in range(3):
        store.apply(spark.createDataFrame(data[50 * i : 50 * i + 50], S))
    assert rows(store.levels()) == whole


def bits(store):
    return sum(bin(b).count("1") for x in store.delete_vectors().collect() for b in x.bitmap)


def test_only_superseded_positions_are_set(spark, rows):
    books = BookStore(spark)
    store = books.store
    books.apply(spark.createDataFrame([(i, 1, "a", "X", False, [(float(i), 1.0)], None, 0, i, "", 0) for i in range(5)], S))
    assert bits(store) == 0
    books.apply(spark.createDataFrame([(10, 1, "a", "X", False, [(2.0, 9.0), (3.0, 0.0)], None, 0, 10, "", 0)], S))
    assert rows(store.read(), "price", "size") == [(0.0, 1.0), (1.0, 1.0), (2.0, 9.0), (4.0, 1.0)]
    assert bits(store) == 2 and store.images().count() == 6  # the old images of 2 and 3; a removal is no image
    # late: older than the removal of 3 and the image of 2, newer than nothing
    books.apply(spark.createDataFrame([(11, 1, "a", "X", False, [(3.0, 5.0), (2.0, 5.0), (7.0, 5.0)], None, 0, 8, "", 0)], S))
    assert rows(store.read(), "price", "size") == [(0.0, 1.0), (1.0, 1.0), (2.0, 9.0), (4.0, 1.0), (7.0, 5.0)]
    assert bits(store) == 2
    # a snapshot replaces what is older, whichever batch it was in
    books.apply(spark.createDataFrame([(12, 1, "a", "X", True, None, [(6.0, 1.0)], 0, 9, "", 0)], S))
    assert rows(store.read(), "side", "price") == [("ask", 6.0), ("bid", 2.0)]
    assert bits(store) == 6


def test_a_change_that_came_before_isnt_applied_again(spark, rows):
    books = BookStore(spark)
    books.apply(spark.createDataFrame([(1, 1, "a", "X", False, [(1.0, 1.0)], None, 0, 5, "", 0)], S))
    books.apply(spark.createDataFrame([(2, 1, "a", "X", False, [(1.0, 2.0), (9.0, 9.0)], None, 0, 5, "", 0)], S))
    assert rows(books.levels(), "price", "size") == [(1.0, 1.0)]
