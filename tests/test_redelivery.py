import random

import numpy as np
import pytest

from tickforge.operators import redelivery
from tickforge.operators.redelivery import Bloom, exactly_once, surplus_deliveries

S = "arrival bigint, venue string, symbol string, trade_id string, sequence bigint, ingest_time_us bigint, price double, first bigint"


def brute(data):
    """First arrivals by messages met in order of arrival."""
    groups, out = {}, []
    mains = {}
    for a, v, s, t, q, *_ in sorted(data):
        t = (t or "").strip().lower() or None
        q = None if q is None or q < 0 else q
        if t and q is not None:
            mains.setdefault((v, t), q)
    for a, v, s, t, q, *_ in sorted(data):
        t = (t or "").strip().lower() or None
        q = None if q is None or q < 0 else q
        if t is None and q is None:
            continue
        key = (v, t, q if q is not None else mains.get((v, t))) if t else (v, None, s, q)
        if key in groups:
            out.append((groups[key], a))
        else:
            groups[key] = a
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, rows, seed):
    r = random.Random(seed)
    ids = ["t1", "T1 ", " t2", "t3", "", None, *[f"u{i}" for i in range(60)]]
    data = [(i, r.choice("ab"), r.choice(["X", "Y", None]), r.choice(ids), r.choice([-1, None, 5, 6, *range(100, 130)]), r.choice([None, *range(0, 50)]), 1.0, 1) for i in range(300)]
    df = spark.createDataFrame(data, S)
    assert rows(surplus_deliveries(df, 7), "first_arrival", "arrival") == brute(data)
    kept = {x[0] for x in rows(exactly_once(df, 7), "arrival")}
    assert kept == {d[0] for d in data} - {a for _, a in brute(data)}


def test_hot_message_and_passed_columns(spark, rows):
    data = [(i, "a", "X", "hot" if i % 3 == 0 else f"m{i}", -1, i, float(i), 1) for i in range(600)]
    got = rows(surplus_deliveries(spark.createDataFrame(data, S), 50), "first_arrival", "arrival", "price")
    assert got == [(0, i, float(i)) for i in range(3, 600, 3)]


def test_columns_that_are_kept(spark, rows):
    df = spark.createDataFrame([(i, "a", "X", "m", -1, i, float(i), 1) for i in range(3)], S)
    assert set(surplus_deliveries(df, keep=["price"]).columns) == {"arrival", "first_arrival", "price"}
    assert rows(surplus_deliveries(df, keep=[]), "first_arrival", "arrival") == [(0, 1), (0, 2)]


def test_old_buckets_hold_no_identifiers():
    history = redelivery._History()
    for b in range(3 * redelivery.BRANCH**redelivery.LEVELS):
        history.add(b, np.array([b], np.int64))
    assert len(history.levels) == redelivery.LEVELS + 1 and all(n.ids is None for n in history.levels[-1])
    assert [b for b, _ in history.matches(np.array([5], np.int64))] == [5]


def test_empty(spark, rows):
    df = spark.createDataFrame([], S)
    assert rows(surplus_deliveries(df)) == [] and rows(exactly_once(df)) == []


def test_bloom_never_misses():
    ids = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 5000)
    f = Bloom(5000)
    f.add(ids)
    assert f.may_hold(ids).all()
    assert f.may_hold(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20000)).mean() < 0.02


def test_many_buckets_are_searched_as_a_tree(spark, rows):
    # 300 buckets, more than one level of filters; each message comes again 250 buckets later
    data = [(i, "a", "X", f"m{i % 500}", -1, i // 2, 1.0, 1) for i in range(600)]
    got = rows(surplus_deliveries(spark.createDataFrame(data, S), 1), "first_arrival", "arrival")
    assert got == [(i - 500, i) for i in range(500, 600)]
