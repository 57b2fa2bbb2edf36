import itertools
import random

import numpy as np
import pytest

from tickforge.operators import anomalies
from tickforge.operators.medians import exact_medians

Q = "quote_id bigint, venue string, symbol string, bid_price double, ask_price double, mid double, spread_bps double, event_time_us bigint, e string, seg int"
D = "divergence_id bigint, symbol string, venue_a string, venue_b string, divergence_bps double, event_time_us bigint, halo boolean"


def source(seed, n=400):
    r = random.Random(seed)
    mid, out, want = 100.0, [], set()
    for i in range(n):
        mid = round(mid + r.choice([-0.02, -0.01, 0.01, 0.02]), 2)
        value, spread = mid, round(r.uniform(4, 6), 3)
        if i in (100, 101, 250):
            value, _ = mid + 3.0, want.add((i, "mid"))
        if i == 160:
            mid += 5.0  # a lasting move
            value = mid
        if 300 <= i < 320:
            value, _ = 111.0, want.add((i, "mid"))
            mid = 111.0
        if i == 50:
            spread, _ = 60.0, want.add((i, "spread_bps"))
        if i == 60:
            value, _ = float("nan"), want.add((i, "mid"))
        if i == 70:
            value, _ = -1.0, want.add((i, "mid"))
        if i == 80:
            spread, _ = -3.0, want.add((i, "spread_bps"))
        if i == 90:
            value = None
        out.append((i, "v", "X", value, value, value, spread, 1_000 + 10 * i, "x", 1))
    out.append((n + 5, "v", "X", 1.0, 1.0, 500.0, 5.0, 1_000 + 10 * 40, "x", 1))  # a repeat of reading 40
    out.append((n + 6, "v", "X", 1.0, 1.0, 500.0, 5.0, 0, "x", 1))  # unusable time
    return out, want


@pytest.mark.parametrize("segment", [16_384, 60, 5])
def test_planted_cases(spark, monkeypatch, segment):
    monkeypatch.setattr(anomalies, "SEGMENT", segment)
    q, want = source(3)
    r = random.Random(1)
    d, wanted = [], set()
    for i in range(90):
        v = r.choice([-1, 1]) * r.uniform(8, 12)
        if i == 30:
            v, _ = 150.0, wanted.add((i, "divergence_bps"))
        if 40 <= i < 46:
            v, _ = 9.5, wanted.add((i, "divergence_bps"))
        if i == 60:
            v, _ = float("inf"), wanted.add((i, "divergence_bps"))
        d.append((i, "X", "a", "b", v, 10 + i, True))
    found = anomalies.implausible(spark.createDataFrame(q, Q), spark.createDataFrame(d, D)).collect()
    assert {(x.record_id, x.field_name) for x in found if x.source_table == "quotes"} == want
    assert {(x.record_id, x.field_name) for x in found if x.source_table == "divergences"} == wanted


def test_small_sources_show_only_impossible_readings(spark):
    q = [(i, "v", None, 1.0, 1.0, 1.0 if i else 900.0, 1.0, 10 + i, "", 0) for i in range(20)] + [(99, "v", "Y", 2.0, 1.0, -5.0, -9.0, 10, "", 0)]
    found = anomalies.implausible(spark.createDataFrame(q, Q), spark.createDataFrame([], D)).collect()
    assert [tuple(x) for x in found] == [("quotes", 99, "mid")]  # crossed: the negative spread is no case


def test_empty(spark):
    assert anomalies.implausible(spark.createDataFrame([], Q), spark.createDataFrame([], D)).collect() == []


def test_forward_backward_against_enumeration():
    r = np.random.default_rng(0)
    e = r.random((2, 5, 4))
    start = np.array([0.985, 0.01, 0.003, 0.002])
    got = anomalies.forward_backward(e)
    for s in range(2):
        want = np.zeros((5, 4))
        for path in itertools.product(range(4), repeat=5):
            p = start[path[0]] * e[s, 0, path[0]]
            for i in range(1, 5):
                p *= anomalies.TRANSITION[path[i - 1], path[i]] * e[s, i, path[i]]
            want[np.arange(5), path] += p
        assert np.allclose(got[s], want / want.sum(1, keepdims=True))


def test_exact_medians(spark):
    r = random.Random(4)
    data = [(k, round(r.choice([-1, 1, 1]) * 10 ** r.uniform(-3, 3), 4), r.randrange(0, 4)) for k in ("a", "b", "c") for _ in range(60)] + [("d", 0.0, 3), ("d", None, 2), ("e", 7.0, 2), ("e", 9.0, 2), (None, 5.0, 1)]
    got = {x.k: x.median for x in exact_medians(spark.createDataFrame(data, "k string, v double, n int"), ["k"], "v", "n").collect()}
    for key in ("a", "b", "c", "d", "e", None):
        values = [v for k, v, n in data if k == key and v is not None for _ in range(n)]
        assert got[key] == pytest.approx(np.median(values))


def by_rule(values, least, factor, run=None):
    """Positions at ``factor`` times the median size, and of runs of ``run`` equal values."""
    size = np.abs(values) if run else np.array(values)
    want = set(np.flatnonzero(size >= factor * np.median(size)))
    for _, same in itertools.groupby(range(len(values)), lambda i: values[i]) if run else ():
        same = list(same)
        want |= set(same) if len(same) >= run else set()
    return want if len(values) >= least and np.median(size) > 0 else set()


@pytest.mark.parametrize("segment", [16_384, 25])
def test_no_stuck_or_wide_reading_is_screened_out(spark, monkeypatch, segment):
    monkeypatch.setattr(anomalies, "SEGMENT", segment)
    r = random.Random(7)
    pairs = {}
    for name, n, runs, length in (("one", 40, 1, 5), ("two", 40, 2, 5), ("three", 40, 3, 6), ("sixty", 1_000, 60, 6), ("more", 1_600, 250, 6), ("four", 40, 5, 4)):
        values, gap = [], (n - runs * length) // runs
        for _ in range(runs):
            values += [r.choice([-1, 1]) * r.uniform(8, 12) for _ in range(gap)] + [r.uniform(8, 12)] * length
        pairs[name] = values + [r.uniform(8, 12) for _ in range(n - len(values))]
    pairs["wide"] = [3.0] * 30 + [30.0] * 4 + [3.0] * 30 + [29.9] * 4
    pairs["most are 0"] = [0.0, 0.1, 0.0, -0.1, 0.1, 0.2, 50.0, 60.0] * 10 + [0.3] * 5
    pairs["low"] = [0.0, 0.5, -5.5, 0.0, 6.0] * 9 + [0.0, 0.5] * 2
    spreads = {"often equal": [5.0] * 60 + [30.0] * 20 + [5.0] * 30 + [29.9] * 10, "two levels": [1.0] * 55 + [0.0] * 5 + [6.0, 7.0] * 25 + [5.9], "low": [0.0] * 40 + [0.5] * 25 + [4.0] * 40}  # of the last, the median is far below that of positive spreads
    d = [(1_000 * k + i if len(v) <= 1_000 else 100_000 + i, name, "a", "b", x, 10 + i, True) for k, (name, v) in enumerate(pairs.items()) for i, x in enumerate(v)]
    q = [(1_000 * k + i, "v", name, 1.0, 1.0, None, x, 10 + i, "", 0) for k, (name, v) in enumerate(spreads.items()) for i, x in enumerate(v)]
    found = anomalies.implausible(spark.createDataFrame(q, Q), spark.createDataFrame(d, D)).collect()
    got = {(x.source_table, x.record_id) for x in found}
    ids = {("divergences", s, t): i for i, s, _, _, _, t, _ in d} | {("quotes", s, t): row[0] for row in q for s, t in [(row[2], row[7])]}
    for table, sources, rule in (("divergences", pairs, (30, 10, 5)), ("quotes", spreads, (40, 6))):
        for name, values in sources.items():
            want = {ids[table, name, 10 + i] for i in by_rule(values, *rule)}
            own = {ids[table, name, 10 + i] for i in range(len(values))}
            assert {i for t, i in got if t == table and i in own} == want, name
            assert want or name == "four"


def test_each_source_gets_its_own_transitions():
    quiet, jumpy = np.zeros((400, 4)), np.zeros((400, 4))
    quiet[:, 0] = 1.0
    jumpy[::2, 0], jumpy[1::2, 1] = 1.0, 1.0
    own = anomalies.fitted(np.concatenate([quiet, jumpy]), np.repeat([0, 1], 400), 2)
    assert np.allclose(own.sum(2), 1)
    assert own[0, 0, 1] < anomalies.TRANSITION[0, 1] < own[1, 0, 1]
    e = np.tile(np.array([[0.3, 0.2, 0.1, 0.0]]), (2, 30, 1))
    assert np.allclose(anomalies.forward_backward(e, np.stack([anomalies.TRANSITION] * 2)), anomalies.forward_backward(e))


def test_nine_digits():
    x = np.array([0.1 + 0.2, 1.0000000001, 123456789.4, 3e-12, 7.0])
    assert np.allclose(anomalies.nine_digits(x), [0.3, 1.0, 123456789.0, 3e-12, 7.0], rtol=1e-12, atol=0)
    assert anomalies.nine_digits(np.array([64000.13 - 64000.12]))[0] == anomalies.nine_digits(np.array([64000.13 - 64000.12]))[0]
