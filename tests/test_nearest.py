import random

import pytest

from tickforge.operators.nearest import nearest_in_time

L = "arrival bigint, venue string, symbol string, t bigint, e string, s bigint"
R = "quote_id bigint, venue string, symbol string, t bigint, k string, i bigint"


def brute(left, right, tolerance):
    out = []
    for a, v, s, t, *_ in left:
        if None in (a, v, s, t):
            continue
        best = min(((abs(u - t), u, q) for q, w, z, u, *_ in right if None not in (q, u) and (w, z) == (v, s)), default=None)
        if best and best[0] <= tolerance:
            out.append((a, best[2]))
    return sorted(out)


def run(spark, left, right, tolerance, slice_us):
    return nearest_in_time(spark.createDataFrame(left, L), spark.createDataFrame(right, R), ["venue", "symbol"], "t", "t", "arrival", "quote_id", tolerance, ("l", "r"), slice_us)


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, rows, seed):
    r = random.Random(seed)
    key = lambda: (r.choice(["a", "a", "a", "b"]), r.choice(["X", "X", "Y", None]))
    left = [(i, *key(), r.choice([None, *range(-50, 400)]), "x", 1) for i in range(260)]
    right = [(i, *key(), r.choice([None, *range(-50, 400, 3)]), "x", 1) for i in range(160)]
    left += left[:5]  # repeated rows
    assert rows(run(spark, left, right, 9, 40)) == brute(left, right, 9)


def test_ties_and_edges(spark, rows):
    left = [(1, "a", "X", 100, "", 0), (2, "a", "X", 40, "", 0), (3, "a", "X", 81, "", 0)]
    right = [(9, "a", "X", 95, "", 0), (8, "a", "X", 95, "", 0), (7, "a", "X", 105, "", 0), (6, "a", "X", 39, "", 0), (5, "a", "X", 79, "", 0)]
    # equal distance: the earlier; equal time: the smaller id; matches across slices of 40
    assert rows(run(spark, left, right, 5, 40)) == [(1, 8), (2, 6), (3, 5)]


def test_empty_tables(spark, rows):
    some = [(1, "a", "X", 1, "", 0)]
    for left, right in (([], some), (some, []), ([], [])):
        assert rows(run(spark, left, right, 5, 40)) == []


def test_tolerance_must_fit_a_slice(spark):
    with pytest.raises(ValueError):
        run(spark, [], [], 40, 40)
