import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickforge.operators import divergence, scans
from tests.test_market import Q, fold_divergence


@pytest.fixture
def frame(spark):
    r = random.Random(3)
    order = r.sample(range(-500, 2000), 400)
    return spark.createDataFrame([(r.choice(["a", "a", "b", None]), o, r.choice([None, *range(50)])) for o in order], "k string, o bigint, v bigint")


@pytest.mark.parametrize("width", [7, 100, 10**6])
def test_scans_equal_windows(frame, rows, width):
    before = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    assert rows(scans.running_max_before(frame, ["k"], "o", "v", "m", width)) == rows(frame.withColumn("m", F.max("v").over(before)))
    odd = F.when(F.col("v") % 2 == 1, F.col("v"))
    assert rows(scans.running_last(frame, ["k"], "o", {"x": odd, "y": F.col("v")}, width)) == rows(frame.withColumns({"x": F.last(odd, True).over(upto), "y": F.last("v", True).over(upto)}))
    assert rows(scans.numbered(frame, ["k"], "o", "n", width)) == rows(frame.withColumn("n", (F.row_number().over(Window.partitionBy("k").orderBy("o")) - 1).cast("bigint")))
    empty = frame.limit(0)
    assert rows(scans.numbered(empty, ["k"], "o", "n", width)) == []


def test_windows_over_blocks(frame, rows):
    numbered = scans.numbered(frame, ["k"], "o", "n")
    w = Window.partitionBy("k").orderBy("n").rowsBetween(-5, -1)
    blocks = scans.with_rows_before(numbered, "n", 5, 8)
    got = blocks.withColumn("s", F.sum("v").over(Window.partitionBy("k", "__block").orderBy("n").rowsBetween(-5, -1))).where("not is_halo").drop("__block", "is_halo")
    assert rows(got) == rows(numbered.withColumn("s", F.sum("v").over(w)))
    with pytest.raises(ValueError):
        scans.with_rows_before(numbered, "n", 9, 8)


def test_divergence_in_small_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 25)
    r = random.Random(8)
    rules = divergence.DivergenceRules(max_age_us=50, ring=20, warm=5, min_bps=5, min_zscore=1.5)
    quotes = [(n, "X", r.choice("abc"), m := 100 * (1 + r.gauss(0, 8e-4)), m, 5 * n) for n in range(400)]
    e = divergence.divergences(spark.createDataFrame(quotes, Q), ["a", "b", "c"], "n", rules)
    got = rows(e.select("n", "symbol", "venue_a", "venue_b", F.round("divergence_bps", 6), F.round("zscore", 6), "window_start_us", "event_time_us"))
    assert got == fold_divergence(quotes, rules) and len(got) > 20
