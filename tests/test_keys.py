from pyspark.sql import functions as F

from tickforge.functions.canonical import canonicalise
from tickforge.operators.skew import balanced_totals, heavy_keys

VS = [("Kesto ", "A-USD", "tA:USD"), ("kesto", "B-USD", " tb:usd"), ("norvex", "A-USD", "AUSD"), ("norvex", None, ""), (None, "C", "C")]


def test_canonical_form(spark, rows):
    df = spark.createDataFrame([(1, " KESTO", " ta:usd "), (2, "kesto", "tB:USD"), (3, "norvex", "ta:usd"), (4, "norvex", "a_usd"), (5, "norvex", "a/usd"), (6, "x", ""), (7, "x", "  "), (8, None, "ta:usd"), (9, "norvex", None), (10, "Norvex", "ausd")], "id int, venue string, symbol string")
    got = rows(canonicalise(df, spark.createDataFrame(VS, "venue string, symbol string, venue_symbol string")))
    assert [x[2] for x in got] == ["A-USD", "B-USD", "TA:USD", "A-USD", "A-USD", None, None, "TA:USD", None, "A-USD"]
    assert [x[1] for x in got] == ["kesto", "kesto", "norvex", "norvex", "norvex", "x", "x", None, "norvex", "norvex"]


def test_two_spellings_of_one_lookup_row_dont_double_rows(spark, rows):
    vs = spark.createDataFrame([*VS, ("KESTO", "Z-USD", "TA:USD")], "venue string, symbol string, venue_symbol string")
    assert rows(canonicalise(spark.createDataFrame([("kesto", "ta:usd")], "venue string, symbol string"), vs)) == [("kesto", "A-USD")]


def test_heavy_keys(spark, rows):
    data = [("t", "hot")] * 50 + [("t", None)] * 30 + [("t", f"k{i}") for i in range(18)] + [("t", "edge")] * 5 + [("b", "only")]
    total = 50 + 30 + 18 + 5
    df = spark.createDataFrame(data, "src string, k string")
    assert rows(heavy_keys(df, "src", "k", 5 / total)) == [("b", "only", 1), ("t", "edge", 5), ("t", "hot", 50)]
    assert rows(heavy_keys(df, "src", "k", 6 / total)) == [("b", "only", 1), ("t", "hot", 50)]
    assert rows(heavy_keys(df.limit(0), "src", "k", 0.1)) == []


def test_totals_combine_before_the_shuffle(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 2.0), ("b", 3.0), ("a", 4.0)], "k string, v double")
    totals = balanced_totals(df, ["k"], n=F.count(F.lit(1)), total=F.sum("v"), top=F.max("v"))
    assert rows(totals) == [(None, 1, 2.0, 2.0), ("a", 3, 5.0, 4.0), ("b", 1, 3.0, 3.0)]
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and plan.index("Exchange") < plan.index("partial_count")
