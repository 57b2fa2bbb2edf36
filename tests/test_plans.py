import re

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
LAZY = ("p1_found", "p2_found", "bars_1m", "bars_1s_to_1m", "divergence_events", "latest_quotes", "reconciliation", "decoded_coinbase_trades", "sequence_status", "source_lag_nearest_rank")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loops_and_no_single_partition(spark, name):
    text = plan(entry.queries()[name](spark, DATA))
    assert not re.search("Cartesian|NestedLoop", text)
    assert "Exchange SinglePartition" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(entry.queries()["range_query"](spark, DATA))
    assert "TakeOrderedAndProject" in text and re.search(r"PushedFilters: \[[^\]]*EqualTo\(symbol,KAXRO-USD\)[^\]]*window_start_us", text)
    text = plan(entry.queries()["p1_found"](spark, DATA))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)", text)
    assert any("quote_id" in s and "mid" not in s and "bid_price" not in s for s in schemas) and any("arrival" in s and "price" not in s for s in schemas)


def test_totals_shuffle_states_only(spark):
    text = plan(entry.queries()["p2_found"](spark, DATA))
    assert "partial_count" in text
    first = text.rindex("Exchange hashpartitioning(source_table")
    assert "partial_count" in text[first:]
