import random

import pytest

from tickforge.sources import frames, generate, lake, schemas
from tickforge.sources.config import Config
from tickforge.sources.schemas import TRADE_V1, TRADE_V2, Registry, SchemaError


def test_registry_and_evolution():
    r = Registry()
    one = r.register("md.trades.v1-value", TRADE_V1)
    assert r.register("md.trades.v1-value", TRADE_V1) == one
    two = r.register("md.trades.v1-value", TRADE_V2)
    assert two != one
    broken = schemas.record("trade", {"name": "needed", "type": "string"})
    with pytest.raises(SchemaError):
        r.register("md.trades.v1-value", broken)
    row = {"venue": "v", "symbol": "X", "trade_id": "é", "price": 1.5, "size": -0.0, "side": "BUY", "event_time_us": 2**60, "ingest_time_us": -5, "sequence": -1}
    old = schemas.encode(TRADE_V1, one, row)
    assert schemas.decode(old, r) == row
    assert schemas.decode(old, r, TRADE_V2) == {**row, "maker_order_id": None, "liquidity": "UNKNOWN"}
    new = schemas.encode(TRADE_V2, two, {**row, "maker_order_id": "m", "liquidity": "TAKER"})
    assert schemas.decode(new, r, TRADE_V1) == row
    for bad in (b"", b"\x00\x00", b"\x01" + old[1:], old[:-1], b"\x00\x00\x00\x00\x63"):
        with pytest.raises(SchemaError):
            schemas.decode(bad, r)


def test_random_integers_survive():
    r, g = random.Random(0), Registry()
    schema = {"type": "record", "name": "n", "fields": [{"name": "n", "type": "long"}]}
    number = g.register("s", schema)
    for n in [0, -1, 1, 63, 64, -64, -65, 2**63 - 1, -(2**63), *(r.randrange(-(2**62), 2**62) for _ in range(200))]:
        assert schemas.decode(schemas.encode(schema, number, {"n": n}), g) == {"n": n}


def test_frames_of_rows(spark, rows):
    r = Registry()
    schema = schemas.record("book_delta")
    number = r.register("md.book.v1-value", schema)
    data = [("v", "X", True, [(1.0, 2.0)], [], 1, 2, 3), ("v", None, None, None, None, None, 2, 3)]
    df = spark.createDataFrame(data, schemas.DDL["book_delta"])
    back = frames.decode_frames(frames.encode_rows(df, schema, number), r, schema, schemas.DDL["book_delta"])
    assert rows(back, "symbol", "is_snapshot", "event_time_us", "error") == [("", False, 0, None), ("X", True, 1, None)]
    broken = spark.createDataFrame([(bytearray(b"junk!"),), (None,)], "value binary")
    assert [x[0] is None and x[1] is not None for x in rows(frames.decode_frames(broken, r, schema, schemas.DDL["book_delta"]), "venue", "error")] == [True, True]


def test_lake(spark, rows, tmp_path):
    path = f"file://{tmp_path}/lake"
    lake.append(generate.trades(spark, 300), path)
    lake.append(generate.trades(spark, 300).where("sequence < 3"), path)
    assert spark.read.parquet(path).count() == 303
    first = generate.trades(spark, 300).first().event_time_us
    got = lake.scan(spark, path, first, first + 10 * 3_333, "BTC-USD")
    assert {x[0] for x in rows(got, "symbol")} == {"BTC-USD"} and got.count() == 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(event_time_us" in plan
    lake.create_database(spark, "market")
    lake.create_trades(spark, "market.trades", path)
    spark.sql("MSCK REPAIR TABLE market.trades")
    assert spark.table("market.trades").where("symbol = 'SOL-USD'").count() == 101
    assert lake.expired_days(spark, path, first + 86_400_000_000 + 1, 1).count() == 2


def test_generators_repeat_and_are_valid(spark, rows):
    assert rows(generate.trades(spark, 50)) == rows(generate.trades(spark, 50))
    assert generate.quotes(spark, 50).where("ask_price < bid_price or bid_price <= 0").count() == 0
    d = generate.book_deltas(spark, 30).collect()
    assert all(len(x.bids) == 5 and x.bids[0].price < x.asks[0].price for x in d)
    assert "btcusdt@trade" in generate.subscriptions("binance", ["BTC-USD"])[0] and len(generate.subscriptions("coinbase", ["A"])) == 3 and '"BTC/USD"' in generate.subscriptions("kraken", ["BTC-USD"])[0]
    assert [generate.backoff(i) for i in (0, 1, 2, 10)] == [0.5, 1.0, 2.0, 30.0]
    with pytest.raises(ValueError):
        generate.subscriptions("x", [])


def test_config():
    c = Config.from_mapping({"TICKFORGE_WINDOW_SECONDS": "5", "TICKFORGE_MIN_BPS": "2.5", "TICKFORGE_LAKE_PATH": "p"})
    assert (c.window_seconds, c.min_bps, c.lake_path, c.book_depth) == (5, 2.5, "p", 50)
    for bad in ({"window_seconds": 0}, {"baseline_warm": 700}, {"replay_start_us": 5, "replay_end_us": 5}):
        with pytest.raises(ValueError):
            Config(**bad)


def test_intermediate_folders_are_deleted_at_the_end(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
from tickforge.sources.shared import write_shared
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
write_shared(spark.range(3), "a"); write_shared(spark.range(3), "b", lasting=True)
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True)
    assert [n[0] for n in os.listdir(tmp_path) if n.startswith(("a-", "b-"))] == ["b"]
