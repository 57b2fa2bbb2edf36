import json

from tickforge.operators import decode

F = "frame_id bigint, recv_us bigint, frame string"


def frames(spark, *objects):
    return spark.createDataFrame([(i, 1000 + i, o if isinstance(o, str) else json.dumps(o)) for i, o in enumerate(objects)], F)


def test_coinbase(spark, rows):
    trade = lambda i, **x: {"trade_id": str(i), "product_id": "btc_usd", "price": "64231.17", "size": "0.0125", "side": "BUY", "time": "2024-01-01T00:00:00.000001Z", **x}
    df = frames(
        spark, {"channel": "market_trades", "sequence_num": 77, "events": [{"trades": [trade(1), trade(2, side="offer")]}, {"trades": [trade(3, time="junk", price="")]}]},
        {"channel": "subscriptions", "events": []}, {"channel": "market_trades", "sequence_num": 78, "events": [{"trades": [trade(4, price="x"), trade(5)]}]}, {"type": "error", "message": "no"}, "{nope",
    )
    got = rows(decode.coinbase_trades(df), "trade_id", "symbol", "price", "side", "event_time_us", "sequence")
    assert got == [("1", "BTC-USD", 64231.17, "BUY", 1_704_067_200_000_001, 77), ("2", "BTC-USD", 64231.17, "SELL", 1_704_067_200_000_001, -1), ("3", "BTC-USD", 0.0, "BUY", 1000, -1)]
    assert rows(decode.frame_errors(df, "coinbase")) == [(2, "malformed number"), (3, "error frame: no"), (4, "envelope")]
    update = lambda side, p, q: {"side": side, "event_time": "2024-01-01T00:00:00Z", "price_level": p, "new_quantity": q}
    l2 = frames(spark, {"channel": "l2_data", "sequence_num": 5, "events": [{"type": "snapshot", "product_id": "A-B", "updates": []}, {"type": "snapshot", "product_id": "A-B", "updates": [update("bid", "1", "2"), update("offer", "3", "0")]}]})
    r = decode.coinbase_book(l2).collect()
    assert len(r) == 1 and (r[0].is_snapshot, r[0].sequence) == (True, 5) and [tuple(x) for x in r[0].bids + r[0].asks] == [(1.0, 2.0), (3.0, 0.0)]


def test_kraken(spark, rows):
    df = frames(
        spark, {"channel": "trade", "type": "update", "data": [{"symbol": "BTC/USD", "side": "buy", "price": 1.5, "qty": 2, "trade_id": 9001, "timestamp": "2024-01-01T00:00:00Z"}]},
        {"channel": "book", "type": "snapshot", "data": [{"symbol": "BTC/USD", "bids": [{"price": 1, "qty": 2}], "asks": [], "checksum": 5, "timestamp": "2024-01-01T00:00:00Z"}]},
        {"method": "subscribe", "success": False, "error": "bad"}, {"method": "subscribe", "success": True}, {"channel": "heartbeat"},
    )
    assert rows(decode.kraken_trades(df), "symbol", "trade_id", "size", "side", "sequence") == [("BTC-USD", "9001", 2.0, "BUY", 9001)]
    r = decode.kraken_book(df).first()
    assert (r.is_snapshot, r.sequence, [tuple(x) for x in r.bids], r.asks) == (True, -1, [(1.0, 2.0)], [])
    assert rows(decode.frame_errors(df, "kraken")) == [(2, "subscribe failed: bad")]


def test_binance(spark, rows):
    trade = lambda m, **x: {"stream": "s", "data": {"e": "trade", "E": 5, "s": "SOLUSDT", "t": 7, "p": "1.5", "q": "2", "T": 6, "m": m, "M": True, **x}}
    depth = lambda b: {"data": {"e": "depthUpdate", "E": 5, "s": "ETHBTC", "U": 10, "u": 12, "b": b, "a": []}}
    df = frames(spark, trade(True), trade(False, T=0), depth([["64149.00", "0"]]), depth([["1"]]), {"result": None, "id": 1}, {"error": {"code": 2, "msg": "x"}})
    assert rows(decode.binance_trades(df), "symbol", "side", "event_time_us", "sequence") == [("SOL-USD", "BUY", 5000, 7), ("SOL-USD", "SELL", 6000, 7)]
    r = decode.binance_book(df).collect()
    assert [(x.symbol, x.is_snapshot, x.first_id, x.final_id, tuple(x.bids[0])) for x in r] == [("ETH-BTC", False, 10, 12, (64149.0, 0.0))]
    assert rows(decode.frame_errors(df, "binance")) == [(3, "malformed level"), (5, "error 2")]


def test_evm(spark, rows):
    log = lambda **x: {"method": "eth_subscription", "params": {"result": {"address": "0xA0b86991c6218b36c1d19D4a2e9Eb0cE3606eB48", "topics": [decode.TRANSFER_TOPIC.upper().replace("0X", "0x"), "0x" + "0" * 24 + "1" * 40, "0x" + "0" * 24 + "2" * 40], "data": "0x" + "0" * 55 + "2540be400", "blockNumber": "0x1312d00", "transactionHash": "0xAB", "logIndex": "0x2a", **x}}}
    df = frames(spark, log(), log(removed=True), log(blockNumber="0x1312d01", address="0x" + "7" * 40), log(), log(topics=["0x1"]), {"id": 1, "result": "0x1"})
    got = rows(decode.evm_transfers(df), "symbol", "amount_raw", "decimals", "block_number", "log_index", "sequence")
    assert got == [("0x" + "7" * 40, "10000000000", 0, 20_000_001, 42, 20_000_001), ("USDC", "10000000000", 6, 20_000_000, 42, -1), ("USDC", "10000000000", 6, 20_000_000, 42, 20_000_000)]
