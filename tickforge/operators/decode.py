"""Raw feed frames to canonical rows. Input: ``frame`` (JSON text) and ``recv_us`` (time of receipt), and an id ``frame_id``.

Each feed has two views of its frames: trades and book changes; frames of other kinds and acknowledgements give no row.
``frame_errors`` lists frames that can't be read or report an error. JSON keys are matched by exact case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.functions.canonical import canonical_pair
from tickforge.functions.market import hex_to_decimal, hex_to_long, lenient_double, maker_side, ms_to_us, rfc3339_us, side, split_symbol, strict_double, topic_address
from tickforge.operators.scans import running_max_before

# The Transfer event of ERC-20 and the contracts that are watched.
TRANSFER_TOPIC = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
TOKENS = (
    ("0xa0b86991c6218b36c1d19d4a2e9eb0ce3606eb48", "USDC", 6), ("0xdac17f958d2ee523a2206206994597c13d831ec7", "USDT", 6),
    ("0xc02aaa39b223fe8d0a0e5c4f27ead9083c756cc2", "WETH", 18), ("0x6b175474e89094c44da98b954eedeac495271d0f", "DAI", 18),
    ("0x833589fcd6edb6e08f4c7c32d4f71b54bda02913", "USDC", 6), ("0x4200000000000000000000000000000000000006", "WETH", 18),
)

_COINBASE = """channel string, sequence_num bigint, type string, message string, events array<struct<type:string,product_id:string,
trades:array<struct<trade_id:string,product_id:string,price:string,size:string,side:string,time:string>>,
updates:array<struct<side:string,event_time:string,price_level:string,new_quantity:string>>>>"""
_KRAKEN = """channel string, type string, method string, success boolean, error string, data array<struct<symbol:string,side:string,price:double,qty:double,
trade_id:bigint,timestamp:string,bids:array<struct<price:double,qty:double>>,asks:array<struct<price:double,qty:double>>>>"""
#: ``data`` is a map, as its keys differ by case alone (e and E, m and M, u and U).
_BINANCE = "data map<string,string>, error struct<code:int,msg:string>"
_EVM = """method string, params struct<result:struct<address:string,topics:array<string>,data:string,blockNumber:string,transactionHash:string,logIndex:string,removed:boolean>>,
error struct<code:int,message:string>"""
SCHEMAS = {"coinbase": _COINBASE, "kraken": _KRAKEN, "binance": _BINANCE, "evm": _EVM}


def parsed(frames: DataFrame, feed: str) -> DataFrame:
    return frames.withColumn("j", F.from_json("frame", SCHEMAS[feed], {"mode": "PERMISSIVE"}))


def _levels(levels: Column, price: str, size: str) -> Column:
    return F.transform(F.coalesce(levels, F.array()), lambda l: F.struct(l[price].alias("price"), l[size].alias("size")))


def _first_with(events: Column, part: str) -> Column:
    """Place of the first event of a frame that has something in ``part``."""
    return F.array_position(F.transform(events, lambda e: F.size(F.coalesce(e[part], F.array())) > 0), True) - 1


def coinbase_trades(frames: DataFrame) -> DataFrame:
    """The first trade of a frame carries its sequence number, the others -1; a malformed number makes the frame an error.

    Both are told within the frame's arrays, so decoding needs no shuffle.
    """
    malformed = lambda t: strict_double(t["price"]).isNull() | strict_double(t["size"]).isNull()
    bad = F.exists(F.flatten(F.transform("j.events", lambda e: F.coalesce(e["trades"], F.array()))), malformed)
    rows = (
        parsed(frames, "coinbase").where("j.channel = 'market_trades'").where(~F.coalesce(bad, F.lit(False)))
        .select("recv_us", "j.sequence_num", _first_with(F.col("j.events"), "trades").alias("head"), F.posexplode("j.events").alias("i", "e"))
        .select("recv_us", "sequence_num", "head", "i", F.posexplode("e.trades").alias("k", "t"))
    )
    return rows.select(
        F.lit("coinbase").alias("venue"), canonical_pair(F.col("t.product_id")).alias("symbol"), F.col("t.trade_id").alias("trade_id"), strict_double("t.price").alias("price"), strict_double("t.size").alias("size"), side("t.side").alias("side"),
        rfc3339_us("t.time", "recv_us").alias("event_time_us"), F.col("recv_us").alias("ingest_time_us"), F.when((F.col("i") == F.col("head")) & (F.col("k") == 0), F.col("sequence_num")).otherwise(-1).alias("sequence"),
    )


def coinbase_book(frames: DataFrame) -> DataFrame:
    """A change per event with updates; the frame's first such event carries the sequence; 'offer' is the ask side."""
    rows = (
        parsed(frames, "coinbase").where("j.channel = 'l2_data'")
        .select("recv_us", "j.sequence_num", _first_with(F.col("j.events"), "updates").alias("head"), F.posexplode("j.events").alias("i", "e")).where("size(e.updates) > 0")
    )
    of = lambda bid: F.transform(
        F.filter("e.updates", lambda u: (u["side"] == "bid") if bid else (u["side"] != "bid")),
        lambda u: F.struct(lenient_double(u["price_level"]).alias("price"), lenient_double(u["new_quantity"]).alias("size")),
    )
    return rows.select(
        F.lit("coinbase").alias("venue"), canonical_pair(F.col("e.product_id")).alias("symbol"), (F.col("e.type") == "snapshot").alias("is_snapshot"), of(True).alias("bids"), of(False).alias("asks"),
        rfc3339_us(F.col("e.updates")[0]["event_time"], "recv_us").alias("event_time_us"), F.col("recv_us").alias("ingest_time_us"), F.when(F.col("i") == F.col("head"), F.col("sequence_num")).otherwise(-1).alias("sequence"),
    )


def kraken_trades(frames: DataFrame) -> DataFrame:
    rows = parsed(frames, "kraken").where("j.method is null and j.channel = 'trade'").select("recv_us", F.explode("j.data").alias("t"))
    return rows.select(
        F.lit("kraken").alias("venue"), canonical_pair(F.col("t.symbol")).alias("symbol"), F.col("t.trade_id").cast("string").alias("trade_id"), F.coalesce("t.price", F.lit(0.0)).alias("price"),
        F.coalesce("t.qty", F.lit(0.0)).alias("size"), side("t.side").alias("side"), rfc3339_us("t.timestamp", "recv_us").alias("event_time_us"), F.col("recv_us").alias("ingest_time_us"), F.coalesce("t.trade_id", F.lit(0)).alias("sequence"),
    )


def kraken_book(frames: DataFrame) -> DataFrame:
    rows = parsed(frames, "kraken").where("j.method is null and j.channel = 'book'").select("recv_us", "j.type", F.explode("j.data").alias("b"))
    return rows.select(
        F.lit("kraken").alias("venue"), canonical_pair(F.col("b.symbol")).alias("symbol"), (F.col("type") == "snapshot").alias("is_snapshot"), _levels(F.col("b.bids"), "price", "qty").alias("bids"),
        _levels(F.col("b.asks"), "price", "qty").alias("asks"), rfc3339_us("b.timestamp", "recv_us").alias("event_time_us"), F.col("recv_us").alias("ingest_time_us"), F.lit(-1).cast("bigint").alias("sequence"),
    )


def _key(name: str, kind: str = "string") -> Column:
    return F.col("j.data")[name].try_cast(kind)


def _depth(name: str) -> Column:
    return F.coalesce(F.from_json(F.col("j.data")[name], "array<array<string>>"), F.array())


def binance_trades(frames: DataFrame) -> DataFrame:
    """``m`` (buyer is the maker) gives the aggressor; ``M`` is another field and means nothing."""
    rows = parsed(frames, "binance").where(F.col("j.error").isNull() & (_key("e") == "trade"))
    rows = rows.withColumns({"price": strict_double(_key("p")), "size": strict_double(_key("q"))}).where("price is not null and size is not null")
    return rows.select(
        F.lit("binance").alias("venue"), split_symbol(_key("s")).alias("symbol"), _key("t").alias("trade_id"), "price", "size", maker_side(F.coalesce(_key("m", "boolean"), F.lit(False))).alias("side"),
        ms_to_us(_key("T", "bigint"), _key("E", "bigint")).alias("event_time_us"), F.col("recv_us").alias("ingest_time_us"), F.coalesce(_key("t", "bigint"), F.lit(0)).alias("sequence"),
    )


def binance_book(frames: DataFrame) -> DataFrame:
    """Never a snapshot; first_id and final_id go to ``dense_sequence``. A level of fewer than two parts makes an error."""
    rows = parsed(frames, "binance").where(F.col("j.error").isNull() & (_key("e") == "depthUpdate")).withColumns({"b": _depth("b"), "a": _depth("a")})
    rows = rows.where("not exists(b, l -> size(l) < 2) and not exists(a, l -> size(l) < 2)")
    of = lambda c: F.transform(c, lambda l: F.struct(lenient_double(l[0]).alias("price"), lenient_double(l[1]).alias("size")))
    return rows.select(
        "frame_id", F.lit("binance").alias("venue"), split_symbol(_key("s")).alias("symbol"), F.lit(False).alias("is_snapshot"), of("b").alias("bids"), of("a").alias("asks"),
        (_key("E", "bigint") * 1000).alias("event_time_us"), F.col("recv_us").alias("ingest_time_us"), _key("U", "bigint").alias("first_id"), _key("u", "bigint").alias("final_id"),
    )


def evm_transfers(frames: DataFrame, chain: str = "ethereum") -> DataFrame:
    """Token transfers; removed logs and other events give none. The first log of each higher block carries its number.

    Known tokens come from a fixed list of six; an unknown contract is its own symbol with 0 decimals.
    """
    tokens = frames.sparkSession.createDataFrame(TOKENS, "address string, token_symbol string, token_decimals int")
    log = F.col("j.params.result")
    rows = parsed(frames, "evm").where((F.col("j.method") == "eth_subscription") & ~F.coalesce(log["removed"], F.lit(False)) & (F.size(log["topics"]) >= 3) & (F.lower(log["topics"][0]) == TRANSFER_TOPIC))
    rows = rows.select("frame_id", "recv_us", F.lower(log["address"]).alias("address"), log["topics"].alias("topics"), log["data"].alias("data"), hex_to_long(log["blockNumber"]).alias("block_number"), hex_to_long(log["logIndex"]).cast("int").alias("log_index"), F.lower(log["transactionHash"]).alias("tx_hash"))
    rows = block_sequence(rows)
    return rows.join(tokens, "address", "left").select(
        F.lit(chain).alias("chain"), F.col("address").alias("token"), F.coalesce("token_symbol", "address").alias("symbol"), topic_address(F.col("topics")[1]).alias("from_addr"), topic_address(F.col("topics")[2]).alias("to_addr"),
        hex_to_decimal(F.col("data")).alias("amount_raw"), F.coalesce("token_decimals", F.lit(0)).alias("decimals"), "block_number", "log_index", "tx_hash", F.col("recv_us").alias("event_time_us"), F.col("recv_us").alias("ingest_time_us"), "sequence",
    )


def block_sequence(logs: DataFrame, order: str = "frame_id") -> DataFrame:
    """``sequence``: the block number on the first log, in order, of each block higher than all before it, else -1.

    A block's first log is found per block; the running maximum then runs over one row per block, in slices.
    """
    firsts = logs.groupBy("block_number").agg(F.min(order).alias("__first"))
    scanned = running_max_before(firsts, [], "__first", "block_number", "__before")
    higher = scanned.where("__before is null or block_number > __before").select("__first", F.col("block_number").alias("__block"))
    return logs.join(higher, F.col(order) == F.col("__first"), "left").withColumn("sequence", F.coalesce("__block", F.lit(-1))).drop("__first", "__block")


def frame_errors(frames: DataFrame, feed: str) -> DataFrame:
    """(frame_id, error) of frames that aren't JSON, report an error or hold malformed numbers or levels."""
    j = parsed(frames, feed)
    broken = F.get_json_object("frame", "$").isNull()
    text = F.when(broken, F.lit("envelope"))
    if feed == "coinbase":
        number = lambda x: (x != "") & x.try_cast("double").isNull()
        bad = F.exists(F.flatten(F.transform(F.coalesce("j.events", F.array()), lambda e: F.coalesce(e["trades"], F.array()))), lambda t: number(t["price"]) | number(t["size"]))
        text = text.when((F.coalesce("j.channel", F.lit("")).isin("", "subscriptions", "heartbeats")) & (F.col("j.type") == "error"), F.concat(F.lit("error frame: "), F.coalesce("j.message", F.lit("")))).when(bad, F.lit("malformed number"))
    elif feed == "kraken":
        text = text.when(F.col("j.method").isNotNull() & ~F.coalesce("j.success", F.lit(True)), F.concat(F.col("j.method"), F.lit(" failed: "), F.coalesce("j.error", F.lit(""))))
    elif feed == "binance":
        short = F.exists(F.concat(_depth("b"), _depth("a")), lambda l: F.size(l) < 2)
        number = lambda c: (_key(c) != "") & _key(c, "double").isNull()
        text = text.when(F.col("j.error").isNotNull(), F.concat(F.lit("error "), F.col("j.error.code").cast("string"))).when(short, F.lit("malformed level")).when((_key("e") == "trade") & (number("p") | number("q")), F.lit("malformed number"))
    else:
        text = text.when(F.col("j.error").isNotNull(), F.concat(F.lit("rpc error "), F.col("j.error.code").cast("string")))
    return j.withColumn("error", text).where("error is not null").select("frame_id", "error")
