"""Schemas of the data model, their versions, and a codec for framed binary records."""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field
from typing import Any

LEVELS = "array<struct<price:double,size:double>>"
#: Spark DDL of each entity.
DDL = {
    "trade": "venue string, symbol string, trade_id string, price double, size double, side string, event_time_us bigint, ingest_time_us bigint, sequence bigint",
    "book_delta": f"venue string, symbol string, is_snapshot boolean, bids {LEVELS}, asks {LEVELS}, event_time_us bigint, ingest_time_us bigint, sequence bigint",
    "chain_transfer": "chain string, token string, symbol string, from_addr string, to_addr string, amount_raw string, decimals int, block_number bigint, log_index int, tx_hash string, event_time_us bigint, ingest_time_us bigint",
    "quote": "venue string, symbol string, bid_price double, bid_size double, ask_price double, ask_size double, mid double, spread_bps double, imbalance double, event_time_us bigint, emit_time_us bigint",
    "window_bar": "venue string, symbol string, window_start_us bigint, window_end_us bigint, open double, high double, low double, close double, volume double, vwap double, trade_count bigint",
    "divergence": "symbol string, venue_a string, venue_b string, price_a double, price_b double, divergence_bps double, zscore double, window_start_us bigint, event_time_us bigint",
}
_AVRO_OF = {"string": "string", "double": "double", "bigint": "long", "int": "int", "boolean": "boolean", LEVELS: {"type": "array", "items": {"type": "record", "name": "Level", "fields": [{"name": "price", "type": "double"}, {"name": "size", "type": "double"}]}}}


def record(entity: str, *extra: dict) -> dict:
    """The entity's record schema, with further fields at the end."""
    fields = []
    for part in DDL[entity].split(", "):
        name, _, kind = part.partition(" ")
        fields.append({"name": name, "type": _AVRO_OF[kind]})
    return {"type": "record", "name": entity, "fields": [*fields, *extra]}


TRADE_V1 = record("trade")
TRADE_V2 = record("trade", {"name": "maker_order_id", "type": ["null", "string"], "default": None}, {"name": "liquidity", "type": "string", "default": "UNKNOWN"})


class SchemaError(ValueError):
    pass


def can_read(reader: dict, writer: dict) -> bool:
    """Every field that the reader wants is written with the same type, or has a default."""
    written = {f["name"]: f["type"] for f in writer["fields"]}
    return all(written[f["name"]] == f["type"] if f["name"] in written else "default" in f for f in reader["fields"])


def is_full_compatible(old: dict, new: dict) -> bool:
    return can_read(new, old) and can_read(old, new)


@dataclass
class Registry:
    """Subjects (topic-value) with their versions; full compatibility is checked before a schema is registered."""

    full: bool = True
    by_id: dict[int, dict] = field(default_factory=dict)
    subjects: dict[str, list[int]] = field(default_factory=dict)

    def register(self, subject: str, schema: dict) -> int:
        for known in self.subjects.get(subject, []):
            if self.by_id[known] == schema:
                return known
        if self.full and not self.compatible(subject, schema):
            raise SchemaError(f"{subject}: not fully compatible with the latest version")
        same = [i for i, s in self.by_id.items() if s == schema]
        number = same[0] if same else len(self.by_id) + 1
        self.by_id[number] = schema
        self.subjects.setdefault(subject, []).append(number)
        return number

    def compatible(self, subject: str, schema: dict) -> bool:
        versions = self.subjects.get(subject)
        return not versions or is_full_compatible(self.by_id[versions[-1]], schema)

    def schema(self, number: int) -> dict:
        if number not in self.by_id:
            raise SchemaError(f"no schema {number}")
        return self.by_id[number]


# --- binary records --------------------------------------------------------------------------------------------------


def _zigzag(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n & ~0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _write(kind: Any, v: Any) -> bytes:
    if isinstance(kind, list):  # null or a type
        return _zigzag(kind.index("null")) if v is None else _zigzag(1 - kind.index("null")) + _write(kind[1 - kind.index("null")], v)
    if isinstance(kind, dict):
        if kind["type"] == "record":
            return b"".join(_write(f["type"], v[f["name"]]) for f in kind["fields"])
        body = b"".join(_write(kind["items"], x) for x in v)
        return (_zigzag(len(v)) + body if v else b"") + _zigzag(0)
    if kind == "string":
        data = v.encode()
        return _zigzag(len(data)) + data
    if kind == "double":
        return struct.pack("<d", v)
    if kind == "boolean":
        return b"\x01" if v else b"\x00"
    return _zigzag(int(v))


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise SchemaError("record too short")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        shift = n = 0
        while True:
            b = self.take(1)[0]
            n |= (b & 0x7F) << shift
            if not b & 0x80:
                return (n >> 1) ^ -(n & 1)
            shift += 7

    def value(self, kind: Any) -> Any:
        if isinstance(kind, list):
            return self.value(kind[self.number()])
        if isinstance(kind, dict):
            if kind["type"] == "record":
                return {f["name"]: self.value(f["type"]) for f in kind["fields"]}
            out = []
            while n := self.number():
                if n < 0:  # a block that gives its size in bytes
                    n = -n
                    self.number()
                out.extend(self.value(kind["items"]) for _ in range(n))
            return out
        if kind == "null":
            return None
        if kind == "string":
            return self.take(self.number()).decode()
        if kind == "double":
            return struct.unpack("<d", self.take(8))[0]
        if kind == "boolean":
            return self.take(1) == b"\x01"
        return self.number()


def encode(schema: dict, number: int, row: dict) -> bytes:
    """A frame: zero byte, schema number in four bytes, record."""
    return b"\x00" + struct.pack(">i", number) + _write(schema, row)


def decode(frame: bytes, registry: Registry, reader: dict | None = None) -> dict:
    """The record of a frame, by the writer's schema, projected to the reader's with its defaults."""
    if len(frame) < 5 or frame[0] != 0:
        raise SchemaError("not a framed record")
    writer = registry.schema(struct.unpack(">i", frame[1:5])[0])
    row = _Reader(frame[5:]).value(writer)
    if reader is None:
        return row
    if not can_read(reader, writer):
        raise SchemaError("the reader's schema can't read this record")
    return {f["name"]: row[f["name"]] if f["name"] in row else f["default"] for f in reader["fields"]}


def as_json(schema: dict) -> str:
    return json.dumps(schema)
