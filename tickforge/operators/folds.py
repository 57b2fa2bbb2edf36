"""Ordered folds per key that no built-in aggregate expresses, streamed partition by partition.

The rows are repartitioned, sorted within partitions and folded in one pass that holds one state: a key's rows are never
gathered. ``split_fold`` also cuts a key into slices of its order, which many tasks fold at once.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import namedtuple
from collections.abc import Callable, Iterator
from math import ceil
from pickle import dumps, loads

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tickforge.functions.market import valid_delta
from tickforge.operators.scans import WIDTH, previous, running_max_before, running_total
from tickforge.sources.shared import write_shared

REGRESSION_TOLERANCE = 1_000
#: Rows of a slice's begin that one value carries to the second pass.
CHUNK = 512


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Callable], schema: str) -> DataFrame:
    """``start()`` makes the state of a key: a function from a row (namedtuple) to an iterable of result tuples.

    Nulls are None, whole numbers stay whole; null keys are a key of their own, text keys come out as ''. Structs are
    dictionaries. An empty table gives an empty result.
    """
    result = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step, make = None, None, None
        for batch in batches:
            if make is None:
                make = namedtuple("Row", batch.schema.names)._make
                places = [batch.schema.names.index(k) for k in keys]
            out = []
            for row in map(make, zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                now = [row[p] for p in places]
                if step is None or now != key:
                    key, step = now, start()
                out.extend(step(row))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), result, strict=True)], schema=result)

    kinds = dict(df.dtypes)
    filled = df.withColumns({k: F.coalesce(k, F.lit("")) for k in keys if kinds[k] == "string"})
    return filled.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def split_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], blur: Callable[[], object], schema: str, width: int = WIDTH) -> DataFrame:
    """The same for states that soon forget their past: one key is folded by many tasks.

    Slices of ``width`` units of ``order[0]`` (an integer) are folded at once. The state before a slice isn't known there;
    ``blur()`` stands for all states there could be, and its ``row(r)`` gives the state after ``r`` once that is the same for
    all of them, else None. Rows up to there are put off, and a second pass per key goes over nothing but these rows and
    the last states of the slices. ``start()`` makes the state of a key; its ``row(r)`` gives the results of a row. States
    must be picklable. The result is the same as of one pass over the key, whatever the width.
    """
    result = to_arrow_schema(StructType.fromDDL(schema))
    kinds = dict(df.dtypes)
    carried = ", ".join([*(f"__k{i} {kinds[k]}" for i, k in enumerate(keys)), "__s bigint, __no bigint, __blob binary"])
    whole = to_arrow_schema(StructType.fromDDL(f"{schema}, {carried}"))

    def batch_of(fields: dict[str, list], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fields[f.name], f.type) if f.name in fields else pa.nulls(n, f.type) for f in whole], schema=whole)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, make, state, unknown, held = None, None, None, None, []
        blobs: list[tuple] = []
        no = 0

        def put(what: object) -> None:
            nonlocal no
            blobs.append((*now, no, dumps(what, 5)))
            no += 1

        for batch in batches:
            if make is None:
                make = namedtuple("Row", batch.schema.names)._make
                places = [batch.schema.names.index(k) for k in (*keys, "slice_at")]
            out = []
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row, at = make(values), [values[p] for p in places]
                if at != now:
                    if held:
                        put(held)
                    if state is not None:
                        put(state)
                    now, state, unknown, held, no = at, None, blur(), [], 0
                if state is not None:
                    out.extend(state.row(row))
                    continue
                held.append(values)
                state = unknown.row(row)
                if state is not None or len(held) == CHUNK:
                    put(held)
                    held = []
            if out:
                yield batch_of(dict(zip(result.names, zip(*out, strict=True), strict=True)), len(out))
            if blobs:
                yield batch_of(dict(zip(whole.names[len(result) :], zip(*blobs, strict=True), strict=True)), len(blobs))
                blobs = []
        if now is not None:
            if held:
                put(held)
            if state is not None:
                put(state)
        if blobs:
            yield batch_of(dict(zip(whole.names[len(result) :], zip(*blobs, strict=True), strict=True)), len(blobs))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        make = namedtuple("Row", names)._make
        for batch in batches:
            out = []
            for *at, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or at != now:
                    now, state = at, start()
                what = loads(blob)
                if isinstance(what, list):
                    for values in what:
                        out.extend(state.row(make(values)))
                else:
                    state = what
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), result, strict=True)], schema=result)

    filled = df.withColumns({k: F.coalesce(k, F.lit("")) for k in keys if kinds[k] == "string"})
    cut = filled.withColumn("slice_at", F.expr(f"(`{order[0]}` - pmod(`{order[0]}`, {width}L)) div {width}L"))
    names = cut.columns
    folded = cut.repartition(*keys, "slice_at").sortWithinPartitions(*keys, "slice_at", *order).mapInArrow(first, f"{schema}, {carried}")
    stored = df.sparkSession.read.parquet(write_shared(folded, "slices"))
    at = [f"__k{i}" for i in range(len(keys))]
    begins = stored.where("__blob is not null").repartition(*at).sortWithinPartitions(*at, "__s", "__no").select(*at, "__blob").mapInArrow(second, schema)
    return stored.where("__blob is null").select(*result.names).unionByName(begins)


# --- sequences -----------------------------------------------------------------------------------------------------


class GapDetector:
    """Status of each sequence number of one key; ``resync``: a gap or regression makes the key unknown again."""

    def __init__(self, resync: bool = False):
        self.last: int | None = None
        self.resync = resync

    def observe(self, seq: int) -> tuple[str, int]:
        if seq < 0:
            return "unsequenced", 0
        last = self.last
        if last is None:
            status, missing = "first", 0
        elif seq == last + 1:
            status, missing = "ok", 0
        elif seq > last + 1:
            status, missing = "gap", seq - last - 1
        elif last - seq <= REGRESSION_TOLERANCE:
            return "duplicate", 0
        else:
            status, missing = "regression", 0
        self.last = None if self.resync and status in ("gap", "regression") else seq
        return status, missing


class GapStates:
    """All states that a detector may be in: none (``empty``), ``low``, and anything above it up to ``high``."""

    def __init__(self, resync: bool = False):
        self.resync, self.started, self.empty, self.low, self.high = resync, False, True, None, None

    def observe(self, seq: int) -> GapDetector | None:
        """The only state there is after ``seq``, if it is one."""
        if seq < 0:
            return None
        if not self.started:  # whatever was: taken over, or repeated by a state at most the tolerance above, or reset
            self.started, self.empty, self.low, self.high = True, self.resync, seq, seq + REGRESSION_TOLERANCE
            return None
        low, high = self.low, self.high
        if not self.resync:
            if seq > high or seq < low - REGRESSION_TOLERANCE:
                self.low = self.high = seq
            else:
                self.low, self.high = seq, max(seq, min(high, seq + REGRESSION_TOLERANCE))
        else:
            numbers = []  # bounds of the numbers that stay
            if self.empty or (low is not None and low <= seq - 1 <= high):
                numbers.append((seq, seq))  # first, or the next
            if low is not None and high >= seq and low <= seq + REGRESSION_TOLERANCE:
                numbers.append((max(low, seq), min(high, seq + REGRESSION_TOLERANCE)))  # repeated
            gone = low is not None and (low < seq - 1 or high > seq + REGRESSION_TOLERANCE)
            self.empty = gone
            self.low, self.high = (min(n[0] for n in numbers), max(n[1] for n in numbers)) if numbers else (None, None)
        if self.empty and self.low is None or not self.empty and self.low == self.high:
            found = GapDetector(self.resync)
            found.last = self.low
            return found
        return None


class _Sequences:
    def __init__(self, keys: list[str], order: str, detector: GapDetector):
        self.keys, self.order, self.detector = keys, order, detector

    def row(self, r) -> list[tuple]:
        return [(*(getattr(r, k) for k in self.keys), getattr(r, self.order), r.sequence, *self.detector.observe(r.sequence))]


class _UnknownSequences:
    def __init__(self, keys: list[str], order: str, resync: bool):
        self.keys, self.order, self.states = keys, order, GapStates(resync)

    def row(self, r) -> _Sequences | None:
        found = self.states.observe(r.sequence)
        return _Sequences(self.keys, self.order, found) if found else None


def sequence_status(df: DataFrame, keys: list[str], order: str, sequence: str = "sequence", resync: bool = False, width: int = WIDTH) -> DataFrame:
    """(keys, order, sequence, status, missing) of every row in order of ``order`` per key; a null sequence is -1.

    A slice of a key knows its state once its numbers have passed the tolerance for repeats, so only about as many rows
    of each slice wait for the slices before it.
    """
    kinds = dict(df.dtypes)
    cols = df.select(*keys, order, F.coalesce(F.col(sequence), F.lit(-1)).cast("bigint").alias("sequence"))
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{order} {kinds[order]}", "sequence bigint", "status string", "missing bigint"])
    return split_fold(cols, keys, [order], lambda: _Sequences(keys, order, GapDetector(resync)), lambda: _UnknownSequences(keys, order, resync), schema, width)


def without_duplicates(status: DataFrame) -> DataFrame:
    """What a pipeline lets through: repeats are dropped, rows without a number and after gaps go on."""
    return status.where("status <> 'duplicate'")


def without_gaps(status: DataFrame) -> DataFrame:
    """The stricter pipeline: the message that shows a gap or a restart is dropped as well; the key begins anew after it (``resync``)."""
    return status.where("status not in ('duplicate', 'gap', 'regression')")


def connection_scope(df: DataFrame, venues: list[str], channel: str) -> DataFrame:
    """Venues whose counter runs per connection get one key: symbol '' and channel 'connection'."""
    whole = F.col("venue").isin(*venues)
    return df.withColumns({"scope_symbol": F.when(whole, "").otherwise(F.coalesce("symbol", F.lit(""))), "scope_channel": F.when(whole, "connection").otherwise(channel)})


class DenseSequence:
    """A dense counter from ranges [first, final] of ids."""

    def __init__(self):
        self.final: int | None = None
        self.dense = 0

    def next(self, first: int, final: int) -> int:
        if self.final is None:
            self.dense = 0
        elif first == self.final + 1:
            self.dense += 1
        elif first <= self.final:
            self.final = max(self.final, final)
            return self.dense
        else:
            self.dense += max(1, first - self.final - 1) + 1
        self.final = final
        return self.dense


def dense_sequence(df: DataFrame, keys: list[str], order: str, first: str, final: str, width: int = WIDTH) -> DataFrame:
    """(keys, order, dense) for ranges of update ids: what ``DenseSequence`` counts, by running maxima and sums in slices.

    The last id known before a row is the largest final id before it, so each row's step is known without the fold.
    """
    cols = df.select(*keys, order, F.col(first).alias("__first"), F.col(final).alias("__final"))
    seen = running_max_before(cols, keys, order, "__final", "__known", width)
    ahead = F.col("__first") - F.col("__known") - 1
    step = F.when(F.col("__known").isNull() | (ahead < 0), 0).when(ahead == 0, 1).otherwise(F.greatest(F.lit(1), ahead) + 1)
    return running_total(seen.withColumn("__step", step.cast("bigint")), keys, order, "__step", "dense", width).select(*keys, order, "dense")


# --- books ---------------------------------------------------------------------------------------------------------


class Book:
    """A level-2 book with a bounded depth; prices of a side are kept sorted, best first."""

    def __init__(self, depth: int = 50):
        self.depth = depth
        self.sizes: tuple[dict, dict] = ({}, {})
        self.prices: tuple[list, list] = ([], [])
        self.sequence = self.event_time_us = 0

    def _set(self, side: int, price: float, size: float) -> None:
        key = -price if side == 0 else price
        sizes, prices = self.sizes[side], self.prices[side]
        if size > 0:
            if key not in sizes:
                insort(prices, key)
            sizes[key] = size
        elif key in sizes:
            del sizes[key]
            del prices[bisect_left(prices, key)]

    def apply(self, snapshot: bool, bids, asks, sequence: int, event_time_us: int) -> None:
        if snapshot:
            self.sizes, self.prices = ({}, {}), ([], [])
        for side, levels in enumerate((bids, asks)):
            for level in levels if levels is not None else ():
                if level["price"] is not None:
                    self._set(side, level["price"], level["size"] or 0.0)
        self.sequence, self.event_time_us = sequence, event_time_us
        for side in (0, 1):
            for key in self.prices[side][self.depth :]:
                del self.sizes[side][key]
            del self.prices[side][self.depth :]

    def side(self, side: int, n: int | None = None) -> list[tuple[float, float]]:
        sign = -1 if side == 0 else 1
        return [(sign * k, self.sizes[side][k]) for k in self.prices[side][:n]]

    def best(self, side: int) -> tuple[float, float] | None:
        top = self.side(side, 1)
        return top[0] if top else None

    @property
    def crossed(self) -> bool:
        b, a = self.best(0), self.best(1)
        return bool(b and a and b[0] >= a[0])

    def imbalance(self, depth: int = 5) -> float:
        b, a = (sum(s for _, s in self.side(i, depth)) for i in (0, 1))
        return (b - a) / (b + a) if b + a > 0 else 0.0

    def quote(self) -> tuple | None:
        """bid, bid size, ask, ask size, mid, spread in bps, imbalance; None without both sides or if invalid."""
        b, a = self.best(0), self.best(1)
        if not b or not a or not 0 < b[0] <= a[0]:
            return None
        m = (b[0] + a[0]) / 2
        return (*b, *a, m, (a[0] - b[0]) / m * 1e4, self.imbalance())

    def snapshot(self) -> dict:
        return {"bids": self.side(0), "asks": self.side(1), "sequence": self.sequence, "event_time_us": self.event_time_us}

    @classmethod
    def restore(cls, state: dict, depth: int = 50) -> Book:
        book = cls(depth)
        for side, levels in enumerate((state["bids"], state["asks"])):
            for price, size in levels:
                book._set(side, price, size)
        book.sequence, book.event_time_us = state["sequence"], state["event_time_us"]
        return book


_BOOK_KEYS = ["session_id", "venue", "symbol"]


def _book_rows(deltas: DataFrame, order: str) -> DataFrame:
    return deltas.where(valid_delta()).withColumn("session_id", F.coalesce("session_id", F.lit(-1)).cast("bigint")).select(
        *_BOOK_KEYS, F.col(order).cast("bigint").alias("ord"), F.coalesce("is_snapshot", F.lit(False)).alias("is_snapshot"), "bids", "asks", F.coalesce("sequence", F.lit(-1)).alias("sequence"), "event_time_us"
    )


class _Books:
    def __init__(self, depth: int):
        self.book = Book(depth)

    def row(self, r) -> list[tuple]:
        book = self.book
        book.apply(bool(r.is_snapshot), r.bids, r.asks, int(r.sequence), int(r.event_time_us))
        return [(r.session_id, r.venue, r.symbol, r.ord, bool(r.is_snapshot), book.crossed, *(book.quote() or (None,) * 7), book.event_time_us)]


class _UnknownBooks:
    """Nothing is known of a book before its next snapshot."""

    def __init__(self, depth: int):
        self.depth = depth

    def row(self, r) -> _Books | None:
        if not r.is_snapshot:
            return None
        known = _Books(self.depth)
        known.row(r)
        return known


def book_states(deltas: DataFrame, order: str = "arrival", depth: int = 50, width: int = WIDTH) -> DataFrame:
    """Top of the book after each delta, in arrival order per session and book, with ``crossed`` and ``is_snapshot``.

    A snapshot replaces both sides, so books are folded in slices from their snapshots on. Prices are null without two
    sides, or if the best prices aren't a valid quote.
    """
    schema = "session_id bigint, venue string, symbol string, ord bigint, is_snapshot boolean, crossed boolean, bid_price double, bid_size double, ask_price double, ask_size double, mid double, spread_bps double, imbalance double, event_time_us bigint"
    return split_fold(_book_rows(deltas, order), _BOOK_KEYS, ["ord"], lambda: _Books(depth), lambda: _UnknownBooks(depth), schema, width)


_QUOTE = ["bid_price", "bid_size", "ask_price", "ask_size", "mid", "spread_bps", "imbalance"]


def book_ticks(states: DataFrame, grid_us: int = 100_000, top_only: bool = False, width: int = WIDTH) -> DataFrame:
    """(keys, quote, event_time_us, emit_time_us, crossed, suppressed) of each tick of the grid of event time that follows a delta.

    A tick shows the book after the last delta before it; a delta with an older time than one before it belongs to the
    tick that is due. The last tick of a book comes too. A crossed book, and a quote equal to the one emitted last (event
    time included, unless ``top_only``), is suppressed; a book without a valid quote has no row.
    """
    slot = F.expr(f"(event_time_us - pmod(event_time_us, {grid_us}L)) div {grid_us}L")
    due = running_max_before(states.withColumn("__slot", slot), _BOOK_KEYS, "ord", "__slot", "__due", width)
    ticks = due.groupBy(*_BOOK_KEYS, ((F.greatest("__slot", "__due") + 1) * grid_us).alias("emit_time_us")).agg(F.max_by(F.struct("crossed", *_QUOTE, "event_time_us"), "ord").alias("q")).select(*_BOOK_KEYS, "emit_time_us", "q.*")
    same = F.when(~F.col("crossed") & F.col("bid_price").isNotNull(), F.struct(*_QUOTE, *([] if top_only else ["event_time_us"])))
    before = previous(ticks.withColumn("__same", same), _BOOK_KEYS, ["emit_time_us"], "__same", "__emitted", width * grid_us)
    return before.where(F.col("crossed") | F.col("bid_price").isNotNull()).withColumn("suppressed", F.col("crossed") | F.coalesce(F.col("__same") == F.col("__emitted"), F.lit(False))).drop("__same", "__emitted")


def book_counters(states: DataFrame, ticks: DataFrame) -> DataFrame:
    """Per session and book: quotes emitted and suppressed, deltas that left the book crossed, snapshots."""
    of_states = states.groupBy(*_BOOK_KEYS).agg(F.count_if("crossed").alias("crossed_books"), F.count_if("is_snapshot").alias("snapshots_applied"))
    of_ticks = ticks.groupBy(*_BOOK_KEYS).agg(F.count_if(~F.col("suppressed")).alias("quotes_emitted"), F.count_if("suppressed").alias("quotes_suppressed"))
    return of_states.join(of_ticks, _BOOK_KEYS, "left").fillna(0, ["quotes_emitted", "quotes_suppressed"])


def final_books(deltas: DataFrame, order: str = "arrival", depth: int = 50) -> DataFrame:
    """Levels of every book after its last delta in arrival order, trimmed to ``depth`` after each delta.

    Only the deltas from a book's last snapshot on are folded, as it replaces what was before. The levels come out of a
    fold that emits the book at each change of key, so a marker row ends every key.
    """
    rows = _book_rows(deltas, order)
    snaps = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in _BOOK_KEYS]).agg(F.max(F.when(F.col("is_snapshot"), F.col("ord"))).alias("__snap"))
    of_book = F.lit(True)
    for k in _BOOK_KEYS:
        of_book = of_book & F.col(k).eqNullSafe(F.col(f"__{k}"))
    cols = rows.join(snaps, of_book).where("__snap is null or ord >= __snap").select(*rows.columns, F.lit(False).alias("end"))
    none = F.array().cast("array<struct<price:double,size:double>>")
    ends = snaps.select(*[F.col(f"__{k}").alias(k) for k in _BOOK_KEYS], F.lit(2**62).alias("ord"), F.lit(False).alias("is_snapshot"), none.alias("bids"), none.alias("asks"), F.lit(-1).cast("bigint").alias("sequence"), F.lit(0).cast("bigint").alias("event_time_us"), F.lit(True).alias("end"))

    def start():
        book = Book(depth)

        def step(r):
            if r.end:
                return [(int(r.session_id), r.venue, r.symbol, ("bid", "ask")[s], p, z, i + 1) for s in (0, 1) for i, (p, z) in enumerate(book.side(s))]
            book.apply(bool(r.is_snapshot), r.bids, r.asks, int(r.sequence), int(r.event_time_us))
            return []

        return step

    return ordered_fold(cols.unionByName(ends), _BOOK_KEYS, ["ord"], start, "session_id bigint, venue string, symbol string, side string, price double, size double, level bigint")


# --- serving -------------------------------------------------------------------------------------------------------


class TokenBucket:
    """Refills by elapsed time; a refused request takes nothing but still moves the clock."""

    def __init__(self, capacity: float, refill: float):
        self.capacity, self.refill, self.tokens, self.at = capacity, refill, capacity, None

    def take(self, now_ms: int, cost: float) -> tuple[bool, int, int]:
        elapsed = 0.0 if self.at is None else max(0, now_ms - self.at) / 1000
        self.tokens = min(self.capacity, self.tokens + elapsed * self.refill)
        self.at = now_ms
        if self.tokens >= cost:
            self.tokens -= cost
            return True, int(self.tokens), 0
        return False, int(self.tokens), ceil((cost - self.tokens) / self.refill) if self.refill > 0 else 2**31


class _Limits:
    def __init__(self, key: str, order: list[str]):
        self.key, self.order, self.bucket = key, order, None

    def row(self, r) -> list[tuple]:
        if self.bucket is None:
            self.bucket = TokenBucket(r.capacity, r.refill)
        return [(getattr(r, self.key), *(getattr(r, o) for o in self.order), *self.bucket.take(int(r.now_ms), float(r.cost)))]


class _UnknownLimits:
    """A bucket is full, whatever it held, once the time since the last request suffices to fill it."""

    def __init__(self, key: str, order: list[str]):
        self.key, self.order, self.at = key, order, None

    def row(self, r) -> _Limits | None:
        full = self.at is not None and max(0, r.now_ms - self.at) / 1000 * r.refill >= r.capacity
        self.at = r.now_ms
        if not full:
            return None
        known = _Limits(self.key, self.order)
        known.row(r)
        return known


def rate_limited(requests: DataFrame, key: str, order: list[str], now_ms: str, cost: str, capacity: float | str, refill: float | str, width: int = WIDTH) -> DataFrame:
    """(key, order, allowed, remaining, retry_after_s) of every request of a key in order; ``order[0]`` is an integer.

    ``capacity`` and ``refill`` are numbers, or names of columns that are constant per key. Requests without a time are
    passed over; a null cost is 1. A key's slices are folded at once from the first pause that fills the bucket on; rows
    before it wait for the slices before.
    """
    kinds = dict(requests.dtypes)
    number = lambda x: (F.col(x) if isinstance(x, str) else F.lit(x)).cast("double")
    cols = requests.select(key, *order, F.col(now_ms).cast("bigint").alias("now_ms"), F.coalesce(F.col(cost).cast("double"), F.lit(1.0)).alias("cost"), number(capacity).alias("capacity"), number(refill).alias("refill")).where("now_ms is not null")
    schema = ", ".join([f"{key} {kinds[key]}", *(f"{o} {kinds[o]}" for o in order), "allowed boolean, remaining bigint, retry_after_s bigint"])
    return split_fold(cols, [key], order, lambda: _Limits(key, order), lambda: _UnknownLimits(key, order), schema, width)


class _Paced:
    def __init__(self, keys: list[str], order: list[str], gap: int, last: int | None = None):
        self.keys, self.order, self.gap, self.last = keys, order, gap, last

    def row(self, r) -> list[tuple]:
        due = self.last is None or r.at - self.last >= self.gap
        if due:
            self.last = r.at
        return [(*(getattr(r, k) for k in self.keys), *(getattr(r, o) for o in self.order), due)]


class _UnknownPaced:
    """A row is due, whatever was before, if all rows before it are older than the gap."""

    def __init__(self, keys: list[str], order: list[str], gap: int):
        self.keys, self.order, self.gap, self.newest = keys, order, gap, None

    def row(self, r) -> _Paced | None:
        sure = self.newest is not None and r.at - self.newest >= self.gap
        self.newest = r.at if self.newest is None else max(self.newest, r.at)
        return _Paced(self.keys, self.order, self.gap, r.at) if sure else None


#: Order units of a slice where the order is a time in microseconds: an hour.
HOUR_US = 3_600_000_000


def paced(df: DataFrame, keys: list[str], order: list[str], time: str, gap: int, width: int) -> DataFrame:
    """(keys, order, due): whether a row comes at least ``gap`` after the last one of its key that was due; ``order`` begins with the time."""
    kinds = dict(df.dtypes)
    cols = df.select(*keys, *order, F.col(time).cast("bigint").alias("at")).where("at is not null")
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in (*keys, *order)), "due boolean"])
    return split_fold(cols, keys, order, lambda: _Paced(keys, order, gap), lambda: _UnknownPaced(keys, order, gap), schema, width)


def coalesced(updates: DataFrame, stream: str, order: list[str], emit_us: str, hz: int = 10, width: int = HOUR_US) -> DataFrame:
    """(stream, order) of the updates that a stream limited to ``hz`` delivers: one clock per stream, shared by its symbols.

    ``order`` begins with the time itself; an update without a time is none. Slices of it are folded at once from their first pause on.
    """
    return paced(updates, [stream], order, emit_us, 1_000_000 // min(max(1, hz), 100), width).where("due").drop("due")
