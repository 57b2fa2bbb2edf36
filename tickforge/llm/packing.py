"""Filling containers of fixed capacity with whole texts, by swap-based local search."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.bpe import VOCABULARY, blocks, encoder, ship
from tickforge.sources.shared import write_shared

#: Items packed against each other at once, and the fill from which a bin is closed.
ITEMS, CLOSED = 8_192, 0.98


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item; sizes lie between 1 and ``capacity``.

    Items are first placed in falling size into the fullest bin that takes them. Then the emptiest bins are emptied into
    the other underfull ones: an item moves, or is exchanged one for one, one for two or two for one, whenever that
    increases the sum of squared fills, that is, when the fuller bin grows; a bin that becomes empty is dropped. All pairs
    of a bin's items are tried, and the search ends when no underfull bin has such a step left.
    """
    if not len(sizes):
        return np.zeros(0, np.int64)
    bin_of = np.empty(len(sizes), np.int64)
    room: list[tuple[int, int]] = []
    count = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        at = bisect_left(room, (s, -1))
        if at == len(room):
            left, b = capacity - s, count
            count += 1
        else:
            left, b = room.pop(at)
            left -= s
        bin_of[i] = b
        if left:
            insort(room, (left, b))
    _search(bin_of, sizes, count, capacity)
    return np.unique(bin_of, return_inverse=True)[1]


def _search(bin_of: np.ndarray, sizes: np.ndarray, count: int, capacity: int) -> None:
    """Local search in place; every step raises the sum of squared fills, so it ends."""
    fill = np.bincount(bin_of, weights=sizes, minlength=count).astype(np.int64)
    least = -(-int(fill.sum()) // capacity)
    stuck = np.zeros(count, bool)
    changed = False
    while count > least:
        candidates = np.flatnonzero((fill > 0) & (fill < capacity) & ~stuck)
        if not len(candidates):
            if not changed:
                return
            stuck[:], changed = False, False  # what was stuck may have found room since
            continue
        a = int(candidates[fill[candidates].argmin()])
        step = _step(a, bin_of, sizes, fill, capacity)
        if step is None:
            stuck[a] = True
            continue
        changed = True
        b, give, take = step
        delta = int(sizes[give].sum() - sizes[take].sum())
        bin_of[give], bin_of[take] = b, a
        fill[a] -= delta
        fill[b] += delta
        count -= fill[a] == 0


def _step(a: int, bin_of: np.ndarray, sizes: np.ndarray, fill: np.ndarray, capacity: int) -> tuple[int, list[int], list[int]] | None:
    """(bin, items it gets, items it gives): a step that takes size out of bin ``a`` into a fuller bin."""
    own = np.flatnonzero(bin_of == a)
    own = own[np.argsort(-sizes[own], kind="stable")].tolist()
    room = capacity - fill
    room[(fill == 0) | (np.arange(len(fill)) == a)] = -1

    def best(delta: np.ndarray | int, bins: np.ndarray | slice) -> int:
        """Place of the exchange that leaves least room among those that fit and raise the squared fills."""
        space = room[bins]
        left = space - delta
        ok = (delta > 0) & (left >= 0) & (fill[bins] - fill[a] + delta > 0)
        left[~ok] = capacity + 1
        k = int(left.argmin())
        return k if left[k] <= capacity else -1

    for i in own:  # move
        k = best(int(sizes[i]), slice(None))
        if k >= 0:
            return k, [i], []
    for i in own:  # one for one
        k = best(sizes[i] - sizes, bin_of)
        if k >= 0:
            return int(bin_of[k]), [i], [k]
    one = np.array(own)
    x, y = np.triu_indices(len(one), 1)
    got = _exchange(one[x], one[y], sizes[one[x]] + sizes[one[y]], np.arange(len(sizes)), None, sizes, bin_of, best)  # two for one
    if got is not None:
        return got
    order = np.argsort(bin_of, kind="stable")
    order = order[room[bin_of[order]] > 0]
    held = bin_of[order]
    first, second = [], []
    for apart in range(1, len(order)):
        at = np.flatnonzero(held[apart:] == held[:-apart])
        if not len(at):
            break
        first.append(order[at])
        second.append(order[at + apart])
    if first:
        p, q = np.concatenate(first), np.concatenate(second)
        return _exchange(one, None, sizes[one], p, q, sizes[p] + sizes[q], bin_of, best)  # one for two
    return None


def _exchange(give: np.ndarray, give_too: np.ndarray | None, given: np.ndarray, take: np.ndarray, take_too: np.ndarray | None, taken: np.ndarray, bin_of: np.ndarray, best) -> tuple[int, list[int], list[int]] | None:
    """The first exchange, in falling size of what is given, that ``best`` has a place for; sizes given are tried once each."""
    bins = bin_of[take]
    for size in np.unique(given)[::-1].tolist():
        k = best(size - taken, bins)
        if k >= 0:
            i = int(np.flatnonzero(given == size)[0])
            own = [int(give[i])] + ([] if give_too is None else [int(give_too[i])])
            other = [int(take[k])] + ([] if take_too is None else [int(take_too[k])])
            return int(bins[k]), own, other
    return None


def _emit(keys: pa.Array, parts: np.ndarray, sizes: np.ndarray, bins: np.ndarray, prefix: str, key: str) -> pa.RecordBatch:
    totals = np.bincount(bins, weights=sizes).astype(np.int64)
    names = pa.array([f"{prefix}-{b}" for b in bins])
    return pa.RecordBatch.from_arrays([keys, pa.array(parts, pa.int64()), pa.array(sizes, pa.int64()), names, pa.array(totals[bins])], names=[key, "part", "n_tokens", "bin", "fill"])


def fill_containers(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2_048, vocabulary: str = VOCABULARY) -> DataFrame:
    """(``key``, part, n_tokens, bin, fill): each text's container, and how many tokens that holds in all.

    Texts of at most ``capacity`` tokens stay whole (part 0). A longer text is cut into full containers of its own and
    one rest, parts 0, 1, ... in order; only the rest is packed. Null and empty texts have no tokens and lie with part 0
    in the container '' that holds nothing. Repeated rows are items of their own; null keys are kept.

    Texts are measured and packed where they are read, ``ITEMS`` at a time, without a shuffle. Only the items of bins
    less than ``CLOSED`` full go on, without their texts, into further rounds over fewer and fewer partitions, so
    underfull bins of different tasks are searched together, until a round saves no container. No item is ever dropped.
    """
    spark = docs.sparkSession
    shipped = ship(spark, vocabulary)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, part bigint, n_tokens bigint, bin string, fill bigint"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(shipped), TaskContext.get().partitionId()
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        n, block = 0, 0

        def close() -> pa.RecordBatch:
            keys = pa.concat_arrays([h[0] for h in held])
            parts, sizes = (np.concatenate([h[i] for h in held]) for i in (1, 2))
            return _emit(keys, parts, sizes, pack(sizes, capacity), f"0-{task}-{block}", key)

        for batch in batches:
            for rows, texts in blocks(batch, text):
                keys, size = rows.column(0), enc.count(texts)
                none = np.flatnonzero(size == 0)
                if len(none):
                    zero = np.zeros(len(none), np.int64)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(none)), pa.array(zero), pa.array(zero), pa.array([""] * len(none)), pa.array(zero)], names=[key, "part", "n_tokens", "bin", "fill"])
                whole, rest = size // capacity, size % capacity
                long = np.repeat(np.arange(len(size)), whole)
                if len(long):
                    part = np.arange(len(long)) - np.repeat(np.cumsum(whole) - whole, whole)
                    full = np.full(len(long), capacity)
                    names = pa.array([f"0-{task}-{block}-{n}-full-{i}" for i in range(len(long))])
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(long)), pa.array(part), pa.array(full), names, pa.array(full)], names=[key, "part", "n_tokens", "bin", "fill"])
                some = np.flatnonzero(rest)
                held.append((keys.take(pa.array(some)), whole[some], rest[some]))
                n += len(some)
                if n >= ITEMS:
                    yield close()
                    held.clear()
                    n, block = 0, block + 1
                elif len(long):
                    block += 1  # keeps the names of full bins apart
        if n:
            yield close()

    def again(round_: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get().partitionId()
            held: list[pa.RecordBatch] = []
            n, block = 0, 0
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n >= ITEMS:
                    yield refill(held, f"{round_}-{task}-{block}")
                    held, n, block = [], 0, block + 1
            if n:
                yield refill(held, f"{round_}-{task}-{block}")

        def refill(held: list[pa.RecordBatch], prefix: str) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            sizes = rows["n_tokens"].to_numpy()
            keys = rows[key].combine_chunks() if isinstance(rows[key], pa.ChunkedArray) else rows[key]
            return _emit(keys, rows["part"].to_numpy(), sizes, pack(sizes, capacity), prefix, key)

        return run

    done: list[DataFrame] = []
    at = spark.read.parquet(write_shared(docs.select(key, text).mapInArrow(measure, schema), "bins-0"))
    is_open = (F.col("fill") < int(CLOSED * capacity)) & (F.col("bin") != "")
    count = lambda: at.where(is_open).agg(F.count(F.lit(1)), F.countDistinct("bin")).first()
    items, bins = count()
    round_ = 0
    while items:
        round_ += 1
        done.append(at.where(~is_open))
        packed = at.where(is_open).repartition(-(-items // (4 * ITEMS))).mapInArrow(again(round_), schema)
        at = spark.read.parquet(write_shared(packed, f"bins-{round_}"))
        before, alone = bins, items <= ITEMS
        items, bins = count()
        closed = at.where(~is_open).agg(F.countDistinct("bin")).first()[0]
        if alone or bins + closed >= before:
            break
    for d in done:
        at = at.unionByName(d)
    return at
