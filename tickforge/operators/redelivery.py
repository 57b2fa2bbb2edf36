"""Messages delivered more than once: exactly one delivery of each is kept.

The identity of a message: two rows are the same message if venue and trade_id agree (trade_id trimmed, letter case
ignored) and their sequences don't contradict each other, where -1 (and null) contradicts nothing. Without a trade_id,
venue, symbol and a sequence of 0 or more must agree. Rows with neither are never repeats.

If one trade_id carries several sequences, each is a message of its own, and rows without a sequence belong to the
message whose first row came earliest among those with a sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.sources.shared import write_shared

#: Width of the time buckets of delivery; each gets a Bloom filter of its own.
BUCKET_US = 21_600_000_000
#: Filters that are joined to one of the next level, and levels up to which identifiers are kept to build the next.
BRANCH, LEVELS = 16, 2
#: Bits of a Bloom filter per identifier, and probes per identifier.
BITS, PROBES = 16, 4


class Bloom:
    """A Bloom filter over 64-bit hashes, probed and filled by whole arrays."""

    def __init__(self, capacity: int):
        self.mask = np.uint64((1 << max(6, int(capacity * BITS - 1).bit_length())) - 1)
        self.words = np.zeros((int(self.mask) + 1) >> 6, np.uint64)

    def _places(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        h = hashes.view(np.uint64)
        step = (h >> np.uint64(32)) | np.uint64(1)
        for k in range(PROBES):
            bit = (h + np.uint64(k) * step) & self.mask
            yield (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))

    def add(self, hashes: np.ndarray) -> None:
        for word, bit in self._places(hashes):
            np.bitwise_or.at(self.words, word, bit)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        hit = np.ones(len(hashes), bool)
        for word, bit in self._places(hashes):
            hit &= (self.words[word] & bit) != 0
        return hit


class _Node:
    """A filter over one bucket, or over the buckets of its children together."""

    def __init__(self, ids: np.ndarray, bucket: int | None = None, children: list[_Node] | None = None):
        self.ids, self.bucket, self.children = ids, bucket, children
        self.filter = Bloom(len(ids))
        self.filter.add(ids)


class _History:
    """The filters of all buckets so far, as trees: a search goes down only where a filter matches.

    Identifiers are held only until the filter over their ``BRANCH ** LEVELS`` buckets is built; after that, a bucket
    costs its filters alone, some bytes per identifier.
    """

    def __init__(self):
        self.levels: list[list[_Node]] = [[]]

    def add(self, bucket: int, ids: np.ndarray) -> None:
        node = _Node(ids, bucket)
        for level in range(len(self.levels) + 1):
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(node)
            if level == LEVELS:
                node.ids = None
                return
            if len(self.levels[level]) < BRANCH:
                return
            children, self.levels[level] = self.levels[level], []
            node = _Node(np.concatenate([c.ids for c in children]), children=children)
            for c in children:
                c.ids = None

    def matches(self, ids: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(bucket, identifiers) of each bucket whose filter knows some of ``ids``."""
        found, todo = [], [(n, ids) for level in self.levels for n in level]
        while todo:
            node, suspects = todo.pop()
            hit = suspects[node.filter.may_hold(suspects)]
            if len(hit) and node.children is None:
                found.append((node.bucket, hit))
            elif len(hit):
                todo.extend((c, hit) for c in node.children)
        return found


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, hash) of all identifiers that may occur more than once; the input is sorted by bucket.

    Identifiers of a bucket are held against the filters of the earlier buckets; what no filter knows, and occurs once
    in its bucket, is new and never looked at again. For the rest, the cells of every matching bucket are named.
    """
    history = _History()

    def close(bucket: int, parts: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch | None:
        ids, n = np.concatenate(parts), np.concatenate(counts)
        earlier = history.matches(ids)
        history.add(bucket, ids)
        again = np.isin(ids, np.concatenate([h for _, h in earlier])) if earlier else np.zeros(len(ids), bool)
        own = ids[again | (n > 1)]
        cells = [*earlier, (bucket, own)] if len(own) else earlier
        if not cells:
            return None
        b = np.concatenate([np.full(len(h), at, np.int64) for at, h in cells])
        return pa.RecordBatch.from_arrays([pa.array(b), pa.array(np.concatenate([h for _, h in cells]))], names=["__bucket", "__hash"])

    now, parts, counts = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, ids, n = (batch.column(c).to_numpy() for c in range(3))
        cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if now is not None and bucket[a] != now:
                if (out := close(now, parts, counts)) is not None:
                    yield out
                parts, counts = [], []
            now = int(bucket[a])
            parts.append(ids[a:z])
            counts.append(n[a:z])
    if now is not None and (out := close(now, parts, counts)) is not None:
        yield out


def surplus_deliveries(df: DataFrame, bucket_us: int = BUCKET_US, keep: list[str] | None = None) -> DataFrame:
    """``arrival`` of all surplus rows of ``df`` with ``first_arrival``, the arrival of their message's first delivery.

    ``df`` has venue and symbol in canonical form, trade_id, sequence, ingest_time_us and a unique, non-null
    ``arrival``; the columns in ``keep`` (all, unless given) are passed through, others aren't shuffled. Null venues count as one venue, null symbols as one symbol; rows
    with a null ingest_time_us share a bucket. An empty table gives an empty result.

    1. Screening: per identifier hash and time bucket of delivery, combined on the map side (an identifier that makes
       up a third of all rows costs one row per map task), the hashes are partitioned and run through one Bloom filter
       per bucket. Only 64-bit hashes are shuffled here.
    2. Verification: only the rows in matching (bucket, hash) cells are compared, exactly and by the true columns. They
       are written to the shared folder first, as they are read three times. Per message, the first arrival is again a
       map-side combined aggregate, and the join back to the rows is split by adaptive execution if one message is hot.
    """
    trade_id = F.nullif(F.lower(F.trim("trade_id")), F.lit(""))
    seq = F.when(F.col("sequence") >= 0, F.col("sequence"))
    venue = F.coalesce("venue", F.lit(""))
    # a message without trade_id is named by its sequence, one with trade_id isn't: its sequence may be missing
    by_sequence = F.concat_ws("\x01", F.lit("s"), venue, F.coalesce("symbol", F.lit("")), seq.cast("string"))
    message = F.when(trade_id.isNotNull(), F.concat_ws("\x01", F.lit("t"), venue, trade_id)).when(seq.isNotNull(), by_sequence)
    bucket = F.expr(f"coalesce((ingest_time_us - pmod(ingest_time_us, {bucket_us}L)) div {bucket_us}L, -1L)")
    rows = (
        df.withColumns({"__message": message, "__seq": F.coalesce(seq, F.lit(-1)), "__bucket": bucket})
        .where("__message is not null")
        .withColumn("__hash", F.xxhash64("__message"))
    )
    cells = rows.groupBy("__bucket", "__hash").agg(F.count(F.lit(1)).alias("__n"))
    sorted_cells = cells.repartition("__hash").sortWithinPartitions("__bucket")
    suspects = sorted_cells.mapInArrow(_screen, "__bucket bigint, __hash bigint").distinct()
    passed = [c for c in (df.columns if keep is None else keep) if c != "arrival"]
    narrow = rows.select("__bucket", "__hash", "__message", "__seq", "arrival", *passed)
    stored_at = write_shared(narrow.join(suspects, ["__bucket", "__hash"], "left_semi").drop("__bucket", "__hash"), "suspects")
    stored = df.sparkSession.read.parquet(stored_at)

    by_seq = stored.groupBy("__message", "__seq").agg(F.min("arrival").alias("__first"))
    known = F.when(F.col("__seq") >= 0, F.col("__first"))
    main = by_seq.groupBy(F.col("__message").alias("__m")).agg(F.min_by("__seq", known).alias("__main"), F.min(known).alias("__known"), F.min(F.when(F.col("__seq") < 0, F.col("__first"))).alias("__open"))
    of_main = (F.col("__seq") < 0) | (F.col("__seq") == F.col("__main"))
    firsts = by_seq.join(main, F.col("__message") == F.col("__m")).select(
        F.col("__message").alias("__m"), F.col("__seq").alias("__s"), F.when(of_main, F.least("__known", "__open")).otherwise(F.col("__first")).alias("first_arrival")
    )
    return (
        stored.join(firsts, (F.col("__message") == F.col("__m")) & (F.col("__seq") == F.col("__s")))
        .where("arrival <> first_arrival")
        .drop("__message", "__seq", "__m", "__s")
    )


def exactly_once(df: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """``df`` without its surplus deliveries: one row per message, the first, and all rows that have no identity."""
    surplus = surplus_deliveries(df, bucket_us, []).select("arrival")
    return df.join(surplus, "arrival", "left_anti")
