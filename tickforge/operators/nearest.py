"""Pairing records of two tables by nearest time within an entity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of the time slices an entity is split into; the tolerance must be far smaller.
SLICE_US = 300_000_000


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_time: str,
    right_time: str,
    left_id: str,
    right_id: str,
    tolerance_us: int,
    names: tuple[str, str],
    slice_us: int = SLICE_US,
) -> DataFrame:
    """Each left record with the right record of its entity nearest in time, before or after.

    Two rows match if all columns of ``by`` agree and the times lie at most ``tolerance_us`` apart. At equal distance
    the earlier right record counts, at equal time the one with the smaller id. Returns (left id, right id) under
    ``names``, only for left records with a match; ids and times are bigint.

    Rows with a null in ``by``, the time or the id never match. Repeated left rows come out as often as they occur.
    Empty tables give an empty result; other columns of either table aren't read, so their names can't clash.

    Plan: an entity is cut into slices of ``slice_us``, so that a hot entity is spread over many tasks; a right record
    within the tolerance of a slice's edge also goes to the neighbouring slice, so no match is lost at an edge. Both
    tables are unioned, repartitioned by (entity, slice), sorted within partitions and merged in one streaming pass
    that holds the last right record and the left records which still wait for the next one.
    """
    if not 0 <= tolerance_us < slice_us:
        raise ValueError("the tolerance must be smaller than a slice")
    entity = lambda df: F.concat_ws("\x01", *[df[c].cast("string") for c in by])

    def rows(df: DataFrame, time: str, key: str, kind: int) -> DataFrame:
        usable = df[time].isNotNull() & df[key].isNotNull()
        for c in by:
            usable = usable & df[c].isNotNull()
        return df.where(usable).select(entity(df).alias("e"), df[time].cast("bigint").alias("t"), F.lit(kind).cast("tinyint").alias("k"), df[key].cast("bigint").alias("i"))

    slot = F.expr(f"(t - pmod(t, {slice_us}L)) div {slice_us}L")
    lefts = rows(left, left_time, left_id, 1).withColumn("s", slot)
    rights = rows(right, right_time, right_id, 0).withColumn("s", slot)
    edge = F.expr(f"pmod(t, {slice_us}L)")
    copies = F.array_compact(
        F.array(F.col("s"), F.when(edge <= tolerance_us, F.col("s") - 1), F.when(edge >= slice_us - tolerance_us, F.col("s") + 1))
    )
    rights = rights.withColumn("s", F.explode(copies))
    ordered = lefts.unionByName(rights).repartition("e", "s").sortWithinPartitions("e", "s", "t", "k", "i")
    return ordered.mapInArrow(_merger(tolerance_us, names), f"`{names[0]}` bigint, `{names[1]}` bigint")


def _merger(tolerance: int, names: tuple[str, str]):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                rows = rows if carry is None else pa.concat_tables([carry, rows])
                pairs, carry = _match(rows.combine_chunks(), tolerance, False)
                if len(pairs[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=list(names))
        if carry is not None and carry.num_rows:
            pairs, _ = _match(carry.combine_chunks(), tolerance, True)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=list(names))

    return merge


def _match(rows: pa.Table, tolerance: int, last: bool) -> tuple[tuple[np.ndarray, np.ndarray], pa.Table]:
    """Pairs of all left rows whose neighbours are known, and the rows to see again with the next batch."""
    n = rows.num_rows
    entity = rows["e"].combine_chunks() if isinstance(rows["e"], pa.ChunkedArray) else rows["e"]
    s, t, k, i = (rows[c].to_numpy() for c in "stki")
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = (s[1:] != s[:-1]) | pc.not_equal(entity.slice(1), entity.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    group = np.cumsum(new)
    quote = k == 0
    first = quote.copy()
    first[1:] &= ~(quote[:-1] & ~new[1:] & (t[1:] == t[:-1]))  # of several at one time, the smallest id came first
    at = np.arange(n)
    before = np.maximum.accumulate(np.where(first, at, -1))
    after = np.minimum.accumulate(np.where(first, at, n)[::-1])[::-1]
    has_b = before >= 0
    has_b[has_b] = group[before[has_b]] == group[has_b]
    has_a = after < n
    has_a[has_a] = group[after[has_a]] == group[has_a]
    far = np.int64(2**62)
    d_b, d_a = np.full(n, far), np.full(n, far)
    d_b[has_b] = t[has_b] - t[before[has_b]]
    d_a[has_a] = t[after[has_a]] - t[has_a]
    done = ~quote
    keep = np.zeros(n, bool)
    if not last:
        open_ = ~quote & (group == group[-1]) & ~has_a & (t[-1] - t <= tolerance)
        done &= ~open_
        keep = open_.copy()
        tail = before[-1]
        if tail >= 0 and group[tail] == group[-1]:
            keep[tail] = True
        keep[-1] |= quote[-1]  # a repeat of the last time must be known as such
    hit = done & (np.minimum(d_b, d_a) <= tolerance)
    pick = np.where(d_b[hit] <= d_a[hit], before[hit], np.minimum(after[hit], n - 1))
    return (i[hit], i[pick]), rows.filter(pa.array(keep))
