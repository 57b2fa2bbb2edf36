"""A feed of inserts, updates and deletes applied through delete vectors.

Row images are only ever appended to files. An index knows the file position of each key's newest image. A batch of
changes looks up its keys in the index; rows that are superseded or deleted stay where they are, but their positions are
set in the bitmap of their file (the delete vector), and readers leave set positions out. Batches may come in any order,
as may changes within them, and any change may come again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.sources.shared import shared_dir, will_vanish, write_shared

#: Positions that one bitmap covers; a file longer than this has several.
BITMAP_POSITIONS = 32_768
#: Batches in which a whole feed is applied; each costs a pass over the index.
BATCHES = 2

BOOK = ["session_id", "venue", "symbol"]


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`")) for k in keys])


def book_changes(deltas: DataFrame) -> DataFrame:
    """(book, ord, snapshot, bids, asks): each change of a book once.

    ``deltas`` has venue and symbol in canonical form. The order within a book is that of ``sequence``, or of
    ``event_time_us`` where the venue gives none (negative or null); changes equal in that are one change, of which
    the first in order of ``arrival`` counts (map-side combined, so a change repeated without end costs one row per
    map task). Rows without a symbol don't count; a null is_snapshot is false; a null session or venue is a group of its own.
    """
    ord_ = F.when(F.col("sequence") >= 0, F.col("sequence")).otherwise(F.col("event_time_us"))
    rows = deltas.where(F.col("symbol").isNotNull()).select(*BOOK, ord_.alias("ord"), "arrival", F.coalesce("is_snapshot", F.lit(False)).alias("snapshot"), "bids", "asks")
    return rows.groupBy(*BOOK, "ord").agg(F.min_by(F.struct("snapshot", "bids", "asks"), "arrival").alias("c")).select(*BOOK, "ord", "c.*")


def level_images(changes: DataFrame) -> DataFrame:
    """(book, side, price, size, ord, place): the levels that changes name.

    Levels without a price don't count; a null size removes, like a size of 0 or less; a null side is an empty one.
    """
    sides = F.array(F.struct(F.lit("bid").alias("side"), F.col("bids").alias("levels")), F.struct(F.lit("ask").alias("side"), F.col("asks").alias("levels")))
    levels = changes.select(*BOOK, "ord", F.explode(sides).alias("s")).select(*BOOK, "ord", F.col("s.side").alias("side"), F.posexplode("s.levels").alias("place", "l"))
    return levels.where("l.price is not null").select(*BOOK, "side", F.col("l.price").alias("price"), F.coalesce("l.size", F.lit(0.0)).alias("size"), "ord", "place")


class ImageStore:
    """Image files with an index and delete vectors, all in the shared folder.

    ``key``: the columns that name a row; ``scope``: those of them that a snapshot replaces as a whole. Images have these,
    ``size`` (0 or less: removed), and ``ord`` and ``place``, by which the newest image of a key is found; snapshots have
    the scope and ``ord``, and replace what is older. Of two images of one key and order, the one applied first counts.
    """

    def __init__(self, spark: SparkSession, key: list[str], scope: list[str]):
        self.spark, self.key, self.scope = spark, key, scope
        self.path = f"{shared_dir(spark)}/images-{uuid.uuid4().hex}"
        will_vanish(spark, self.path)
        self.batches = 0
        self._index: DataFrame | None = None
        self._snapshots: DataFrame | None = None
        self._vectors: DataFrame | None = None

    def apply(self, images: DataFrame, snapshots: DataFrame) -> None:
        """Apply a batch.

        1. Of the batch's images of a key the newest is kept (map-side combined), unless a snapshot is newer.
        2. The keys are looked up in the index. Where the batch's image is newer, or a snapshot came, the position in the
           index is superseded; where the index is newer, the batch's image came late and is dropped. Removals stay in
           the index without a position, so that a late older image doesn't bring the row back.
        3. New images are appended; a file is what one task writes, a position the row's number in it.
        4. The bits of the superseded positions, and of no others, are set in the delete vectors.
        """
        spark, number = self.spark, self.batches
        newest = snapshots.groupBy(*self.scope).agg(F.max("ord").alias("snap"))
        if self._snapshots is not None:
            newest = newest.unionByName(self._snapshots).groupBy(*self.scope).agg(F.max("snap").alias("snap"))
        self._snapshots = snaps = spark.read.parquet(write_shared(newest, "snapshots"))
        batch = images.groupBy(*self.key).agg(F.max_by(F.struct("size", "ord", "place"), F.struct("ord", "place")).alias("n"))
        cols = [F.coalesce(F.col(f"b.`{k}`"), F.col(f"i.`{k}`")).alias(k) for k in self.key]
        if self._index is None:
            both = batch.select(*self.key, "n", F.lit(None).cast("struct<ord:bigint,place:int,at:struct<batch:int,file:bigint,pos:bigint>>").alias("o"))
        else:
            both = batch.alias("b").join(self._index.alias("i"), _same("b", "i", self.key), "full_outer").select(*cols, "b.n", F.when(F.col("i.ord").isNotNull(), F.struct("i.ord", "i.place", "i.at")).alias("o"))
        at = both.alias("x").join(snaps.alias("s"), _same("x", "s", self.scope), "left")
        live = lambda c: F.col(f"{c}.ord").isNotNull() & (F.col("s.snap").isNull() | (F.col(f"{c}.ord") >= F.col("s.snap")))
        won = live("n") & (~live("o") | (F.struct("n.ord", "n.place") > F.struct("o.ord", "o.place")))
        judged = at.select(*[F.col(f"x.`{k}`").alias(k) for k in self.key], "n", "o", won.alias("won"), (live("o") & ~won).alias("kept"))
        judged = spark.read.parquet(write_shared(judged.where("won or kept or o.at is not null"), "judged"))

        fresh = judged.where("won")
        here = F.monotonically_increasing_id()
        appended = fresh.where("n.size > 0").select(*self.key, "n.*").withColumns({"file": F.shiftright(here, 33).cast("bigint"), "pos": here.bitwiseAND(F.lit((1 << 33) - 1))})
        appended.write.parquet(f"{self.path}/batch={number}")
        self.batches += 1
        place = F.struct(F.lit(number).alias("batch"), "file", "pos").alias("at")
        stored = spark.read.parquet(f"{self.path}/batch={number}").select(*self.key, "ord", "place", place)
        gone = fresh.where("n.size <= 0").select(*self.key, "n.ord", "n.place", F.lit(None).cast("struct<batch:int,file:bigint,pos:bigint>").alias("at"))
        self._index = judged.where("kept").select(*self.key, "o.ord", "o.place", "o.at").unionByName(stored).unionByName(gone)

        dead = judged.where("not kept and o.at is not null").select("o.at.*")
        part = F.expr(f"pos div {BITMAP_POSITIONS}L").alias("part")
        bits = dead.groupBy("batch", "file", part).agg(F.call_function("bitmap_construct_agg", F.expr(f"pos % {BITMAP_POSITIONS}L")).alias("bitmap"))
        if self._vectors is not None:
            bits = bits.unionByName(self._vectors).groupBy("batch", "file", "part").agg(F.call_function("bitmap_or_agg", F.col("bitmap")).alias("bitmap"))
        self._vectors = spark.read.parquet(write_shared(bits, "vectors"))

    def images(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def index(self) -> DataFrame:
        """(key, ord, place, at): the newest image of each key and its (batch, file, pos), null for a removal."""
        return self._index

    def delete_vectors(self) -> DataFrame:
        """(batch, file, part, bitmap): bit ``pos % 32768`` of part ``pos div 32768`` is set for superseded rows."""
        return self._vectors

    def read(self) -> DataFrame:
        """The current rows: all images but those whose position is set in their file's delete vector."""
        rows = self.images().withColumn("part", F.expr(f"pos div {BITMAP_POSITIONS}L"))
        words = self.delete_vectors().mapInArrow(_words, "batch int, file bigint, part bigint, words array<bigint>")
        bit = F.expr(f"bit_get(words[cast((pos % {BITMAP_POSITIONS}L) div 64 as int)], cast(pos % 64 as int))")
        joined = rows.join(words, ["batch", "file", "part"], "left")
        return joined.where(F.col("words").isNull() | (bit == 0)).drop("words", "part", "batch", "file", "pos")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps as words of 64 bits, from which a reader takes a bit without a copy."""
    for batch in batches:
        words = [np.frombuffer(b, "<i8") for b in batch.column(3).to_pylist()]
        offsets = pa.array(np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int32))
        values = pa.array(np.concatenate(words) if words else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.ListArray.from_arrays(offsets, values)], names=["batch", "file", "part", "words"])


class BookStore:
    """Books kept by an ``ImageStore``: batches of a book change feed go in, the levels of all books come out."""

    def __init__(self, spark: SparkSession):
        self.store = ImageStore(spark, [*BOOK, "side", "price"], BOOK)
        self.seen: DataFrame | None = None

    def apply(self, deltas: DataFrame) -> None:
        """Apply the changes of a batch, but for those that an earlier batch had already."""
        changes = book_changes(deltas)
        if self.seen is not None:
            changes = changes.alias("b").join(self.seen.alias("i"), _same("b", "i", [*BOOK, "ord"]), "left_anti")
        changes = deltas.sparkSession.read.parquet(write_shared(changes, "changes"))
        known = changes.select(*BOOK, "ord")
        self.seen = known if self.seen is None else self.seen.unionByName(known)
        self.store.apply(level_images(changes), changes.where("snapshot").select(*BOOK, "ord"))

    def levels(self) -> DataFrame:
        return self.store.read().select(*BOOK, "side", "price", "size")


def closing_books(deltas: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The levels alive at the end of each (session_id, venue, symbol): side, price, size.

    Books start empty and have no depth limit. Several images of one price: the latest change counts, within a change
    the last in list order. The feed is applied in ``batches`` ranges of ``arrival``, rows without one with the first;
    the result is the same for any number of them. An empty feed gives an empty result.
    """
    store = BookStore(deltas.sparkSession)
    low, high = deltas.agg(F.min("arrival"), F.max("arrival")).first()
    if low is None:
        low = high = 0
    cuts = [low + (high - low + 1) * i // batches for i in range(1, batches)]
    number = reduce(lambda a, b: a + b, [(F.col("arrival") >= c).cast("int") for c in cuts], F.lit(0))
    for i in range(batches):
        store.apply(deltas.where(F.coalesce(number, F.lit(0)) == i))
    return store.levels()
