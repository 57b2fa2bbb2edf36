"""Consolidating far too many small files into few well-sized ones."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions.canonical import canonical_pair
from tickforge.sources.shared import write_shared

SMALL_BYTES = 16_384
#: Bytes of shuffled rows that a new file gets, about.
TARGET_BYTES = 128 * 1024 * 1024


class ChecksumMismatch(RuntimeError):
    """What was written isn't what was read; nothing has been committed."""


def live_files(files: DataFrame) -> DataFrame:
    """Committed files that no other file replaces, with ``lake_symbol`` and ``lake_day`` (UTC day of min_event_time)."""
    live = files.where("committed_at is not null and replaced_by is null")
    return live.withColumns({"lake_symbol": canonical_pair(F.col("symbol")), "lake_day": F.to_date("min_event_time")})


def small_file_groups(files: DataFrame, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """(file_id, lake_symbol, lake_day) of live files under ``small_bytes`` in groups of at least two.

    Files without symbol, day or n_bytes belong to no group. n_rows isn't relied on. The table of files is small beside
    the rows; counts per group are combined on the map side and joined back.
    """
    small = live_files(files).where(F.col("n_bytes") < small_bytes).where("lake_symbol is not null and lake_day is not null").select("file_id", "lake_symbol", "lake_day")
    groups = small.groupBy("lake_symbol", "lake_day").agg(F.count(F.lit(1)).alias("__n")).where("__n >= 2")
    return small.join(groups, ["lake_symbol", "lake_day"]).select("file_id", "lake_symbol", "lake_day")


def _hashes(cols: list[str]) -> list[Column]:
    """Two hashes of a row."""
    return [F.xxhash64(*[F.col(f"`{c}`") for c in sorted(cols)], F.lit(seed)).alias(f"__h{seed}") for seed in (1, 2)]


def _sums(hashes: DataFrame) -> tuple:
    return tuple(hashes.agg(F.count(F.lit(1)), *[F.sum(F.col(f"__h{seed}").cast("decimal(38,0)")) for seed in (1, 2)]).first())


def multiset_checksum(df: DataFrame) -> tuple:
    """Number of rows and two sums of row hashes: equal for equal multisets of rows, whatever their order or files."""
    return _sums(df.select(*_hashes(df.columns)))


def expected_checksum(rows: DataFrame, groups: DataFrame, stay: DataFrame) -> tuple:
    """The checksum of what has to be written, from the source alone: each row of the files in ``groups`` once, but for those that a file in ``stay`` holds.

    Worked out from row hashes, not from the rows that were written, so a row lost or doubled on the way is noticed.
    """
    content = [c for c in rows.columns if c != "file_id"]
    files = groups.select("file_id", F.lit(False).alias("__stays")).unionByName(stay.select("file_id", F.lit(True).alias("__stays")))
    return _sums(rows.join(files, "file_id").select(*_hashes(content), "__stays").groupBy("__h1", "__h2").agg(F.max("__stays").alias("__stays")).where("not __stays"))


def file_sizes(df: DataFrame) -> DataFrame:
    """(file_path, n_bytes, n_rows) of the files behind a table that was read from files."""
    return df.groupBy(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("n_bytes")).agg(F.count(F.lit(1)).alias("n_rows"))


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def compact(rows: DataFrame, files: DataFrame, small_bytes: int = SMALL_BYTES, target_bytes: int = TARGET_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rewrite the small files' rows; returns (manifest, rows of the whole lake after it).

    ``rows``: the lake's rows with their ``file_id``; ``files``: see ``live_files``. The rows of the small files are
    shuffled by a REBALANCE hint on symbol and day: runtime statistics then merge small partitions and split large
    ones towards ``target_bytes``, so a hot symbol is spread and a quiet one shares a file.
    A row that lies in several live files comes out once: equal rows of the small files are folded (map-side), and
    those that a file which stays also holds are left out.

    The result is written to the shared folder once, read again and compared by a multiset checksum with what its source
    demands (see ``expected_checksum``); only then is the manifest (file_id, new_path) written, which is the commit: files
    in it are replaced by those below new_path. A mismatch raises ChecksumMismatch. Empty
    files are listed in the manifest though they hold no row; without small files nothing is rewritten.
    """
    spark = rows.sparkSession
    plan = spark.read.parquet(write_shared(small_file_groups(files, small_bytes), "plan"))
    content = [c for c in rows.columns if c != "file_id"]
    stay = live_files(files).select("file_id").join(plan, "file_id", "left_anti")
    staying = rows.join(stay, "file_id", "left_semi").select(content)
    same = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in content]
    groups = plan.select(F.col("file_id"), F.struct("lake_symbol", "lake_day").alias("__at"))
    moved = rows.join(groups, "file_id").groupBy(*content).agg(F.min_by("__at", "file_id").alias("__at"))
    moved = moved.alias("l").join(staying.alias("r"), same, "left_anti")

    with _setting(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes)):
        path = write_shared(moved.hint("rebalance", "__at").sortWithinPartitions("__at"), "compacted", lasting=True)
    written = spark.read.parquet(path)
    if multiset_checksum(written.select(content)) != expected_checksum(rows, plan, stay):
        raise ChecksumMismatch(path)
    manifest = spark.read.parquet(write_shared(plan.select("file_id", F.lit(path).alias("new_path")), "manifest", lasting=True))
    return manifest, written.select(content).unionByName(staying)
