import datetime as dt

import pytest

from tickforge.operators import compaction
from tickforge.operators.compaction import compact, multiset_checksum, small_file_groups

F = "file_id bigint, symbol string, min_event_time timestamp, n_rows bigint, n_bytes bigint, committed_at timestamp, replaced_by bigint"
R = "file_id bigint, venue string, trade_id string, price double, lake_day string"
DAY = dt.datetime(2025, 3, 3, 10)


def files():
    late = DAY + dt.timedelta(days=1)
    return [
        (1, "a-b", DAY, 2, 10, DAY, None), (2, " A/B", DAY, None, 10, DAY, None), (3, "A_B", DAY, 1, 99_999, DAY, None), (4, "A-B", late, 1, 10, DAY, None),
        (5, "A-B", DAY, 1, 10, None, None), (6, "A-B", DAY, 1, 10, DAY, 3), (7, "C", DAY, 0, 10, DAY, None), (8, "C", DAY, 0, 10, DAY, None), (9, None, DAY, 1, 10, DAY, None), (10, "", DAY, 1, 10, DAY, None), (11, "A-B", None, 1, 10, DAY, None),
    ]


def test_groups(spark, rows):
    assert rows(small_file_groups(spark.createDataFrame(files(), F)), "file_id") == [(1,), (2,), (7,), (8,)]


def test_every_live_trade_once(spark, rows):
    data = [(1, "v", "x", 1.0, "d"), (1, "v", None, None, None), (2, "v", "y", 1.0, "d"), (2, "v", "x", 1.0, "d"), (3, "v", "y", 1.0, "d"), (3, "v", "z", 2.0, "d"), (4, "v", "q", 1.0, "d"), (5, "v", "bad", 1.0, "d"), (6, "v", "old", 1.0, "d")]
    manifest, lake = compact(spark.createDataFrame(data, R), spark.createDataFrame(files(), F))
    assert rows(manifest, "file_id") == [(1,), (2,), (7,), (8,)]
    assert rows(lake, "trade_id") == [(None,), ("q",), ("x",), ("y",), ("z",)]


def test_nothing_to_do(spark, rows):
    manifest, lake = compact(spark.createDataFrame([], R), spark.createDataFrame([], F))
    assert rows(manifest) == [] and rows(lake) == []


def test_mismatch_commits_nothing(spark, monkeypatch):
    sums = iter([(1, 2, 3), (1, 2, 4)])
    monkeypatch.setattr(compaction, "multiset_checksum", lambda df: next(sums))
    with pytest.raises(compaction.ChecksumMismatch):
        compact(spark.createDataFrame([(1, "v", "x", 1.0, "d")], R), spark.createDataFrame(files(), F))


def test_checksum_sees_rows_lost_doubled_or_changed(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(9)], "a int, b string")
    same = multiset_checksum(df.repartition(3).orderBy("b"))
    assert multiset_checksum(df) == same
    for other in (df.where("a > 0"), df.unionByName(df.limit(1)), df.selectExpr("a + 1 as a", "b")):
        assert multiset_checksum(other) != same


def test_checksum_comes_from_the_source(spark, monkeypatch):
    data = [(1, "v", "x", 1.0, "d"), (2, "v", "y", 1.0, "d"), (2, "v", "x", 1.0, "d"), (3, "v", "y", 1.0, "d")]
    write = compaction.write_shared
    monkeypatch.setattr(compaction, "write_shared", lambda df, name, **kw: write(df.limit(0) if name == "compacted" else df, name, **kw))
    with pytest.raises(compaction.ChecksumMismatch):
        compact(spark.createDataFrame(data, R), spark.createDataFrame(files(), F))


def test_files_come_out_at_the_target(spark):
    data = [(i % 2 + 1, "v", f"{i}-{hash(i * 7919)}", float(i), "d") for i in range(60_000)]
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    sizes = {}
    # few rows: several map tasks, between whose outputs a partition is split
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for target in (100_000, 100_000_000):
        manifest, _ = compact(spark.createDataFrame(data, R).repartition(8), spark.createDataFrame(files(), F), target_bytes=target)
        sizes[target] = compaction.file_sizes(spark.read.parquet(manifest.first().new_path)).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert 1 <= len(sizes[100_000_000]) < len(sizes[100_000])
    assert all(sum(r.n_rows for r in s) == 60_000 for s in sizes.values())
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == before
