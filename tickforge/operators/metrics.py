"""Observability queries: rates, quantiles, islands without data, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Upper bounds of the lag histogram, in seconds.
LAG_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def event_rate(df: DataFrame, time_us: str, seconds: int, *keys: str) -> DataFrame:
    """Events per second by key and time bucket."""
    start = (F.col(time_us) - F.pmod(F.col(time_us), F.lit(seconds * 1_000_000))).alias("bucket_us")
    return df.groupBy(*keys, start).agg(F.count(F.lit(1)).alias("n")).withColumn("per_second", F.col("n") / seconds)


def histogram_quantile(df: DataFrame, value: Column, q: float, *keys: str, bounds: tuple[float, ...] = LAG_BUCKETS) -> DataFrame:
    """Quantile by linear interpolation in cumulative buckets; beyond the last bound, that bound. Empty keys have none."""
    counts = df.where(value.isNotNull()).groupBy(*keys).agg(*[F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(F.lit(1)).alias("n"))
    rank, out = F.col("n") * q, None
    for i, b in enumerate(bounds):
        low, below = (bounds[i - 1], F.col(f"b{i - 1}")) if i else (0.0, F.lit(0))
        inside = F.col(f"b{i}") - below
        at = low + (b - low) * F.when(inside > 0, (rank - below) / inside).otherwise(0.0)
        out = F.when(F.col(f"b{i}") >= rank, at) if out is None else out.when(F.col(f"b{i}") >= rank, at)
    return counts.select(*keys, "n", out.otherwise(bounds[-1]).alias("quantile"))


def nearest_rank(df: DataFrame, value: str, p: float, *keys: str) -> DataFrame:
    """The sorted value at place round(p / 100 * (n - 1)), halves to even, by counts of values, not by a list."""
    n = F.sum("c").over(Window.partitionBy(*keys))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c")).withColumns({"n": n, "upto": upto})
    return counts.where(F.col("upto") > F.bround(F.lit(p / 100) * (F.col("n") - 1))).groupBy(*keys).agg(F.min(value).alias("value"), F.max("n").alias("n"))


def silent_periods(df: DataFrame, time_us: str, least_us: int, *keys: str) -> DataFrame:
    """(keys, from_us, to_us) of gaps between successive events of at least ``least_us``.

    Times are first reduced to the first and last per key and slice of ``least_us``, so the window sees two rows per slice.
    """
    t = F.col(time_us)
    ends = df.where(t.isNotNull()).groupBy(*keys, (t - F.pmod(t, F.lit(least_us))).alias("__slice")).agg(F.min(t).alias("__lo"), F.max(t).alias("__hi"))
    before = F.lag("__hi").over(Window.partitionBy(*keys).orderBy("__slice"))
    return ends.withColumn("from_us", before).where(F.col("__lo") - F.col("from_us") >= least_us).select(*keys, "from_us", F.col("__lo").alias("to_us"))


def counter_increase(samples: DataFrame, value: str, time_s: str, range_s: int, *keys: str) -> DataFrame:
    """``increase`` and ``rate`` of a counter over the range before each sample; a falling counter was reset to 0."""
    by = Window.partitionBy(*keys).orderBy(time_s)
    step = F.col(value) - F.lag(value).over(by)
    steps = samples.withColumn("__step", F.when(step < 0, F.col(value)).otherwise(step))
    span = by.rangeBetween(-range_s, 0)
    first = F.min(time_s).over(span)
    # the step into the first sample of the range lies before the range
    inner = F.sum(F.coalesce("__step", F.lit(0))).over(span) - F.coalesce(F.first("__step").over(span), F.lit(0))
    return steps.withColumns({"increase": inner, "__s": F.col(time_s) - first}).withColumn("rate", F.when(F.col("__s") > 0, F.col("increase") / F.col("__s"))).drop("__step", "__s")


def read_amplification(df: DataFrame, kind: str, n_bytes: str, wanted: list[str]) -> DataFrame:
    """Bytes read over bytes wanted if all kinds share a topic, and the share discarded."""
    sums = df.agg(F.sum(n_bytes).alias("bytes_all"), F.sum(F.when(F.col(kind).isin(wanted), F.col(n_bytes)).otherwise(0)).alias("bytes_wanted"))
    return sums.select("bytes_all", "bytes_wanted", (F.col("bytes_all") / F.nullif("bytes_wanted", F.lit(0))).alias("amplification"), (F.lit(1.0) - F.col("bytes_wanted") / F.nullif("bytes_all", F.lit(0))).alias("waste"))


def pipeline_stats(status: DataFrame, *keys: str) -> DataFrame:
    """received, published, duplicates, gaps, regressions and missed messages from sequence statuses."""
    n = lambda s: F.count_if(F.col("status") == s)
    return status.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("received"), F.count_if(F.col("status") != "duplicate").alias("published"), n("duplicate").alias("duplicates"),
        n("gap").alias("gaps"), n("regression").alias("regressions"), F.sum("missing").alias("missed"),
    )


def lost_messages(received: DataFrame, dropped: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """(keys, received, dropped, stored, lost): what came in and was neither dropped on purpose nor found at the output.

    Each side is counted on its own, so messages lost between them show; a negative number is more output than input.
    """
    of = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(name))
    sides = of(received, "received").unionByName(of(dropped, "dropped")).unionByName(of(stored, "stored"))
    counts = sides.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(s) for s in ("received", "dropped", "stored")])
    return counts.withColumn("lost", F.col("received") - F.col("dropped") - F.col("stored"))


def layout_report(checkpoints: DataFrame, layout: str, duration_ms: str, failed: str, state_bytes: str) -> DataFrame:
    """Per job layout: mean and longest checkpoint, failures and state in all."""
    return checkpoints.groupBy(layout).agg(
        F.avg(duration_ms).alias("mean_ms"), F.max(duration_ms).alias("longest_ms"), F.sum(failed).alias("failures"), F.sum(state_bytes).alias("state_bytes")
    )
