"""Canonical spelling of venues and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_venue(venue: Column) -> Column:
    """Trimmed and lower case; null stays null."""
    return F.lower(F.trim(venue))


def canonical_pair(symbol: Column) -> Column:
    """Trimmed, upper case, with ``/`` and ``_`` as ``-``; an empty symbol is null."""
    return F.nullif(F.translate(F.upper(F.trim(symbol)), "/_", "--"), F.lit(""))


def canonicalise(df: DataFrame, venue_symbols: DataFrame) -> DataFrame:
    """``df`` with its ``venue`` and ``symbol`` in canonical form.

    A venue's own form of a symbol is looked up in ``venue_symbols`` (columns venue, symbol, venue_symbol). The join
    carries no hint: Catalyst broadcasts the lookup while its size is known to lie under the broadcast threshold, and
    otherwise shuffles, with adaptive splitting of skewed partitions. Two lookup rows for one spelling: the
    alphabetically first symbol counts. Rows keep every other column; null and empty symbols become null.
    """
    dim = (
        venue_symbols.select(
            canonical_venue(F.col("venue")).alias("__vs_venue"),
            F.upper(F.trim("venue_symbol")).alias("__vs_spelling"),
            F.col("symbol").alias("__vs_symbol"),
        )
        .where("__vs_spelling <> ''")
        .groupBy("__vs_venue", "__vs_spelling")
        .agg(F.min("__vs_symbol").alias("__vs_symbol"))
    )
    spelled = df.withColumns({"venue": canonical_venue(df["venue"]), "__spelling": F.upper(F.trim(df["symbol"]))})
    return (
        spelled.join(dim, (F.col("venue") == F.col("__vs_venue")) & (F.col("__spelling") == F.col("__vs_spelling")), "left")
        .withColumn("symbol", F.coalesce("__vs_symbol", canonical_pair(F.col("symbol"))))
        .drop("__vs_venue", "__vs_spelling", "__vs_symbol", "__spelling")
    )
