"""Queries pN_... of the text problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.bpe import encode_texts
from tickforge.llm.packing import fill_containers
from tickforge.llm.residue import find_residue
from tickforge.sources import table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return fill_containers(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_residue(table(spark, d, "documents"))


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that stay once those with residue are left out, per source."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    kept = docs.join(find_residue(docs), "doc_id", "left_anti")
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


ORACLE: dict[str, str] = {}

QUERIES = {f.__name__: f for f in (p8_ids, p9_containers, p10_found, p10_clean)}
