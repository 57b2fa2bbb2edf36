"""Framed binary records as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.sources import schemas


def encode_rows(df: DataFrame, schema: dict, number: int, key: str = "symbol") -> DataFrame:
    """(key, value): each row as a frame; rows with nulls in required fields get the field's empty value."""
    empty = {"string": "", "double": 0.0, "long": 0, "int": 0, "boolean": False}
    kinds = {f["name"]: f["type"] for f in schema["fields"]}

    def value(name: str, v):
        kind = kinds[name]
        if isinstance(kind, dict):
            return [{k: x[k] if x[k] is not None else 0.0 for k in ("price", "size")} for x in (v if v is not None else [])]
        if v is None or v is pd.NA or (isinstance(v, float) and v != v and kind != "double"):
            return None if isinstance(kind, list) else empty[kind]
        return v

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
            yield pd.DataFrame({"key": pdf[key], "value": [schemas.encode(schema, number, {k: value(k, r.get(k)) for k in kinds}) for r in rows]})

    return df.mapInPandas(run, "key string, value binary")


def decode_frames(df: DataFrame, registry: schemas.Registry, reader: dict, ddl: str) -> DataFrame:
    """Rows of ``ddl`` plus ``error``: a frame that can't be read gives a row of nulls with the reason, and is counted there."""
    names = [f["name"] for f in reader["fields"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for frame in pdf["value"]:
                try:
                    row = schemas.decode(bytes(frame) if frame is not None else b"", registry, reader)
                    out.append((*(row[n] for n in names), None))
                except (schemas.SchemaError, UnicodeDecodeError) as e:
                    out.append((*[None] * len(names), str(e)))
            yield pd.DataFrame(out, columns=[*names, "error"])

    return df.select(F.col("value")).mapInPandas(run, f"{ddl}, error string")
