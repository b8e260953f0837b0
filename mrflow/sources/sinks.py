"""Outputs: JSON lines or Parquet, rolling parts, gzip, overwrite or append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


FORMATS = ("json", "items", "values", "lines", "parquet")


def as_json(column: str) -> Column:
    """A column's value alone as JSON, null included."""
    c = F.col(f"`{column}`")
    return F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))


def write(df: DataFrame, path: str, fmt: str = "json", compress: bool = False, max_records_per_file: int | None = None, append: bool = False) -> None:
    """fmt: json (a row is an object), items (a row is an array, as a keyed item is), values (one column of any type), lines (one column of text as it is) or parquet."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    if fmt == "items":
        df = df.select(F.concat(F.lit("["), F.concat_ws(",", *[as_json(c) for c in df.columns]), F.lit("]")).alias("value"))
    elif fmt == "values":
        (only,) = df.columns
        df = df.select(as_json(only).alias("value"))
    elif fmt == "lines":
        (only,) = df.columns
        df = df.select(F.col(f"`{only}`").cast("string").alias("value"))
    out = df.write.mode("append" if append else "overwrite")
    if max_records_per_file:
        out = out.option("maxRecordsPerFile", max_records_per_file)
    if compress and fmt != "parquet":
        out = out.option("compression", "gzip")
    {"json": out.json, "parquet": out.parquet}.get(fmt, out.text)(path)
