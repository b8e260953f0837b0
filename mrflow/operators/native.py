"""Keyed operators as columns that Catalyst sees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda t: t != "")


def explode_tokens(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """The words of a text as rows. The empty ones that splitting leaves go afterwards, which needs no second array."""
    return df.select(*keep, F.explode(F.split(F.lower(text_col), NOT_WORD)).alias("token")).filter("token <> ''")


def count_by(df: DataFrame, *keys: str, into: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(into))


def merge_sums(parts: Sequence[DataFrame], keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """f(A) and f(B) to f(A and B), for outputs that add up."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])


def runs(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """Runs of equal values in each key's order: run number (from 1), value, length."""
    w = Window.partitionBy(key).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("long")
    marked = df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "run", value).agg(F.count("*").alias("length"))


def sessions(df: DataFrame, key: str, time: Column, gap_us: int, order: Sequence[str]) -> DataFrame:
    """Sessions of a key, a new one after a pause longer than the gap: number (from 1), events, first and last microsecond."""
    w = Window.partitionBy(key).orderBy("__t", *order)
    new = F.coalesce((F.col("__t") - F.lag("__t").over(w) > gap_us).cast("long"), F.lit(1))
    marked = df.withColumn("__t", time).withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "session").agg(F.count("*").alias("n_events"), F.min("__t").alias("first_us"), F.max("__t").alias("last_us"))


def top_k(df: DataFrame, key: str, k: int, order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def lookup(df: DataFrame, aux: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Auxiliary data joined by key; Spark sends it to all executors if its size allows, else both sides are dealt by key."""
    return df.join(aux, on, how)
