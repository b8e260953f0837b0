"""Helpers shared by the training-data operators: shared scratch tables, ids, text columns."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..sources import scratch

#: A word is a run of characters other than these.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends here and survives lost executors."""
    ship(df.sparkSession)
    return scratch.keep(df, name)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_names(columns: list[str], taken: list[str]) -> dict[str, str]:
    """The columns and the names they get beside new ones: their own, with underscores added while it is one of ``taken``."""
    new = {t.lower() for t in taken}
    used, names = new | {c.lower() for c in columns}, {}
    for c in columns:
        name = c
        while name.lower() in used and c.lower() in new:
            name += "_"
        used.add(name.lower())
        names[c] = name
    return names


def released() -> None:
    """Give memory that a worker needs no more back to the machine, since idle workers stay."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def sized(batches: Iterator[pd.DataFrame], by: list[str], least: int) -> Iterator[pd.DataFrame]:
    """Sorted batches put together to ``least`` rows or more, such that the rows of a key come in one."""
    held: list[pd.DataFrame] = []
    n = 0
    for pdf in batches:
        if not len(pdf):
            continue
        # all rows but those of the batch's last key, which may go on in the next one, are complete
        start = int((pdf[by] == pdf[by].iloc[-1]).all(axis=1).to_numpy().argmax())
        ended = start or (held and (held[-1][by].iloc[-1] != pdf[by].iloc[0]).any())
        if ended and n + start >= least:
            yield _whole([*held, pdf.iloc[:start]])
            held, n = [pdf.iloc[start:]], len(pdf) - start
        else:
            held.append(pdf)
            n += len(pdf)
    if n:
        yield _whole(held)


def _whole(parts: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
