"""Inputs: text, JSON lines and Parquet of several folders; listing, deterministic downsampling, bad lines."""

from __future__ import annotations

import fcntl
import hashlib
import time
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import file_system

BAD_LINE = "_corrupt_record"
#: Outputs that were appended lie in folders of this name in the output folder, as partitions.
RUN = "mrflow_run"
#: How the names of files end that some program is still writing.
UNFINISHED = ("._COPYING_", ".tmp", ".part", ".inprogress")


def _folders(inputs: Sequence[str]) -> list[str]:
    if isinstance(inputs, str):
        raise TypeError("inputs is a list of folders; a single string would be read letter by letter")
    return list(inputs)


def _locked(path: str) -> bool:
    """Whether another program holds a lock on a file of the driver's own disk."""
    try:
        with Path(path).open("rb") as f:
            fcntl.flock(f, fcntl.LOCK_SH | fcntl.LOCK_NB)
            fcntl.flock(f, fcntl.LOCK_UN)
    except BlockingIOError:
        return True
    except OSError:
        return False  # no file here, or a store without locks
    return False


def list_files(spark: SparkSession, inputs: Sequence[str], settle: float = 0.0) -> list[tuple[str, str]]:
    """(folder, file name) of the files right inside the folders, or in those that a job's runs appended there; any store Spark can read.

    Left out are hidden files (. or _ first) and those still being written, which a later listing has: names with an ending
    of UNFINISHED, files changed less than ``settle`` seconds ago, and, on a local disk, files that are locked.
    """
    found, now = [], time.time()
    for folder in _folders(inputs):
        fs, path = file_system(spark, folder)
        local = fs.getUri().getScheme() == "file"
        entries = [(s.getPath().getName(), s) for s in fs.listStatus(path)]
        for run, status in [e for e in entries if not e[1].isFile() and e[0].startswith(f"{RUN}=")]:
            entries += [(f"{run}/{s.getPath().getName()}", s) for s in fs.listStatus(status.getPath())]
        for name, status in entries:
            if not status.isFile() or name.rpartition("/")[2][0] in "._" or name.endswith(UNFINISHED):
                continue
            if settle and now - status.getModificationTime() / 1000 < settle:
                continue
            if local and _locked(status.getPath().toUri().getPath()):
                continue
            found.append((folder.rstrip("/"), name))
    return sorted(found)


def draw(path: str) -> float:
    """A number in [0, 1) fixed by the file's path."""
    return int.from_bytes(hashlib.md5(path.encode()).digest()[:7], "big") / (1 << 56)


def sampled(files: list[tuple[str, str]], ratio: float) -> list[tuple[str, str]]:
    """Whole files, each kept if its draw is at most the ratio: a smaller ratio's sample lies within a larger one's."""
    if not 0 <= ratio <= 1:
        raise ValueError("a ratio lies between 0 and 1")
    return [f for f in files if ratio == 1 or draw("/".join(f)) <= ratio]


def row_draw(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def sample_rows(df: DataFrame, key: str, ratio: float) -> DataFrame:
    """Rows whose key draws at most the ratio; null keys go."""
    return df.filter(row_draw(F.col(key)) <= ratio)


def paths(spark: SparkSession, inputs: Sequence[str], downsample: float = 1.0, seen: set[str] | None = None, settle: float = 0.0) -> list[str]:
    for p in _folders(inputs):
        if p.rstrip("/").rpartition("/")[2].startswith("_"):
            raise ValueError(f"Spark would silently skip the hidden folder {p}")
    files = sampled(list_files(spark, inputs, settle), downsample)
    return [f"{d}/{n}" for d, n in files if not seen or f"{d}/{n}" not in seen]


def read_text(spark: SparkSession, inputs: Sequence[str], downsample: float = 1.0, seen: set[str] | None = None, settle: float = 0.0) -> DataFrame:
    """One row per line (value, without its line end); .gz files are read as such, and may lie beside plain ones."""
    files = paths(spark, inputs, downsample, seen, settle)
    return spark.read.text(files) if files else spark.createDataFrame([], "value string")


def read_json_lines(spark: SparkSession, inputs: Sequence[str], schema: StructType | str, keep_bad: bool = False, **options) -> DataFrame:
    """Items as JSON lines. A bad line stops the job, or is kept in the column _corrupt_record."""
    files = paths(spark, inputs, **options)
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if keep_bad:
        wanted = StructType([*wanted.fields]).add(BAD_LINE, "string")
    if not files:
        return spark.createDataFrame([], wanted)
    return spark.read.schema(wanted).option("mode", "PERMISSIVE" if keep_bad else "FAILFAST").json(files)


def read_tables(spark: SparkSession, inputs: Sequence[str]) -> DataFrame:
    return spark.read.parquet(*_folders(inputs))
