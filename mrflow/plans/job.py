"""Jobs: mapreduce, script and file transfer, checked when made; a mapreduce job compiles to one lazy DataFrame."""

from __future__ import annotations

import json
import subprocess
import sys
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..functions import registry
from ..functions.shipping import ship
from ..operators import opaque
from ..sources import readers, scratch, sinks


class InvalidJob(ValueError):
    """A job lacks a field, or has a wrong one."""


@dataclass
class Job:
    job_name: str | None = None
    job_priority: int | None = None
    group_name: str | None = None
    job_submitter: str | None = None
    run_once: bool = False
    force_run: bool = False
    #: Of subclasses: fields that a job can't do without.
    _needed = ("job_name", "job_priority")
    kind = "job"

    def __post_init__(self) -> None:
        missing = [f for f in self._needed if getattr(self, f) in (None, "", [])]
        if missing:
            raise InvalidJob(f"{self.kind} job {self.job_name!r} lacks {', '.join(missing)}")

    def as_dict(self) -> dict[str, Any]:
        return {"job_type": self.kind} | asdict(self)


@dataclass
class MapReduceJob(Job):
    inputs: Sequence[str] | None = None
    map_function_name: str | None = None
    reduce_function_name: str | None = None
    project_name: str | None = None
    output_dir: str | None = None
    aux_map: str | None = None
    aux_reduce: str | None = None
    aux_dir: str | None = None
    hold_state: bool = False
    downsample: float = 1.0
    #: Files changed in the last so many seconds wait for the next run.
    settle: float = 0.0
    #: json: a row is an object; items: a row is an array, its key first, as other jobs' map functions read them; values; parquet.
    output_format: str = "json"
    max_records_per_file: int | None = None
    streaming_group: bool = False
    compress: bool = False
    delete_job_data: bool = True
    shuffle_partitions: int | None = None
    _needed = ("job_name", "job_priority", "inputs", "map_function_name", "reduce_function_name")
    kind = "mapreduce"

    def __post_init__(self) -> None:
        super().__post_init__()
        if isinstance(self.inputs, str):
            raise InvalidJob("inputs is a list of folders")
        if not 0 <= self.downsample <= 1:
            raise InvalidJob("downsample lies between 0 and 1")
        if self.output_format not in sinks.FORMATS:
            raise InvalidJob(f"unknown output format {self.output_format!r}")


@dataclass
class ScriptJob(Job):
    script_location: str | None = None
    script_arguments: Sequence[str] = ()
    _needed = ("job_name", "job_priority", "script_location")
    kind = "script"


TRANSFERS = ("upload", "upload_bulk", "download", "download_bulk", "upload_auxiliary", "delete")


@dataclass
class FileTransferJob(Job):
    transfer_type: str | None = None
    input_dir: str | None = None
    output_dir: str | None = None
    input_file_name: str | None = None
    auxiliary_data_name: str | None = None
    reload_files: bool = True
    delete_files: bool = False
    compress: bool = False
    _needed = ("job_name", "job_priority", "transfer_type")
    kind = "file_transfer"

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.transfer_type not in TRANSFERS:
            raise InvalidJob(f"unknown transfer {self.transfer_type!r}")
        needed = {"delete": ["output_dir"], "upload_auxiliary": ["input_file_name", "auxiliary_data_name", "output_dir"]}.get(self.transfer_type, ["input_dir", "output_dir"])
        if missing := [n for n in needed if not getattr(self, n)]:
            raise InvalidJob(f"{self.transfer_type} needs {', '.join(missing)}")


KINDS = {c.kind: c for c in (MapReduceJob, ScriptJob, FileTransferJob)}


def from_dict(d: dict[str, Any]) -> Job:
    kind = KINDS.get(d.get("job_type"))
    if kind is None:
        raise InvalidJob(f"unknown job type {d.get('job_type')!r}")
    known = {f.name for f in fields(kind)}
    if extra := set(d) - known - {"job_type"}:
        raise InvalidJob(f"unknown fields {sorted(extra)}")
    return kind(**{k: v for k, v in d.items() if k in known})


def auxiliary(spark: SparkSession, folder: str | None, name: str | None) -> Any:
    """One JSON document of any store that Spark can read, or None without a name. Small by contract: every executor gets it."""
    if not name:
        return None
    path = f"{folder}/{name}.data"
    if not scratch.exists(spark, path):
        raise FileNotFoundError(path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _function(spark: SparkSession, kind: str, name: str, project: str | None) -> registry.Function:
    f = registry.find(kind, name, project)
    if project:
        ship(spark, project)
    return f


def mapped(df: DataFrame, job: MapReduceJob) -> DataFrame:
    f = _function(df.sparkSession, "map", job.map_function_name, job.project_name)
    aux = auxiliary(df.sparkSession, job.aux_dir, job.aux_map)
    if f.native:
        return f.call(df, aux)
    if f.counts:
        return opaque.count_keys(df, f.call, f.schema, aux)
    return opaque.flat_map(df, f.call, f.schema, aux, StructType.fromDDL(f.schema).names[:1], f.merge)


def reduced(items: DataFrame, job: MapReduceJob) -> DataFrame:
    """The first column is the key. A native reducer may aggregate partially; an opaque one sees its items in order."""
    f = _function(items.sparkSession, "reduce", job.reduce_function_name, job.project_name)
    aux = auxiliary(items.sparkSession, job.aux_dir, job.aux_reduce)
    if f.native:
        return f.call(items, aux)
    call = f.call if job.streaming_group else lambda group, a, call=f.call: call(list(group), a)
    merge = registry.find("map", job.map_function_name, job.project_name).merge
    return opaque.reduce_groups(items, items.columns[:1], call, f.schema, aux, f.order_by or None, job.shuffle_partitions, merge)


def compile_job(spark: SparkSession, job: MapReduceJob, source: DataFrame | None = None, seen: set[str] | None = None) -> DataFrame:
    lines = source if source is not None else readers.read_text(spark, job.inputs, job.downsample, seen, job.settle)
    return reduced(mapped(lines, job), job)


def run_mapreduce(spark: SparkSession, job: MapReduceJob) -> None:
    from ..streaming import incremental

    if not job.output_dir:
        raise InvalidJob("a job that is run needs output_dir")
    if job.hold_state or incremental.has_ledger(spark, job):
        incremental.run_delta(spark, job)
        return
    to = job.output_dir if job.delete_job_data else f"{job.output_dir.rstrip('/')}/{readers.RUN}={uuid.uuid4().hex}"
    sinks.write(compile_job(spark, job), to, job.output_format, job.compress, job.max_records_per_file)


def run_script(job: ScriptJob) -> None:
    subprocess.run([sys.executable, job.script_location, *map(str, job.script_arguments)], check=True, capture_output=True, text=True)
