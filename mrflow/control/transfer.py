"""File transfers between the driver's disk and any file system that Hadoop knows."""

from __future__ import annotations

import gzip
import shutil
from pathlib import Path

from pyspark.sql import SparkSession

from ..plans.job import FileTransferJob, InvalidJob
from ..sources.scratch import file_system as _fs


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isFile() and s.getPath().getName()[0] not in "._")


def transfer(spark: SparkSession, job: FileTransferJob) -> list[str]:
    """Returns the names written or deleted. reload_files: overwrite what is there; delete_files: remove the source afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if job.transfer_type == "delete":
        fs, p = _fs(spark, job.output_dir)
        return [job.output_dir] if fs.delete(p, True) else []
    fs, target = _fs(spark, job.output_dir)
    done = []
    if job.transfer_type == "upload_auxiliary":
        fs.copyFromLocalFile(job.delete_files, True, path(job.input_file_name), path(f"{job.output_dir}/{job.auxiliary_data_name}.data"))
        return [f"{job.auxiliary_data_name}.data"]
    if job.transfer_type in ("upload", "upload_bulk"):
        fs.mkdirs(target)
        for f in sorted(p for p in Path(job.input_dir).iterdir() if p.is_file() and p.name[0] not in "._"):
            source = f
            if job.compress and f.suffix != ".gz":
                source = f.with_name(f".{f.name}.gz")
                with f.open("rb") as a, gzip.open(source, "wb") as b:
                    shutil.copyfileobj(a, b)
            name = source.name.lstrip(".") if source != f else f.name
            to = path(f"{job.output_dir}/{name}")
            if job.reload_files or not fs.exists(to):
                fs.copyFromLocalFile(False, True, path(f"file://{source.resolve()}"), to)
                done.append(name)
            if source != f:
                source.unlink()
            if job.delete_files:
                f.unlink()
        return done
    if job.transfer_type in ("download", "download_bulk"):
        Path(job.output_dir).mkdir(parents=True, exist_ok=True)
        source_fs, _ = _fs(spark, job.input_dir)
        for name in _names(spark, job.input_dir):
            to = Path(job.output_dir) / name
            if job.reload_files or not to.exists():
                source_fs.copyToLocalFile(job.delete_files, path(f"{job.input_dir}/{name}"), path(f"file://{to.resolve()}"), True)
                done.append(name)
        return done
    raise InvalidJob(f"unknown transfer {job.transfer_type!r}")
