"""Incremental runs: files seen before are left out, and outputs that add up are merged.

Two ways: a ledger of files for any job, and a Structured Streaming file source whose checkpoint is the state, run with
availableNow. The ledger is written after the output. The output of a run that appends goes to a folder named by a hash of
its files, so a run that is repeated because it broke off between the two replaces what it wrote: nothing is lost, nothing counts twice.
"""

from __future__ import annotations

import functools
import hashlib
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..functions import registry
from ..operators import native, opaque
from ..plans.job import InvalidJob, MapReduceJob, compile_job
from ..sources import readers, scratch, sinks

LEDGER = "path string, ts double, job string"


def _ledger(job: MapReduceJob) -> str:
    return f"{job.output_dir.rstrip('/')}.ledger"


def has_ledger(spark: SparkSession, job: MapReduceJob) -> bool:
    return scratch.exists(spark, _ledger(job))


def read_ledger(spark: SparkSession, job: MapReduceJob) -> DataFrame:
    return spark.read.schema(LEDGER).json(_ledger(job)) if has_ledger(spark, job) else spark.createDataFrame([], LEDGER)


def reset(spark: SparkSession, job: MapReduceJob) -> None:
    scratch.delete(spark, _ledger(job))


def run_delta(spark: SparkSession, job: MapReduceJob) -> list[str]:
    """Run over files not seen; afterwards they are. A run without hold_state forgets the state and reads all files. Identity is the path."""
    if not job.hold_state:
        reset(spark, job)
    files = readers.paths(spark, job.inputs, job.downsample, settle=job.settle)
    if files and has_ledger(spark, job):  # only what is listed now comes back, however long the ledger
        listed = spark.createDataFrame([(f,) for f in files], "path string")
        seen = {r["path"] for r in read_ledger(spark, job).select("path").join(listed, "path", "left_semi").distinct().collect()}
        files = [f for f in files if f not in seen]
    if files:
        out = compile_job(spark, job, spark.read.text(files))
        name = hashlib.md5("\n".join(sorted(files)).encode()).hexdigest()
        to = job.output_dir if job.delete_job_data else f"{job.output_dir.rstrip('/')}/{readers.RUN}={name}"
        sinks.write(out, to, job.output_format, job.compress, job.max_records_per_file)
    elif job.delete_job_data:
        sinks.write(compile_job(spark, job, spark.createDataFrame([], "value string")), job.output_dir, job.output_format)
    if job.hold_state and files:
        now = time.time()
        spark.createDataFrame([(f, now, job.job_name) for f in files], LEDGER).coalesce(1).write.mode("append").json(_ledger(job))
    return files


def merged_output(spark: SparkSession, job: MapReduceJob) -> DataFrame:
    """The appended outputs of all runs as one: a key's outputs are merged by the reducer's ``merge``, first inside each task; Spark adds up what adds up."""
    f = registry.find("reduce", job.reduce_function_name, job.project_name)
    if f.merge is None or f.schema is None:
        raise InvalidJob(f"reduce function {f.name} does not say how its outputs merge, or lacks a schema")
    names = StructType.fromDDL(f.schema).names
    if job.output_format not in ("json", "parquet"):
        raise InvalidJob("outputs merge if their rows have names: json or parquet")
    read = spark.read.schema(f.schema).option("recursiveFileLookup", True)
    parts = getattr(read, job.output_format)(job.output_dir) if scratch.exists(spark, job.output_dir) else spark.createDataFrame([], f.schema)
    key, merge = names[:1], f.merge
    if opaque.adds(parts.schema, key, merge):
        return opaque.sum_up(parts, key)

    def fold(group, aux):
        yield functools.reduce(merge, group)

    return opaque.reduce_groups(opaque.combine(parts, key, merge), key, fold, f.schema, order_by=[])


def token_counts_so_far(spark: SparkSession, folder: str, checkpoint: str, parts: str) -> DataFrame:
    """Count tokens of the files that came since the last call, append the partial counts, and merge all partial counts.

    A batch's counts go to a folder of its own, overwritten if the batch is repeated, so nothing counts twice.
    """

    def save(batch: DataFrame, number: int) -> None:
        native.count_by(native.explode_tokens(batch, "value"), "token").write.mode("overwrite").parquet(f"{parts}/batch={number}")

    query = spark.readStream.text(folder).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if not scratch.exists(spark, parts):
        return spark.createDataFrame([], "token string, n long")
    return native.merge_sums([spark.read.parquet(parts).select("token", "n")], ["token"], ["n"])
