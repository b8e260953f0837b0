"""Engine settings and the Spark settings they stand for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class EngineConfig:
    shuffle_partitions: int | None = None
    memory_per_executor: str | None = None
    broadcast_bytes: int = 10 << 20
    advisory_partition_bytes: int = 128 << 20

    def spark_conf(self) -> dict[str, str]:
        conf = {
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(self.advisory_partition_bytes),
            "spark.sql.autoBroadcastJoinThreshold": str(self.broadcast_bytes),
            "spark.sql.session.timeZone": "UTC",
        }
        if self.shuffle_partitions:
            conf["spark.sql.shuffle.partitions"] = str(self.shuffle_partitions)
        if self.memory_per_executor:
            conf["spark.executor.memory"] = self.memory_per_executor
        return conf

    def session(self, name: str = "mrflow", master: str | None = None, more: dict[str, str] | None = None) -> SparkSession:
        builder = SparkSession.builder.appName(name).config(map=self.spark_conf() | (more or {}))
        return (builder.master(master) if master else builder).getOrCreate()
