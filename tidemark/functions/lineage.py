"""Cutting lineage so that a lost executor does not recompute from changed input."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder the session names in spark.checkpoint.dir.

    Without that setting the frame is returned as it is.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            return df
        context.setCheckpointDir(folder)
    return df.checkpoint()


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a local session may go without that setting and gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


class Settled:
    """Successive states of a table that a run makes: each is written, and the one before it deleted unless it is to be kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.number = spark, work_folder(spark), 0

    def write(self, df: DataFrame, keep: bool = False) -> DataFrame:
        path = f"{self.root}/{self.number}"
        df.write.parquet(path)
        if self.number and not keep:
            self._delete(f"{self.root}/{self.number - 1}")
        self.number += 1
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
