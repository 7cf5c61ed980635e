"""Shared helpers: tables, intermediate results in the shared folder, words, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null doc_id counts as the largest one.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Only a local session may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Within it, plans that start hand fewer rows at a time to Python: for rows that hold whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more: what was made of them has been written itself."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """At the end of a task: hands memory that its Python worker holds but does not use back to the system.

    Workers wait for the next task, and what they keep is missing where the heap of the JVM grows.
    """
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a system library without that call


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Moves a folder; False if the target was there already."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(target).getParent())
    return not fs.exists(path(target)) and fs.rename(path(source), path(target))


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the frame's size, used to choose a number of buckets and nothing else."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 1 << 34


def bucket_count(df: DataFrame, mb: int = 16, least: int = 24) -> int:
    """Buckets that hold the keys of about so many MB of stored text each."""
    return max(least, input_bytes(df) // (mb << 20) + 1)


def doc_key(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """What identifies a document's content: its id (null: the largest) and a hash of its text."""
    return (
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("_did"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_th"),
    )


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) for every node: the smallest node that links reach, itself included.

    nodes: column node (long); edges: columns a, b (long), in any direction. Nodes without edges
    stay out of the rounds. Each round merges every node into its smallest neighbour, and that one's
    smallest, and goes on with the edges between what is left; a star is done after one round, a
    chain after a number that grows with the logarithm of its length.
    """
    left = written(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a <> b").distinct()
    )
    labels = None
    while not left.isEmpty():
        least = left.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
        further = least.select(F.col("node").alias("to"), F.col("label").alias("further"))
        merged = written(least.join(further, F.col("label") == F.col("to")).select("node", F.col("further").alias("label")))
        new = merged.select(F.col("node").alias("was"), F.col("label").alias("now"))
        before, done = labels, left
        if labels is None:
            labels = written(merged)
        else:
            labels = written(labels.join(new, F.col("label") == F.col("was"), "left").select("node", F.coalesce("now", "label").alias("label")))
            forget(before)
        ends = done.join(new, F.col("a") == F.col("was")).select(F.col("now").alias("a"), "b")
        ends = ends.join(new, F.col("b") == F.col("was")).select("a", F.col("now").alias("b"))
        left = written(ends.where("a <> b").distinct())
        forget(done, merged)
    forget(left)
    if labels is None:
        return written(nodes.select("node", F.col("node").alias("component")))
    out = written(nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("component")))
    forget(labels)
    return out


QueryFn = Callable[[SparkSession, str], DataFrame]
