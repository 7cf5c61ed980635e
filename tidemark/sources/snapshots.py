"""Stored days whose partitions are replaced together.

A commit writes the partitions (chain, month) that change into a folder of its own and then moves a
manifest into place: a short text with the folder of every partition. Readers follow the latest
manifest, so they see the whole commit or nothing of it, and older versions stay readable until they
are cleaned up. A run that ends before the move leaves files that no manifest names. A manifest has one
line for each chain and month, so its length follows the calendar. One writer per table at a time.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

PARTITIONS = ("chain", "month")
_KEY = ["chain", "date"]
Manifest = dict[tuple[str, str], str]  # (chain, month) -> folder below data/


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, pattern: str) -> list[str]:
    where, fs = _files(spark, pattern)
    return sorted(s.getPath().getName() for s in fs.globStatus(where) or [])


def _manifest_path(path: str, version: int) -> str:
    return f"{path}/manifests/v{version:012d}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the readable versions, oldest first."""
    return [int(n[1:]) for n in _names(spark, f"{path}/manifests/v*")]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """Partitions of a version (default: the latest) and their folders; empty before the first commit."""
    found = versions(spark, path)
    if version is None:
        if not found:
            return {}
        version = found[-1]
    if version not in found:
        raise ValueError(f"no version {version} in {path}")
    lines = spark.read.text(_manifest_path(path, version)).collect()
    return {(e["chain"], e["month"]): e["folder"] for e in (json.loads(r["value"]) for r in lines)}


def publish(spark: SparkSession, path: str, entries: Manifest) -> int:
    """Makes entries the next version, in one rename."""
    version = (versions(spark, path) or [0])[-1] + 1
    aside, fs = _files(spark, f"{path}/aside/{uuid.uuid4().hex}")
    text = "\n".join(json.dumps({"chain": c, "month": m, "folder": f}) for (c, m), f in sorted(entries.items()))
    out = fs.create(aside)
    out.write(bytearray(text.encode()))
    out.close()
    target, _ = _files(spark, _manifest_path(path, version))
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(aside, target):
        raise RuntimeError(f"version {version} of {path} was written by somebody else")
    return version


def write_parts(rows: DataFrame, path: str) -> Manifest:
    """Writes rows (chain, date, ...) by partition into a new folder that no reader knows yet."""
    spark, folder = rows.sparkSession, f"commit={uuid.uuid4().hex}"
    by_month = rows.withColumn("month", F.date_format("date", "yyyy-MM")).repartition(*PARTITIONS)
    by_month.write.partitionBy(*PARTITIONS).parquet(f"{path}/data/{folder}")
    where, fs = _files(spark, f"{path}/data/{folder}/chain=*/month=*")
    written = {}
    for status in fs.globStatus(where) or []:
        month, chain = status.getPath().getName(), status.getPath().getParent().getName()
        written[chain.removeprefix("chain="), month.removeprefix("month=")] = f"{folder}/{chain}/{month}"
    return written


def _read(spark: SparkSession, path: str, schema: StructType, entries: Manifest) -> DataFrame:
    names = schema.fieldNames()
    if not entries:
        return spark.createDataFrame([], schema)
    inner = [f for f in schema.fields if f.name not in PARTITIONS]
    full = StructType([*inner, *[StructField(p, StringType()) for p in PARTITIONS]])
    folders = [f"{path}/data/{f}" for f in sorted(set(entries.values()))]
    return spark.read.schema(full).option("basePath", f"{path}/data").parquet(*folders).select(*names)


def read_days(
    spark: SparkSession, path: str, schema: StructType, start: dt.date | None = None, end: dt.date | None = None,
    version: int | None = None,
) -> DataFrame:
    """Days of a version, from start to end; only folders of months in that range are listed."""
    low, high = f"{start:%Y-%m}" if start else "", f"{end:%Y-%m}" if end else "9999-99"
    df = _read(spark, path, schema, {k: f for k, f in manifest(spark, path, version).items() if low <= k[1] <= high})
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start))
    return df if end is None else df.where(F.col("date") <= F.lit(end))


def replace_days(days: DataFrame, path: str, since: dt.date | None = None) -> int:
    """Stores days, one row for each (chain, date): they replace stored days of the same key.

    With since, stored days from then on of the chains in days go as well, so a re-run leaves no day
    that it did not compute. Partitions without a change keep their folder. Returns the version.
    """
    spark, stored = days.sparkSession, manifest(days.sparkSession, path)
    month = F.date_format("date", "yyyy-MM").alias("month")
    touched = {(r["chain"], r["month"]) for r in days.select("chain", month).distinct().toLocalIterator()}
    if since is not None:
        chains = {c for c, _ in touched}
        touched |= {(c, m) for c, m in stored if c in chains and m >= f"{since:%Y-%m}"}
    before = _read(spark, path, days.schema, {k: f for k, f in stored.items() if k in touched})
    if since is not None:
        before = before.where(F.col("date") < F.lit(since))
    merged = before.join(days.select(*_KEY), _KEY, "left_anti").unionByName(days)
    entries = {k: f for k, f in stored.items() if k not in touched} | write_parts(merged, path)
    return publish(spark, path, entries)


def drop_before(spark: SparkSession, path: str, schema: StructType, cutoff: dt.date) -> int:
    """Retention to the day: whole months before the cutoff leave the manifest, the cutoff's own month is written without its older days, in one commit."""
    stored, own = manifest(spark, path), f"{cutoff:%Y-%m}"
    edge = {k: f for k, f in stored.items() if k[1] == own}
    kept = {k: f for k, f in stored.items() if k[1] > own}
    if edge:
        kept |= write_parts(_read(spark, path, schema, edge).where(F.col("date") >= F.lit(cutoff)), path)
    return publish(spark, path, kept)


def clean_up(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes versions before the last keep ones and all folders that no kept version names; returns these folders.

    Not beside a running commit: its folder has no manifest yet.
    """
    if keep < 1:
        raise ValueError("at least one version must stay")
    found = versions(spark, path)
    used = {f.split("/")[0] for v in found[-keep:] for f in manifest(spark, path, v).values()}
    for version in found[:-keep]:
        _delete(spark, [_manifest_path(path, version)])
    unused = [n for n in _names(spark, f"{path}/data/commit=*") if n not in used]
    _delete(spark, [f"{path}/data/{n}" for n in unused])
    return unused


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        where, fs = _files(spark, path)
        fs.delete(where, True)
