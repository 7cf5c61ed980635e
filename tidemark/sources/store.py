"""Stored tables on partitioned parquet: schemas, keyed upserts, retention.

A table is partitioned by chain and month. An upsert rewrites only the partitions its new rows
fall in; dynamic partition overwrite stages the result and swaps it in when the job commits.
One writer per table at a time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType, DoubleType, LongType, StringType, StructField, StructType, TimestampType,
)

from tidemark.functions.values import number
from tidemark.operators.quality import broken_rules


def _schema(*fields: tuple) -> StructType:
    return StructType([StructField(n, t, nullable) for n, t, nullable in fields])


_SCORES = [(n, DoubleType(), False) for n in ("whale_index", "stress_index", "momentum_score")]

DAILY_SIGNALS = _schema(
    ("chain", StringType(), False), ("date", DateType(), False), ("risk_score", DoubleType(), False),
    ("regime", StringType(), False), ("risk_state", StringType(), False), *_SCORES,
    ("created_at", TimestampType(), True),
)
PERFORMANCE = _schema(
    ("chain", StringType(), False), ("model_version", StringType(), False), ("auc", DoubleType(), True),
    ("hitrate", DoubleType(), True), ("sharpe_ratio", DoubleType(), True), ("trained_at", TimestampType(), True),
)
ALERTS = _schema(
    ("id", LongType(), False), ("chain", StringType(), False), ("date", DateType(), False),
    ("alert_type", StringType(), False), ("message", StringType(), True), ("created_at", TimestampType(), True),
)
NORM_PARAMS = _schema(
    ("chain", StringType(), False), ("feature", StringType(), False),
    ("mean", DoubleType(), False), ("std", DoubleType(), False),
)

SCHEMAS = {"daily_signals": DAILY_SIGNALS, "performance_summary": PERFORMANCE, "alerts": ALERTS}
KEYS = {
    "daily_signals": ["chain", "date"],
    "performance_summary": ["chain", "model_version"],
    "alerts": ["id"],
}
_NEWEST = {"daily_signals": "created_at", "performance_summary": "trained_at", "alerts": "created_at"}


def latest_per_key(df: DataFrame, keys: Sequence[str], newest: str) -> DataFrame:
    """One row per key, the newest by a column; the remaining columns break ties.

    ``max_by`` keeps one row per key and task, so no key is ever sorted as a whole.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(newest).isNotNull(), F.col(newest), *[c for c in rest if c != newest])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], newest: str) -> DataFrame:
    """New rows replace stored rows of the same key; within the batch the newest row wins."""
    new = latest_per_key(new, keys, newest)
    kept = existing.join(new.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new.select(*existing.columns))


def insert_new(existing: DataFrame, new: DataFrame, keys: Sequence[str], newest: str) -> DataFrame:
    """Rows of keys not stored yet; a repeated run adds nothing."""
    fresh = latest_per_key(new, keys, newest).join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def alert_id(chain: str = "chain", date: str = "date", alert_type: str = "alert_type"):
    return F.xxhash64(F.col(chain), F.col(date), F.col(alert_type))


def with_alert_id(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("id", alert_id())


def split_signal(signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signal rows with nested alerts to the two tables they are stored in."""
    rows = signals.select(*DAILY_SIGNALS.fieldNames())
    alerts = signals.select("chain", "date", "created_at", F.explode("alerts").alias("a")).select(
        "chain", "date", F.col("a.alert_type").alias("alert_type"), F.col("a.message").alias("message"), "created_at"
    )
    return rows, with_alert_id(alerts).select(*ALERTS.fieldNames())


def _month(table: str):
    return F.date_format(F.col("trained_at" if table == "performance_summary" else "date"), "yyyy-MM")


def _partitions(table: str) -> list[str]:
    return ["chain"] if table == "performance_summary" else ["chain", "month"]


def _path(root: str, table: str) -> str:
    if table not in SCHEMAS:
        raise ValueError(f"unknown table {table!r}")
    return f"{root.rstrip('/')}/{table}"


def create_table(spark: SparkSession, root: str, table: str) -> None:
    """Creates an empty table; does nothing when it exists."""
    path = _path(root, table)
    try:
        _read_with_month(spark, root, table)
    except Exception as missing:  # noqa: BLE001 - AnalysisException of either client
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        empty = spark.createDataFrame([], SCHEMAS[table])
        empty.write.mode("ignore").parquet(path)


def create_tables(spark: SparkSession, root: str) -> None:
    for table in SCHEMAS:
        create_table(spark, root, table)


def _read_with_month(spark: SparkSession, root: str, table: str) -> DataFrame:
    schema = SCHEMAS[table]
    if "month" in _partitions(table):
        schema = StructType([*schema.fields, StructField("month", StringType(), True)])
    return spark.read.schema(schema).parquet(_path(root, table))


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    return _read_with_month(spark, root, table).select(*SCHEMAS[table].fieldNames())


def _write_partitions(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    (
        df.repartition(*partitions)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def accepted(table: str, new: DataFrame, as_of: dt.date | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of a batch that keep their table's rules, and the others."""
    broken = F.coalesce(broken_rules(table, as_of), F.lit(True))
    return new.where(~broken), new.where(broken)


def write_rows(spark: SparkSession, root: str, table: str, new: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Stores the valid rows: upsert by key, except alerts, which are only added once.

    Returns the rows that were refused because they break a rule of the table (``quality``); with
    ``as_of`` also signals of later days. Stored rows are read for the partitions of the new rows only (partition pruning at run time
    through the join), merged with them and written back.
    """
    partitions = _partitions(table)
    columns = [f.name for f in SCHEMAS[table].fields]
    new, refused = accepted(table, new.select(*columns), as_of)
    touched = new.withColumn("month", _month(table)).select(*partitions).distinct()
    existing = _read_with_month(spark, root, table).join(touched, partitions, "left_semi").select(*columns)
    merge = insert_new if table == "alerts" else upsert
    merged = merge(existing, new, KEYS[table], _NEWEST[table])
    if "month" in partitions:
        merged = merged.withColumn("month", _month(table))
    _write_partitions(merged, _path(root, table), partitions)
    return refused


def write_features(days: DataFrame, path: str) -> None:
    """Stores days of features: replaces days stored before, keeps the others, starts the table if need be.

    A day that a batch holds more than once is stored once (the row with the greatest values).
    """
    spark, keys = days.sparkSession, ["chain", "date"]
    days = latest_per_key(days.withColumn("_same", F.lit(0)), keys, "_same").drop("_same")
    days = days.withColumn("month", F.date_format("date", "yyyy-MM"))
    if not _exists(spark, path):
        _write_partitions(days, path, ["chain", "month"])
        return
    touched = days.select("chain", "month").distinct()
    fields = [f for f in days.schema.fields if f.name not in ("chain", "month")]
    schema = StructType([*fields, StructField("chain", StringType()), StructField("month", StringType())])
    stored = spark.read.schema(schema).parquet(path).join(touched, ["chain", "month"], "left_semi")
    kept = stored.join(days.select(*keys), keys, "left_anti")
    _write_partitions(kept.unionByName(days), path, ["chain", "month"])


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def drop_before(spark: SparkSession, path: str, cutoff: dt.date) -> list[str]:
    """Retention: drops the stored partitions of months that end before the cutoff; returns their names.

    Months are dropped as a whole, so days of the cutoff's own month stay.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path
    fs = folder(path).getFileSystem(spark._jsc.hadoopConfiguration())
    dropped = []
    for found in fs.globStatus(folder(f"{path.rstrip('/')}/chain=*/month=*")) or []:
        month = found.getPath().getName().removeprefix("month=")
        if month < cutoff.strftime("%Y-%m"):
            fs.delete(found.getPath(), True)
            dropped.append(f"{found.getPath().getParent().getName()}/month={month}")
    return sorted(dropped)


def load_features(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Stored daily aggregates; values that are no numbers read as missing."""
    df = spark.read.parquet(path)
    return df.select("chain", F.col("date").cast("date").alias("date"),
                     *[number(n).alias(n) if n in df.columns else F.lit(None).cast("double").alias(n) for n in names])


def keep_since(df: DataFrame, cutoff: dt.date) -> DataFrame:
    """Retention as a filter: what a clean-up keeps."""
    return df.where(F.col("date") >= F.lit(cutoff))


def last_rows(df: DataFrame, n: int) -> DataFrame:
    """Newest n days of each chain; a chain has one row per day, so the sort is by calendar."""
    if n < 1:
        raise ValueError("n must be at least 1")
    rank = F.row_number().over(Window.partitionBy("chain").orderBy(F.desc("date")))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")

