"""Raw block and transaction tables in the hive layout ``{root}/{prefix}/{table}/date=D/``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark import spec
from tidemark.functions.values import check_chain, check_date
from tidemark.operators.features import KEY
from tidemark.sources.worklist import spine_between

RAW_TABLES = ("blocks", "transactions")
_SALTS = 1024


def raw_path(root: str, chain: str, table: str) -> str:
    if table not in RAW_TABLES:
        raise ValueError(f"unknown raw table {table!r}")
    return f"{root.rstrip('/')}/{spec.RAW_PREFIX[check_chain(chain)]}/{table}"


def scan_raw(
    spark: SparkSession,
    root: str,
    chain: str,
    table: str,
    start: dt.date | None = None,
    end: dt.date | None = None,
    schema: StructType | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Raw rows of one chain with ``chain`` and ``date`` columns, pruned to [start, end].

    Without a schema the columns of all files of the range are united by name, which reads their
    footers; give the schema for large ranges. ``limit`` is for one day: any n rows, 0 the schema only;
    ``limit_per_day`` does the same for many days.
    """
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    path = raw_path(root, chain, table)
    if schema is not None:
        df = spark.read.schema(schema).parquet(path)
    else:
        days = _days_between(spark, path, start, end)
        df = spark.read.option("mergeSchema", True).option("basePath", path).parquet(*(days or [path]))
    df = df.withColumn("date", F.col("date").cast("date"))
    if start is not None:
        df = df.where(F.col("date") >= F.lit(check_date(start, "start")))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(check_date(end, "end")))
    if limit is not None:
        df = df.limit(limit)
    return df.withColumn("chain", F.lit(check_chain(chain)))


def _days_between(spark: SparkSession, path: str, start: dt.date | None, end: dt.date | None) -> list[str]:
    """Folders of the days in the range, so that no other footer is opened."""
    if start is None and end is None:
        return []
    folder = spark._jvm.org.apache.hadoop.fs.Path
    fs = folder(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(s.getPath().getName().removeprefix("date="), s.getPath().toString()) for s in fs.globStatus(folder(f"{path}/date=*")) or []]
    low, high = str(start or "0000-00-00"), str(end or "9999-99-99")
    return [where for day, where in sorted(found) if low <= day <= high]


def limit_per_day(df: DataFrame, n: int | None, order_by: list[str]) -> DataFrame:
    """First n rows of each (chain, date); None keeps all, 0 keeps the schema only.

    Order by a unique key for a repeatable choice. Up to the session's group limit (1,000 rows by
    default) Spark cuts every day to n rows in each map task, before the exchange. For larger n
    a day is cut in each of 1024 hash groups first, so no single task sorts a whole large day.
    """
    if n is None:
        return df
    if n < 0:
        raise ValueError("limit must not be negative")
    if n == 0:
        return df.limit(0)
    mapped = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > mapped:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order_by), F.lit(_SALTS)))
        df = _first_rows(salted, n, [*KEY, "_salt"], order_by).drop("_salt")
    return _first_rows(df, n, KEY, order_by)


def _first_rows(df: DataFrame, n: int, keys: list[str], order_by: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")


def union_by_name(*parts: DataFrame) -> DataFrame:
    """Union of frames with different columns; what a part lacks is NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def available_days(blocks: DataFrame) -> DataFrame:
    """Days with at least one block, over the whole table."""
    return blocks.select(*KEY).distinct()


def has_data(blocks: DataFrame, chain: str, date: dt.date) -> bool:
    """Whether one day has any block; reads until the first row."""
    day = (F.col("chain") == check_chain(chain)) & (F.col("date") == F.lit(check_date(date, "date")))
    return not blocks.where(day).limit(1).isEmpty()


def raw_readiness(spine: DataFrame | None, blocks: DataFrame, tx: DataFrame) -> DataFrame:
    """Row counts of both raw tables per expected day; one missing table is still usable.

    Without a spine the days expected are those between a chain's first and last in either table.
    """

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*KEY).agg(F.count(F.lit(1)).alias(name))

    if spine is None:
        n_blocks = counts(blocks, "n_blocks").withColumn("n_tx", F.lit(0).cast("long"))
        n_tx = counts(tx, "n_tx").withColumn("n_blocks", F.lit(0).cast("long"))
        both = n_blocks.unionByName(n_tx).groupBy(*KEY).agg(F.sum("n_blocks").alias("n_blocks"), F.sum("n_tx").alias("n_tx"))
        out = spine_between(both).join(both, KEY, "left")
    else:
        out = spine.join(counts(blocks, "n_blocks"), KEY, "left").join(counts(tx, "n_tx"), KEY, "left")
    out = out.fillna(0, ["n_blocks", "n_tx"])
    both = (F.col("n_blocks") == 0) & (F.col("n_tx") == 0)
    one = (F.col("n_blocks") == 0) | (F.col("n_tx") == 0)
    status = F.when(both, F.lit("missing")).when(one, F.lit("partial")).otherwise(F.lit("complete"))
    return out.withColumn("raw_status", status)
