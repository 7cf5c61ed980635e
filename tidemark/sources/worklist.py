"""The spine: every (chain, date) a run is expected to cover."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import spec
from tidemark.functions.values import check_chain, check_date
from tidemark.operators.features import KEY

_DAY = "interval 1 day"


def date_range(
    as_of: dt.date, date: dt.date | None = None, start: dt.date | None = None, end: dt.date | None = None
) -> tuple[dt.date, dt.date]:
    """Inclusive range of a run: one date, or start..end; the default is yesterday."""
    yesterday = check_date(as_of, "as_of") - dt.timedelta(days=1)
    if date is not None and (start is not None or end is not None):
        raise ValueError("give either date or start/end")
    if start is None and end is not None:
        raise ValueError("end needs start")
    first = date or start or yesterday
    last = date or end or yesterday
    check_date(first, "start"), check_date(last, "end")
    if first > last:
        raise ValueError(f"start {first} is after end {last}")
    if last > yesterday:
        raise ValueError(f"{last} is later than yesterday ({yesterday})")
    return first, last


def spine(spark: SparkSession, start: dt.date, end: dt.date, chains: Sequence[str] = spec.CHAINS) -> DataFrame:
    names = F.array(*[F.lit(check_chain(c, chains)) for c in chains])
    days = F.sequence(F.lit(start), F.lit(end), F.expr(_DAY))
    return (
        spark.range(1)
        .select(F.explode(days).alias("date"))
        .select(F.explode(names).alias("chain"), "date")
    )


def spine_between(bounds: DataFrame) -> DataFrame:
    """All calendar days between the first and last day of each chain in ``bounds``."""
    limits = bounds.groupBy("chain").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    return limits.select("chain", F.explode(F.sequence("_a", "_b", F.expr(_DAY))).alias("date"))


def present_days(spine: DataFrame, raw: DataFrame) -> DataFrame:
    return spine.join(raw.select(*KEY), KEY, "left_semi")


def missing_days(spine: DataFrame, raw: DataFrame) -> DataFrame:
    return spine.join(raw.select(*KEY), KEY, "left_anti")


def with_placeholders(
    spine: DataFrame, features: DataFrame, prices: DataFrame, raw_days: DataFrame | None = None
) -> DataFrame:
    """Every expected day with its features, or an invalid placeholder row and its reason.

    Checked in the order of a run: raw data, then price, then aggregate. Features computed from
    the raw tables have a row for every day with raw data; give ``raw_days`` when they were
    stored by an earlier run and days may be absent for other reasons.
    """
    out = spine.join(features.withColumn("_agg", F.lit(True)), KEY, "left").join(
        prices.groupBy(*KEY).agg(F.first("close", ignorenulls=True).alias("close")), KEY, "left"
    )
    has_raw = F.col("_agg").isNotNull()
    if raw_days is not None:
        out = out.join(raw_days.select(*KEY).distinct().withColumn("_raw", F.lit(True)), KEY, "left")
        has_raw = F.col("_raw").isNotNull()
    reason = (
        F.when(~has_raw, F.lit("no_raw_data"))
        .when(F.col("close").isNull(), F.lit("no_price"))
        .when(F.col("_agg").isNull(), F.lit("no_aggregate"))
    )
    names = [c for c in features.columns if c not in KEY]
    values = [F.when(F.col("invalid_reason").isNull(), F.col(n)).alias(n) for n in names]
    return out.withColumn("invalid_reason", reason).select(
        *KEY, *values, "close", F.col("invalid_reason").isNull().alias("is_valid"), "invalid_reason"
    )
