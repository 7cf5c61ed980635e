"""From daily features to a training matrix: labels, returns, cleaning, splits.

Windows here run over one chain's days in date order. There is one row per chain and day, so
such a group grows with the calendar only, not with the number of transactions.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import spec
from tidemark.functions.ranks import exact_quantile
from tidemark.functions.values import finite_or_null



def drawdown_label(
    prices: DataFrame, drawdown_pct: float = spec.TARGET_DRAWDOWN_PCT, window_days: int = spec.TARGET_WINDOW_DAYS
) -> DataFrame:
    """1 when the close falls by the given share within the next rows, 0 when not.

    NULL for the last rows of a chain, whose window is not complete.
    """
    series = Window.partitionBy("chain").orderBy("date")
    ahead = series.rowsBetween(1, window_days)
    lowest, seen = F.min("close").over(ahead), F.count(F.lit(1)).over(ahead)
    hit = lowest <= F.col("close") * F.lit(1.0 - drawdown_pct / 100.0)
    return prices.select("chain", "date", "close", F.when(seen == window_days, hit.cast("int")).alias("target"))


def daily_returns(prices: DataFrame) -> DataFrame:
    previous = F.lag("close").over(Window.partitionBy("chain").orderBy("date"))
    return prices.select("chain", "date", (F.try_divide(F.col("close"), previous) - F.lit(1.0)).alias("ret"))


def rolling_netflow(days: DataFrame, column: str = "exchange_netflow_7d", window_days: int = 7) -> DataFrame:
    """Netflow over the last calendar days; a day without a row counts as a gap, not as a row."""
    window = (
        Window.partitionBy("chain").orderBy(F.unix_date("date")).rangeBetween(-(window_days - 1), Window.currentRow)
    )
    return days.select("chain", "date", F.sum(finite_or_null(column)).over(window).alias("netflow_7d"))


def training_set(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Daily features joined with their label; days without a known label are left out."""
    return features.join(labels.select("chain", "date", "target"), ["chain", "date"]).where(
        F.col("target").isNotNull()
    )


def require_training_columns(data: DataFrame) -> DataFrame:
    """Stored history must hold date and target and may not be empty."""
    missing = {"date", "target"} - set(data.columns)
    if missing:
        raise ValueError(f"training data lacks {sorted(missing)}")
    if data.isEmpty():
        raise ValueError("training data is empty")
    return data


def clean_training_rows(df: DataFrame, names: Sequence[str], max_share: float = spec.MAX_DROPPED_ROW_SHARE) -> DataFrame:
    """Per chain: drop rows with missing values if they are few, else fill in the median.

    The whole row goes, label included. Infinite values count as missing.
    """
    names = list(names)
    df = df.withColumns({n: finite_or_null(n) for n in names})
    incomplete = reduce(Column.__or__, [F.col(n).isNull() for n in names])
    shares = df.groupBy("chain").agg(
        (F.count_if(incomplete) / F.count(F.lit(1))).alias("_share")
    )
    long = df.select(
        "chain", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("v")) for n in names])).alias("e")
    ).select("chain", "e.feature", "e.v")
    medians = (
        exact_quantile(long, ["chain", "feature"], F.col("v"), "median")
        .groupBy("chain")
        .agg(F.map_from_entries(F.collect_list(F.struct("feature", "median"))).alias("_medians"))
    )
    fill = F.col("_share") > F.lit(max_share)
    return (
        df.join(shares, "chain")
        .join(medians, "chain", "left")
        .where(fill | ~incomplete)
        .withColumns({n: F.when(fill, F.coalesce(F.col(n), F.col("_medians")[n])).otherwise(F.col(n)) for n in names})
        .select(*df.columns)
    )


def impute(df: DataFrame, medians: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fills missing values with medians given as (chain, feature, median)."""
    maps = medians.groupBy("chain").agg(F.map_from_entries(F.collect_list(F.struct("feature", "median"))).alias("_m"))
    filled = {n: F.coalesce(finite_or_null(n), F.col("_m")[n], F.lit(0.0)) for n in names}
    return df.join(maps, "chain", "left").withColumns(filled).drop("_m")


def feature_medians(df: DataFrame, names: Sequence[str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(n).alias("feature"), finite_or_null(n).alias("v")) for n in names])
    long = df.select("chain", F.explode(entries).alias("e")).select("chain", "e.feature", "e.v")
    return exact_quantile(long, ["chain", "feature"], F.col("v"), "median")


@dataclass(frozen=True)
class SplitDates:
    """Inclusive ranges; they may overlap, then a row is on both sides."""

    train_start: dt.date
    train_end: dt.date
    val_start: dt.date
    val_end: dt.date


def train_val_split(df: DataFrame, dates: SplitDates, end_date: dt.date | None = None) -> DataFrame:
    """Adds ``split`` (train or validation); rows of neither range are left out."""
    val_end = min(dates.val_end, end_date) if end_date is not None else dates.val_end
    sides = F.array(
        F.when(F.col("date").between(F.lit(dates.train_start), F.lit(dates.train_end)), F.lit("train")),
        F.when(F.col("date").between(F.lit(dates.val_start), F.lit(val_end)), F.lit("validation")),
    )
    return df.withColumn("split", F.explode(F.array_compact(sides)))


def require_both_sides(split: DataFrame) -> None:
    sides = {r["split"] for r in split.select("split").distinct().limit(2).collect()}
    if sides != {"train", "validation"}:
        raise ValueError("train and validation sets must not be empty")
