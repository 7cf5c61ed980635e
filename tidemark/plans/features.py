"""Daily features of all chains and days as one plan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DoubleType, StringType, StructField, StructType

from tidemark import spec
from tidemark.functions.lineage import Settled
from tidemark.functions.values import check_date_range
from tidemark.operators.btc import BtcFeatures
from tidemark.operators.eth import EthFeatures
from tidemark.operators.features import KEY, FeatureSet, daily_features
from tidemark.operators.quality import feature_validity
from tidemark.sources import snapshots
from tidemark.sources.raw import RAW_TABLES, scan_raw, union_by_name
from tidemark.sources.worklist import missing_days, with_placeholders


@dataclass(frozen=True)
class RawChain:
    blocks: DataFrame | None
    tx: DataFrame | None


def default_sets() -> dict[str, FeatureSet]:
    return {"BTC": BtcFeatures(), "ETH": EthFeatures()}


def features_all_chains(
    raw: Mapping[str, RawChain], prices: DataFrame | None = None, sets: Mapping[str, FeatureSet] | None = None
) -> DataFrame:
    """Features of every chain in one frame; features a chain does not have are NULL."""
    sets = sets or default_sets()
    unknown = set(raw) - set(sets)
    if unknown:
        raise ValueError(f"no feature set for {sorted(unknown)}")
    return union_by_name(*[daily_features(sets[c], r.blocks, r.tx, prices) for c, r in raw.items()])


def build_daily_features(
    raw: Mapping[str, RawChain], spine: DataFrame, prices: DataFrame, sets: Mapping[str, FeatureSet] | None = None
) -> DataFrame:
    """One row per expected day: features, close, is_valid and the reason when it is not."""
    return with_placeholders(spine, features_all_chains(raw, prices, sets), prices)


def days_to_build(spine: DataFrame, stored: DataFrame) -> DataFrame:
    """Expected days that are not stored yet, and those stored as not valid."""
    done = stored.where("is_valid") if "is_valid" in stored.columns else stored
    return missing_days(spine, done).select(*KEY)


def raw_of_days(
    spark: SparkSession, root: str, chain: str, days: DataFrame, start: dt.date, end: dt.date,
    schemas: Mapping[str, StructType],
) -> RawChain:
    """Blocks and transactions of the given days of one chain, from day folders between start and end.

    The days are a small table (one row for each day of the calendar at most) that is joined with the
    scans on their partition column, so Spark reads the folders of these days only (dynamic partition
    pruning), however many lie in the range.
    """
    mine = days.where((F.col("chain") == chain) & F.col("date").between(F.lit(start), F.lit(end))).select("date")
    scans = [scan_raw(spark, root, chain, table, start, end, schemas[table]).join(mine, "date", "left_semi") for table in RAW_TABLES]
    return RawChain(*scans)


def build_missing_days(
    spark: SparkSession, root: str, path: str, spine: DataFrame, prices: DataFrame, start: dt.date, end: dt.date,
    schemas: Mapping[str, Mapping[str, StructType]], sets: Mapping[str, FeatureSet] | None = None,
) -> int:
    """Adds the days of the spine that the table at ``path`` lacks, and returns its new version.

    ``schemas``: by chain, those of its raw tables. Stored valid days are neither read from the raw
    tables nor computed again; a day that failed comes back as an invalid row and is tried again by the
    next run. All days of all chains are one plan and one commit of ``sources.snapshots``.
    """
    sets = sets or default_sets()
    names = list(dict.fromkeys(n for c in schemas for n in sets[c].names))
    stored = snapshots.read_days(spark, path, daily_schema(names), start, end)
    kept = Settled(spark)
    todo = kept.write(days_to_build(spine.where(F.col("date").between(F.lit(start), F.lit(end))), stored))
    raw = {chain: raw_of_days(spark, root, chain, todo, start, end, schemas[chain]) for chain in schemas}
    built = kept.write(build_daily_features(raw, todo, prices, sets).select(*daily_schema(names).fieldNames()), keep=True)
    version = snapshots.replace_days(built, path)
    kept.close()
    return version


def daily_schema(names: Sequence[str]) -> StructType:
    """Stored days: key, features, price, whether the day is valid and why not."""
    fields = [("chain", StringType()), ("date", DateType()), *[(n, DoubleType()) for n in (*names, "close")]]
    return StructType([StructField(n, t) for n, t in (*fields, ("is_valid", BooleanType()), ("invalid_reason", StringType()))])


def features_between(
    days: DataFrame, start: dt.date, end: dt.date, today: dt.date, chain: str | None = None
) -> DataFrame:
    """Valid days of a range, oldest first; days that failed are left out."""
    start, end = check_date_range(start, end, today)
    out = days.where(F.col("date").between(F.lit(start), F.lit(end)) & F.col("is_valid"))
    if chain is not None:
        out = out.where(F.col("chain") == chain)
    return out.orderBy("chain", "date")


def features_of_day(days: DataFrame, date: dt.date, today: dt.date, chain: str | None = None) -> DataFrame:
    return features_between(days, date, date, today, chain)


def require_rows(df: DataFrame, what: str = "features") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what} in the requested range")
    return df


def with_validity(days: DataFrame, names_by_chain: Mapping[str, Sequence[str]] = spec.FEATURES_BY_CHAIN) -> DataFrame:
    names = list(dict.fromkeys(n for names in names_by_chain.values() for n in names))
    return feature_validity(days.select(*KEY, *names), names_by_chain)
