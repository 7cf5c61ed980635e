"""Z-score scaling with parameters kept as a table (chain, feature, mean, std)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.values import finite_or_null
from tidemark.sources.store import NORM_PARAMS

Names = Sequence[str] | Mapping[str, Sequence[str]]


def _all_names(features: Names) -> list[str]:
    groups = features.values() if isinstance(features, Mapping) else [features]
    return list(dict.fromkeys(n for names in groups for n in names))


def fit_params(df: DataFrame, features: Names) -> DataFrame:
    """Mean and population standard deviation of the finite values per chain and feature.

    ``features`` is one list for all chains or one per chain. A feature without finite values
    gets (0, 0); a name that is no column is left out. One aggregation over all features.
    """
    names = [n for n in _all_names(features) if n in df.columns]
    if not _all_names(features):
        raise ValueError("cannot fit on an empty feature list")

    def stats(name: str) -> Column:
        x = finite_or_null(name)
        values = F.struct(
            F.lit(name).alias("feature"),
            F.coalesce(finite_or_null(F.avg(x)), F.lit(0.0)).alias("mean"),
            F.coalesce(finite_or_null(F.stddev_pop(x)), F.lit(0.0)).alias("std"),
        )
        if not isinstance(features, Mapping):
            return values
        return F.when(F.col("chain").isin(*[c for c, own in features.items() if name in own]), values)

    rows = df.groupBy("chain").agg(F.array_compact(F.array(*[stats(n) for n in names])).alias("s"))
    return rows.select("chain", F.explode("s").alias("s")).select("chain", "s.feature", "s.mean", "s.std")


def _with_params(df: DataFrame, params: DataFrame) -> DataFrame:
    """Adds one map per row: feature to (mean, std) of the row's chain."""
    entry = F.struct(F.col("feature"), F.struct("mean", "std"))
    params = params.where("feature IS NOT NULL")
    maps = params.groupBy("chain").agg(F.map_from_entries(F.collect_list(entry)).alias("_params"))
    return df.join(maps, "chain", "left")


def _scaled(name: str, degenerate_null: str) -> str:
    """SQL text of one scaled feature; ``p`` is its (mean, std)."""
    p = f"_params['{name}']"
    x = f"CASE WHEN NOT isnan(`{name}`) AND abs(`{name}`) < double('inf') THEN CAST(`{name}` AS DOUBLE) END"
    return (
        f"CASE WHEN {p}.std = 0 OR {p}.std IS NULL THEN CASE WHEN ({x}) IS NULL THEN {degenerate_null} ELSE 0D END "
        f"ELSE (({x}) - {p}.mean) / {p}.std END"
    )


def check_params(params: DataFrame, names: Sequence[str], chain: str | None = None) -> DataFrame:
    """The parameters, or an error when they hold none of the names (for the chain)."""
    mine = params.where(F.col("feature").isin(*names))
    if mine.where(F.lit(True) if chain is None else F.col("chain") == chain).isEmpty():
        raise ValueError("no scaling parameters for the features" + (f" of {chain}" if chain else ""))
    return params


def transform(df: DataFrame, params: DataFrame, names: Sequence[str]) -> DataFrame:
    """Scales the named columns that have parameters; every other column is left as it is.

    A chain without any parameters has no scaled values: NULL (see ``check_params``). A missing value stays missing; with a standard deviation of 0 every value becomes 0.
    """
    out = {
        n: F.expr(f"CASE WHEN _params IS NULL THEN NULL WHEN _params['{n}'] IS NULL THEN CAST(`{n}` AS DOUBLE) ELSE {_scaled(n, 'NULL')} END")
        for n in names if n in df.columns
    }
    return _with_params(df, params).withColumns(out).drop("_params").select(*df.columns)


def transform_for_inference(df: DataFrame, params: DataFrame, names: Sequence[str]) -> DataFrame:
    """Key and scaled features only, as 32-bit floats.

    Unlike ``transform`` a standard deviation of 0 gives 0 for missing values too, and a feature
    without parameters is NULL, so the finite check before scoring stops the row.
    """
    present = [n for n in names if n in df.columns]
    if not present:
        raise ValueError("no feature column to scale")
    scaled = [
        F.expr(f"CAST(CASE WHEN _params['{n}'] IS NOT NULL THEN {_scaled(n, '0D')} END AS FLOAT)").alias(n)
        for n in present
    ]
    return _with_params(df, params).select("chain", "date", *scaled)


def save_params(params: DataFrame, path: str, model_version: str) -> None:
    """Writes fitted parameters of one model version; non-finite values become 0."""
    if params.isEmpty():
        raise ValueError("cannot save empty parameters")
    (
        clean_params(params)
        .withColumn("model_version", F.lit(model_version))
        .repartition("chain")
        .sortWithinPartitions("chain", "feature")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model_version")
        .parquet(path)
    )


def clean_params(params: DataFrame, strict: bool = False) -> DataFrame:
    """Stored parameters ready for use.

    Text that is no number drops the entry, missing or infinite values count as 0. ``strict``
    keeps such entries and lets ``bad_params`` report them instead.
    """
    if strict:
        return params.select("chain", "feature", finite_or_null("mean").alias("mean"), finite_or_null("std").alias("std"))
    readable = [
        F.col(c).isNull() | F.col(c).try_cast("double").isNotNull() for c in ("mean", "std")
    ]
    return params.where(readable[0] & readable[1]).select(
        "chain", "feature",
        *[F.coalesce(finite_or_null(c), F.lit(0.0)).alias(c) for c in ("mean", "std")],
    )


def bad_params(params: DataFrame) -> DataFrame:
    """Entries the strict reading refuses: mean or std absent or no finite number."""
    return params.where(finite_or_null("mean").isNull() | finite_or_null("std").isNull()).select("chain", "feature")


def load_params(spark: SparkSession, path: str, model_version: str, strict: bool = False) -> DataFrame:
    stored = spark.read.parquet(path).where(F.col("model_version") == model_version)
    if strict and not bad_params(stored).isEmpty():
        raise ValueError("stored parameters hold values that are no finite numbers")
    params = clean_params(stored, strict)
    if params.isEmpty():
        raise ValueError(f"no valid parameters for version {model_version}")
    return params.select(*NORM_PARAMS.fieldNames())
