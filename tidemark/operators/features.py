"""Feature sets: what to aggregate per (chain, date), and the plan that does it.

A set lists native aggregate columns per input table. New sets subclass ``FeatureSet``; no
Python runs on the executors. All days of a chain are aggregated in one plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["chain", "date"]

Aggregates = dict[str, Column]


class FeatureSet:
    """Base class of the feature sets; the hooks default to "nothing to compute"."""

    chain: str = ""
    names: tuple[str, ...] = ()
    price_features: tuple[str, ...] = ()  # names whose expression reads the close price, ``_close``

    def tx_aggregates(self, tx: DataFrame) -> Aggregates:
        return {}

    def block_aggregates(self, blocks: DataFrame) -> Aggregates:
        return {}

    def side_tables(self, tx: DataFrame | None, blocks: DataFrame | None, names: Sequence[str]) -> list[DataFrame]:
        """Statistics that need their own shuffle (distinct counts, medians), keyed by KEY.

        Only what the asked names need; their columns must not occur in other expressions.
        """
        return []

    def features(
        self, tx: DataFrame | None, blocks: DataFrame | None, has_price: bool, names: Sequence[str]
    ) -> Aggregates:
        """Final expressions over the joined aggregates, one per asked name."""
        raise NotImplementedError


def _per_day(df: DataFrame, count_name: str, aggregates: Aggregates) -> DataFrame:
    return df.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias(count_name), *[c.alias(n) for n, c in aggregates.items()]
    )


def merge_by_day(parts: Sequence[DataFrame]) -> DataFrame:
    """Outer join of tables with at most one row per day and different columns.

    Written as a union and one small aggregation, which takes any number of parts with a single
    exchange; ``max`` picks the one value there is.
    """
    if len(parts) == 1:
        return parts[0]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return union.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in union.columns if c not in KEY])


def daily_features(
    fs: FeatureSet,
    blocks: DataFrame | None,
    tx: DataFrame | None,
    prices: DataFrame | None = None,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """One row (chain, date, features...) per day with blocks or transactions.

    ``names`` computes a part of the set only. Both inputs absent is an error; one absent
    input leaves the features that need it NULL.
    """
    if blocks is None and tx is None:
        raise ValueError("blocks and transactions are both missing")
    names = list(names or fs.names)
    unknown = set(names) - set(fs.names)
    if unknown:
        raise ValueError(f"not features of this set: {sorted(unknown)}")
    parts = []
    if blocks is not None:
        parts.append(_per_day(blocks, "_n_blocks", fs.block_aggregates(blocks)))
    if tx is not None:
        parts.append(_per_day(tx, "_n_tx", fs.tx_aggregates(tx)))
    merged = merge_by_day([*parts, *fs.side_tables(tx, blocks, names)])
    for name, present in (("_n_blocks", blocks is not None), ("_n_tx", tx is not None)):
        if not present:
            merged = merged.withColumn(name, F.lit(None).cast("long"))
    has_price = prices is not None and not set(names).isdisjoint(fs.price_features)
    if has_price:
        merged = merged.join(prices.select(*KEY, F.col("close").alias("_close")), KEY, "left")
    exprs = fs.features(tx, blocks, has_price, names)
    if set(exprs) != set(names):
        raise ValueError("feature set does not return exactly the asked names")
    return merged.select(*KEY, *[exprs[n].cast("double").alias(n) for n in names])


def select_expected(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Key and expected features in their order; extra columns go, a missing one is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"expected features are missing: {missing}")
    return df.select(*KEY, *names)


def name_differences(df: DataFrame, names: Sequence[str]) -> tuple[list[str], list[str]]:
    """Expected names absent from df, and feature columns of df that are not expected."""
    have = [c for c in df.columns if c not in KEY]
    return sorted(set(names) - set(have)), sorted(set(have) - set(names))
