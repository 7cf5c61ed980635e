"""Ethereum feature set.

Wei amounts are summed as DECIMAL(38,0) and turned into double after the sum only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import spec
from tidemark.functions.ranks import count_distinct_values, exact_quantile
from tidemark.functions.values import finite_or_null, missing, number
from tidemark.operators.features import KEY, Aggregates, FeatureSet


def _wei(name: str) -> Column:
    return F.col(name).try_cast("decimal(38,0)")


def _wei_sum(condition: Column) -> Column:
    total = F.coalesce(F.sum(F.when(condition, _wei("value"))).cast("double"), F.lit(0.0))
    return total / F.lit(spec.WEI_PER_ETH)


class EthFeatures(FeatureSet):
    """``labels`` (address, is_exchange) turns the netflow placeholder into in minus out, in ETH.

    ``approximate`` trades the exact median and distinct counts for one-pass sketches.
    """

    chain = "ETH"
    names = spec.ETH_FEATURES
    price_features = ("whale_flow_1d",)

    def __init__(self, exchange_labels: DataFrame | None = None, approximate: bool = False) -> None:
        self.exchange_labels = exchange_labels
        self.approximate = approximate

    def tx_aggregates(self, tx: DataFrame) -> Aggregates:
        columns = set(tx.columns)
        out: Aggregates = {}
        if "value" in columns:
            out["_whale_eth"] = _wei_sum(_wei("value") >= F.lit(spec.WHALE_THRESHOLD_WEI).cast("decimal(38,0)"))
        if {"value", "to_address"} <= columns:
            to_contract = F.lower(F.col("to_address").cast("string")) == spec.STAKING_DEPOSIT_CONTRACT
            out["_staking"] = _wei_sum(to_contract)
        if "input" in columns:
            called = F.col("input").isNotNull() & (F.col("input") != "0x")
            if "to_address" in columns:
                called = called | F.col("to_address").isNull()
            out["_calls"] = F.count_if(called)
        if self.approximate and "gas_price" in columns:
            out["_gas_median"] = F.percentile_approx(number("gas_price"), 0.5)
        return out

    def block_aggregates(self, blocks: DataFrame) -> Aggregates:
        if "base_fee_per_gas" not in blocks.columns and "gas_price_median" in blocks.columns:
            return {"_gas_block": F.avg(number("gas_price_median"))}
        return {}

    def side_tables(self, tx: DataFrame | None, blocks: DataFrame | None, names: Sequence[str]) -> list[DataFrame]:
        side = []
        if "gas_price_median" in names:
            prices = []
            if tx is not None and "gas_price" in tx.columns and not self.approximate:
                prices.append((tx, "gas_price", "_gas_median"))
            if blocks is not None and "base_fee_per_gas" in blocks.columns:
                prices.append((blocks, "base_fee_per_gas", "_gas_block"))
            side += _medians(prices)
        addresses = [c for c in ("from_address", "to_address") if tx is not None and c in tx.columns]
        if addresses and "active_addresses" in names:
            strings = F.array(*[F.col(c).cast("string") for c in addresses])
            side.append(count_distinct_values(tx, KEY, strings, "_addresses", self.approximate))
        if self.exchange_labels is not None and tx is not None and "exchange_netflow_7d" in names:
            side.append(labelled_netflow(tx, self.exchange_labels))
        return side

    def features(
        self, tx: DataFrame | None, blocks: DataFrame | None, has_price: bool, names: Sequence[str]
    ) -> Aggregates:
        tx_columns = set(tx.columns) if tx is not None else set()
        block_columns = set(blocks.columns) if blocks is not None else set()
        from_tx = self.tx_aggregates(tx) if tx is not None else {}
        has_tx = F.coalesce(F.col("_n_tx"), F.lit(0)) > 0

        def col(name: str) -> Column:
            return F.col(name).cast("double") if name in from_tx else missing()

        whale = col("_whale_eth")
        if has_price:
            whale = whale * F.coalesce(F.col("_close"), F.lit(1.0))
        netflow = F.when(has_tx, F.lit(0.0))
        if "exchange_netflow_7d" in names and self.exchange_labels is not None and tx is not None:
            netflow = F.when(has_tx, F.coalesce(F.col("_netflow"), F.lit(0.0)))
        # the block fallback is for days without transactions, not for days of null gas prices
        gas = missing()
        if "gas_price_median" in names:
            if block_columns & {"base_fee_per_gas", "gas_price_median"}:
                gas = F.col("_gas_block")
            if "gas_price" in tx_columns:
                gas = F.when(has_tx, F.col("_gas_median")).otherwise(gas)
        addresses = missing()
        if "active_addresses" in names and tx_columns & {"from_address", "to_address"}:
            addresses = F.when(has_tx, F.coalesce(F.col("_addresses").cast("double"), F.lit(0.0)))
        out = {
            "whale_flow_1d": whale,
            "exchange_netflow_7d": netflow,
            "gas_price_median": gas / F.lit(spec.WEI_PER_GWEI),
            "active_addresses": addresses,
            "smart_contract_calls": col("_calls"),
            "eth2_staking_flow": col("_staking"),
        }
        return {n: out[n] for n in names}


def _medians(columns: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """Exact medians of columns of several tables in one walk down the buckets."""
    if not columns:
        return []
    rows = [df.select(*KEY, F.lit(out).alias("_of"), finite_or_null(name).alias("_x")) for df, name, out in columns]
    found = exact_quantile(reduce(DataFrame.unionByName, rows), [*KEY, "_of"], F.col("_x"), "_median")
    return [found.select(*KEY, *[F.when(F.col("_of") == out, F.col("_median")).alias(out) for _, _, out in columns])]


def labelled_netflow(tx: DataFrame, labels: DataFrame) -> DataFrame:
    """ETH into minus out of labelled addresses, per day.

    Transfers are summed per address first, so an address with very many transfers is one row
    per day when it meets its label.
    """
    wei = F.coalesce(_wei("value"), F.lit(0).cast("decimal(38,0)"))
    sides = F.array(
        F.struct(F.col("to_address").alias("address"), wei.alias("wei")),
        F.struct(F.col("from_address").alias("address"), (-wei).alias("wei")),
    )
    per_address = (
        tx.select(*KEY, F.explode(sides).alias("s"))
        .groupBy(*KEY, F.lower(F.col("s.address")).alias("address"))
        .agg(F.sum("s.wei").alias("wei"))
    )
    marked = labels.where("is_exchange").select(F.lower("address").alias("address")).distinct()
    return (
        per_address.join(marked, "address", "left_semi")
        .groupBy(*KEY)
        .agg((F.sum("wei").cast("double") / F.lit(spec.WEI_PER_ETH)).alias("_netflow"))
    )


def whale_flow_unit(days: DataFrame, prices: DataFrame | None) -> DataFrame:
    """Adds whale_flow_unit: USD on days with a close price, ETH on the others."""
    if prices is None:
        return days.withColumn("whale_flow_unit", F.lit("ETH"))
    close = prices.select(*KEY, F.col("close").alias("_close"))
    unit = F.when(F.col("_close").isNotNull(), F.lit("USD")).otherwise(F.lit("ETH"))
    return days.join(close, KEY, "left").withColumn("whale_flow_unit", unit).drop("_close")
