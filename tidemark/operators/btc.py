"""Bitcoin feature sets: the canonical seven and the minimal five."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import spec
from tidemark.functions.ranks import count_distinct_values
from tidemark.functions.values import finite_or_null, first_present, missing, number, sum_or_zero
from tidemark.operators.features import KEY, Aggregates, FeatureSet

# column names looked for, in order of preference (fixed values)
UTXO_ADDRESS_COLUMNS = (
    "input_address", "input_script_pubkey", "input_pubkey_hash",
    "output_address", "output_script_pubkey", "output_pubkey_hash",
)
PLAIN_ADDRESS_COLUMNS = ("from_address", "to_address")
SENDER_COLUMNS = ("sender", "from_address", "address_from", "input_address", "spending_address")
OUTPUT_BTC_COLUMNS = ("output_value_btc", "value_btc", "out_value_btc", "output_total_btc")
OUTPUT_SAT_COLUMNS = ("output_value_sat", "value_sat", "out_value_sat", "output_total_sat")
FEE_COLUMNS = ("fee_sat", "fee_satoshi", "fee", "total_fee_sat")
VSIZE_COLUMNS = ("vsize", "virtual_size", "vbytes", "size_vbytes")
BLOCK_SIZE_COLUMNS = ("size", "block_size", "block_size_bytes")


def _one_of(df: DataFrame, *names: str) -> str | None:
    return next((n for n in names if n in df.columns), None)


def _strings(names: list[str]) -> Column:
    return F.array(*[F.col(n).cast("string") for n in names])


class BtcFeatures(FeatureSet):
    chain = "BTC"
    names = spec.BTC_FEATURES

    def __init__(self, approximate_distinct: bool = False) -> None:
        self.approximate_distinct = approximate_distinct

    def tx_aggregates(self, tx: DataFrame) -> Aggregates:
        has = set(tx.columns).issuperset
        old = number("spent_output_age_days") >= spec.OLD_OUTPUT_DAYS
        out: Aggregates = {}
        if has({"is_whale", "value_usd"}):
            out["_whale"] = sum_or_zero(F.when(F.col("is_whale").cast("boolean"), number("value_usd")))
        if has({"exchange_in_usd", "exchange_out_usd"}):
            out["_netflow"] = sum_or_zero(number("exchange_in_usd")) - sum_or_zero(number("exchange_out_usd"))
        fee = _one_of(tx, "fee_rate", "fee")
        if fee:
            out["_mean_fee"] = F.avg(number(fee))
        value = _one_of(tx, "value_usd", "value_btc")
        if has({"spent_output_age_days"}) and value:
            out["_old_value"] = sum_or_zero(F.when(old, number(value)))
        if has({"revived_supply_usd"}):
            out["_revived"] = sum_or_zero(number("revived_supply_usd"))
        elif has({"spent_output_age_days", "value_usd"}):
            out["_revived"] = sum_or_zero(F.when(old, number("value_usd")))
        return out

    def block_aggregates(self, blocks: DataFrame) -> Aggregates:
        out: Aggregates = {}
        if "tx_count" in blocks.columns:
            out["_block_tx"] = sum_or_zero(number("tx_count"))
        reward = _one_of(blocks, "block_reward_btc", "block_subsidy_btc")
        if reward and "total_fees_btc" in blocks.columns:
            out["_fee_ratio"] = F.avg(F.try_divide(number("total_fees_btc"), number(reward)))
        return out

    def address_columns(self, tx: DataFrame) -> list[str]:
        for family in (UTXO_ADDRESS_COLUMNS, PLAIN_ADDRESS_COLUMNS):
            present = [c for c in family if c in tx.columns]
            if present:
                return present
        return []

    def side_tables(self, tx: DataFrame | None, blocks: DataFrame | None, names: Sequence[str]) -> list[DataFrame]:
        addresses = self.address_columns(tx) if tx is not None else []
        if not addresses or "active_addresses" not in names:
            return []
        return [count_distinct_values(tx, KEY, _strings(addresses), "_addresses", self.approximate_distinct)]

    def features(
        self, tx: DataFrame | None, blocks: DataFrame | None, has_price: bool, names: Sequence[str]
    ) -> Aggregates:
        from_tx = self.tx_aggregates(tx) if tx is not None else {}
        from_blocks = self.block_aggregates(blocks) if blocks is not None else {}

        def col(name: str) -> Column:
            return F.col(name).cast("double") if name in from_tx or name in from_blocks else missing()

        addresses = missing()
        if "active_addresses" in names and tx is not None and self.address_columns(tx):
            addresses = F.when(F.col("_n_tx") > 0, F.coalesce(F.col("_addresses").cast("double"), F.lit(0.0)))
        out = {
            "whale_flow_1d": col("_whale"),
            "exchange_netflow_7d": col("_netflow"),
            "mempool_stress": F.coalesce(col("_block_tx"), F.col("_n_tx").cast("double")),
            "fee_pressure": F.coalesce(col("_fee_ratio"), col("_mean_fee")),
            "active_addresses": addresses,
            "utxo_age_1y": col("_old_value"),
            "revived_supply": col("_revived"),
        }
        return {n: out[n] for n in names}


class BtcMinimalFeatures(FeatureSet):
    chain = "BTC"
    names = spec.BTC_MINIMAL_FEATURES

    def tx_aggregates(self, tx: DataFrame) -> Aggregates:
        out: Aggregates = {}
        btc, sat = first_present(tx, OUTPUT_BTC_COLUMNS), first_present(tx, OUTPUT_SAT_COLUMNS)
        if btc:
            out["_output"] = sum_or_zero(number(btc))
        elif sat:
            out["_output"] = sum_or_zero(number(sat) / F.lit(spec.SAT_PER_BTC))
        fee, size = first_present(tx, FEE_COLUMNS), first_present(tx, VSIZE_COLUMNS)
        if fee and size:
            out["_fee_rate"] = F.avg(F.when(number(size) > 0, F.try_divide(number(fee), number(size))))
        return out

    def side_tables(self, tx: DataFrame | None, blocks: DataFrame | None, names: Sequence[str]) -> list[DataFrame]:
        sender = first_present(tx, SENDER_COLUMNS) if tx is not None else None
        if sender is None or "BTC_active_addresses_count" not in names:
            return []
        return [count_distinct_values(tx, KEY, F.array(F.col(sender)), "_senders")]

    def features(
        self, tx: DataFrame | None, blocks: DataFrame | None, has_price: bool, names: Sequence[str]
    ) -> Aggregates:
        from_tx = self.tx_aggregates(tx) if tx is not None else {}

        def col(name: str) -> Column:
            return finite_or_null(name) if name in from_tx else missing()

        has_sender = "BTC_active_addresses_count" in names and tx is not None and bool(first_present(tx, SENDER_COLUMNS))
        out = {
            "BTC_total_block_count": F.col("_n_blocks").cast("double"),
            "BTC_total_transactions_count": F.col("_n_tx").cast("double"),
            "BTC_total_output_value_btc": col("_output"),
            "BTC_mean_transaction_fee_rate_sat_per_vbyte": col("_fee_rate"),
            "BTC_active_addresses_count": F.col("_senders").cast("double") if has_sender else missing(),
        }
        return {n: out[n] for n in names}


def mean_block_size(blocks: DataFrame) -> DataFrame:
    """Mean block size in bytes per (chain, date); not part of any feature set."""
    size = first_present(blocks, BLOCK_SIZE_COLUMNS)
    mean = F.avg(number(size)) if size else missing()
    return blocks.groupBy(*KEY).agg(mean.alias("mean_block_size_bytes"))
