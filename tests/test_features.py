"""Edge rows of the daily features, quality rules and exact statistics."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark import spec
from tidemark.functions.ranks import exact_quantile, rank_auc
from tidemark.functions.values import first_present, score_or_neutral
from tidemark.operators.btc import BtcFeatures, BtcMinimalFeatures
from tidemark.operators.eth import EthFeatures
from tidemark.operators.features import FeatureSet, daily_features, name_differences, select_expected
from tidemark.operators.quality import daily_violations, feature_validity, is_critical
from tidemark.sources import raw, worklist

D = dt.date(2024, 1, 1)
NAN, INF = float("nan"), float("inf")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def btc_tx(spark, rows, schema):
    return spark.createDataFrame([("BTC", D, *r) for r in rows], "chain string, date date, " + schema)


def test_no_whale_is_zero_and_nan_is_skipped(spark):
    schema = "is_whale boolean, value_usd double, exchange_in_usd double, exchange_out_usd double"
    got = one(daily_features(BtcFeatures(), None, btc_tx(spark, [(False, 5.0, 1.0, NAN)], schema)))
    assert got.whale_flow_1d == 0.0 and got.exchange_netflow_7d == 1.0
    got = one(daily_features(BtcFeatures(), None, btc_tx(spark, [(True, 1.0, 1.0, 2.0), (True, NAN, 0.0, 0.0)], schema)))
    assert got.whale_flow_1d == 1.0 and got.exchange_netflow_7d == -1.0


def test_absent_columns_leave_features_missing(spark):
    got = one(daily_features(BtcFeatures(), None, btc_tx(spark, [(1,)], "other int")))
    assert got.mempool_stress == 1.0
    assert [got[n] for n in spec.BTC_FEATURES if n != "mempool_stress"] == [None] * 6
    with pytest.raises(ValueError):
        daily_features(BtcFeatures(), None, None)


def test_fee_pressure_falls_back_to_transactions(spark):
    blocks = spark.createDataFrame(
        [("BTC", D, 1.0, 0.0)], "chain string, date date, total_fees_btc double, block_subsidy_btc double"
    )
    tx = btc_tx(spark, [(4.0,), (6.0,), (NAN,)], "fee_rate double")
    assert one(daily_features(BtcFeatures(), blocks, tx)).fee_pressure == 5.0
    assert one(daily_features(BtcFeatures(), blocks.withColumn("block_reward_btc", F.lit(2.0)), tx)).fee_pressure == 0.5


def test_active_addresses_prefer_utxo_columns(spark):
    tx = btc_tx(spark, [("a", "b", "x"), ("b", None, "y"), (None, "c", "z")],
                "input_address string, output_address string, from_address string")
    assert one(daily_features(BtcFeatures(), None, tx)).active_addresses == 3.0
    tx = btc_tx(spark, [(None, "p"), (None, "p")], "from_address string, to_address string")
    assert one(daily_features(BtcFeatures(), None, tx)).active_addresses == 1.0
    assert one(daily_features(BtcMinimalFeatures(), None, tx)).BTC_active_addresses_count is None
    none = btc_tx(spark, [(None, None)], "from_address string, to_address string")
    assert one(daily_features(BtcFeatures(), None, none)).active_addresses == 0.0


def test_minimal_set_units_and_zero_sizes(spark):
    tx = btc_tx(spark, [(3e8, 10.0, 0.0), (1e8, 30.0, 0.0)], "Value_Sat double, fee double, vsize double")
    got = one(daily_features(BtcMinimalFeatures(), None, tx))
    assert got.BTC_total_output_value_btc == 4.0
    assert got.BTC_mean_transaction_fee_rate_sat_per_vbyte is None
    assert first_present(tx, ("value_sat",)) == "Value_Sat"


def eth_tx(spark, rows):
    return spark.createDataFrame(
        [("ETH", D, *r) for r in rows],
        "chain string, date date, value string, gas_price double, from_address string, to_address string, input string",
    ).withColumn("value", F.col("value").cast("decimal(38,0)"))


def test_contract_calls_count_empty_text(spark):
    rows = [("1", 1e9, "a", to, data) for to in ("b", None) for data in ("", "0x", None, "0xff")]
    assert one(daily_features(EthFeatures(), None, eth_tx(spark, rows))).smart_contract_calls == 6.0


def test_wei_sums_case_and_even_median(spark):
    deposit = spec.STAKING_DEPOSIT_CONTRACT.upper().replace("0X", "0x")
    rows = [("32" + "0" * 18, g * 1e9, "a", deposit, "0x") for g in (1, 2, 3, 10)]
    rows[0] = ("5000" + "0" * 18, 1e9, "A", "b", "0x")
    got = one(daily_features(EthFeatures(), None, eth_tx(spark, rows)))
    assert (got.eth2_staking_flow, got.whale_flow_1d, got.gas_price_median) == (96.0, 5000.0, 2.5)
    assert got.active_addresses == 4.0  # a, A, b, deposit: case is kept
    approx = one(daily_features(EthFeatures(approximate=True), None, eth_tx(spark, rows)))
    assert approx.gas_price_median in (2.0, 3.0)


def test_gas_falls_back_by_day_and_by_column(spark):
    blocks = spark.createDataFrame(
        [("ETH", D, 4e9), ("ETH", D + dt.timedelta(1), 6e9)], "chain string, date date, base_fee_per_gas double"
    )
    got = {r.date: r.gas_price_median for r in
           daily_features(EthFeatures(), blocks, eth_tx(spark, [("1", None, "a", "b", "0x")])).collect()}
    assert got == {D: None, D + dt.timedelta(1): 6.0}
    other = blocks.withColumnRenamed("base_fee_per_gas", "gas_price_median")
    assert one(daily_features(EthFeatures(), other.where(F.col("date") == F.lit(D)), None)).gas_price_median == 4.0


def test_own_feature_set(spark):
    class Count(FeatureSet):
        chain, names = "BTC", ("n",)

        def features(self, tx, blocks, has_price, names):
            return {"n": F.col("_n_tx")}

    assert one(daily_features(Count(), None, btc_tx(spark, [(1,), (2,)], "x int"))).n == 2.0


@pytest.mark.parametrize("kind", ["ties", "negative", "tiny", "wide", "near"])
def test_exact_quantile_is_the_median(spark, kind):
    rnd = random.Random(kind)
    make = {
        "ties": lambda: float(rnd.randint(0, 3)), "negative": lambda: rnd.uniform(-5, 5),
        "tiny": lambda: rnd.uniform(0, 1e-300), "wide": lambda: 10 ** rnd.uniform(-200, 200),
        "near": lambda: 1e12 + rnd.random() * 1e-3,
    }[kind]
    groups = {k: [make() for _ in range(n)] for k, n in (("a", 101), ("b", 200), ("c", 1))}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r.k: r.m for r in exact_quantile(df, ["k"], F.col("v"), "m").collect()}
    assert got == {k: pytest.approx(statistics.median(vs), rel=1e-15) for k, vs in groups.items()}


@pytest.mark.parametrize("digits", [1, 2, 17])
def test_rank_auc_counts_pairs(spark, digits):
    rnd = random.Random(digits)
    rows = [(rnd.randint(0, 1), round(rnd.random() ** 9, digits)) for _ in range(300)] + [(1, 1.0), (0, 0.0), (0, 1.0)]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "y int, p double")
    assert one(rank_auc(df, [], "y", "p")).auc == pytest.approx(want, abs=1e-15)
    assert one(rank_auc(df.where("y = 1"), [], "y", "p")).auc is None
    # only the order of the scores counts
    assert one(rank_auc(df.withColumn("p", F.col("p") / 2), [], "y", "p")).auc == pytest.approx(want, abs=1e-15)


def test_scores_are_cleaned(spark):
    df = spark.createDataFrame([(NAN,), (-5.0,), (120.0,), (INF,), (None,), (7.0,)], "s double")
    assert [r[0] for r in df.select(score_or_neutral("s")).collect()] == [50.0, 0.0, 100.0, 50.0, 50.0, 7.0]


def test_quality_rules(spark):
    df = spark.createDataFrame(
        [("BTC", D, NAN, 1.0), ("BTC", D, INF, None)], "chain string, date date, total_value double, fee double"
    )
    got = sorted((r.rule, r.column_name, r.severity) for r in daily_violations(df).collect())
    assert got == [("infinite_value", "total_value", "error"), ("missing_value", "fee", "warning"),
                   ("missing_value", "total_value", "error"), ("not_one_row", "", "error")]
    assert is_critical("Close_Price") and not is_critical("fee")
    out = feature_validity(df, {"BTC": ("total_value", "gone")}).collect()
    assert [r.reasons for r in out] == [["not_finite:total_value", "absent:gone", "extra:fee"]] * 2


def test_names(spark):
    df = btc_tx(spark, [(1.0, 2.0)], "b double, a double")
    assert select_expected(df, ["a", "b"]).columns == ["chain", "date", "a", "b"]
    assert name_differences(df, ["a", "c"]) == (["c"], ["b"])
    with pytest.raises(ValueError):
        select_expected(df, ["c"])


def test_date_ranges():
    as_of = dt.date(2024, 3, 10)
    assert worklist.date_range(as_of) == (dt.date(2024, 3, 9),) * 2
    assert worklist.date_range(as_of, start=dt.date(2024, 3, 1)) == (dt.date(2024, 3, 1), dt.date(2024, 3, 9))
    for bad in ({"date": as_of}, {"start": dt.date(2024, 3, 5), "end": dt.date(2024, 3, 1)}, {"end": D}):
        with pytest.raises(ValueError):
            worklist.date_range(as_of, **bad)


def test_spine_and_placeholders(spark):
    spine = worklist.spine(spark, D, D + dt.timedelta(2))
    assert spine.count() == 6
    features = spark.createDataFrame([("BTC", D, 1.0)], "chain string, date date, f double")
    days = spark.createDataFrame([("BTC", D), ("BTC", D + dt.timedelta(1))], "chain string, date date")
    prices = spark.createDataFrame([("BTC", D, 9.0), ("BTC", D + dt.timedelta(1), 9.0)], "chain string, date date, close double")
    got = {(r.chain, r.date.day): (r.f, r.is_valid, r.invalid_reason) for r in
           worklist.with_placeholders(spine, features, prices, days).collect()}
    assert got[("BTC", 1)] == (1.0, True, None)
    assert got[("BTC", 2)] == (None, False, "no_aggregate")
    assert got[("ETH", 1)] == (None, False, "no_raw_data")
    got = worklist.with_placeholders(spine, features, prices.limit(0)).where("chain = 'BTC'").orderBy("date").collect()
    assert [r.invalid_reason for r in got] == ["no_price", "no_raw_data", "no_raw_data"]


def test_raw_scan(spark, tmp_path):
    for day, schema in (("2024-01-01", "v double"), ("2024-01-02", "v double, extra string")):
        values = [(1.0,), (2.0,)] if "extra" not in schema else [(3.0, "e")]
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/v1.0/btc/blocks/date={day}")
    df = raw.scan_raw(spark, str(tmp_path), "btc", "blocks")
    assert set(df.columns) == {"chain", "date", "v", "extra"} and df.count() == 3
    part = raw.scan_raw(spark, str(tmp_path), "BTC", "blocks", start=dt.date(2024, 1, 2))
    assert part.count() == 1
    assert "PartitionFilters: [isnotnull(date" in part._jdf.queryExecution().executedPlan().toString()
    assert raw.scan_raw(spark, str(tmp_path), "BTC", "blocks", limit=2).count() == 2
    assert raw.has_data(df, "BTC", D) and not raw.has_data(df, "BTC", dt.date(2023, 1, 1))
    assert raw.limit_per_day(df, 1, ["v"]).count() == 2 and raw.limit_per_day(df, 0, ["v"]).count() == 0
    with pytest.raises(ValueError):
        raw.limit_per_day(df, -1, ["v"])
    many = spark.range(5000).selectExpr("CASE WHEN id >= 0 THEN 'BTC' END AS chain", "DATE'2024-01-01' AS date", "id")
    assert raw.limit_per_day(many, 1500, ["id"]).agg(F.count("id"), F.max("id")).first()[:] == (1500, 1499)
    few = raw.limit_per_day(many, 3, ["id"])
    assert [r.id for r in few.collect()] == [0, 1, 2]
    assert "WindowGroupLimit" in few._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        raw.scan_raw(spark, str(tmp_path), "DOGE", "blocks")
