"""The registered queries: every operator over the whole driver tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from checks.inputs import load, table
from tidemark import spec
from tidemark.functions.lineage import cut_lineage, work_folder
from tidemark.functions.values import feature_or_neutral, known_chain, normal_chain, score_or_neutral, to_date
from tidemark.operators import alerts as alert_ops
from tidemark.operators import metrics, model, normalize, quality, signals, training_data
from tidemark.operators.btc import BtcFeatures, BtcMinimalFeatures, mean_block_size
from tidemark.operators.eth import EthFeatures, whale_flow_unit
from tidemark.operators.features import daily_features, select_expected
from tidemark.plans import features as feature_plans
from tidemark.plans import inference, reports, training
from tidemark.sources import raw, snapshots, store, worklist

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = dt.datetime(2024, 1, 31, 3, 0)
RULES = signals.SignalRules()
WHOLE_SERIES_GAP = RULES.history_days


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


# averages and medians of amounts in cents fall on half units of fewer digits
OWN_DIGITS = {"close": 6, "gas_price_median": 6}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = {n for n, t in df.dtypes if t == "double"}
    return df.select(*[r(c, max(digits, OWN_DIGITS.get(c, 0))).alias(c) if c in doubles else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ derived inputs


def btc_days(spark: SparkSession, sf: str, names: tuple[str, ...] | None = None) -> DataFrame:
    return daily_features(BtcFeatures(), load(spark, sf, "btc_blocks"), load(spark, sf, "btc_tx"), names=names)


def eth_days(spark: SparkSession, sf: str, names: tuple[str, ...] | None = None) -> DataFrame:
    blocks, tx, prices = (load(spark, sf, n) for n in ("eth_blocks", "eth_tx", "prices"))
    return daily_features(EthFeatures(), blocks, tx, prices, names)


def raw_chains(spark: SparkSession, sf: str) -> dict[str, feature_plans.RawChain]:
    return {
        "BTC": feature_plans.RawChain(load(spark, sf, "btc_blocks"), load(spark, sf, "btc_tx")),
        "ETH": feature_plans.RawChain(load(spark, sf, "eth_blocks"), load(spark, sf, "eth_tx")),
    }


def raw_days(spark: SparkSession, sf: str) -> DataFrame:
    days = [load(spark, sf, n).select("chain", "date") for n in ("btc_blocks", "btc_tx", "eth_blocks", "eth_tx")]
    return raw.union_by_name(*days)


def both_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return raw.union_by_name(*[load(spark, sf, n).select("chain", "date") for n in ("btc_blocks", "eth_blocks")])


def both_tx(spark: SparkSession, sf: str) -> DataFrame:
    return raw.union_by_name(*[load(spark, sf, n).select("chain", "date") for n in ("btc_tx", "eth_tx")])


def whole_spine(spark: SparkSession, sf: str) -> DataFrame:
    return worklist.spine_between(raw_days(spark, sf))


def all_days(spark: SparkSession, sf: str) -> DataFrame:
    return feature_plans.features_all_chains(raw_chains(spark, sf), load(spark, sf, "prices"))


def stored_days(spark: SparkSession, sf: str) -> DataFrame:
    """Daily features as a daily run keeps them: computed from the raw rows once, then reused."""
    return cut_lineage(all_days(spark, sf))


def checked_days(spark: SparkSession, sf: str) -> DataFrame:
    """Every calendar day of a chain, with its features or as an invalid placeholder."""
    days = stored_days(spark, sf)
    return worklist.with_placeholders(worklist.spine_between(days), days, load(spark, sf, "prices"))


def scaled(spark: SparkSession, sf: str) -> DataFrame:
    days = stored_days(spark, sf)
    return normalize.transform(days, normalize.fit_params(days, spec.FEATURES_BY_CHAIN), spec.ALL_FEATURES)


def scored_days(spark: SparkSession, sf: str) -> DataFrame:
    """Scaled features of the days that have a raw score."""
    return scaled(spark, sf).join(load(spark, sf, "raw_scores"), ["chain", "date"])


def stored_at(hours: int = 27) -> Column:
    return F.timestamp_seconds(F.unix_date("date").cast("long") * 86400 + F.lit(hours * 3600))


def sample_signals(scored: DataFrame) -> DataFrame:
    """Signals standing for the stored table: one per day, stored at 03:00 the next day."""
    return signals.stateless_signals(scored).withColumn("created_at", stored_at())


def stored_signals(spark: SparkSession, sf: str) -> DataFrame:
    return sample_signals(scored_days(spark, sf))


def sample_alerts(rows: DataFrame) -> DataFrame:
    found = alert_ops.alert_rows(rows).withColumn("created_at", stored_at())
    return store.with_alert_id(found).select(*store.ALERTS.fieldNames())


def stored_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return sample_alerts(stored_signals(spark, sf))


def sample_performance(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of ten model versions; later patch numbers are trained later."""
    report = metrics.evaluation_report(load(spark, sf, "predictions"), ["chain", "model_version"])
    day = F.split("model_version", r"\.")[2].cast("int")
    return report.select(
        "chain", "model_version", "auc", "hitrate", F.lit(None).cast("double").alias("sharpe_ratio"),
        F.timestamp_seconds(F.lit(1704067200) + day * 86400).alias("trained_at"),
    )


def labelled_days(spark: SparkSession, sf: str) -> DataFrame:
    return training_data.training_set(stored_days(spark, sf), training_data.drawdown_label(load(spark, sf, "prices")))


def with_epoch(df: DataFrame, name: str = "created_at") -> DataFrame:
    return df.withColumn(name, F.unix_seconds(name))


def alert_text(df: DataFrame) -> DataFrame:
    """Nested alerts as a count and a joined text, which both engines print alike."""
    joined = F.array_join(F.transform(F.sort_array(F.transform("alerts", lambda a: a["alert_type"])), lambda t: t), ",")
    return df.withColumn("n_alerts", F.size("alerts").cast("long")).withColumn("alert_types", joined).drop("alerts")


# ------------------------------------------------------------------ sources and work-lists


@query
def daily_spine(spark: SparkSession, sf: str) -> DataFrame:
    return whole_spine(spark, sf)


@query
def missing_days(spark: SparkSession, sf: str) -> DataFrame:
    return worklist.missing_days(whole_spine(spark, sf), both_blocks(spark, sf))


@query
def data_availability(spark: SparkSession, sf: str) -> DataFrame:
    return worklist.present_days(whole_spine(spark, sf), raw.available_days(both_blocks(spark, sf)))


@query
def raw_readiness(spark: SparkSession, sf: str) -> DataFrame:
    """Each raw table is scanned once: the calendar's bounds come from the counts per day."""
    return raw.raw_readiness(None, both_blocks(spark, sf), both_tx(spark, sf))


@query
def placeholder_days(spark: SparkSession, sf: str) -> DataFrame:
    days = checked_days(spark, sf)
    return rounded(days, 4)


@query
def tx_scan_limited(spark: SparkSession, sf: str) -> DataFrame:
    first = raw.limit_per_day(load(spark, sf, "btc_tx"), 5, ["tx_id", "value_usd", "from_address", "to_address"])
    return first.groupBy("chain", "date").agg(F.count("*").alias("n_tx"), F.sum("tx_id").alias("sum_tx_id"))


@query
def union_of_files(spark: SparkSession, sf: str) -> DataFrame:
    both = raw.union_by_name(load(spark, sf, "btc_tx"), load(spark, sf, "eth_tx"))
    return both.groupBy("chain").agg(
        F.count("*").alias("n_rows"), F.count("value_usd").alias("n_value_usd"), F.count("gas_price").alias("n_gas_price")
    )


@query
def chains_accepted(spark: SparkSession, sf: str) -> DataFrame:
    """Chain names as people type them; known ones are accepted in any case."""
    typed = F.concat(F.lit(" "), F.lower("chain"), F.when(F.col("y") == 1, F.lit("x")).otherwise(F.lit(" ")))
    rows = load(spark, sf, "predictions").withColumn("typed", typed)
    return rows.select("id", normal_chain("typed").alias("chain"), known_chain("typed").alias("is_known"))


@query
def dates_read(spark: SparkSession, sf: str) -> DataFrame:
    """Dates from timestamps, ISO text and text that is no date."""
    orders = table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date").cast("string")
    text = F.when(F.col("o_orderstatus") == "F", F.concat(day, F.lit("T01:02:03"))).when(
        F.col("o_orderstatus") == "P", F.lit("unknown")).otherwise(day)
    return orders.select("o_orderkey", to_date("o_orderdate").alias("from_timestamp"), to_date(text).alias("from_text"))


# ------------------------------------------------------------------ daily features


def _btc_feature(name: str, feature: str, digits: int) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(btc_days(spark, sf, (feature,)), digits)

    QUERIES[name] = run


_btc_feature("btc_whale_flow", "whale_flow_1d", 4)
_btc_feature("btc_exchange_netflow", "exchange_netflow_7d", 4)
_btc_feature("btc_mempool_stress", "mempool_stress", 4)
_btc_feature("btc_fee_pressure", "fee_pressure", 6)
_btc_feature("btc_active_addresses", "active_addresses", 4)
_btc_feature("btc_utxo_age_1y", "utxo_age_1y", 4)
_btc_feature("btc_revived_supply", "revived_supply", 4)


@query
def btc_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(btc_days(spark, sf), 4)


@query
def btc_min_features(spark: SparkSession, sf: str) -> DataFrame:
    blocks, tx = load(spark, sf, "btc_blocks"), load(spark, sf, "btc_tx")
    return rounded(daily_features(BtcMinimalFeatures(), blocks, tx), 4)


@query
def btc_mean_block_size(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mean_block_size(load(spark, sf, "btc_blocks")), 4)


@query
def eth_whale_flow(spark: SparkSession, sf: str) -> DataFrame:
    days = eth_days(spark, sf, ("whale_flow_1d",))
    return rounded(whale_flow_unit(days, load(spark, sf, "prices")), 2)


@query
def eth_whale_flow_in_eth(spark: SparkSession, sf: str) -> DataFrame:
    days = daily_features(EthFeatures(), None, load(spark, sf, "eth_tx"), names=("whale_flow_1d",))
    return rounded(whale_flow_unit(days, None), 4)


def _eth_feature(name: str, feature: str, digits: int = 6) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(eth_days(spark, sf, (feature,)), digits)

    QUERIES[name] = run


_eth_feature("eth_netflow_placeholder", "exchange_netflow_7d")
_eth_feature("eth_gas_median", "gas_price_median")
_eth_feature("eth_active_addresses", "active_addresses")
_eth_feature("eth_contract_calls", "smart_contract_calls")
_eth_feature("eth_staking_flow", "eth2_staking_flow", 4)


@query
def eth_gas_from_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Days without transactions: the median comes from the block base fee."""
    days = daily_features(EthFeatures(), load(spark, sf, "eth_blocks"), None, names=("gas_price_median",))
    return rounded(days, 6)


@query
def eth_labelled_netflow(spark: SparkSession, sf: str) -> DataFrame:
    tx = load(spark, sf, "eth_tx")
    seen = tx.select(F.explode(F.array("from_address", "to_address")).alias("address")).where("address IS NOT NULL")
    labels = seen.distinct().withColumn("is_exchange", F.col("address").endswith("7"))
    days = daily_features(EthFeatures(exchange_labels=labels), None, tx, names=("exchange_netflow_7d",))
    return rounded(days, 4)


@query
def eth_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eth_days(spark, sf), 2)


@query
def features_all_chains(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(select_expected(all_days(spark, sf), spec.ALL_FEATURES), 2)


@query
def features_date_range(spark: SparkSession, sf: str) -> DataFrame:
    days = checked_days(spark, sf)
    return rounded(feature_plans.features_between(days, dt.date(1996, 1, 1), dt.date(2024, 1, 15), AS_OF.date()), 2).drop("invalid_reason")


def raw_folders(spark: SparkSession, sf: str) -> tuple[str, dict[str, StructType]]:
    """The ETH tables as day folders, and their schemas."""
    root, schemas = work_folder(spark), {}
    for name, rows in (("blocks", "eth_blocks"), ("transactions", "eth_tx")):
        df = load(spark, sf, rows).drop("chain")
        df.repartition("date").write.partitionBy("date").parquet(raw.raw_path(root, "ETH", name))
        schemas[name] = StructType([f for f in df.schema.fields if f.name != "date"] + [StructField("date", DateType())])
    return root, schemas


@query
def incremental_build(spark: SparkSession, sf: str) -> DataFrame:
    """Days are built up to the 20th and then up to the end; the second run reads and computes new days, and one stored as invalid, only."""
    root, schemas = raw_folders(spark, sf)
    path, prices = work_folder(spark), load(spark, sf, "prices")
    spine = whole_spine(spark, sf).where("chain = 'ETH'")
    run = partial(feature_plans.build_missing_days, spark, root, path, spine, prices, dt.date(2024, 1, 1), schemas={"ETH": schemas})
    run(end=dt.date(2024, 1, 20))
    schema = feature_plans.daily_schema(EthFeatures().names)
    marked = snapshots.read_days(spark, path, schema, dt.date(2024, 1, 5), dt.date(2024, 1, 10)).where("day(date) IN (5, 10)")
    marked = marked.withColumns({"close": F.lit(-1.0), "is_valid": F.dayofmonth("date") == 5})
    snapshots.replace_days(marked, path)
    run(end=dt.date(2024, 1, 31))
    return rounded(snapshots.read_days(spark, path, schema), 2)


@query
def raw_folders_united(spark: SparkSession, sf: str) -> DataFrame:
    """Day folders whose files lack columns or have others: columns are united by name, footers of the range only are read."""
    root = work_folder(spark)
    path, rows = raw.raw_path(root, "ETH", "transactions"), load(spark, sf, "eth_tx").drop("chain")
    early = F.col("date") < F.lit(dt.date(2024, 1, 11))
    for part, columns in ((early, ["date", "value", "from_address"]), (~early, ["date", "from_address", "gas_price", "input"])):
        rows.where(part).select(*columns).repartition("date").write.mode("append").partitionBy("date").parquet(path)
    spark.createDataFrame([("text",)], "from_address string").write.text(f"{path}/date=2023-12-01")  # outside the range: never opened
    scan = raw.scan_raw(spark, root, "ETH", "transactions", dt.date(2024, 1, 3), dt.date(2024, 1, 25))
    return scan.groupBy("chain", "date").agg(
        F.count("*").alias("n_rows"), F.count("value").alias("n_value"), F.count("gas_price").alias("n_gas_price"),
        F.count("input").alias("n_input"), F.countDistinct("from_address").alias("n_senders"))


@query
def features_of_day(spark: SparkSession, sf: str) -> DataFrame:
    days = checked_days(spark, sf)
    return rounded(feature_plans.features_of_day(days, dt.date(1997, 6, 2), AS_OF.date()), 2).drop("invalid_reason")


# ------------------------------------------------------------------ normalisation and training data


@query
def norm_params(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(normalize.fit_params(all_days(spark, sf), spec.FEATURES_BY_CHAIN), 3)


@query
def params_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Stored parameters as text: unreadable entries go, missing and infinite values count as 0."""
    stored = normalize.fit_params(stored_days(spark, sf), spec.FEATURES_BY_CHAIN).select(
        "chain", "feature", F.when(F.col("feature") == "fee_pressure", F.lit("broken")).otherwise(F.col("mean").cast("string")).alias("mean"),
        F.when(F.col("std") == 0, F.lit("Infinity")).otherwise(F.col("std").cast("string")).alias("std"),
    )
    return rounded(normalize.clean_params(stored), 3)


@query
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scaled(spark, sf), 6)


@query
def zscore_one_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters of one chain only: days of the other chain have no scaled values."""
    days = stored_days(spark, sf)
    params = normalize.fit_params(days, spec.FEATURES_BY_CHAIN).where("chain = 'BTC'")
    return rounded(normalize.transform(days, params, spec.ALL_FEATURES), 6)


@query
def zscore_inference_variant(spark: SparkSession, sf: str) -> DataFrame:
    days = stored_days(spark, sf)
    params = normalize.fit_params(days, spec.FEATURES_BY_CHAIN)
    out = normalize.transform_for_inference(days, params, spec.ALL_FEATURES)
    return rounded(out.select("chain", "date", *[F.col(n).cast("double").alias(n) for n in spec.ALL_FEATURES]), 4)


@query
def clean_training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """BTC with the fee rate as it is, ETH rows with a third of the gas prices taken out."""
    days = stored_days(spark, sf).select(
        "chain", "date", "whale_flow_1d", "active_addresses",
        F.when((F.col("chain") == "BTC") | (F.dayofmonth("date") % 3 != 0), F.coalesce("gas_price_median", "fee_pressure"))
        .alias("cost"),
    )
    return rounded(training_data.clean_training_rows(days, ["whale_flow_1d", "active_addresses", "cost"]), 4)


SPLIT = training_data.SplitDates(
    dt.date(1995, 1, 1), dt.date(1999, 12, 31), dt.date(2000, 1, 1), dt.date(2001, 12, 31)
)
ETH_SPLIT = training_data.SplitDates(
    dt.date(2024, 1, 1), dt.date(2024, 1, 6), dt.date(2024, 1, 7), dt.date(2024, 1, 31)
)


@query
def train_val_split(spark: SparkSession, sf: str) -> DataFrame:
    days = labelled_days(spark, sf)
    split = training_data.train_val_split(days.where("chain = 'BTC'"), SPLIT, dt.date(2001, 6, 30)).unionByName(
        training_data.train_val_split(days.where("chain = 'ETH'"), ETH_SPLIT))
    return rounded(split.select("chain", "date", "split", "target", "whale_flow_1d"), 4)


@query
def drawdown_label(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(training_data.drawdown_label(load(spark, sf, "prices")), 4)


@query
def daily_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(training_data.daily_returns(load(spark, sf, "prices")), 6)


@query
def netflow_7d(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(training_data.rolling_netflow(btc_days(spark, sf, ("exchange_netflow_7d",))), 3)


@query
def training_input_check(spark: SparkSession, sf: str) -> DataFrame:
    """Both chains, each with its own split dates and features."""
    parts = []
    for chain, dates in (("BTC", SPLIT), ("ETH", ETH_SPLIT)):
        mine = training_data.train_val_split(labelled_days(spark, sf).where(F.col("chain") == chain), dates)
        found = quality.training_input_problems(mine, "split", spec.FEATURES_BY_CHAIN[chain])
        parts.append(found.select(F.lit(chain).alias("chain"), *found.columns))
    return parts[0].unionByName(parts[1])


# ------------------------------------------------------------------ metrics


MODEL_KEYS = ["chain", "model_version"]


@query
def auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.roc_auc(load(spark, sf, "predictions"), MODEL_KEYS))


@query
def auc_overall(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.roc_auc(load(spark, sf, "predictions")))


@query
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(load(spark, sf, "predictions"), MODEL_KEYS)


@query
def precision_recall_f1(spark: SparkSession, sf: str) -> DataFrame:
    counts = metrics.confusion(load(spark, sf, "predictions"), MODEL_KEYS)
    return rounded(metrics.with_rates(counts)).select(*MODEL_KEYS, "precision", "recall", "f1")


@query
def drawdown_hitrate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.drawdown_hitrate(load(spark, sf, "predictions"), MODEL_KEYS, threshold=0.3))


def strategy_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Holding returns as baseline; the strategy is out of the market on days of a high score."""
    ret = training_data.daily_returns(load(spark, sf, "prices"))
    held = ret.join(load(spark, sf, "raw_scores"), ["chain", "date"])
    return held.withColumn("base_ret", F.col("ret")).withColumn(
        "ret", F.when(F.col("raw_score") >= 66, F.lit(0.0) * F.col("ret")).otherwise(F.col("ret"))
    )


@query
def sharpe(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.return_ratios(strategy_returns(spark, sf), ["chain"]).select("chain", "sharpe"), 5)


@query
def sortino(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.return_ratios(strategy_returns(spark, sf), ["chain"]).select("chain", "sortino"), 5)


@query
def sharpe_improvement(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.return_ratios(strategy_returns(spark, sf), ["chain"], base="base_ret"), 5)


@query
def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.evaluation_report(load(spark, sf, "predictions"), MODEL_KEYS))


@query
def evaluation_report_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Some versions with NaN scores, scores above 1 or labels of 2: no metrics, but what is wrong."""
    patch = F.split("model_version", r"\.")[2].cast("int")
    p = F.when((patch == 2) & (F.col("id") % 7 == 0), F.lit(float("nan"))).when((patch == 4) & (F.col("id") % 3 == 0), F.col("p") + 1)
    rows = load(spark, sf, "predictions").withColumns({
        "p": p.otherwise(F.col("p")), "y": F.when((patch == 4) & (F.col("id") % 7 == 1), F.lit(2)).otherwise(F.col("y")),
    })
    return rounded(metrics.evaluation_report(rows, MODEL_KEYS, with_reason=True))


@query
def metric_input_check(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "predictions").withColumn("p", F.when(F.col("id") % 7 == 0, F.col("p") * 1.5).otherwise(F.col("p")))
    return quality.metric_input_problems(p, MODEL_KEYS, "y", "p")


# ------------------------------------------------------------------ signals


@query
def risk_score_sanitised(spark: SparkSession, sf: str) -> DataFrame:
    score = F.when(F.dayofmonth("date") == 13, F.lit(float("nan"))).otherwise(F.col("raw_score") * 1.4 - 20)
    return load(spark, sf, "raw_scores").select("chain", "date", r(score_or_neutral(score)).alias("risk_score"))


@query
def risk_percent(spark: SparkSession, sf: str) -> DataFrame:
    """Model output to a score; the probability is cut to [0, 1] first."""
    p = load(spark, sf, "predictions").withColumn("p", F.col("p") * 1.3 - 0.1)
    return p.select("id", r(model.percent(F.col("p"))).alias("raw_score"))


@query
def feature_fallbacks(spark: SparkSession, sf: str) -> DataFrame:
    days = all_days(spark, sf)
    return days.select("chain", "date", *[r(feature_or_neutral(days, n)).alias(n) for n in ("mempool_stress", "gas_price_median", "absent")])


@query
def ewma_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(signals.backfill_scores(load(spark, sf, "raw_scores"), RULES)).select("chain", "date", "risk_score")


@query
def regimes(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "raw_scores").select("chain", "date", signals.regime(F.col("raw_score")).alias("regime"))


@query
def risk_states(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "raw_scores").select("chain", "date", signals.risk_state(F.col("raw_score")).alias("risk_state"))


@query
def whale_index(spark: SparkSession, sf: str) -> DataFrame:
    df = scaled(spark, sf)
    return df.select("chain", "date", r(signals.whale_index(df)).alias("whale_index"))


@query
def stress_index(spark: SparkSession, sf: str) -> DataFrame:
    df = scaled(spark, sf)
    return df.select("chain", "date", r(signals.stress_index(df)).alias("stress_index"))


@query
def momentum_score(spark: SparkSession, sf: str) -> DataFrame:
    df = scaled(spark, sf)
    return df.select("chain", "date", r(signals.momentum_score(df)).alias("momentum_score"))


def _history(spark: SparkSession, sf: str) -> DataFrame:
    scores = load(spark, sf, "raw_scores")
    s = score_or_neutral("raw_score")
    return scores.select(
        "chain", "date", s.alias("risk_score"), signals.regime(s).alias("regime"),
        F.lit(50.0).alias("whale_index"), F.lit(50.0).alias("momentum_score"), stored_at().alias("created_at"),
    )


@query
def hysteresis_step(spark: SparkSession, sf: str) -> DataFrame:
    df = signals.with_history(load(spark, sf, "raw_scores"), _history(spark, sf), RULES.history_days)
    s = signals.smoothed(score_or_neutral("raw_score"), RULES)
    df = df.withColumn("risk_score", s)
    s = F.col("risk_score")
    return df.select("chain", "date", r(s).alias("risk_score"),
                     signals.after_hysteresis(signals.regime(s), s, RULES).alias("regime"))


@query
def rate_limit_step(spark: SparkSession, sf: str) -> DataFrame:
    """Every day asks for a change to the regime of its own raw score."""
    df = signals.with_history(load(spark, sf, "raw_scores"), _history(spark, sf), RULES.history_days)
    df = df.withColumn("wanted", signals.regime(F.col("raw_score")))
    return df.select("chain", "date", "wanted", signals.after_rate_limit(F.col("wanted"), RULES).alias("regime"))


@query
def signal_step(spark: SparkSession, sf: str) -> DataFrame:
    targets = scored_days(spark, sf)
    return rounded(signals.signal_step(targets, sample_signals(targets), RULES))


@query
def signals_backfill(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(signals.backfill(scored_days(spark, sf), RULES, created_after_hours=27.0))


#: Late days that are computed again, oldest first; between them all days of both chains.
RERUNS = (dt.date(2000, 1, 1), dt.date(2024, 1, 20))


@query
def signals_rerun(spark: SparkSession, sf: str) -> DataFrame:
    """The series is stored with wrong scores on late days, which then are computed again on top of what is stored before."""
    targets, path = cut_lineage(scored_days(spark, sf)), work_folder(spark)
    late = (F.col("chain") == "BTC") & (F.col("date") >= F.lit(RERUNS[0])) | (F.col("date") >= F.lit(RERUNS[1]))
    wrong = targets.withColumn("raw_score", F.when(late, 100.0 - F.col("raw_score")).otherwise(F.col("raw_score")))
    first = signals.backfill(wrong, RULES, created_after_hours=27.0).withColumn("created_at", stored_at())
    snapshots.replace_days(first.select(*store.DAILY_SIGNALS.fieldNames()), path)
    for since, chain in zip(RERUNS, ("BTC", "ETH"), strict=True):
        inference.rerun_signals(spark, targets.where(F.col("chain") == chain), path, since, 27.0, RULES)
    return rounded(snapshots.read_days(spark, path, store.DAILY_SIGNALS).drop("created_at"))


@query
def alerts(spark: SparkSession, sf: str) -> DataFrame:
    return alert_ops.alert_rows(stored_signals(spark, sf), WHOLE_SERIES_GAP)


# ------------------------------------------------------------------ quality


@query
def violations_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Days since 2001 were stored twice; only days with a price are expected."""
    days = stored_days(spark, sf).withColumn(
        "close_price", F.when(F.col("gas_price_median") > 33, F.lit(float("inf"))).otherwise(F.col("gas_price_median"))
    )
    stored = days.unionByName(days.where(F.col("date") >= F.lit(dt.date(2001, 1, 1))))
    return quality.daily_violations(stored, load(spark, sf, "prices"))


@query
def feature_validity(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.feature_validity(all_days(spark, sf), spec.FEATURES_BY_CHAIN, bound=700000.0)
    return out.select("chain", "date", "is_valid", F.array_join("reasons", ",").alias("reasons"))


def damaged_signals(spark: SparkSession, sf: str) -> DataFrame:
    day = F.dayofmonth("date")
    return stored_signals(spark, sf).withColumns({
        "risk_score": F.when(day == 3, F.lit(None)).when(day == 4, F.col("risk_score") + 60).otherwise(F.col("risk_score")),
        "regime": F.when(day == 5, F.lit("Sideways")).otherwise(F.col("regime")),
        "risk_state": F.when(day == 6, F.lit(None)).otherwise(F.col("risk_state")),
        "chain": F.when(day == 7, F.lit("DOGE")).otherwise(F.col("chain")),
    })


@query
def violations_signals(spark: SparkSession, sf: str) -> DataFrame:
    return quality.signal_violations(damaged_signals(spark, sf), dt.date(2024, 1, 25))


@query
def signals_accepted(spark: SparkSession, sf: str) -> DataFrame:
    good = quality.valid_signals(damaged_signals(spark, sf), dt.date(2024, 1, 25))
    return rounded(good.select("chain", "date", "risk_score", "regime"))


@query
def violations_alerts(spark: SparkSession, sf: str) -> DataFrame:
    day = F.dayofmonth("date")
    damaged = stored_alerts(spark, sf).withColumns({
        "message": F.when(day % 3 == 0, F.lit(None)).otherwise(F.col("message")),
        "alert_type": F.when(day % 5 == 0, F.lit("noise")).otherwise(F.col("alert_type")),
    })
    return quality.alert_violations(damaged)


@query
def violations_performance(spark: SparkSession, sf: str) -> DataFrame:
    return quality.performance_violations(sample_performance(spark, sf).withColumn("auc", F.col("auc") * 1.6))


# ------------------------------------------------------------------ stored tables


STORED_TO, RERUN_FROM, TWICE_FROM = dt.date(2000, 6, 30), dt.date(2000, 1, 1), dt.date(2001, 1, 1)


def _since(df: DataFrame, day: dt.date) -> DataFrame:
    return df.where(F.col("date") >= F.lit(day))


def _revised(signal_rows: DataFrame) -> DataFrame:
    """A re-run of the days from 2000 on, done twice for those from 2001 on."""
    again = _since(signal_rows, RERUN_FROM).withColumn("created_at", stored_at(51))
    twice = _since(again, TWICE_FROM).withColumn("created_at", stored_at(75))
    return again.withColumn("risk_state", F.lit("Neutral")).unionByName(twice.withColumn("risk_state", F.lit("Risk OFF")))


@query
def upsert_signals(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored_signals(spark, sf)
    stored = rows.where(F.col("date") <= F.lit(STORED_TO))
    merged = store.upsert(stored, _revised(rows), ["chain", "date"], "created_at")
    return with_epoch(rounded(merged))


@query
def upsert_performance(spark: SparkSession, sf: str) -> DataFrame:
    perf = sample_performance(spark, sf)
    again = perf.withColumns({"hitrate": F.lit(0.5), "trained_at": F.timestamp_seconds(F.unix_seconds("trained_at") + 60)})
    merged = store.upsert(perf, again.where("model_version <> '1.0.3'"), ["chain", "model_version"], "trained_at")
    return with_epoch(rounded(merged), "trained_at")


@query
def insert_alerts(spark: SparkSession, sf: str) -> DataFrame:
    found = stored_alerts(spark, sf)
    stored = found.where(F.col("date") <= F.lit(STORED_TO))
    again = _since(found, RERUN_FROM).withColumn("created_at", stored_at(51))
    return with_epoch(store.insert_new(stored, again, ["id"], "created_at")).drop("id")


@query
def split_signal_alerts(spark: SparkSession, sf: str) -> DataFrame:
    targets = scored_days(spark, sf)
    nested = alert_ops.with_alerts(signals.signal_step(targets, sample_signals(targets), RULES))
    _, rows = store.split_signal(nested.withColumn("created_at", stored_at()))
    return with_epoch(rows).drop("id")


@query
def retention(spark: SparkSession, sf: str) -> DataFrame:
    kept = store.keep_since(all_days(spark, sf), dt.date(2000, 1, 1))
    return kept.groupBy("chain").agg(F.count("*").alias("n_days"), F.min("date").alias("first_day"))


@query
def retention_to_the_day(spark: SparkSession, sf: str) -> DataFrame:
    """Days are stored, those before a day within a month are dropped, and the table is read back."""
    path, days = work_folder(spark), select_expected(all_days(spark, sf), spec.ALL_FEATURES)
    snapshots.replace_days(days, path)
    snapshots.drop_before(spark, path, days.schema, dt.date(2000, 5, 17))
    return rounded(snapshots.read_days(spark, path, days.schema), 2)


@query
def atomic_replace(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of the stored days, read by number, beside a commit that was broken off."""
    path, days = work_folder(spark), cut_lineage(select_expected(all_days(spark, sf), spec.ALL_FEATURES))
    revised = _since(days, RERUN_FROM).withColumn("whale_flow_1d", F.col("whale_flow_1d") * 2)
    first = snapshots.replace_days(days, path)
    second = snapshots.replace_days(revised.where("day(date) <= 20"), path, RERUN_FROM)
    snapshots.write_parts(days.withColumn("whale_flow_1d", F.lit(-1.0)), path)  # never published
    both = [snapshots.read_days(spark, path, days.schema, version=v).withColumn("version", F.lit(n)) for n, v in ((1, first), (2, None))]
    assert snapshots.versions(spark, path) == [first, second]
    return rounded(both[0].unionByName(both[1]), 2)


# ------------------------------------------------------------------ reports


@query
def latest_signal(spark: SparkSession, sf: str) -> DataFrame:
    return with_epoch(rounded(reports.latest_signals(stored_signals(spark, sf), "BTC")))


@query
def latest_signal_with_alerts(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored_signals(spark, sf)
    return with_epoch(rounded(alert_text(reports.latest_response(rows, sample_alerts(rows), AS_OF, "ETH"))), "updated_at")


@query
def signal_history_with_alerts(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored_signals(spark, sf)
    out = reports.history_response(rows, sample_alerts(rows), dt.date(1997, 3, 1), dt.date(1999, 3, 1), AS_OF, "BTC")
    return with_epoch(rounded(alert_text(out)), "updated_at")


@query
def latest_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored_signals(spark, sf)
    return with_epoch(rounded(alert_text(reports.attach_alerts(reports.latest_signals(rows), sample_alerts(rows)))))


@query
def signal_history(spark: SparkSession, sf: str) -> DataFrame:
    out = reports.signal_history(stored_signals(spark, sf), dt.date(1997, 3, 1), dt.date(1999, 3, 1), AS_OF.date(), "BTC")
    return with_epoch(rounded(out))


@query
def last_n_signals(spark: SparkSession, sf: str) -> DataFrame:
    return with_epoch(rounded(reports.last_n_signals(stored_signals(spark, sf), 30)))


@query
def signals_with_alerts(spark: SparkSession, sf: str) -> DataFrame:
    day = F.dayofmonth("date")
    rows = stored_signals(spark, sf)
    found = sample_alerts(rows).withColumn("message", F.when(day % 2 == 0, F.col("message")))
    rows = rows.withColumn("created_at", F.when(day % 4 != 0, F.col("created_at")))
    return with_epoch(rounded(alert_text(reports.signal_response(rows, found, AS_OF))), "updated_at")


@query
def alerts_for_date(spark: SparkSession, sf: str) -> DataFrame:
    found = stored_alerts(spark, sf)
    busiest = found.groupBy("date").agg(F.count("*").alias("n")).agg(F.max_by("date", F.struct("n", "date")).alias("date"))
    return with_epoch(found.join(busiest, "date", "left_semi")).drop("id")


@query
def alerts_on_fixed_date(spark: SparkSession, sf: str) -> DataFrame:
    day = reports.alerts_for_date(stored_alerts(spark, sf), dt.date(2024, 1, 17), AS_OF, alert_type="regime_shift")
    return with_epoch(day).drop("id")


@query
def recent_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return with_epoch(reports.recent_alerts(stored_alerts(spark, sf), AS_OF, days=30, chain="ETH", limit=20)).drop("id")


@query
def recent_alerts_cut(spark: SparkSession, sf: str) -> DataFrame:
    """The first five of more alerts than that."""
    return with_epoch(reports.recent_alerts(stored_alerts(spark, sf), AS_OF, days=30, limit=5)).drop("id")


@query
def finite_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Days of a chain whose features are all finite numbers."""
    days = stored_days(spark, sf)
    parts = [quality.finite_vectors(days.where(F.col("chain") == c), names) for c, names in spec.FEATURES_BY_CHAIN.items()]
    return parts[0].unionByName(parts[1]).select("chain", "date")


@query
def bad_params(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that the strict reading refuses, of parameters without a mean for one feature and with an infinite deviation."""
    params = normalize.fit_params(stored_days(spark, sf), spec.FEATURES_BY_CHAIN).select(
        "chain", "feature", F.when(F.col("feature") != "fee_pressure", F.col("mean")).alias("mean"),
        F.when(F.col("std") == 0, F.lit(float("inf"))).otherwise(F.col("std")).alias("std"))
    return normalize.bad_params(params)


@query
def alert_readiness(spark: SparkSession, sf: str) -> DataFrame:
    days = whole_spine(spark, sf)
    return reports.readiness(days, stored_alerts(spark, sf), dt.datetime(2024, 1, 29, 2, 30))


@query
def alerts_today(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored_signals(spark, sf)
    today = reports.alerts_today(sample_alerts(rows), rows, dt.datetime(2024, 1, 17, 2, 30))
    return with_epoch(today).drop("id")


@query
def latest_model(spark: SparkSession, sf: str) -> DataFrame:
    return with_epoch(rounded(reports.latest_models(sample_performance(spark, sf))), "trained_at")


@query
def active_model(spark: SparkSession, sf: str) -> DataFrame:
    out = model.active_models(sample_performance(spark, sf), 0.6)
    return with_epoch(rounded(out), "trained_at")


@query
def next_version(spark: SparkSession, sf: str) -> DataFrame:
    chains = reports.chain_dimension(spark, ("BTC", "ETH", "SOL"))
    return model.next_versions(sample_performance(spark, sf), chains)


@query
def chain_status(spark: SparkSession, sf: str) -> DataFrame:
    chains = reports.chain_dimension(spark)
    out = reports.chain_status(chains, stored_signals(spark, sf), sample_performance(spark, sf), AS_OF)
    return with_epoch(rounded(out), "last_model_trained_at")


@query
def chain_list(spark: SparkSession, sf: str) -> DataFrame:
    chains = reports.chain_dimension(spark)
    as_of = dt.datetime(2024, 1, 31, 0, 0)
    return reports.chain_list(
        reports.chain_status(chains, stored_signals(spark, sf), sample_performance(spark, sf), as_of)
    )


@query
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    return reports.service_freshness(stored_signals(spark, sf), AS_OF, "ETH")


# ------------------------------------------------------------------ model


TREES = model.ModelConfig(trees=8, max_depth=4, chunk=4)
SIDES = {"BTC": SPLIT, "ETH": ETH_SPLIT}


@query
def train_score(spark: SparkSession, sf: str) -> DataFrame:
    """Fits on the train days of each chain and scores its validation days: a score is finite and in [0, 100]."""
    days = cut_lineage(labelled_days(spark, sf))
    done = training.at_once(lambda c: training.train_chain(days, c, spec.FEATURES_BY_CHAIN[c], SIDES[c], TREES).validation, list(SIDES))
    sound = F.coalesce(F.col("raw_score").between(0.0, 100.0), F.lit(False)) & ~F.isnan("raw_score")
    picked = [p.select("chain", "date", F.col("y").cast("int").alias("y"), sound.alias("score_ok")) for p in done.values()]
    return raw.union_by_name(*picked)


def train_days_learnt(scored: DataFrame, auc: float | None, few: int = 100) -> tuple[int, bool]:
    """Number of train days, and whether their scores show the labels; days of one label, which has no AUC, are all scored on its side.

    Fewer than ``few`` days count as learnt without being judged; 0 judges any number of them.
    """
    own_side = F.coalesce((F.col("raw_score") > 50.0) == (F.col("target") == 1), F.lit(False))
    days = scored.where("split = 'train'").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("target").alias("labels"), F.count_if(own_side).alias("own_side")).first()
    if days["n"] < few:
        return days["n"], True
    return days["n"], days["own_side"] == days["n"] if days["labels"] == 1 else auc is not None and auc > 0.65


@query
def training_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """What the fits of both chains show: they separate their train days, stop in time and keep the best trees."""
    days = cut_lineage(labelled_days(spark, sf))
    config = model.ModelConfig(trees=12, max_depth=4, learning_rate=0.3, chunk=3, patience=3)

    def shown(chain: str) -> DataFrame:
        names, dates = spec.FEATURES_BY_CHAIN[chain], SIDES[chain]
        split = cut_lineage(training_data.train_val_split(days.where(F.col("chain") == chain), dates))
        fitted, params = training.prepare(split, names)
        fitted = cut_lineage(fitted)
        boosting = model.boost(fitted, names, config)
        kept = model.best_iteration(boosting.model)
        scored = model.risk_scores(boosting.model, fitted)
        auc = metrics.roc_auc(scored.withColumns({"y": F.col("target"), "p": F.col("raw_score") / 100.0}), ["chain", "split"])
        by_side = {r["split"]: r["auc"] for r in auc.collect()}
        again, judged = boosting.aucs[kept - 1], by_side.get("validation")
        n_train, learns = train_days_learnt(scored, by_side.get("train"), few=0)
        row = (
            chain, n_train, params.count(), learns,
            again is None or (judged is not None and abs(again - judged) < 1e-9), kept == (model.best_prefix(boosting.aucs, 3) or boosting.fitted),
            boosting.fitted <= kept + config.patience + config.chunk)
        return spark.createDataFrame([row], "chain string, n_train long, n_params long, learns boolean, same_auc boolean, keeps_best boolean, stops boolean")

    return raw.union_by_name(*training.at_once(shown, list(SIDES)).values())
