"""Daily inference: features to scaled vectors, risk score, signal, alerts, stored rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import spec
from tidemark.functions.lineage import cut_lineage
from tidemark.functions.values import check_chain, instant, midnight_epoch
from tidemark.operators.alerts import with_alerts
from tidemark.operators.model import active_models, load_model, risk_scores
from tidemark.operators.normalize import load_params, transform_for_inference
from tidemark.operators.quality import finite_vectors, valid_signals
from tidemark.operators.signals import SignalRules, resumed, signal_step
from tidemark.sources import snapshots, store
from tidemark.sources.raw import union_by_name


def pending(features: DataFrame, date: dt.date, chains: Sequence[str] = spec.CHAINS) -> DataFrame:
    """The rows of one run: the chosen chains on the target date."""
    names = [check_chain(c) for c in chains]
    return features.where(F.col("chain").isin(*names) & (F.col("date") == F.lit(date)))


def score_days(
    features: DataFrame, params: DataFrame, models: Mapping[str, PipelineModel],
    names: Mapping[str, Sequence[str]] = spec.FEATURES_BY_CHAIN,
) -> DataFrame:
    """Raw risk score of every given (chain, date) with a complete feature vector."""
    parts = []
    for chain, model in models.items():
        mine = features.where(F.col("chain") == chain)
        scaled = transform_for_inference(mine, params, names[chain])
        parts.append(risk_scores(model, finite_vectors(scaled, names[chain])).select("chain", "date", "raw_score"))
    return union_by_name(*parts)


def daily_signals(
    features: DataFrame, scores: DataFrame, history: DataFrame, created_at: dt.datetime,
    rules: SignalRules = SignalRules(),
) -> DataFrame:
    """Signals with nested alerts of the scored days; days without a score are left out."""
    targets = features.join(scores, ["chain", "date"])
    return with_alerts(signal_step(targets, history, rules)).withColumn("created_at", instant(created_at))


def load_active(
    spark: SparkSession, root: str, chains: Sequence[str] = spec.CHAINS
) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Models and scaling parameters of the version in production, per chain that has one."""
    registry = active_models(store.read_table(spark, root, "performance_summary"))
    names = [check_chain(c) for c in chains]
    active = {r["chain"]: r["model_version"] for r in registry.where(F.col("chain").isin(*names)).collect()}
    if not active:
        raise ValueError("no chain has a model in production")
    models = {c: load_model(f"{root}/models", c, v) for c, v in active.items()}
    params = [load_params(spark, f"{root}/norm_params/{c.lower()}", v) for c, v in active.items()]
    return models, union_by_name(*params)


def run_inference(
    spark: SparkSession, features: DataFrame, params: DataFrame, models: Mapping[str, PipelineModel], root: str,
    date: dt.date, created_at: dt.datetime, rules: SignalRules = SignalRules(),
) -> DataFrame:
    """Scores one date for all chains that have a model and stores signals and alerts.

    Returns (chain, stored): chains without a usable feature vector show false.
    """
    if date > created_at.date():
        raise ValueError("the target date lies in the future")
    store.create_tables(spark, root)
    wanted = pending(features, date, list(models))
    history = store.read_table(spark, root, "daily_signals").where(
        F.col("date").between(F.date_sub(F.lit(date), rules.history_days), F.date_sub(F.lit(date), 1))
    )
    signals = daily_signals(wanted, score_days(wanted, params, models), history, created_at, rules)
    rows, _ = store.split_signal(signals)
    good = valid_signals(rows, created_at.date())
    kept = signals.join(good.select("chain", "date"), ["chain", "date"], "left_semi")
    # the plan reads the table its rows go to: fix the rows before that table changes
    kept = cut_lineage(kept)
    rows, alerts = store.split_signal(kept)
    stored = [r["chain"] for r in rows.select("chain").distinct().collect()]
    store.write_rows(spark, root, "daily_signals", rows)
    if not alerts.isEmpty():
        store.write_rows(spark, root, "alerts", alerts)
    chains = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in models])).alias("chain"))
    return chains.withColumn("stored", F.col("chain").isin(*stored) if stored else F.lit(False))


def rerun_signals(
    spark: SparkSession, targets: DataFrame, path: str, since: dt.date, created_after_hours: float,
    rules: SignalRules = SignalRules(), as_of: dt.date | None = None,
) -> int:
    """Computes the days from ``since`` on again, on top of the signals stored before, and replaces them.

    ``targets``: chain, date, raw_score and features of the days to compute; ``path``: a table of
    ``sources.snapshots``. All chains and days are one plan and one commit: a run that fails leaves the
    stored version. Days stored after ``since`` that the run does not compute go. Returns the version.
    """
    lookback = since - dt.timedelta(days=rules.history_days)
    stored = snapshots.read_days(spark, path, store.DAILY_SIGNALS, lookback, since - dt.timedelta(days=1))
    days = resumed(targets, stored, since, rules, created_after_hours=created_after_hours)
    stored_at = F.timestamp_seconds(midnight_epoch(F.col("date")) + F.lit(int(created_after_hours * 3600)))
    rows = days.withColumn("created_at", stored_at).select(*store.DAILY_SIGNALS.fieldNames())
    good, _ = store.accepted("daily_signals", rows, as_of)
    return snapshots.replace_days(cut_lineage(good), path, since)
