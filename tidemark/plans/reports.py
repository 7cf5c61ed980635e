"""Read-side queries over the stored signals, alerts and model metrics.

``as_of`` stands for the current time, so every report can be repeated.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import spec
from tidemark.functions.values import check_chain, check_date_range, epoch_seconds, instant, midnight_epoch
from tidemark.sources.store import last_rows, latest_per_key


def latest_signals(signals: DataFrame, chain: str | None = None) -> DataFrame:
    """Newest signal per chain; chains without signals are absent."""
    if chain is not None:
        return signals.where(F.col("chain") == check_chain(chain)).orderBy(F.desc("date")).limit(1)
    return latest_per_key(signals, ["chain"], "date")


def signal_history(signals: DataFrame, start: dt.date, end: dt.date, today: dt.date, chain: str | None = None) -> DataFrame:
    start, end = check_date_range(start, end, today)
    out = signals.where(F.col("date").between(F.lit(start), F.lit(end)))
    if chain is not None:
        out = out.where(F.col("chain") == check_chain(chain))
    return out.orderBy("chain", "date")


def last_n_signals(signals: DataFrame, n: int = 30) -> DataFrame:
    return last_rows(signals, n).orderBy("chain", F.desc("date"))


def attach_alerts(signals: DataFrame, alerts: DataFrame) -> DataFrame:
    """Adds ``alerts``, the day's alerts oldest first (at most one per type); empty when none."""
    entry = F.struct("created_at", "id", "alert_type", F.coalesce("message", F.lit("")).alias("message"))
    nested = alerts.groupBy("chain", "date").agg(F.sort_array(F.collect_list(entry)).alias("alerts"))
    out = signals.join(nested, ["chain", "date"], "left")
    empty = F.array().cast(nested.schema["alerts"].dataType)
    return out.withColumn("alerts", F.coalesce("alerts", empty))


def signal_response(signals: DataFrame, alerts: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Signals in response form: nested alerts, updated_at falls back to as_of.

    A regime or risk state outside its allowed set shows as NULL.
    """
    known = {
        n: F.when(F.col(n).isin(*allowed), F.col(n))
        for n, allowed in (("regime", spec.REGIMES), ("risk_state", spec.RISK_STATES))
    }
    updated = F.coalesce(F.col("created_at"), instant(as_of))
    return attach_alerts(signals.withColumns(known), alerts).withColumn("updated_at", updated).drop("created_at")


def latest_response(signals: DataFrame, alerts: DataFrame, as_of: dt.datetime, chain: str) -> DataFrame:
    """The newest signal of a chain in response form, with the alerts of its day."""
    return signal_response(latest_signals(signals, chain), alerts, as_of)


def history_response(signals: DataFrame, alerts: DataFrame, start: dt.date, end: dt.date, as_of: dt.datetime, chain: str) -> DataFrame:
    """Signals of a chain and range in response form, oldest first, each with its alerts and ``n_signals``, the rows of the range."""
    rows = signal_history(signals, start, end, as_of.date(), chain)
    rows = rows.withColumn("n_signals", F.count(F.lit(1)).over(Window.partitionBy("chain")))
    return signal_response(rows, alerts, as_of).orderBy("chain", "date")


def _filtered(alerts: DataFrame, chain: str | None, alert_type: str | None) -> DataFrame:
    if chain is not None:
        alerts = alerts.where(F.col("chain") == check_chain(chain))
    if alert_type is not None:
        if alert_type not in spec.ALERT_TYPES:
            raise ValueError(f"unknown alert type {alert_type!r}")
        alerts = alerts.where(F.col("alert_type") == alert_type)
    return alerts


def alerts_for_date(alerts: DataFrame, date: dt.date, as_of: dt.datetime, chain: str | None = None,
                    alert_type: str | None = None) -> DataFrame:
    if date > as_of.date():
        raise ValueError("the date lies in the future")
    return _filtered(alerts, chain, alert_type).where(F.col("date") == F.lit(date)).orderBy("created_at", "id")


def recent_alerts(alerts: DataFrame, as_of: dt.datetime, days: int = spec.DEFAULT_ALERT_DAYS, chain: str | None = None,
                  alert_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Alerts of the last calendar days, today included, newest first; all of them, or the first ``limit``."""
    if not 1 <= days <= spec.MAX_ALERT_HISTORY_DAYS:
        raise ValueError(f"days must be in 1..{spec.MAX_ALERT_HISTORY_DAYS}")
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    today = as_of.date()
    window = F.col("date").between(F.lit(today - dt.timedelta(days=days - 1)), F.lit(today))
    out = _filtered(alerts, chain, alert_type).where(window)
    out = out.orderBy(F.desc("date"), F.desc("created_at"), "chain", "alert_type")
    return out if limit is None else out.limit(limit)


def readiness(days: DataFrame, processed: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Whether the alerts of each asked day are final.

    ``processed`` holds the days that went through: the signal table. Passing the alerts table
    instead treats a quiet day as not processed.
    """
    today = F.lit(as_of.date())
    have = processed.select("date").distinct().withColumn("_done", F.lit(True))
    status = (
        F.when(F.col("date") > today, F.lit("future"))
        .when((F.col("date") == today) & F.lit(as_of.hour < spec.READY_HOUR_UTC), F.lit("too_early"))
        .when((F.col("date") == today) & F.col("_done").isNull(), F.lit("not_processed"))
        .otherwise(F.lit("ready"))
    )
    return days.select("date").distinct().join(have, "date", "left").select("date", status.alias("readiness"))


def alerts_today(alerts: DataFrame, processed: DataFrame, as_of: dt.datetime, chain: str | None = None,
                 alert_type: str | None = None) -> DataFrame:
    """Alerts of the current day; empty while ``readiness`` does not call the day ready."""
    today = alerts_for_date(alerts, as_of.date(), as_of, chain, alert_type)
    ready = readiness(today, processed, as_of).where(F.col("readiness") == "ready").select("date")
    return today.join(ready, "date", "left_semi").orderBy("created_at", "id")


def latest_models(performance: DataFrame) -> DataFrame:
    return latest_per_key(performance, ["chain"], "trained_at")


def chain_dimension(spark: SparkSession, chains: Sequence[str] = spec.CHAINS) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in chains])).alias("chain"))


def age_hours(date: Column, as_of: dt.datetime) -> Column:
    """Hours from 00:00 UTC of the signal date."""
    return (F.lit(epoch_seconds(as_of)) - midnight_epoch(date)) / F.lit(3600.0)


def _freshness(age: Column) -> Column:
    return (
        F.when(age <= spec.HEALTHY_HOURS, F.lit("healthy"))
        .when(age <= spec.DEGRADED_HOURS, F.lit("degraded"))
        .otherwise(F.lit("unhealthy"))
    )


def chain_status(chains: DataFrame, signals: DataFrame, performance: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Latest signal, latest model and status of every chain."""
    signal = latest_signals(signals).select(
        "chain", F.col("date").alias("latest_signal_date"), F.col("risk_score").alias("latest_risk_score"),
        F.when(F.col("regime").isin(*spec.REGIMES), F.col("regime")).alias("latest_regime"),
    )
    model = latest_models(performance).select(
        "chain", "model_version", F.col("trained_at").alias("last_model_trained_at"), F.lit(True).alias("_model")
    )
    lacking = F.col("latest_signal_date").isNull() | F.col("_model").isNull()
    status = F.when(lacking, F.lit("unhealthy")).otherwise(_freshness(age_hours(F.col("latest_signal_date"), as_of)))
    return (
        chains.join(signal, "chain", "left")
        .join(model, "chain", "left")
        .withColumn("status", status)
        .drop("_model")
    )


def chain_list(status: DataFrame) -> DataFrame:
    return status.select("chain", "latest_signal_date", "status").orderBy("chain")


def service_freshness(signals: DataFrame, as_of: dt.datetime, chain: str = "BTC") -> DataFrame:
    """Age and status of one chain's newest signal; without any signal the service is degraded."""
    newest = signals.where(F.col("chain") == check_chain(chain)).agg(F.max("date").alias("_d"))
    age = age_hours(F.col("_d"), as_of)
    return newest.select(
        age.alias("latest_signal_age_hours"),
        F.when(F.col("_d").isNull(), F.lit("degraded")).otherwise(_freshness(age)).alias("status"),
    )
