"""Alerts from a day's signal and the signal row before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import spec

_PREVIOUS = ("whale_index", "momentum_score", "regime")


def with_previous(signals: DataFrame, max_gap_days: int | None = None) -> DataFrame:
    """Adds prev_* from the previous row of the chain, if it is not too old."""
    series = Window.partitionBy("chain").orderBy("date")
    recent = F.lit(True)
    if max_gap_days is not None:
        recent = F.datediff(F.col("date"), F.lag("date").over(series)) <= max_gap_days
    return signals.withColumns({f"prev_{n}": F.when(recent, F.lag(n).over(series)) for n in _PREVIOUS})


def _alert(kind: str, condition: Column, *values: Column) -> Column:
    message = F.format_string(spec.ALERT_MESSAGES[kind], *values)
    return F.when(condition, F.struct(F.lit(kind).alias("alert_type"), message.alias("message")))


def alert_array() -> Column:
    """The 0 to 4 alerts of a row that has prev_* columns, in fixed order."""
    whale = F.col("whale_index") - F.col("prev_whale_index")
    stress = F.col("stress_index")
    drop = F.col("prev_momentum_score") - F.col("momentum_score")
    before, now = F.col("prev_regime"), F.col("regime")
    return F.array_compact(F.array(
        _alert("whale_spike", whale > spec.WHALE_SPIKE_POINTS, whale),
        _alert("stress_event", stress > spec.STRESS_LEVEL, stress),
        _alert("momentum_collapse", drop > spec.MOMENTUM_DROP_POINTS, drop),
        _alert("regime_shift", before != now, before, now),
    ))


def with_alerts(step: DataFrame) -> DataFrame:
    """Signal rows with nested ``alerts``, from rows with prev_* columns."""
    return step.withColumn("alerts", alert_array()).drop(*[f"prev_{n}" for n in _PREVIOUS])


def alert_rows(signals: DataFrame, max_gap_days: int | None = None) -> DataFrame:
    """One row per alert (chain, date, alert_type, message) of a series of signals."""
    return with_previous(signals, max_gap_days).select(
        "chain", "date", F.explode(alert_array()).alias("a")
    ).select("chain", "date", "a.alert_type", "a.message")
