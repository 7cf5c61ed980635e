"""Data-quality rules. A broken rule is a row of a violations table, never an exception."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemark import spec
from tidemark.functions.values import finite_or_null, known_chain
from tidemark.operators.features import KEY


def is_critical(name: str) -> bool:
    """Columns that must never be missing, told by their name."""
    return any(part in name.lower() for part in spec.CRITICAL_NAME_PARTS)


def _violation(rule: str, column: str, severity: str) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"), F.lit(column).alias("column_name"), F.lit(severity).alias("severity")
    )


def _explode_violations(df: DataFrame, found: list[Column]) -> DataFrame:
    return df.select(*KEY, F.explode(F.array_compact(F.array(*found))).alias("v")).select(
        *KEY, "v.rule", "v.column_name", "v.severity"
    )


def daily_violations(df: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Violations of daily aggregates as (chain, date, rule, column_name, severity).

    not_one_row: a day with several rows, or with none when ``expected`` lists the days.
    unexpected_date: a row for a day that is not expected.
    missing_value: NULL or NaN; an error in critical columns, else a warning.
    infinite_value: always an error.
    """
    columns = [f.name for f in df.schema.fields if f.name not in KEY and isinstance(f.dataType, NumericType)]
    found = []
    for name in columns:
        value = F.col(name).cast("double")
        missing = value.isNull() | F.isnan(value)
        severity = "error" if is_critical(name) else "warning"
        found.append(F.when(missing, _violation("missing_value", name, severity)))
        found.append(F.when(F.abs(value) == F.lit(float("inf")), _violation("infinite_value", name, "error")))
    counts = df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    if expected is not None:
        counts = counts.withColumn("_have", F.lit(True)).join(
            expected.select(*KEY).withColumn("_want", F.lit(True)), KEY, "full_outer"
        )
        checks = [
            F.when(F.col("_want") & (F.coalesce("_n", F.lit(0)) != 1), _violation("not_one_row", "", "error")),
            F.when(F.col("_have") & F.col("_want").isNull(), _violation("unexpected_date", "date", "error")),
        ]
    else:
        checks = [F.when(F.col("_n") != 1, _violation("not_one_row", "", "error"))]
    return _explode_violations(counts, checks).unionByName(_explode_violations(df, found))


def feature_validity(
    df: DataFrame, names_by_chain: Mapping[str, Sequence[str]], bound: float = spec.FEATURE_BOUND
) -> DataFrame:
    """Adds ``reasons`` and ``is_valid`` per feature vector, judged by the features of its chain."""
    reasons = []
    have = {c for c in df.columns if c not in KEY}
    all_expected = {n for names in names_by_chain.values() for n in names}
    for chain, names in names_by_chain.items():
        mine = F.col("chain") == chain
        for name in names:
            if name not in have:
                reasons.append(F.when(mine, F.lit(f"absent:{name}")))
                continue
            value = finite_or_null(name)
            reasons.append(F.when(mine & value.isNull(), F.lit(f"not_finite:{name}")))
            reasons.append(F.when(mine & (F.abs(value) > F.lit(bound)), F.lit(f"out_of_bounds:{name}")))
    for name in sorted(have - all_expected):
        reasons.append(F.lit(f"extra:{name}"))
    reasons.append(F.when(~F.col("chain").isin(*names_by_chain), F.lit("unknown_chain")))
    out = df.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return out.withColumn("is_valid", F.size("reasons") == 0)


def finite_vectors(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows whose features are all finite numbers (the strict check before scoring)."""
    return df.where(reduce(Column.__and__, [finite_or_null(n).isNotNull() for n in names]))


def _signal_rules(as_of: dt.date | None) -> list[Column]:
    found = [F.when(~F.coalesce(known_chain("chain"), F.lit(False)), _violation("unknown_chain", "chain", "error"))]
    if as_of is not None:
        found.append(F.when(F.col("date") > F.lit(as_of), _violation("future_date", "date", "error")))
    for name in ("risk_score", "whale_index", "stress_index", "momentum_score"):
        value = finite_or_null(name)
        found.append(F.when(value.isNull(), _violation("not_finite", name, "error")))
        found.append(F.when(~value.between(0.0, 100.0), _violation("out_of_range", name, "error")))
    for name, allowed in (("regime", spec.REGIMES), ("risk_state", spec.RISK_STATES)):
        known = F.coalesce(F.col(name).isin(*allowed), F.lit(False))
        found.append(F.when(~known, _violation("unknown_value", name, "error")))
    return found


def signal_violations(signals: DataFrame, as_of: dt.date) -> DataFrame:
    """Reasons a signal row must not be stored."""
    return _explode_violations(signals, _signal_rules(as_of))


def broken_rules(table: str, as_of: dt.date | None = None) -> Column:
    """Whether a row of a stored table breaks a rule of its table."""
    rules = {
        "daily_signals": lambda: [F.when(~_sound_signal(as_of) | F.col("date").isNull(), F.lit("signal"))],
        "performance_summary": lambda: [*_performance_rules(), *[F.when(F.col(n).isNull(), F.lit(n)) for n in ("chain", "model_version")]],
        "alerts": _alert_rules,
    }[table]()
    return reduce(Column.__or__, [rule.isNotNull() for rule in rules])


def valid_signals(signals: DataFrame, as_of: dt.date) -> DataFrame:
    """Rows that keep every rule of ``signal_violations``."""
    return signals.where(_sound_signal(as_of))


def _sound_signal(as_of: dt.date | None) -> Column:
    kept = [known_chain("chain"), *[F.col(n).between(0.0, 100.0) for n in ("risk_score", "whale_index", "stress_index", "momentum_score")]]
    kept += [F.col("regime").isin(*spec.REGIMES), F.col("risk_state").isin(*spec.RISK_STATES)]
    if as_of is not None:
        kept.append(F.col("date").isNull() | (F.col("date") <= F.lit(as_of)))
    return F.coalesce(reduce(Column.__and__, kept), F.lit(False))


def _performance_rules() -> list[Column]:
    return [F.when(F.isnan(n) | ~F.col(n).between(0.0, 1.0), F.lit(n)) for n in ("auc", "hitrate")]


def performance_violations(perf: DataFrame) -> DataFrame:
    """Metric rows whose auc or hitrate is a number outside [0, 1]."""
    return perf.select(
        "chain", "model_version", F.explode(F.array_compact(F.array(*_performance_rules()))).alias("column_name")
    )


def _alert_rules() -> list[Column]:
    found = [
        F.when(F.col(n).isNull(), _violation("missing_value", n, "error"))
        for n in ("id", "chain", "date", "alert_type", "message", "created_at")
    ]
    found.append(F.when(~known_chain("chain"), _violation("unknown_value", "chain", "error")))
    found.append(F.when(~F.col("alert_type").isin(*spec.ALERT_TYPES), _violation("unknown_value", "alert_type", "error")))
    return found


def alert_violations(alerts: DataFrame) -> DataFrame:
    """Alert rows that lack a field or hold a value outside its allowed set."""
    return _explode_violations(alerts, _alert_rules())


def input_problems(label: str, score: str) -> dict[str, Column]:
    """Aggregates: rows of a group that make a metric undefined, by what is wrong with them."""
    y, p = finite_or_null(label), finite_or_null(score)
    return {
        "bad_label": F.count_if(y.isNull()),
        "non_binary_label": F.count_if(~y.isin(0.0, 1.0)),
        "bad_score": F.count_if(p.isNull()),
        "score_out_of_range": F.count_if(~p.between(0.0, 1.0)),
    }


def metric_input_problems(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Counts of rows that make a metric undefined; all zero and n_rows > 0 means usable."""
    found = input_problems(label, score)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[c.alias(n) for n, c in found.items()])
    problems = sum((F.col(c) for c in found), F.lit(0))
    return out.withColumn("is_usable", (F.col("n_rows") > 0) & (problems == 0))


def training_input_problems(df: DataFrame, split: str, names: Sequence[str]) -> DataFrame:
    """Row and complete-row counts per split; an absent split is an empty one."""
    complete = reduce(Column.__and__, [finite_or_null(n).isNotNull() for n in names])
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(complete).alias("n_complete")
    ).withColumn("n_features", F.lit(len(names)))
