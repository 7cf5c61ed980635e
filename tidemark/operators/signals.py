"""Raw risk scores to daily signals: smoothing, regimes with hysteresis and rate limit, indices.

Today's signal depends on the signals stored before it. ``signal_step`` takes those as a table
and is a join; ``backfill`` recomputes whole series and carries the state along each chain.
"""

from __future__ import annotations

import datetime as dt
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import spec
from tidemark.functions.values import (
    clamp_0_100, feature_or_neutral, finite_or_null, midnight_epoch, score_or_neutral, squash,
)

KEY = ["chain", "date"]


@dataclass(frozen=True)
class SignalRules:
    smoothing_days: int = spec.SMOOTHING_DAYS
    hysteresis_points: float = spec.HYSTERESIS_POINTS
    min_change_hours: int = spec.MIN_REGIME_CHANGE_HOURS

    @property
    def alpha(self) -> float:
        return 2.0 / (max(1, self.smoothing_days) + 1.0)

    @property
    def change_hours(self) -> int:
        return max(0, int(self.min_change_hours))

    @property
    def history_days(self) -> int:
        return max(1, self.smoothing_days) * spec.HISTORY_DAYS_PER_SMOOTHING_DAY


def regime(score: Column) -> Column:
    return F.when(score < spec.NEUTRAL_FROM, F.lit("Bull")).when(score < spec.BEAR_FROM, F.lit("Neutral")).otherwise(
        F.lit("Bear")
    )


def risk_state(score: Column) -> Column:
    return (
        F.when(score < spec.RISK_NEUTRAL_FROM, F.lit("Risk ON"))
        .when(score < spec.RISK_OFF_FROM, F.lit("Neutral"))
        .otherwise(F.lit("Risk OFF"))
    )


def whale_index(df: DataFrame) -> Column:
    outflow = F.greatest(F.lit(0.0), -feature_or_neutral(df, "exchange_netflow_7d"))
    return squash(F.abs(feature_or_neutral(df, "whale_flow_1d")) + outflow)


def stress_index(df: DataFrame) -> Column:
    fees = feature_or_neutral(df, "mempool_stress") + feature_or_neutral(df, "fee_pressure")
    gas = feature_or_neutral(df, "gas_price_median")
    if {"mempool_stress", "fee_pressure"} & set(df.columns):
        other = fees
    elif "gas_price_median" in df.columns:
        other = gas
    else:
        other = F.lit(spec.NEUTRAL_SCORE)
    return squash(F.when(F.col("chain") == "BTC", fees).when(F.col("chain") == "ETH", gas).otherwise(other))


def momentum_score(df: DataFrame) -> Column:
    active = feature_or_neutral(df, "active_addresses")
    aged = active - feature_or_neutral(df, "utxo_age_1y")
    calls = active + feature_or_neutral(df, "smart_contract_calls")
    if "utxo_age_1y" in df.columns:
        other = aged
    elif "smart_contract_calls" in df.columns:
        other = calls
    else:
        other = active
    return squash(F.when(F.col("chain") == "BTC", aged).when(F.col("chain") == "ETH", calls).otherwise(other))


def indices(df: DataFrame) -> dict[str, Column]:
    return {
        "whale_index": whale_index(df), "stress_index": stress_index(df), "momentum_score": momentum_score(df),
    }


def stateless_signals(df: DataFrame, score: str = "raw_score") -> DataFrame:
    """Signals as if every day were the first of its series."""
    s = score_or_neutral(score)
    return df.select(*KEY, s.alias("risk_score"), regime(s).alias("regime"), risk_state(s).alias("risk_state"),
                     *[c.alias(n) for n, c in indices(df).items()])


def with_history(targets: DataFrame, history: DataFrame, days: int) -> DataFrame:
    """Adds ``hist``: stored signals of the look-back before each target day, newest first.

    The look-back is spelled out as one row per day and met by an equi-join, so no range join
    is needed and an array never holds more than ``days`` entries.
    """
    stored_at = (
        F.coalesce(F.unix_seconds(F.col("created_at").cast("timestamp")), midnight_epoch(F.col("date")))
        if "created_at" in history.columns
        else midnight_epoch(F.col("date"))
    )
    past = history.select(
        "chain", F.col("date").alias("_day"),
        F.struct(
            F.col("date"), F.col("regime"), F.col("risk_score").cast("double").alias("risk_score"),
            stored_at.alias("ts"), F.col("whale_index").cast("double").alias("whale_index"),
            F.col("momentum_score").cast("double").alias("momentum_score"),
        ).alias("_row"),
    )
    wanted = targets.select(*KEY, F.explode(F.sequence(F.lit(1), F.lit(days))).alias("_k")).select(
        *KEY, F.date_sub(F.col("date"), F.col("_k")).alias("_day")
    )
    grouped = (
        wanted.join(past, ["chain", "_day"])
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_list("_row"), asc=False).alias("hist"))
    )
    return targets.join(grouped, KEY, "left")


def smoothed(score: Column, rules: SignalRules) -> Column:
    scores = F.filter(F.transform("hist", lambda h: finite_or_null(h["risk_score"])), lambda s: s.isNotNull())
    previous = F.get(scores, F.lit(0))
    return F.when(previous.isNull(), score).otherwise(
        clamp_0_100(F.lit(rules.alpha) * score + F.lit(1.0 - rules.alpha) * previous)
    )


def after_hysteresis(new: Column, score: Column, rules: SignalRules) -> Column:
    last = F.get("hist", F.lit(0))
    held = F.abs(score - last["risk_score"]) < F.lit(rules.hysteresis_points)
    return F.when(last["regime"].isNotNull() & F.coalesce(held, F.lit(False)), last["regime"]).otherwise(new)


def after_rate_limit(new: Column, rules: SignalRules) -> Column:
    """Keeps the previous regime when it is younger than the minimum time between changes."""
    last = F.get("hist", F.lit(0))
    differing = F.filter("hist", lambda h: h["regime"].isNotNull() & (h["regime"] != F.col("hist")[0]["regime"]))
    oldest = F.element_at("hist", -1)["ts"]
    changed_at = F.when(F.size(differing) > 0, F.get(differing, F.lit(0))["ts"]).otherwise(oldest)
    hours = (midnight_epoch(F.col("date")) - changed_at) / F.lit(3600.0)
    keep = last["regime"].isNotNull() & (new != last["regime"]) & (hours < F.lit(rules.change_hours))
    return F.when(F.coalesce(F.size("hist"), F.lit(0)) < 1, new).when(keep, last["regime"]).otherwise(new)


def signal_step(
    targets: DataFrame, history: DataFrame, rules: SignalRules = SignalRules(), score: str = "raw_score"
) -> DataFrame:
    """Signals of the target days from their raw score, features and stored history.

    Also returns the previous row's values the alerts need (prev_*).
    """
    df = with_history(targets, history, rules.history_days)
    s = smoothed(score_or_neutral(score), rules)
    df = df.withColumn("risk_score", s)
    s = F.col("risk_score")
    df = df.withColumn("_held", after_hysteresis(regime(s), s, rules))
    df = df.withColumn("regime", after_rate_limit(F.col("_held"), rules))
    last = F.get("hist", F.lit(0))
    return df.select(
        *KEY, "risk_score", "regime", risk_state(s).alias("risk_state"),
        *[c.alias(n) for n, c in indices(targets).items()],
        last["whale_index"].alias("prev_whale_index"),
        last["momentum_score"].alias("prev_momentum_score"),
        last["regime"].alias("prev_regime"),
    )


Entry = tuple[dt.date, int, str, float]  # day, stored at (epoch seconds), regime, smoothed score
_EPOCH = dt.date(1970, 1, 1)


def _regime_name(score: float) -> str:
    return "Bull" if score < spec.NEUTRAL_FROM else "Neutral" if score < spec.BEAR_FROM else "Bear"


def next_entry(past: deque[Entry], day: dt.date, raw: float, rules: SignalRules, stored_after: int = 0) -> Entry:
    """One day of a series: ages the look-back (oldest first), adds the new day and returns it."""
    while past and (day - past[0][0]).days > rules.history_days:
        past.popleft()
    midnight = (day - _EPOCH).days * 86400
    if past:
        _, _, last, before = past[-1]
        score = max(0.0, min(100.0, rules.alpha * raw + (1.0 - rules.alpha) * before))
        now = last if abs(score - before) < rules.hysteresis_points else _regime_name(score)
        if now != last:
            changed = next((ts for _, ts, name, _ in reversed(past) if name != last), past[0][1])
            if (midnight - changed) / 3600.0 < rules.change_hours:
                now = last
    else:
        score, now = raw, _regime_name(raw)
    past.append((day, midnight + stored_after, now, score))
    return past[-1]


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


ENTRIES = "array<struct<day:date,ts:bigint,regime:string,score:double>>"


def _folded(days: Column, rules: SignalRules, stored_after: int, before: Column | None = None) -> Column:
    """Entries (day, ts, regime, score) of a series of (date, score) in date order, each from the look-back before it.

    ``before``: entries of earlier days, in date order; they stay in front.
    """

    def step(past: Column, x: Column) -> Column:
        midnight = F.unix_date(x["date"]).cast("long") * 86400

        def entry_of(score: Column, name: Column) -> Column:
            return F.struct(x["date"].alias("day"), (midnight + stored_after).alias("ts"), name.alias("regime"), score.alias("score"))

        def following(last: Column) -> Column:
            def named(score: Column) -> Column:
                held = F.abs(score - last["score"]) < F.lit(rules.hysteresis_points)
                other = F.filter(past, lambda h: h["regime"] != last["regime"])
                changed = F.when(F.size(other) > 0, F.element_at(other, -1)["ts"]).otherwise(F.element_at(past, 1)["ts"])
                too_soon = (midnight - changed) / F.lit(3600.0) < F.lit(rules.change_hours)
                return entry_of(score, F.when(held | too_soon, last["regime"]).otherwise(regime(score)))

            return _let(clamp_0_100(F.lit(rules.alpha) * x["score"] + F.lit(1.0 - rules.alpha) * last["score"]), named)

        return F.when(F.size(past) == 0, entry_of(x["score"], regime(x["score"]))).otherwise(_let(F.element_at(past, -1), following))

    def merge(acc: Column, x: Column) -> Column:
        # entries are in date order: those of the look-back are at the end
        recent = F.slice(acc, F.greatest(F.lit(1), F.size(acc) - F.lit(rules.history_days)), F.lit(rules.history_days + 1))
        past = F.filter(recent, lambda h: F.datediff(x["date"], h["day"]) <= F.lit(rules.history_days))
        return F.concat(acc, F.array(_let(past, lambda p: step(p, x))))

    return F.aggregate(days, F.array().cast(ENTRIES) if before is None else before, merge)


def backfill_scores(
    scores: DataFrame, rules: SignalRules = SignalRules(), score: str = "raw_score",
    created_after_hours: float | None = None,
) -> DataFrame:
    """Smoothed score and regime of whole series, exactly as day after day of ``signal_step``.

    ``created_after_hours`` is the time from a signal's midnight to its storing, None when only
    dates are known. The state of a day depends on the day before, so a chain is one array of its
    calendar days, folded by ``aggregate``.
    """
    rows = scores.select("chain", "date", score_or_neutral(score).alias("score"))
    series = rows.groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("date", "score"))).alias("days"))
    entries = _folded(F.col("days"), rules, int((created_after_hours or 0.0) * 3600))
    return series.select("chain", F.explode(entries).alias("e")).select(
        "chain", F.col("e.day").alias("date"), F.col("e.score").alias("risk_score"), F.col("e.regime").alias("regime"))


def resumed_scores(
    scores: DataFrame, stored: DataFrame, since: dt.date, rules: SignalRules = SignalRules(), score: str = "raw_score",
    created_after_hours: float | None = None,
) -> DataFrame:
    """Smoothed score and regime of the days from ``since`` on, going on from stored signals.

    ``stored`` has chain, date, risk_score, regime and, if known, created_at; of each chain only the
    look-back before ``since`` is read, so a late re-run costs as much as the days it computes. The
    result is that of the whole series if the stored days are. A chain without stored days starts anew.
    """
    first = F.date_sub(F.lit(since), rules.history_days)
    known = finite_or_null("risk_score").isNotNull() & F.col("regime").isNotNull()
    stored_at = midnight_epoch(F.col("date"))
    if "created_at" in stored.columns:
        stored_at = F.coalesce(F.unix_seconds(F.col("created_at").cast("timestamp")), stored_at)
    past = stored.where((F.col("date") >= first) & (F.col("date") < F.lit(since)) & known).select("chain", F.struct(
        F.col("date").alias("day"), stored_at.alias("ts"), "regime", F.col("risk_score").cast("double").alias("score")).alias("e"))
    past = past.groupBy("chain").agg(F.sort_array(F.collect_list("e")).cast(ENTRIES).alias("before"))
    rows = scores.where(F.col("date") >= F.lit(since)).select("chain", "date", score_or_neutral(score).alias("score"))
    series = rows.groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("date", "score"))).alias("days")).join(past, "chain", "left")
    before = F.coalesce("before", F.array().cast(ENTRIES))
    entries = _folded(F.col("days"), rules, int((created_after_hours or 0.0) * 3600), before)
    return series.select("chain", F.explode(entries).alias("e")).where(F.col("e.day") >= F.lit(since)).select(
        "chain", F.col("e.day").alias("date"), F.col("e.score").alias("risk_score"), F.col("e.regime").alias("regime"))


def resumed(
    targets: DataFrame, stored: DataFrame, since: dt.date, rules: SignalRules = SignalRules(), score: str = "raw_score",
    created_after_hours: float | None = None,
) -> DataFrame:
    """Signals of the target days from ``since`` on, going on from stored ones (see ``resumed_scores``)."""
    return _with_indices(resumed_scores(targets, stored, since, rules, score, created_after_hours), targets)


def backfill(
    targets: DataFrame, rules: SignalRules = SignalRules(), score: str = "raw_score",
    created_after_hours: float | None = None,
) -> DataFrame:
    """Whole signal series from raw scores and features."""
    return _with_indices(backfill_scores(targets, rules, score, created_after_hours), targets)


def _with_indices(folded: DataFrame, targets: DataFrame) -> DataFrame:
    own = targets.select(*KEY, *[c.alias(n) for n, c in indices(targets).items()])
    return folded.join(own, KEY).select(
        *KEY, "risk_score", "regime", risk_state(F.col("risk_score")).alias("risk_state"),
        "whale_index", "stress_index", "momentum_score",
    )
