"""Signals from a stream of daily raw scores, with the look-back of each chain as state."""

from __future__ import annotations

import bisect
import datetime as dt
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.values import score_or_neutral
from tidemark.operators.signals import SignalRules, next_entry

_OUT = "chain string, date date, risk_score double, regime string, is_late boolean"
_STATE = "days array<date>, stored array<bigint>, regimes array<string>, scores array<double>, raws array<double>"


def stream_signals(
    scores: DataFrame, rules: SignalRules = SignalRules(), score: str = "raw_score",
    created_after_hours: float | None = None,
) -> DataFrame:
    """Smoothed score and regime per incoming (chain, date), and again for the days that a late one changes.

    A day that comes after newer ones, or again, and is not older than ``rules.history_days`` before the
    newest, is put in its place: it and all days after it are computed again from their raw scores and come
    out once more, so the last row of a (chain, date) is that of the whole series; store them by upsert. An
    older day comes back with is_late and no score: it takes a re-run of the series
    (``operators.signals.resumed``). The state of a chain are its entries of twice the look-back, which is
    what computing the oldest of these days needs.
    """
    stored_after = int((created_after_hours or 0.0) * 3600)
    reach = dt.timedelta(days=rules.history_days)

    def advance(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get)) if state.exists else []  # (day, stored, regime, score, raw) by day
        raws = {e[0]: e[4] for e in kept}
        rows = pd.concat(list(batches)).sort_values("date", ignore_index=True)
        newest = kept[-1][0] if kept else None
        late, changed = [], None
        for day, raw in zip(rows["date"], rows["score"], strict=True):
            if newest is not None and day < newest - reach:
                late.append((key[0], day, None, None, True))
            else:
                raws[day] = raw
                changed = day if changed is None else min(changed, day)
        out = []
        if changed is not None:
            days = sorted(raws)
            first = bisect.bisect_left(days, changed)
            kept = kept[:first]
            past = deque(e[:4] for e in kept)
            for day in days[first:]:
                entry = next_entry(past, day, raws[day], rules, stored_after)
                kept.append((*entry, raws[day]))
                out.append((key[0], day, entry[3], entry[2], False))
            oldest = kept[-1][0] - 2 * reach
            kept = kept[bisect.bisect_left([e[0] for e in kept], oldest) :]
            state.update(tuple(list(part) for part in zip(*kept, strict=True)))
        yield pd.DataFrame(out + late, columns=["chain", "date", "risk_score", "regime", "is_late"])

    rows = scores.select("chain", "date", score_or_neutral(score).alias("score"))
    return rows.groupBy("chain").applyInPandasWithState(
        advance, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout
    )
