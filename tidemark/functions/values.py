"""Scalar column helpers: missing values, clamps, column lookup, argument checks.

NULL is the only form of "missing" inside the library. Spark orders NaN above every number
and lets it through sums, so numbers pass one of the helpers below when they are first read.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import spec

INF = float("inf")


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing() -> Column:
    return F.lit(None).cast("double")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def number(c: Column | str) -> Column:
    """Double with NaN as NULL; text that is no number becomes NULL."""
    if isinstance(c, str):
        d = f"try_cast({quoted(c)} AS DOUBLE)"
        return F.expr(f"CASE WHEN NOT isnan({d}) THEN {d} END")
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def finite_or_null(c: Column | str) -> Column:
    """Double with NaN and both infinities as NULL."""
    if isinstance(c, str):
        d = f"try_cast({quoted(c)} AS DOUBLE)"
        return F.expr(f"CASE WHEN NOT isnan({d}) AND abs({d}) < double('Infinity') THEN {d} END")
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(INF)), d)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def clamp_0_100(c: Column) -> Column:
    """NULL stays NULL (greatest and least alone would skip it)."""
    return F.when(c.isNotNull(), clamp(c, 0.0, 100.0))


def score_or_neutral(c: Column | str) -> Column:
    """Raw risk score in [0, 100]; anything that is no finite number counts as neutral."""
    return F.coalesce(clamp_0_100(finite_or_null(c)), F.lit(spec.NEUTRAL_SCORE))


def feature_or_neutral(df: DataFrame, name: str) -> Column:
    """A feature as signal input: absent, missing or non-finite counts as neutral."""
    if name not in df.columns:
        return F.lit(spec.NEUTRAL_SCORE)
    return F.coalesce(finite_or_null(name), F.lit(spec.NEUTRAL_SCORE))


def squash(c: Column) -> Column:
    """Unbounded activity value to an index in [0, 100]."""
    return clamp(F.lit(50.0) + F.lit(50.0) * F.tanh(c / F.lit(spec.SQUASH_SCALE)), 0.0, 100.0)


def first_present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate that is a column of df, ignoring case; returned as spelled in df."""
    spelled = {c.lower(): c for c in df.columns}
    return next((spelled[c.lower()] for c in candidates if c.lower() in spelled), None)


def sum_or_zero(c: Column) -> Column:
    """Sum over the rows of a group that exists: 0 when no row contributes."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def normal_chain(c: Column | str) -> Column:
    return F.upper(F.trim(as_column(c)))


def known_chain(c: Column | str, chains: Iterable[str] = spec.CHAINS) -> Column:
    return normal_chain(c).isin(*chains)


def to_date(c: Column | str) -> Column:
    """Date from a date, timestamp or ISO text; unreadable text becomes NULL."""
    return as_column(c).try_cast("date")


def midnight_epoch(date: Column) -> Column:
    """Seconds from the epoch to 00:00 UTC of a date, whatever the session time zone."""
    return F.unix_date(date).cast("long") * F.lit(86400)


def epoch_seconds(moment: dt.datetime) -> int:
    """Seconds from the epoch; a time without zone is UTC."""
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=dt.timezone.utc)
    return int(moment.timestamp())


def instant(moment: dt.datetime) -> Column:
    """Timestamp column of a point in time, whatever the time zone of session and driver."""
    return F.timestamp_seconds(F.lit(epoch_seconds(moment)))


def check_chain(chain: str, chains: Iterable[str] = spec.CHAINS) -> str:
    name = str(chain).strip().upper()
    if name not in tuple(chains):
        raise ValueError(f"unsupported chain {chain!r}, expected one of {tuple(chains)}")
    return name


def check_date(value: object, name: str) -> dt.date:
    if isinstance(value, dt.datetime) or not isinstance(value, dt.date):
        raise TypeError(f"{name} must be a plain date, got {type(value).__name__}")
    return value


def check_date_range(start: dt.date, end: dt.date, today: dt.date) -> tuple[dt.date, dt.date]:
    """Inclusive range that is ordered and does not reach past today."""
    start, end = check_date(start, "start"), check_date(end, "end")
    if start > end:
        raise ValueError(f"start {start} is after end {end}")
    if end > today:
        raise ValueError(f"range {start}..{end} reaches past {today}")
    return start, end
