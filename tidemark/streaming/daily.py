"""The per-day aggregates over a stream of transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import finite_or_null
from tidemark.operators.features import FeatureSet


def stream_daily_aggregates(
    tx: DataFrame, fs: FeatureSet, addresses: list[str], time: str = "ts", lateness: str = "1 day"
) -> DataFrame:
    """One row per chain and day once the watermark has passed it, from the set's own aggregates.

    ``addresses`` are counted by sketch: exact distinct counts keep every address of a day in
    the state. A transaction later than ``lateness`` belongs to a re-run of its day.
    """
    aggregates = [c.alias(n.lstrip("_")) for n, c in fs.tx_aggregates(tx).items()]
    sketches = [F.approx_count_distinct(F.col(a).cast("string")).alias(f"approx_{a}") for a in addresses]
    return (
        _by_day(tx, time, lateness)
        .agg(F.count(F.lit(1)).alias("n_tx"), *aggregates, *sketches)
        .select("chain", F.col("_day.start").cast("date").alias("date"), "*")
        .drop("_day")
    )


def stream_daily_medians(
    tx: DataFrame, value: str, time: str = "ts", lateness: str = "1 day", accuracy: int = 10_000
) -> DataFrame:
    """Median of a value per chain and day once the watermark has passed it, from a quantile sketch as state.

    Sketches of tasks and micro-batches merge; the rank of what comes out is off by at most a share of
    1 / ``accuracy`` of the day's values. Missing values do not count; a day without any has NULL.
    """
    number = finite_or_null(value)
    return _by_day(tx, time, lateness).agg(
        F.count(number).alias("n_values"), F.percentile_approx(number, 0.5, accuracy).alias(f"median_{value}")
    ).select("chain", F.col("_day.start").cast("date").alias("date"), "n_values", f"median_{value}")


def stream_daily_distinct(
    tx: DataFrame, addresses: list[str], time: str = "ts", lateness: str = "1 day"
) -> DataFrame:
    """Exact number of distinct addresses per chain and day, over all the given columns together.

    The state holds each (chain, day, address) until the watermark has passed its day, spread over all
    tasks by all three; what comes again is dropped before it is counted. Repeats of an address lie less
    than a day apart, so ``lateness`` must be a day or more for none to outlive the state.
    """
    if _seconds(tx, lateness) < 86400:
        raise ValueError("lateness must be at least one day")
    each = F.explode(F.array_distinct(F.array_compact(F.array(*[F.col(a).cast("string") for a in addresses]))))
    rows = tx.select("chain", time, F.to_date(time).alias("_date"), each.alias("_address")).withWatermark(time, lateness)
    once = rows.dropDuplicatesWithinWatermark(["chain", "_date", "_address"])
    return (
        once.groupBy("chain", F.window(time, "1 day").alias("_day")).agg(F.count(F.lit(1)).alias("active_addresses"))
        .select("chain", F.col("_day.start").cast("date").alias("date"), "active_addresses")
    )


def _by_day(tx: DataFrame, time: str, lateness: str):
    return tx.withWatermark(time, lateness).groupBy("chain", F.window(time, "1 day").alias("_day"))


def _seconds(tx: DataFrame, interval: str) -> float:
    row = tx.sparkSession.sql(f"SELECT unix_seconds(TIMESTAMP'2001-01-01 00:00:00' + INTERVAL {interval}) - unix_seconds(TIMESTAMP'2001-01-01 00:00:00') AS s").first()
    return row["s"]
