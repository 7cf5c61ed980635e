"""Classification and return metrics, per group of any keys, as aggregations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import spec
from tidemark.functions.ranks import rank_auc
from tidemark.functions.values import finite_or_null
from tidemark.operators.quality import input_problems

Y, P = "y", "p"


def roc_auc(df: DataFrame, keys: Sequence[str] = (), label: str = Y, score: str = P) -> DataFrame:
    return rank_auc(df, keys, label, score)


def predicted_class(score: str = P, threshold: float = spec.CLASS_THRESHOLD) -> Column:
    """1 or 0; NULL for a score that is missing or no finite number."""
    return (finite_or_null(score) >= F.lit(threshold)).cast("int")


def _counts(label: str, score: str, threshold: float) -> dict[str, Column]:
    y, hit = F.col(label), predicted_class(score, threshold)
    return {
        "tn": F.count_if((y == 0) & (hit == 0)),
        "fp": F.count_if((y == 0) & (hit == 1)),
        "fn": F.count_if((y == 1) & (hit == 0)),
        "tp": F.count_if((y == 1) & (hit == 1)),
    }


def confusion(df: DataFrame, keys: Sequence[str] = (), label: str = Y, score: str = P,
              threshold: float = spec.CLASS_THRESHOLD) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in _counts(label, score, threshold).items()])


def _or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def with_rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 and the hit-rate of actual drawdowns to confusion counts."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({
        "precision": _or_zero(tp, tp + fp),
        "recall": _or_zero(tp, tp + fn),
        "f1": _or_zero(tp * 2, tp * 2 + fp + fn),
        "hitrate": F.try_divide(tp.cast("double"), (tp + fn).cast("double")),
    })


def drawdown_hitrate(df: DataFrame, keys: Sequence[str] = (), label: str = Y, score: str = P,
                     threshold: float = spec.CLASS_THRESHOLD) -> DataFrame:
    """Share of actual drawdowns that were predicted; NULL when there were none."""
    counts = with_rates(confusion(df, keys, label, score, threshold))
    return counts.select(*keys, "hitrate")


def sharpe_column(ret: str, rf: float = 0.0, ann: float = spec.ANNUALISATION) -> Column:
    """Aggregate: NULL returns are absent rows, a NaN or infinite one makes the ratio NULL."""
    x, finite = F.col(ret), finite_or_null(ret)
    broken = F.count_if(x.isNotNull() & finite.isNull()) > 0
    std = F.stddev_samp(finite)
    ratio = (F.avg(finite) - F.lit(rf)) / std * F.sqrt(F.lit(ann))
    return F.when(~broken, F.when(std == 0, F.lit(0.0)).when(std > 0, ratio))


def sortino_column(ret: str, rf: float = 0.0, ann: float = spec.ANNUALISATION) -> Column:
    """As Sharpe with the deviation of the returns below rf; infinite when there are none."""
    x, finite = F.col(ret), finite_or_null(ret)
    broken = F.count_if(x.isNotNull() & finite.isNull()) > 0
    below = F.when(finite < F.lit(rf), finite)
    std = F.stddev_samp(below)
    ratio = (F.avg(finite) - F.lit(rf)) / std * F.sqrt(F.lit(ann))
    none_below = (F.count(finite) > 0) & (F.count(below) == 0)
    return F.when(
        ~broken, F.when(none_below, F.lit(float("inf"))).when(std == 0, F.lit(0.0)).when(std > 0, ratio)
    )


def return_ratios(df: DataFrame, keys: Sequence[str] = (), ret: str = "ret", base: str | None = None) -> DataFrame:
    """Sharpe and Sortino; with a baseline return column also the Sharpe improvement over it."""
    out = df.groupBy(*keys).agg(
        sharpe_column(ret).alias("sharpe"),
        sortino_column(ret).alias("sortino"),
        *([sharpe_column(base).alias("base_sharpe")] if base else []),
    )
    if base:
        out = out.withColumn("sharpe_improvement", F.col("sharpe") - F.col("base_sharpe"))
    return out


def evaluation_report(df: DataFrame, keys: Sequence[str], label: str = Y, score: str = P,
                      ret: str | None = None, with_reason: bool = False) -> DataFrame:
    """All metrics per group: counts and ratios from one aggregation, AUC joined to it.

    A group with a missing or non-finite label or score, a label other than 0 and 1 or a score
    outside [0, 1] has NULL metrics; ``with_reason`` adds which of that it is (NULL when usable).
    """
    keys = list(keys)
    counts = [c.alias(n) for n, c in _counts(label, score, spec.CLASS_THRESHOLD).items()]
    ratios = [sharpe_column(ret).alias("sharpe"), sortino_column(ret).alias("sortino")] if ret else []
    if not keys:
        df, by = df.withColumn("_all", F.lit(0)), ["_all"]
    else:
        by = keys
    problems = [c.alias(f"_{n}") for n, c in input_problems(label, score).items()]
    report = with_rates(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *counts, *ratios, *problems))
    report = report.join(rank_auc(df, by, label, score), by)
    names = list(input_problems(label, score))
    usable = reduce(Column.__and__, [F.col(f"_{n}") == 0 for n in names])
    measured = [c for c in report.columns if c not in [*by, "n_rows"] and not c.startswith("_")]
    report = report.withColumns({c: F.when(usable, F.col(c)) for c in measured})
    if with_reason:
        found = F.concat_ws(",", *[F.when(F.col(f"_{n}") > 0, F.lit(n)) for n in names])
        report = report.withColumn("reason", F.when(~usable, found))
    return report.drop("_all", *[f"_{n}" for n in names])
