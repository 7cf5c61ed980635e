"""Training run: clean, scale, fit, score the validation side, evaluate, register."""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import spec
from tidemark.functions.lineage import cut_lineage
from tidemark.functions.values import instant, missing
from tidemark.operators.metrics import evaluation_report
from tidemark.operators.model import Boosting, ModelConfig, boost, next_versions, risk_scores, save_model
from tidemark.operators.normalize import fit_params, save_params, transform
from tidemark.operators.training_data import (
    SplitDates, clean_training_rows, feature_medians, impute, require_both_sides, require_training_columns,
    train_val_split,
)
from tidemark.sources import store


T = TypeVar("T")


@dataclass(frozen=True)
class TrainedChain:
    chain: str
    model: PipelineModel
    params: DataFrame
    validation: DataFrame  # y, p per validation day
    report: DataFrame
    boosting: Boosting


def prepare(split: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Scaled train and validation rows, and the parameters, fitted on the train rows only.

    Train rows with missing values are dropped or filled by the usual rule; validation rows keep
    all days and are filled with the train medians.
    """
    train_rows = cut_lineage(clean_training_rows(split.where(F.col("split") == "train"), names))
    medians = feature_medians(train_rows, names)
    validation = impute(split.where(F.col("split") == "validation"), medians, names)
    params = fit_params(train_rows, list(names))
    filled = impute(train_rows, medians, names).unionByName(validation)
    return transform(filled, params, names), params


def train_chain(
    data: DataFrame, chain: str, names: Sequence[str], dates: SplitDates, config: ModelConfig = ModelConfig(),
    end_date: dt.date | None = None, returns: str | None = None,
) -> TrainedChain:
    """Model of one chain from rows (chain, date, features, target)."""
    split = cut_lineage(train_val_split(require_training_columns(data).where(F.col("chain") == chain), dates, end_date))
    require_both_sides(split)
    scaled, params = prepare(split, names)
    scaled = cut_lineage(scaled)  # read by every boosting round
    boosting = boost(scaled, names, config)
    model = boosting.model
    scored = risk_scores(model, scaled.where(F.col("split") == "validation"))
    validation = scored.withColumns({"y": F.col("target"), "p": F.col("raw_score") / 100.0})
    report = evaluation_report(validation, ["chain"], ret=returns)
    return TrainedChain(chain, model, params, validation, report, boosting)


def run_training(
    spark: SparkSession, data: DataFrame, root: str, trained_at: dt.datetime, dates: SplitDates,
    names: Mapping[str, Sequence[str]] = spec.FEATURES_BY_CHAIN, config: ModelConfig = ModelConfig(),
    returns: str | None = None,
) -> dict[str, str]:
    """Trains and stores every chain; a chain that fails does not stop the others.

    Returns the outcome per chain: its new version or the error text. The fit of each chain is
    distributed, and chains are fitted at the same time.
    """
    store.create_table(spark, root, "performance_summary")
    storing = threading.Lock()  # one writer per table

    def run(chain: str) -> str:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", chain)
        try:
            done = train_chain(data, chain, names[chain], dates, config, returns=returns)
            with storing:
                return _registered(spark, root, done, trained_at, returns)
        except Exception as error:  # noqa: BLE001 - reported per chain
            return f"failed: {error}"

    return at_once(run, list(names))


def at_once(run: Callable[[str], T], keys: Sequence[str], most: int = 8) -> dict[str, T]:
    """run(key) for every key, some at the same time: small jobs of one fill the gaps that others leave.

    With spark.scheduler.mode FAIR their jobs share the executors by pool, otherwise in order of arrival.
    """
    with ThreadPoolExecutor(max_workers=max(1, min(most, len(keys)))) as pool:
        started = {key: pool.submit(inheritable_thread_target(partial(run, key))) for key in keys}
        return {key: future.result() for key, future in started.items()}


def _registered(spark: SparkSession, root: str, done: TrainedChain, trained_at: dt.datetime, returns: str | None) -> str:
    """Stores a trained chain's model, parameters and metrics under its next version."""
    registry = store.read_table(spark, root, "performance_summary")
    chains = spark.range(1).select(F.lit(done.chain).alias("chain"))
    version = next_versions(registry, chains).first()["next_version"]
    save_model(done.model, f"{root}/models", done.chain, version)
    save_params(done.params, f"{root}/norm_params/{done.chain.lower()}", version)
    row = done.report.select(
        "chain", F.lit(version).alias("model_version"), "auc", "hitrate",
        F.col("sharpe").alias("sharpe_ratio") if returns else missing().alias("sharpe_ratio"),
        instant(trained_at).alias("trained_at"),
    )
    store.write_rows(spark, root, "performance_summary", row)
    return version
