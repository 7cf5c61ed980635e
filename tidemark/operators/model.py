"""Drawdown classifier: boosted trees per chain, batch scoring, model registry."""

from __future__ import annotations

import random
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import spec
from tidemark.functions.lineage import Settled
from tidemark.functions.ranks import rank_auc
from tidemark.functions.values import check_chain, clamp, finite_or_null
from tidemark.sources.store import latest_per_key


@dataclass(frozen=True)
class ModelConfig:
    """Defaults of the classifier; ``max_depth`` -1 (no limit) becomes Spark's limit of 30.

    ``patience``: trees without a better AUC on the validation rows after which no more are fitted; None fits all.
    ``chunk``: trees between two looks at that AUC. ``column_share``: of the features, drawn for each tree.
    """

    trees: int = 500
    max_depth: int = 6
    learning_rate: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    patience: int | None = 50
    chunk: int = 10
    seed: int = 42


@dataclass(frozen=True)
class Boosting:
    """A fitted model, the number of trees that were fitted for it, and the validation AUC after each of them."""

    model: PipelineModel
    fitted: int
    aucs: tuple[float | None, ...]


def tree_columns(config: ModelConfig, tree: int, n: int) -> list[int]:
    """The features that a tree may split on, drawn once for the whole tree."""
    k = max(1, round(config.column_share * n))
    return sorted(random.Random(config.seed * 1_000_003 + tree).sample(range(n), k))


def train(df: DataFrame, names: Sequence[str], config: ModelConfig = ModelConfig(), split: str | None = "split",
          label: str = "target") -> PipelineModel:
    """Fits on the train rows; with a split column the validation rows decide how many trees stay.

    Features must be scaled and without missing values.
    """
    return boost(df, names, config, split, label).model


def boost(df: DataFrame, names: Sequence[str], config: ModelConfig = ModelConfig(), split: str | None = "split",
          label: str = "target") -> Boosting:
    """Gradient boosting of regression trees on the logistic loss, a chunk of trees at a time.

    Rows carry their margin. Each tree is fitted to the loss's gradient on a share of the train rows and
    of the features, and only its own output is added to the margins. After a chunk the rows are written,
    with one margin for each new tree for the validation rows, whose AUC then tells whether to go on:
    once the best is ``patience`` trees back, no further chunk is fitted and the trees past it are cut.
    """
    n = len(names)
    rows = df.withColumn("label", F.col(label).cast("double"))
    late = F.lit(False) if split is None else F.coalesce(F.col(split) == "validation", F.lit(False))
    assembler = VectorAssembler(inputCols=list(names), outputCol="features")
    wide = assembler.transform(rows.select(*names, "label", late.alias("late"))).select("features", "label", "late")
    none = F.array().cast("array<double>")
    states = Settled(df.sparkSession)
    state = states.write(wide.withColumns({"x": vector_to_array("features"), "margin": F.lit(0.0), "staged": none}))
    watched = split is not None and config.patience is not None
    trees, weights, aucs = [], [], []
    y = 2.0 * F.col("label") - 1.0
    while len(trees) < config.trees:
        chunk = range(len(trees), min(len(trees) + config.chunk, config.trees))
        for t in chunk:
            weight = config.learning_rate if t else 1.0
            gradient = 4.0 * y / (1.0 + F.exp(2.0 * y * F.col("margin"))) if t else y
            mine = set(tree_columns(config, t, n))
            seen = array_to_vector(F.array(*[F.col("x")[i] if i in mine else F.lit(0.0) for i in range(n)]))
            share = F.pmod(F.xxhash64("x", "label", F.lit(config.seed + t)), F.lit(1 << 20)) < int(config.row_share * (1 << 20))
            learner = DecisionTreeRegressor(
                featuresCol="seen", labelCol="gradient", maxDepth=30 if config.max_depth < 0 else config.max_depth, seed=config.seed + t)
            tree = learner.fit(state.where(~F.col("late") & share).select(seen.alias("seen"), gradient.alias("gradient")))
            state = tree.setFeaturesCol("features").setPredictionCol("tree").transform(state)
            state = state.withColumn("margin", F.col("margin") + weight * F.col("tree")).drop("tree")
            if watched:
                state = state.withColumn("staged", F.when(F.col("late"), F.concat("staged", F.array("margin"))).otherwise(F.col("staged")))
            trees.append(tree)  # whose JVM side lives as long as it does
            weights.append(weight)
        state = states.write(state)
        if watched:
            aucs += _staged_aucs(state, len(chunk))
            state = state.withColumn("staged", none)
            best = best_prefix(aucs, config.patience)
            if len(aucs) - best >= config.patience:
                break
    states.close()
    keep = (best_prefix(aucs, config.patience) if watched else 0) or len(trees)
    return Boosting(PipelineModel([assembler, _of_trees([t._java_obj for t in trees[:keep]], weights[:keep])]), len(trees), tuple(aucs))


def _staged_aucs(state: DataFrame, n: int) -> list[float | None]:
    """AUC on the validation rows after each tree of a chunk, from one plan."""
    long = state.where("late").select("label", F.posexplode("staged").alias("k", "margin"))
    found = rank_auc(long.withColumn("p", 1.0 / (1.0 + F.exp(-2.0 * F.col("margin")))), ["k"], "label", "p").collect()
    by_tree = {r["k"]: r["auc"] for r in found}
    return [by_tree.get(k) for k in range(n)]


def _of_trees(trees: Sequence, weights: Sequence[float]) -> GBTClassificationModel:
    """A boosted model of the given (JVM) trees."""
    gateway = SparkContext.getOrCreate()._gateway
    jvm = gateway.jvm.org.apache.spark.ml
    kept = gateway.new_array(jvm.regression.DecisionTreeRegressionModel, len(trees))
    shares = gateway.new_array(gateway.jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights, strict=True)):
        kept[i], shares[i] = tree, float(weight)
    return GBTClassificationModel(jvm.classification.GBTClassificationModel(f"GBTClassifier_{uuid.uuid4().hex[:12]}", kept, shares))


def best_prefix(aucs: Sequence[float | None], patience: int) -> int:
    """Leading trees with the best AUC, looking no further than ``patience`` trees past the best so far; 0 if there is none."""
    best = 0
    for k, auc in enumerate(aucs, 1):
        if auc is not None and (not best or auc > aucs[best - 1]):
            best = k
        elif k - best >= patience:
            break
    return best


def first_trees(model: PipelineModel, n: int) -> PipelineModel:
    """The model with its first n trees only."""
    boosted = model.stages[-1]
    return PipelineModel([*model.stages[:-1], _of_trees(list(boosted._java_obj.trees())[:n], list(boosted.treeWeights)[:n])])


def best_iteration(model: PipelineModel) -> int:
    """Number of trees that were kept."""
    return model.stages[-1].getNumTrees


def percent(chance: Column) -> Column:
    """Probability to a score in [0, 100]; a value that is no finite number becomes NULL."""
    return F.when(finite_or_null(chance).isNotNull(), clamp(chance, 0.0, 1.0) * 100.0)


def risk_scores(model: PipelineModel, df: DataFrame, out: str = "raw_score") -> DataFrame:
    """Adds the probability of a drawdown in percent; a value that is no number becomes NULL."""
    scored = model.transform(df)
    if "probability" in scored.columns:
        chance = vector_to_array("probability")[1]
    else:
        chance = F.col("prediction")
    return scored.withColumn(out, percent(chance)).select(*df.columns, out)


def model_path(root: str, chain: str, version: str) -> str:
    return f"{root.rstrip('/')}/{check_chain(chain).lower()}/v{version}"


def save_model(model: PipelineModel, root: str, chain: str, version: str) -> str:
    path = model_path(root, chain, version)
    model.write().overwrite().save(path)
    return path


def load_model(root: str, chain: str, version: str) -> PipelineModel:
    return PipelineModel.load(model_path(root, chain, version))


def next_versions(performance: DataFrame, chains: DataFrame) -> DataFrame:
    """Next model version per chain: patch of the latest plus one; 1.0.0 when none or unreadable."""
    latest = latest_per_key(performance, ["chain"], "trained_at").select("chain", "model_version")
    parts = F.split("model_version", r"\.")

    def part(i: int):
        text = F.get(parts, F.lit(i))
        return F.when(text.isNull(), F.lit(0)).otherwise(text.try_cast("int"))

    bumped = F.concat_ws(".", part(0), part(1), part(2) + 1)
    readable = F.col("model_version").isNotNull() & part(0).isNotNull() & part(1).isNotNull() & part(2).isNotNull()
    return chains.select("chain").join(latest, "chain", "left").select(
        "chain", F.when(readable, bumped).otherwise(F.lit("1.0.0")).alias("next_version")
    )


def active_models(performance: DataFrame, min_auc: float = spec.MIN_PRODUCTION_AUC) -> DataFrame:
    """The latest version per chain that is good enough for production."""
    good = performance.where(finite_or_null("auc") >= F.lit(min_auc))
    return latest_per_key(good, ["chain"], "trained_at").select("chain", "model_version", "auc", "trained_at")
