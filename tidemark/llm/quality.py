"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to Spark columns.

Shallow trees are grown on statistics of labelled texts; every path from a root to a node is a rule
(a conjunction of comparisons). A logistic regression with an L1 penalty weighs the rules and sets
most weights to zero. What is left is an expression of built-in functions, so scoring is one scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "#$%&*!|<>{}[]=+^~@_\\"


@dataclass(frozen=True)
class RuleConfig:
    """sample_rows: expected number of labelled rows that trees and weights are fitted on."""

    sample_rows: int = 20_000
    trees: int = 20
    depth: int = 3
    penalty: float = 0.002
    seed: int = 7


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is_above, limit) hold; weight is what the rule adds to the log odds."""

    tests: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def holds(self) -> Column:
        cond = F.lit(True)
        for name, above, limit in self.tests:
            cond = cond & ((F.col(name) > limit) if above else (F.col(name) <= limit))
        return cond


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """Probability of label 1 from the statistics columns of a row."""
        odds = F.lit(self.intercept)
        for rule in self.rules:
            odds = odds + F.when(rule.holds(), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-odds))


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a whole text; a null text counts as empty, and an empty one has zeros."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text).cast("double")
    some = F.greatest(chars, F.lit(1.0))
    blanks = chars - _without(text, " \t\n\r\x0b\x0c")
    words = F.split(text, r"[ \n]+")
    return {
        "s_chars": F.log1p(chars),
        "s_blank": blanks / some,
        "s_word": (chars - blanks) / (blanks + 1.0),
        "s_upper": (chars - _without(text, UPPER)) / some,
        "s_digit": (chars - _without(text, "0123456789")) / some,
        "s_mark": (chars - _without(text, MARKS)) / some,
        "s_stop": (chars - _without(text, ".,;:?")) / some,
        "s_line": (chars - _without(text, "\n")) / some,
        "s_wide": (F.octet_length(text) - chars) / some,
        "s_distinct": F.size(F.array_distinct(words)) / F.size(words).cast("double"),
    }


STATISTICS = (
    "s_chars", "s_blank", "s_word", "s_upper", "s_digit", "s_mark", "s_stop", "s_line", "s_wide", "s_distinct",
)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _paths(node, tests=()) -> list[tuple]:
    """Rules of all nodes below a tree's root, as tuples of tests."""
    found = [tests] if tests else []
    if node.subtreeDepth() > 0:
        split = node.split()
        name, limit = STATISTICS[split.featureIndex()], split.threshold()
        found += _paths(node.leftChild(), (*tests, (name, False, limit)))
        found += _paths(node.rightChild(), (*tests, (name, True, limit)))
    return found


def fit_rules(docs: DataFrame, labels: DataFrame, config: RuleConfig = RuleConfig()) -> RuleModel:
    """Fits on rows of docs (doc_id, text) with a label (doc_id, quality) whose id is not held out.

    Labels other than 0 and 1 and null ids are left out; a repeated label or document counts again.
    More labelled rows than sample_rows are thinned by a hash of their id. Without rows of both
    labels the model is a constant: the share of label 1, or 0.5 without any row.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("label"))
    known = known.where(F.col("_id").isNotNull() & F.col("label").isin(0.0, 1.0) & ~held_out("_id"))
    n = max(1, known.count())
    known = known.where(F.pmod(F.xxhash64("_id", F.lit(config.seed)), F.lit(n)) < config.sample_rows)
    text = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("_id"))
    rows = written(text.select("label", *[c.alias(k) for k, c in statistics(F.col("text")).items()]))
    count, ones = rows.agg(F.count("*"), F.sum("label")).first()
    if not count or ones in (0.0, float(count)):
        share = min(max((ones or 0.0) / count, 1e-6), 1 - 1e-6) if count else 0.5
        return RuleModel(math.log(share / (1 - share)), ())
    feature = rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(
        numTrees=config.trees, maxDepth=config.depth, featureSubsetStrategy="sqrt", subsamplingRate=0.7, seed=config.seed,
    ).fit(feature)
    tests = sorted({t for tree in forest._java_obj.trees() for t in _paths(tree.rootNode())})
    candidates = [Rule(t) for t in tests]
    held = rows.select("label", array_to_vector(F.array(*[F.when(r.holds(), 1.0).otherwise(0.0) for r in candidates])).alias("features"))
    held = written(held)
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=config.penalty, standardization=False, maxIter=100).fit(held)
    forget(rows, held)
    weights = [float(w) for w in lasso.coefficients.toArray()]
    rules = tuple(Rule(r.tests, w) for r, w in zip(candidates, weights, strict=True) if w)
    return RuleModel(float(lasso.intercept), rules)


def score_quality(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """Every row of docs with all its columns (but for those named like the new ones), held_out, score and predicted.

    One scan without exchange. Null and empty texts get the score of an empty text. A null doc_id is
    not held out.
    """
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    scored = docs.select(F.struct(*kept).alias("row"), held_out().alias("held_out"), *[c.alias(k) for k, c in statistics(F.col("text")).items()])
    scored = scored.select("row", "held_out", model.score().alias("score"))
    return scored.select("row.*", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
