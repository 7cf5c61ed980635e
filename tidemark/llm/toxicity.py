"""Toxicity by a classifier chain: categories are predicted one after the other.

Each category has a sparse linear model over the words of a text and the probabilities of the
categories before it. While fitting, those probabilities are out-of-fold: they come from models that
have not seen the row, so later models learn from the same kind of input that they get when scoring.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, written
from tidemark.llm.quality import held_out

MARKS = ".,;:!?\"'()[]{}<>#$%&*|/\\-_\n\t\r"


@dataclass(frozen=True)
class ChainConfig:
    """sample_rows: expected number of labelled rows that are fitted on; vocabulary: most words that models see."""

    sample_rows: int = 20_000
    vocabulary: int = 1 << 16
    least_docs: int = 5
    folds: int = 2
    penalty: float = 0.0003
    iterations: int = 25
    seed: int = 11


@dataclass(frozen=True)
class Chain:
    words: CountVectorizerModel
    models: tuple[tuple[str, LogisticRegressionModel], ...]


def words_of(text: Column) -> Column:
    """Lower-cased distinct words without punctuation; null and empty texts have none."""
    flat = F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKS, " " * len(MARKS))
    return F.array_distinct(F.filter(F.split(flat, " "), lambda w: w != ""))


def _features(df: DataFrame, earlier: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=["word_counts", *earlier], outputCol="features").transform(df.drop("features"))


def _probability(model: LogisticRegressionModel, df: DataFrame, name: str) -> DataFrame:
    scored = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return scored.drop("probability", "rawPrediction", "prediction")


def fit_chain(docs: DataFrame, categories: DataFrame, names: Sequence[str], config: ChainConfig = ChainConfig()) -> Chain:
    """Fits on rows of docs (doc_id, text) that categories (doc_id, a 0/1 column for each name) knows.

    Held-out ids (crc32 of the id divisible by 5), null ids and rows with a null category are left
    out; repeated rows count again. More known rows than sample_rows are thinned by a hash of their
    id. Without rows, or words, there is a chain without models, which predicts 0.
    """
    known = categories.select(F.col("doc_id").alias("_id"), *names).where(F.col("_id").isNotNull() & ~held_out("_id")).dropna()
    n = max(1, known.count())
    known = known.where(F.pmod(F.xxhash64("_id", F.lit(config.seed)), F.lit(n)) < config.sample_rows)
    rows = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("_id"))
    fold = F.pmod(F.xxhash64("_id", F.lit(config.seed + 1)), F.lit(config.folds)).alias("fold")
    rows = written(rows.select(words_of(F.col("text")).alias("words"), fold, *[F.col(c).cast("double").alias(c) for c in names]))
    counts = rows.agg(F.count("*"), *[F.sum(c) for c in names]).first()
    if not counts[0]:
        return Chain(None, ())
    vectorizer = CountVectorizer(inputCol="words", outputCol="word_counts", vocabSize=config.vocabulary, minDF=min(config.least_docs, counts[0]), binary=True)
    words = vectorizer.fit(rows)
    texts, rows = rows, written(words.transform(rows).drop("words"))
    forget(texts)
    models, earlier = [], []
    for c, name in enumerate(names):
        featured = _features(rows, [f"p_{e}" for e in earlier])
        learner = LogisticRegression(labelCol=name, elasticNetParam=1.0, regParam=config.penalty, maxIter=config.iterations, standardization=False)
        model = learner.fit(featured)
        models.append((name, model))
        if c < len(names) - 1:
            parts = [
                _probability(learner.fit(featured.where(F.col("fold") != k)), featured.where(F.col("fold") == k), f"p_{name}")
                for k in range(config.folds)
            ]
            out = parts[0]
            for part in parts[1:]:
                out = out.unionByName(part)
            before, rows = rows, written(out.drop("features"))
            forget(before)
        earlier.append(name)
    forget(rows)
    return Chain(words, tuple(models))


def score_toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """Every row of docs (doc_id, text): doc_id and p_<category> for each category, from its whole text. One scan."""
    rows = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    if chain.words is None:
        return rows.select("doc_id")
    rows = chain.words.transform(rows).drop("words")
    earlier: list[str] = []
    for name, model in chain.models:
        rows = _probability(model, _features(rows, earlier), f"p_{name}")
        earlier.append(f"p_{name}")
    return rows.select("doc_id", *earlier)
