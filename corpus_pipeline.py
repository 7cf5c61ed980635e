"""From documents to piece ids: five stages, each written and read again before the next.

run(spark, sf_dir) applies STAGES to the documents of sf_dir. Each stage is a function of (spark,
docs, sf_dir); all but the last return the columns of documents. Nulls, repeated rows, empty texts
and tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, jaccard_join, quality, sentencepiece_trie, substring_dedup
from tidemark.llm.common import forget, table, written
from tidemark.llm.queries import PIECES


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts. It is fitted on labelled documents that are not held out."""
    model = quality.fit_rules(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of similar ones."""
    return jaccard_join.first_of_groups(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of 20 words and more that stood before."""
    return substring_dedup.without_repeats(docs)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str, model_path: str = PIECES) -> DataFrame:
    """doc_id, lang, source, piece_ids, n_pieces, and whether the pieces give the text back."""
    return sentencepiece_trie.round_trip(docs, model_path).select(
        "doc_id", "lang", "source", "piece_ids", sentencepiece_trie.piece_count().alias("n_pieces"), "same")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_test_items),
    ("SentencePiece encoding and decoding", to_pieces),
]

#: SQL cannot express the fitted classifier and the piece search; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
            if before is not None:
                forget(before)
            before = docs
    return docs
