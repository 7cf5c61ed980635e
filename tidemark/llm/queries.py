"""Registered queries of the training-data operators: each runs over its whole table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    decontaminate, embedding_dedup, jaccard_join, lexical_search, license_scan, prefix_trie, quality, sentencepiece_trie, substring_dedup, suffix_dedup,
    token_counts, toxicity, url_filters,
)
from tidemark.llm.common import QueryFn, forget, shared_folder, small_batches, table, written


PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Tokenizer versions by their files, and those that need none.
TOKENIZERS = {"byte-bpe-50k": "/opt/tokenizers/byte_bpe_50k.tiktoken", "word-bpe-49k": "/opt/tokenizers/word_bpe_49k.json"}
COUNTERS = {"words-1": token_counts.word_count, "bytes-1": token_counts.byte_count}


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and test item of which it has 3/4 or more."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


#: Categories in the order of the chain: abuse in texts of poor and of good quality, and abuse at all, which is judged last and with the others' probabilities.
TOXIC = ("toxic_junk", "toxic_prose", "toxic")


def op5_toxicity(spark: SparkSession, sf_dir: str, threshold: float = 0.2) -> DataFrame:
    """Probabilities of the categories for every document; toxic: 1 if that of the last link reaches the threshold.

    The table labels two things, so the categories before the last are the products of its labels
    toxic and quality (toxic * (1 - quality), toxic * quality).
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    categories = labels.select(
        "doc_id", (F.col("toxic") * (1 - F.col("quality"))).alias("toxic_junk"), (F.col("toxic") * F.col("quality")).alias("toxic_prose"), "toxic")
    chain = toxicity.fit_chain(docs, categories, TOXIC)
    scored = toxicity.score_toxicity(docs, chain)
    for c in TOXIC:
        if f"p_{c}" not in scored.columns:
            scored = scored.withColumn(f"p_{c}", F.lit(0.0))
    return scored.select("doc_id", F.when(F.col("p_toxic") >= threshold, 1).otherwise(0).alias("toxic"), *[f"p_{c}" for c in TOXIC])


def op6_tokenizer_counts(spark: SparkSession, sf_dir: str, tokenizers: Mapping[str, str] = TOKENIZERS) -> DataFrame:
    """Totals as of op6_token_counts, with exact token counts of whole texts by tokenizer files as versions besides words and bytes."""
    return _token_totals(spark, sf_dir, tokenizers)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup with the two versions that SQL can count, words and bytes; op6_tokenizer_counts has those of tokenizers too."""
    return _token_totals(spark, sf_dir, {})


def _token_totals(spark: SparkSession, sf_dir: str, tokenizers: Mapping[str, str]) -> DataFrame:
    """Totals after three batches: estimated counts come in, exact counts revise them (that batch is
    delivered twice), and later copies of a text are deleted. A version for each counter and tokenizer."""
    docs = table(spark, sf_dir, "documents")
    counted = docs.select(
        "doc_id", "source", "lang", F.coalesce(F.ceil(F.col("n_chars") / 6), F.lit(0)).cast("long").alias("guess"),
        F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), *[count(F.col("text")).alias(v) for v, count in COUNTERS.items()], "text")
    with small_batches(spark):
        counted = written(token_counts.tokenizer_counts(counted, tokenizers) if tokenizers else counted.drop("text"))
    # the id is part of the key, so that copies of one text are spread
    first = counted.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
    copies = counted.where("doc_id IS NOT NULL").join(first, ["h1", "h2", "doc_id"], "left_anti")
    versions = F.explode(F.array(*[
        F.struct(F.lit(v).alias("tokenizer_version"), F.col(f"`{v}`").alias("exact")) for v in (*COUNTERS, *tokenizers)])).alias("c")
    keys = ["source", "lang", "tokenizer_version"]
    each = lambda df: df.select("source", "lang", "guess", versions).select("source", "lang", "guess", "c.*")
    nothing = F.lit(None).cast("long")
    store = shared_folder(spark)
    token_counts.commit(spark, store, "0-insert", each(counted).select(
        F.lit("insert").alias("op"), *keys, nothing.alias("old_tokens"), F.col("guess").alias("new_tokens")))
    for _ in range(2):
        token_counts.commit(spark, store, "1-revise", each(counted).select(
            F.lit("revise").alias("op"), *keys, F.col("guess").alias("old_tokens"), F.col("exact").alias("new_tokens")))
    token_counts.commit(spark, store, "2-delete", each(copies).select(
        F.lit("delete").alias("op"), *keys, F.col("exact").alias("old_tokens"), nothing.alias("new_tokens")))
    forget(counted)
    return token_counts.totals(spark, store)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit_rules(docs, labels)
    return quality.score_quality(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = PIECES) -> DataFrame:
    """Piece ids of every text, and whether decoding returns the text (null: empty)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_trie.round_trip(docs, model_path).select(
        "doc_id", "piece_ids", sentencepiece_trie.piece_count().alias("n_pieces"), "same")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the base phrases and all license labels of every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations."""
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, QueryFn] = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filters": op2_url_filters,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_tokenizer_counts": op6_tokenizer_counts,
    "op6_token_counts": op6_token_counts,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality": op8_quality,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_license_scan": op11_license_scan,
    "op12_lexical_search": op12_lexical_search,
    "op13_prefix_trie": op13_prefix_trie,
}
