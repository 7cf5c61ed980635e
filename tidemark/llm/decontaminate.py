"""Benchmark decontamination: which test items stand in which documents.

Containment search by MinHash over size partitions. Test items are partitioned by their number of
shingles (a doubling each). For a partition of items of up to L shingles, documents are cut into
windows of 2 L shingles that start every L, so that an item lies within one window whatever the
length of the document, and the Jaccard similarity that its containment implies stays above a bound
(3/17 at a containment of 3/4). A MinHash signature has one least hash for each of 64 bins of the
hash domain; one equal bin makes a candidate. Only windows that contain some item's least hash get a
signature. For partitions of up to SMALL shingles every shared shingle makes a candidate, since their
signatures are too thin. Candidates are verified by the exact share of the item's shingles that the
whole document has.

What can be missed: an item of more than SMALL shingles of which 3/4 stand in one window. It has 7 shared
shingles at least, and each fails to be its bin's least with a chance of at most 1/4 (a window of 32
shingles over 64 bins), so all fail with less than 1 in 10,000; larger items have more bins, each of which
agrees with a chance of 3/17 or more, 1 in 100,000 that none does. An item that is spread in single
shingles over more than a window is not proposed for its sake, though the share that is returned counts
the whole document.

Items are the query set: they are read in blocks of bounded size, each sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NO_ID, doc_key
from tidemark.llm.jaccard_join import shingle_sequence, shingle_sets
from tidemark.llm.packed import Texts, U, ranges, text_blocks

BINS = 64
#: Items of size partitions up to so many shingles are proposed by each of their shingles.
SMALL = 8
SCHEMA = "_did long, item long, shared long, item_shingles long"


class Items:
    """A block of test items: shingle sets and, sorted by hash, the least hash of every bin of every item."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        ids = np.arange(len(raw))
        self.hashes, self.cut = shingle_sets(Texts(ids, ids, np.frombuffer(b"".join(raw), np.uint8), starts))
        n = np.diff(self.cut)
        self.size = np.int64(1) << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)
        owner = np.repeat(ids, n)
        slot = owner * BINS + bin_of(self.hashes)
        # sorted by hash, so a bin's first is its least
        least = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]) | (self.size[owner] <= SMALL)) if len(slot) else np.zeros(0, np.int64)
        order = np.argsort(self.hashes[least], kind="stable")
        self.sig, self.sig_item = self.hashes[least][order], owner[least][order]


def bin_of(h: np.ndarray) -> np.ndarray:
    """High bits of the hash: hashes of a set that are in order are in order of their bins."""
    return (h >> U(58)).astype(np.int64)


def candidate_pairs(hashes: np.ndarray, cut: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(text, item) whose signatures agree in a bin for some window, or that share a shingle if the item is small."""
    lo, hi = np.searchsorted(items.sig, hashes, "left"), np.searchsorted(items.sig, hashes, "right")
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = (hi - lo)[hit]
    at, item = np.repeat(hit, count), items.sig_item[ranges(lo[hit], count)]
    text = np.searchsorted(cut, at, "right") - 1
    size = items.size[item]
    small = size <= SMALL
    proposed = np.unique(np.stack([text[small], item[small]]), axis=1)
    at, text, item, size = at[~small], text[~small], item[~small], size[~small]
    if not len(at):
        return proposed[0], proposed[1]
    step = (at - cut[text]) // size
    # the window that starts at or before the shingle, and the one before that
    at, text, item, size = (np.concatenate([x, x]) for x in (at, text, item, size))
    step = np.concatenate([step, step - 1])
    ok = step >= 0
    at, text, item, size, step = at[ok], text[ok], item[ok], size[ok], step[ok]
    _, one, window = np.unique(np.stack([text, size, step]), axis=1, return_index=True, return_inverse=True)
    first = cut[text[one]] + step[one] * size[one]
    length = np.minimum(2 * size[one], cut[text[one] + 1] - first)
    of = np.repeat(np.arange(len(one)), length)
    h = hashes[ranges(first, length)]
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    slot = of * BINS + bin_of(h)
    least = np.append(True, slot[1:] != slot[:-1])
    signature = np.zeros(len(one) * BINS, U)
    signature[slot[least]] = h[least]
    same = signature[window.ravel() * BINS + bin_of(hashes[at])] == hashes[at]
    pairs = np.concatenate([proposed, np.unique(np.stack([text[same], item[same]]), axis=1)], axis=1)
    return pairs[0], pairs[1]


def _found(items: Items, least_share: tuple[int, int]):
    over, of = least_share

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in text_blocks(batches):
            hashes, cut = shingle_sequence(texts)
            text, item = candidate_pairs(hashes, cut, items)
            out = []
            for t, i in zip(text.tolist(), item.tolist(), strict=True):
                want = items.hashes[items.cut[i] : items.cut[i + 1]]
                shared = int(np.isin(want, hashes[cut[t] : cut[t + 1]]).sum())
                if of * shared >= over * len(want):
                    out.append((texts.did[t], i, shared, len(want)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["_did", "item", "shared", "item_shingles"])

    return rows


def contaminated(docs: DataFrame, items: DataFrame, least_share: tuple[int, int] = (3, 4), block_mb: int = 16) -> DataFrame:
    """Pairs (doc_id, item_id, shared, item_shingles, containment) with at least 3/4 of an item's shingles.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Shingles are 5 lower-cased
    words; a text of 1 to 4 words has itself as its only shingle, so such an item is found only where
    it is the whole document. Null and empty texts match nothing. Null ids stay null. Rows that
    repeat a document or an item repeat its pairs once. block_mb bounds the text of the items that
    are sent to tasks at a time; a larger set of items is searched in several scans of docs.
    """
    spark = docs.sparkSession
    known = items.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).where("text IS NOT NULL AND text <> ''").distinct()
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // (block_mb << 20) + 1
    keyed = docs.select(*doc_key(), F.lower("text").alias("text")).where("text IS NOT NULL")
    out = None
    for block in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        rows = sorted(rows, key=lambda r: (r.item_id is None, r.item_id or 0, r.text))
        found = keyed.mapInArrow(_found(Items([r.text for r in rows]), least_share), SCHEMA)
        names = pd.DataFrame({"item": range(len(rows)), "item_id": pd.array([r.item_id for r in rows], "Int64")})
        names = spark.createDataFrame(pa.Table.from_pandas(names, preserve_index=False)) if len(rows) else spark.createDataFrame([], "item long, item_id long")
        part = found.join(names, "item").drop("item")
        out = part if out is None else out.unionByName(part)
    return out.distinct().select(
        F.nullif("_did", F.lit(NO_ID)).alias("doc_id"), "item_id", "shared", "item_shingles",
        (F.col("shared") / F.col("item_shingles")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that contain no test item. A row with a null doc_id goes with the others of that id."""
    bad = contaminated(docs, items).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_bad")).distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_key"))
    return keyed.join(bad, F.col("_key") == F.col("_bad"), "left_anti").select("row.*")
