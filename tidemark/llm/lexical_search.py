"""Ranked lexical search by an Aho-Corasick scan of the documents.

All terms of the items form one automaton, each between two guard blanks, so that it finds whole terms
only. Documents are read once: letters A-Z are lowered, what separates terms becomes a blank, and the
automaton counts every item term in the text, without an index of the documents. What it puts out is a
term's number; terms map to the items that hold them.

Collection counts (documents, terms, documents of each term) come from the counts of that scan. A second
step reads the counts, not the texts: each task scores its documents for all items and keeps the best
rows of each item, and the best of those are ranked. Items are read in blocks of bounded size, each sent
to all tasks and searched in a scan of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import NO_ID, forget, give_back, small_batches, written
from tidemark.llm.packed import ranges

#: Bytes to what they count as: A-Z in lower case, other ASCII but digits and letters as blanks.
GUARDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTS = "doc_id long, n long, term array<int>, tf array<int>"
BEST = "item int, doc_id long, score long"
#: Scores that a task holds at a time (documents times items), and rows beyond the best that it keeps before it cuts.
SCORES, SPARE = 1 << 21, 1 << 18


def guarded(text: str | None) -> bytes:
    """A text's terms between blanks, at least one blank at either end."""
    return b" " + (text or "").encode().translate(GUARDED) + b" "


def terms_of(text: str | None) -> list[str]:
    return [t.decode() for t in guarded(text).split()]


class Items:
    """A block of items: their distinct terms in order, and by term the items that hold it."""

    def __init__(self, texts: list[str | None]):
        own = [set(terms_of(t)) for t in texts]
        self.count = len(texts)
        self.terms = sorted(set().union(*own)) if own else []
        number = {t: i for i, t in enumerate(self.terms)}
        pairs = sorted((number[t], i) for i, ts in enumerate(own) for t in ts)
        self.holder = np.array([i for _, i in pairs], np.int64)
        held = np.bincount([t for t, _ in pairs], minlength=len(self.terms)) if pairs else np.zeros(len(self.terms), np.int64)
        self.start, self.held = np.cumsum(held) - held, held.astype(np.int64)


def _counts(terms: list[str]):
    """Per document: its id, number of terms, and the automaton's terms that it holds with their occurrences."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            automaton.add_word(f" {term} ", i)
        automaton.make_automaton()
        output = itemgetter(1)
        for batch in batches:
            n, sizes, found, times = [], [], [], []
            for text in batch.column("text").to_pylist():
                flat = guarded(text)
                n.append(len(flat.split()))
                many = Counter(map(output, automaton.iter(flat.decode()))) if terms and n[-1] else {}
                sizes.append(len(many))
                found.extend(many)
                times.extend(many.values())
            edges = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(edges, pa.array(found, pa.int32())),
                pa.ListArray.from_arrays(edges, pa.array(times, pa.int32()))], names=["doc_id", "n", "term", "tf"])
        give_back()

    return rows


def _top(item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each item's k best rows: highest score first, then smallest document."""
    order = np.lexsort((doc, -score, item))
    first = np.searchsorted(item[order], item[order])
    return order[np.arange(len(order)) - first < k]


def _best(items: Items, weight: np.ndarray, n_docs: int, n_terms: int, k: int):
    """The k best documents of a task for each item."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        least = np.zeros(items.count, np.int64)  # what a score must reach once k better ones are known
        for batch in batches:
            step = max(1, SCORES // max(1, items.count))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                lists = part.column("term")
                size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                tf = part.column("tf").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                m = 50 + 50 * part.column("n").to_numpy() * n_docs // n_terms
                row = np.repeat(np.arange(len(size)), size)
                value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))
                # a share of the documents at a time: a term goes to all the items that hold it
                spread = np.cumsum(items.held[term])
                doc = part.column("doc_id").fill_null(NO_ID).to_numpy()
                scores = np.zeros(len(size) * items.count, np.int64)
                begin = 0
                while begin < len(term):
                    stop = max(begin + 1, int(np.searchsorted(spread, (spread[begin - 1] if begin else 0) + SCORES, "right")))
                    t = term[begin:stop]
                    count = items.held[t]
                    to = items.holder[ranges(items.start[t], count)]
                    np.add.at(scores, np.repeat(row[begin:stop] * items.count, count) + to, np.repeat(value[begin:stop], count))
                    begin = stop
                scores = scores.reshape(len(size), items.count)
                at, item = np.nonzero((scores > 0) & (scores >= least[None, :]))
                held = [np.concatenate(x) for x in zip(held, (item, doc[at], scores[at, item]), strict=True)]
                if len(held[0]) > items.count * k + SPARE:
                    keep = _top(*held, k)
                    held = [x[keep] for x in held]
                    first = np.searchsorted(held[0], np.arange(items.count))
                    full = np.searchsorted(held[0], np.arange(items.count), "right") - first >= k
                    least[full] = held[2][(first + k - 1)[full]]
        keep = _top(*held, k)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep], t) for x, t in zip(held, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "score"])

    return rows


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, block_mb: int = 4) -> DataFrame:
    """The k highest-scoring documents (doc_id, text) of each item (item_id, text): item_id, rank, doc_id, score.

    Terms are runs of digits, letters and all characters beyond ASCII, A-Z lower-cased; null texts have
    none. A term's weight is floor(1000 * ln((2 N + 2) / (2 df + 1))), where N counts the documents with
    terms; its part of a document's score is weight * ((10^9 * tf) div (1000 * tf + 20 * m)) with m =
    50 + (50 * n * N) div L, n the document's terms and L those of all. Only scores above 0 are ranked;
    equal ones by ascending doc_id, null last. Every row of items is an item and every row of docs a
    document, so repeated rows are ranked again, and repeated ids have results of their own. An item
    without terms has no rows, nor does any item over an empty table. Other columns are ignored. block_mb
    bounds the text of the items that tasks hold at a time; more items are searched in several scans.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // (block_mb << 20) + 1
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        rows = sorted(rows, key=lambda r: (r.item_id is None, r.item_id or 0, r.text))
        some = Items([r.text for r in rows])
        with small_batches(spark):
            counted = written(read.mapInArrow(_counts(some.terms), COUNTS))
        n_docs, n_terms = counted.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        if n_docs and some.terms:
            n, df = F.lit(float(2 * n_docs + 2)), 2.0 * F.col("df") + 1.0
            weights = counted.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
            weight = np.zeros(len(some.terms), np.int64)
            for r in weights.select("term", F.floor(1000.0 * F.log(n / df)).alias("w")).toLocalIterator():
                weight[r.term] = r.w
            best = written(counted.mapInArrow(_best(some, weight, n_docs, n_terms, k), BEST))
            order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
            best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], "item int, item_id long")
            out.append(best.join(names, "item").select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score"))
        forget(counted)
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found
