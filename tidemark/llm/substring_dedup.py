"""Substring dedup over words by recompression: removes repeats of 20 words and more.

Rounds replace runs of one symbol, and then pairs of neighbours, by new symbols. Which pairs are
joined is decided by one bit of each symbol (a left one followed by a right one), and a new symbol's
name is a hash of the names it stands for, so all tasks give equal names to equal words without
asking each other. A symbol's context is the span of words that settles that it is formed there and
in this way. Wherever the same words as in that span stand, the same symbol is formed: a window of
20 words therefore has the same symbols inside, wherever it occurs.

1. Every window takes as its anchor one symbol, of the highest level at which there is one whose
   context lies inside: of these the one with the least hash. Spark brings equal anchors together; windows whose anchor (name and
   words of its context) occurs once in the corpus are done.
2. Windows with shared anchors are compared as a whole: Spark finds the first place of each.
3. What later windows cover is removed from the texts.

An exchange holds at most one entry for a key and flush of a task: occurrences that a task sees
together are settled in the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NO_ID, bucket_count, doc_key
from tidemark.llm.packed import (
    BUCKET_ROWS, DOC, Texts, U, decoder, doc_bucket, encode, encode_by_doc, mix, once_each, ranges, reduce_buckets, rows_again,
    span_hashes, text_blocks, window_hashes, with_texts, words_of,
)

WINDOW = 20
TOP = 4
BLOCK = 2 << 20
#: Windows at .. at+more of a document have the anchor. asks: 0 known to be shared, 1 to be settled, 2 a witness only.
ANCHOR = np.dtype([("key", "<u8"), ("at", "<u4"), ("more", "u1"), ("asks", "u1")])
SHARED = np.dtype([("at", "<u4"), ("more", "u1")])
#: A window of a document. later: known not to be the first.
PLACE = np.dtype([("key", "<u8"), ("at", "<u4"), ("later", "u1")])
REMOVED = np.dtype([("at", "<u4")])


class Symbols:
    """A level: names, first and last word of each symbol, first and last word of its context, its text."""

    def __init__(self, name, first, last, left, right, owner):
        self.name, self.first, self.last, self.left, self.right, self.owner = name, first, last, left, right, owner

    def join(self, start: np.ndarray, end: np.ndarray, name, left, right) -> Symbols:
        """Symbols start .. end (inclusive) of this level become one."""
        return Symbols(name, self.first[start], self.last[end], left, right, self.owner[start])


def _runs(s: Symbols, words: np.ndarray, level: int) -> Symbols:
    """Runs of one symbol become a symbol. It is enough to see one word on either side that differs."""
    n = len(s.name)
    new = np.ones(n, bool)
    new[1:] = (s.name[1:] != s.name[:-1]) | (s.owner[1:] != s.owner[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], n) - 1
    length = end - start + 1
    name = np.where(length > 1, mix(s.name[start] ^ mix(length.astype(U) * U(64) + U(level))), s.name[start])
    left, right = s.left[start].copy(), s.right[end].copy()
    inner = start > 0
    inner[inner] = s.owner[start[inner] - 1] == s.owner[start[inner]]
    before = np.maximum(s.first[start] - 1, 0)
    told = words[before] != words[s.last[start]]
    seen = np.where(told, before, s.left[np.maximum(start - 1, 0)])
    left = np.where(inner, np.minimum(left, seen), s.first[start] - 1)  # a text's border is in no window
    inner = end < n - 1
    inner[inner] = s.owner[end[inner] + 1] == s.owner[end[inner]]
    after = np.minimum(s.last[end] + 1, len(words) - 1)
    told = words[after] != words[s.first[end]]
    seen = np.where(told, after, s.right[np.minimum(end + 1, n - 1)])
    right = np.where(inner, np.maximum(right, seen), s.last[end] + 1)
    return s.join(start, end, name, left, right)


def _pairs(s: Symbols, level: int) -> Symbols:
    """A left symbol and a right one after it become a symbol."""
    n = len(s.name)
    is_left = (mix(s.name ^ U(level + 1)) & U(1)) == U(0)
    same = s.owner[1:] == s.owner[:-1]
    pair = np.zeros(n, bool)  # with the next one
    pair[:-1] = is_left[:-1] & ~is_left[1:] & same
    second = np.zeros(n, bool)
    second[1:] = pair[:-1]
    start = np.flatnonzero(~second)
    end = start + pair[start]
    name = np.where(pair[start], mix(s.name[start] * U(3) + mix(s.name[end] + U(level))), s.name[start])
    # alone: a left one shows by what follows, a right one by what goes before
    alone = ~pair[start]
    has_next = np.zeros(n, bool)
    has_next[:-1] = same
    has_last = np.zeros(n, bool)
    has_last[1:] = same
    follows = np.where(has_next[start], s.right[np.minimum(start + 1, n - 1)], s.last[start] + 1)
    precedes = np.where(has_last[start], s.left[np.maximum(start - 1, 0)], s.first[start] - 1)
    right = np.where(alone & is_left[start], np.maximum(follows, s.right[start]), s.right[end])
    left = np.where(alone & ~is_left[start], np.minimum(precedes, s.left[start]), s.left[start])
    return s.join(start, end, name, left, right)


def levels_of(words: np.ndarray, first: np.ndarray, size: int = WINDOW) -> list[Symbols]:
    """Levels 0 (words) to TOP, as long as some context fits into size words."""
    n = len(words)
    at = np.arange(n, dtype=np.int64)
    levels = [Symbols(words, at, at, at, at, np.repeat(np.arange(len(first) - 1), np.diff(first)))]
    for level in range(TOP):
        s = _pairs(_runs(levels[-1], words, level), level) if n else levels[-1]
        if not n or not (s.right - s.left < size).any():
            break
        levels.append(s)
    return levels


def anchors_of(words: np.ndarray, first: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows more, key) of each anchor. Windows are counted by their first word in the block."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    open_ = ranges(first[:-1], count)
    key = np.zeros(len(open_), U)
    who = np.zeros(len(open_), np.int64)
    todo = np.arange(len(open_))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(words * _powers(len(words)))])
    back = _powers(len(words) + 1, -1)
    for level, s in reversed(list(enumerate(levels_of(words, first, size)))):
        if not len(todo):
            break
        # contexts begin, and end, in the order of the symbols: those inside a window are neighbours
        p = open_[todo]
        ahead = np.searchsorted(s.left, np.arange(len(words) + 1))
        lo = ahead[p]
        hi = np.searchsorted(s.right, np.arange(len(words) + size), "right")[p + size - 1]
        inside = hi > lo
        got = todo[inside]
        i = _least(mix(s.name), lo[inside], hi[inside], size)
        span = (sums[s.right[i] + 1] - sums[s.left[i]]) * back[s.left[i]]
        key[got] = s.name[i] ^ mix(span + U(level)) ^ (s.right[i] - s.left[i]).astype(U)
        who[got] = i * (TOP + 1) + level
        todo = todo[~inside]
    owner = np.repeat(np.arange(len(count)), count)
    new = np.ones(len(open_), bool)
    new[1:] = (who[1:] != who[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    more = np.diff(np.append(start, len(open_))) - 1
    return owner[start], open_[start], more, mix(key[start])


def _least(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int) -> np.ndarray:
    """Place of the least of h[lo:hi], the first of equal ones, for ranges of 1 to most members."""
    at = np.arange(len(h))
    out = lo.copy()
    width, step = hi - lo, 1
    while step <= most:
        mine = (width >= step) & (width < 2 * step)
        if mine.any():
            x, y = at[lo[mine]], at[hi[mine] - step]
            out[mine] = np.where(h[y] < h[x], y, x)
        nxt = at.copy()
        if len(h) > step:
            x, y = at[:-step], at[step:]
            nxt[:-step] = np.where(h[y] < h[x], y, x)
        at, step = nxt, 2 * step
    return out


def _powers(n: int, sign: int = 1) -> np.ndarray:
    out = np.full(n, pow(0xA24BAED4963EE407, sign, 1 << 64), U)
    out[:1] = 1
    return np.cumprod(out)


def _docs(texts: Texts) -> np.ndarray:
    docs = np.empty(len(texts), DOC)
    docs["did"], docs["th"] = texts.did, texts.th
    return docs


def _words(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = words_of(texts)
    return span_hashes(texts.data, starts, ends), first


def _entry_batch(dtype: np.dtype, docs: np.ndarray, doc: np.ndarray, to_doc: np.ndarray, buckets: int, **columns: np.ndarray) -> pa.RecordBatch:
    """Entries packed by the bucket of their document (to_doc) or else of their key."""
    entries = np.empty(len(doc), dtype)
    for name, values in columns.items():
        entries[name] = values
    bucket = np.where(to_doc, doc_bucket(docs["did"], docs["th"], buckets)[doc], (mix(entries["key"]) % U(buckets)).astype(np.int64))
    return encode(bucket, entries, docs, doc)


def _anchor_rows(buckets: int, size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in map(once_each, text_blocks(batches, BLOCK)):
            words, first = _words(texts)
            doc, at, more, key = anchors_of(words, first, size)
            at = at - first[doc]
            group, counts, one = _grouped(key)
            seen_twice = counts[group] > 1
            witness = one[counts > 1]
            asks = np.concatenate([np.where(seen_twice, 0, 1), np.full(len(witness), 2)])
            pick = np.concatenate([np.arange(len(key)), witness])
            if len(pick):
                yield _entry_batch(ANCHOR, _docs(texts), doc[pick], asks == 0, buckets, key=key[pick], at=at[pick], more=more[pick], asks=asks)

    return rows


def _shared_anchors(buckets: int):
    def reducer(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        known = rows[rows["asks"] == 0]
        rows = rows[rows["asks"] > 0]
        group, counts, _ = _grouped(rows["key"])
        out = np.concatenate([known, rows[(counts[group] > 1) & (rows["asks"] == 1)]])
        if len(out):
            yield encode_by_doc(out, SHARED, buckets)

    return reducer


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each key its group, for each group its size and one member."""
    _, one, group, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return group, counts, one


def _later(key: np.ndarray, did: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key and place, and whether each row of it stands after the first place of its key."""
    order = np.lexsort((at, did, key))
    key, did, at = key[order], did[order], at[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    head = np.repeat(start, np.diff(np.append(start, len(key))))
    return order, (did != did[head]) | (at != at[head])


def _place_rows(buckets: int, size: int):
    def rows(found: np.ndarray, place: np.ndarray, texts: Texts) -> Iterator[pa.RecordBatch]:
        if not len(found):
            return
        words, first = _words(texts)
        counts = found["more"].astype(np.int64) + 1
        doc, at = np.repeat(place, counts), ranges(found["at"].astype(np.int64), counts)
        _, once = np.unique(doc * (1 << 40) + at, return_index=True)  # repeated rows name a window twice
        doc, at = doc[once], at[once]
        key = window_hashes(words, size)[first[doc] + at]
        order, later = _later(key, texts.did[doc], at)
        yield _entry_batch(PLACE, _docs(texts), doc[order], later, buckets, key=key[order], at=at[order], later=later)

    return rows


def _later_places(buckets: int):
    def reducer(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        known = rows[rows["later"] == 1]
        rows = rows[rows["later"] == 0]
        order, later = _later(rows["key"], rows["did"], rows["at"])
        out = np.concatenate([known, rows[order][later]])
        if len(out):
            yield encode_by_doc(out, REMOVED, buckets)

    return reducer


def _kept_texts(size: int):
    def rows(found: np.ndarray, place: np.ndarray, texts: Texts) -> Iterator[pa.RecordBatch]:
        edges = np.searchsorted(place, np.arange(len(texts) + 1))
        data = texts.data.tobytes()
        counts, gone, kept = [], [], []
        for i in range(len(texts)):
            words = data[texts.starts[i] : texts.starts[i + 1]].split()
            at = found["at"][edges[i] : edges[i + 1]].astype(np.int64)
            if len(at):
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + size, -1)
                keep = np.cumsum(step[:-1]) == 0
                kept.append(b" ".join(compress(words, keep.tolist())))
                gone.append(len(words) - int(keep.sum()))
            else:
                kept.append(b" ".join(words))
                gone.append(0)
            counts.append(len(words))
        yield rows_again(texts, pa.RecordBatch.from_arrays(
            [pa.array(texts.did), pa.array(texts.th), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["_did", "_th", "n_words", "n_removed", "kept_text"]))

    return rows


def dedup_substrings(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, _th (a hash of the text), n_words, n_removed and kept_text.

    Words are what stands between ASCII white space, unchanged. A window is size words of one text.
    Every word is removed that is in a window whose words also start earlier: in a smaller doc_id, or
    in the same document further in front. Windows are judged on the input. Kept words are joined by
    one space. A null text is an empty one and has no words. A null doc_id counts as the largest.
    Rows that repeat a doc_id are occurrences at the same places of one document: none of two equal
    rows is before the other. Other columns are ignored. Windows are compared by 64-bit hashes within
    groups of equal anchors.
    """
    buckets = bucket_count(docs)
    keyed = docs.select("doc_id", *doc_key(), F.coalesce("text", F.lit("")).alias("text"))
    texts = keyed.select("_did", "_th", "text")
    anchors = texts.mapInArrow(_anchor_rows(buckets, size), BUCKET_ROWS)
    shared = reduce_buckets(anchors, buckets, decoder(DOC, ANCHOR), _shared_anchors(buckets), BUCKET_ROWS)
    places = with_texts(texts, shared, buckets, decoder(DOC, SHARED), _place_rows(buckets, size), BUCKET_ROWS)
    later = reduce_buckets(places, buckets, decoder(DOC, PLACE), _later_places(buckets), BUCKET_ROWS)
    schema = "_did long, _th long, n_words long, n_removed long, kept_text string"
    kept = with_texts(texts, later, buckets, decoder(DOC, REMOVED), _kept_texts(size), schema)
    return kept.select(F.nullif("_did", F.lit(NO_ID)).alias("doc_id"), "_th", "n_words", "n_removed", "kept_text")


def without_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs with all columns; where words were removed, text is what was kept and n_chars its length.

    Texts that lose nothing stay as they are, to the byte. Texts that lose every word go.
    """
    changed = dedup_substrings(docs, size).where("n_removed > 0").select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("_did"), "_th", "kept_text").dropDuplicates(["_did", "_th"])
    joined = docs.select(F.struct("*").alias("row"), *doc_key()).join(changed, ["_did", "_th"], "left").where("kept_text IS NULL OR kept_text <> ''")
    new = {
        "text": F.coalesce("kept_text", "row.text"),
        "n_chars": F.when(F.col("kept_text").isNotNull(), F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None,
    }
    return joined.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])
