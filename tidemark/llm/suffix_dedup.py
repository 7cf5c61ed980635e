"""Byte-level dedup after prefix-free parsing: removes strings of 50 bytes that an earlier document has.

1. Parse. A rolling hash of 8 bytes runs over every text; in each window of 50 bytes the place of the
   least hash is a trigger. Triggers cut texts into phrases, and as they depend on bytes inside the
   window alone, equal windows have equal triggers. Around a trigger lie 29 bytes (before or after
   it, whichever the window covers) that every window of that trigger and side contains. Spark counts
   them: phrases whose surroundings occur in one document only are done with.
2. Dictionary. The rest is sent as phrases with what its windows reach into, each distinct one once
   for a task. Spark brings those with equal triggers together; equal phrases are one dictionary
   entry with the smallest document that has it, however often it is repeated.
3. Order. The suffixes of a group's dictionary entries that start a window are sorted by their bytes.
   Neighbours that agree in 50 bytes are one string of the corpus; its smallest document is the least
   of its entries' documents. The parse says where each entry stands: there, windows with a smaller
   document are covered.
4. Covered bytes are cut out of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NO_ID, bucket_count, doc_key
from tidemark.llm.packed import (
    BUCKET_ROWS, DOC, Texts, U, decoder, doc_bucket, encode, encode_by_doc, mix, once_each, ranges, reduce_buckets, rows_again,
    span_hashes, text_blocks, with_texts,
)

SIZE = 50
GRAM = 8
AROUND = 29  # bytes of the surroundings, the trigger's own 8 included
BLOCK = 1 << 20
#: Windows at .. at+more have the trigger at at+off. asks: 0 known to be in two documents, 1 to be settled, 2 a witness only.
PHRASE = np.dtype([("low", "<u4"), ("high", "u1"), ("at", "<u4"), ("more", "u1"), ("off", "u1"), ("asks", "u1")])
SHARED = np.dtype([("at", "<u4"), ("more", "u1"), ("off", "u1")])
COVERED = np.dtype([("at", "<u4"), ("more", "u1")])
#: A phrase as it stands in a document; its bytes follow the entries, in their order.
UNIT = np.dtype([("did", "<i8"), ("th", "<i8"), ("at", "<u4"), ("more", "u1")])


def grams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number (fewer places by 7)."""
    if len(data) < GRAM:
        return np.zeros(0, U)
    return np.ndarray((len(data) - GRAM + 1,), "<u8", data.tobytes(), 0, (1,)).astype(U)


def phrases_of(texts: Texts, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows more, trigger) for each run of windows with one trigger and side; places in the block."""
    count = np.maximum(np.diff(texts.starts) - size + 1, 0)
    starts = ranges(texts.starts[:-1], count)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    shift = U(64 - int(len(texts.data)).bit_length())
    low = (U(1) << (U(64) - shift)) - U(1)
    # hash in the high bits, place in the low ones: the least is the first of equal ones
    h = grams(texts.data)
    h *= U(0x9FB21C651E98DF25)
    h ^= h >> U(29)
    h *= U(0xD6E8FEB86659FD93)
    h = (h & ~low) | np.arange(len(h), dtype=U)
    span = size - GRAM + 1
    width = 1
    while 2 * width <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    least = np.minimum(h[: len(h) - (span - width)], h[span - width :])
    trigger = (least[starts] & low).astype(np.int64)
    before = (trigger - starts) >= AROUND - GRAM
    new = np.ones(len(starts), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (before[1:] != before[:-1]) | (np.diff(starts) != 1)
    first = np.flatnonzero(new)
    more = np.diff(np.append(first, len(starts))) - 1
    owner = np.searchsorted(texts.starts, starts[first], "right") - 1
    return owner, starts[first], more, trigger[first]


def surroundings(data: np.ndarray, at: np.ndarray, trigger: np.ndarray) -> np.ndarray:
    """40-bit keys of the 29 bytes before or after the trigger that windows of this phrase share."""
    before = (trigger - at) >= AROUND - GRAM
    lo = np.where(before, trigger - (AROUND - GRAM), trigger)
    return (span_hashes(data, lo, lo + AROUND) ^ before.astype(U)) >> U(24)


def _docs(texts: Texts) -> np.ndarray:
    docs = np.empty(len(texts), DOC)
    docs["did"], docs["th"] = texts.did, texts.th
    return docs


def _two_docs(key: np.ndarray, did: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in two documents, and one member of every such key."""
    order = np.lexsort((did, key))
    k, d = key[order], did[order]
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(k)))
    two = d[start] != d[start + size - 1] if len(k) else np.zeros(0, bool)
    out = np.zeros(len(key), bool)
    out[order] = np.repeat(two, size)
    return out, order[start[two]]


def _phrase_rows(buckets: int, size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in map(once_each, text_blocks(batches, BLOCK)):
            doc, at, more, trigger = phrases_of(texts, size)
            if not len(doc):
                continue
            key = surroundings(texts.data, at, trigger)
            known, witness = _two_docs(key, texts.did[doc])
            # of a key that the task has in two documents, one witness goes to the key's bucket
            asks = np.concatenate([np.where(known, 0, 1), np.full(len(witness), 2)])
            pick = np.concatenate([np.arange(len(key)), witness])
            entries = np.empty(len(pick), PHRASE)
            told = np.where(asks == 0, U(0), key[pick])
            entries["low"], entries["high"] = told & U(0xFFFFFFFF), told >> U(32)
            entries["at"], entries["more"], entries["asks"] = (at - texts.starts[doc])[pick], more[pick], asks
            entries["off"] = (trigger - at)[pick]
            docs = _docs(texts)
            bucket = np.where(asks == 0, doc_bucket(docs["did"], docs["th"], buckets)[doc[pick]], (mix(key[pick]) % U(buckets)).astype(np.int64))
            yield encode(bucket, entries, docs, doc[pick])

    return rows


def _shared_phrases(buckets: int):
    def reducer(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        known = rows[rows["asks"] == 0]
        rows = rows[rows["asks"] > 0]
        # a witness stands for two documents
        key = rows["low"].astype(U) | rows["high"].astype(U) << U(32)
        two, _ = _two_docs(key, rows["did"])
        seen = np.isin(key, key[rows["asks"] == 2])
        out = np.concatenate([known, rows[(two | seen) & (rows["asks"] == 1)]])
        if len(out):
            yield encode_by_doc(out, SHARED, buckets)

    return reducer


def _unit_rows(buckets: int, size: int):
    def rows(found: np.ndarray, place: np.ndarray, texts: Texts) -> Iterator[pa.RecordBatch]:
        if not len(found):
            return
        _, once = np.unique(place * (1 << 40) + found["at"], return_index=True)  # repeated rows name a phrase twice
        found, place = found[once], place[once]
        at = found["at"].astype(np.int64) + texts.starts[place]
        length = found["more"].astype(np.int64) + size
        key = surroundings(texts.data, at, at + found["off"])
        content = span_hashes(texts.data, at, at + length)
        # a phrase that a smaller document of the block has as a whole is covered as a whole
        order = np.lexsort((texts.did[place], content))
        c, d = content[order], texts.did[place][order]
        start = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        head = np.repeat(start, np.diff(np.append(start, len(c))))
        covered = np.zeros(len(c), bool)
        covered[order] = d > d[head]
        units = np.empty(len(found), UNIT)
        units["did"], units["th"], units["at"], units["more"] = found["did"], found["th"], found["at"], found["more"]
        if covered.any():
            yield _unit_batch(doc_bucket(units["did"][covered], units["th"][covered], buckets), units[covered], None, None, None)
        left = ~covered
        yield _unit_batch((mix(key[left]) % U(buckets)).astype(np.int64), units[left], texts.data, at[left], length[left])

    return rows


def _unit_batch(bucket: np.ndarray, units: np.ndarray, data: np.ndarray | None, at, length) -> pa.RecordBatch:
    """One row for each bucket: units and their bytes; without bytes for units that are covered as a whole."""
    order = np.lexsort((units["at"], units["th"], units["did"], bucket))
    found, first = np.unique(bucket[order], return_index=True)
    rows = []
    for i, j in zip(first, np.append(first[1:], len(order)), strict=True):
        mine = order[i:j]
        text = data[ranges(at[mine], length[mine])].tobytes() if data is not None else b""
        columns = [np.ascontiguousarray(units[n][mine]).tobytes() for n in UNIT.names]
        raw = b"".join((np.array([len(mine), data is not None], "<i8").tobytes(), *columns, text))
        rows.append(len(raw).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(raw, asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(rows, pa.binary())], names=["bucket", "rows"])


def _unit_parts(rows: bytes) -> np.ndarray:
    """A row as one object: kept apart until the bucket is complete."""
    out = np.empty(1, object)
    out[0] = rows
    return out


def window_ranks(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows of size bytes at starts by their bytes, and the number of each one's group of equal ones."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).tobytes()
    words = np.ndarray((len(data) + 1,), ">u8", padded, 0, (1,))
    order = np.arange(len(starts))
    rank = np.zeros(len(starts), np.int64)  # of the group so far, by place in order
    tied = np.ones(len(starts), bool)
    for k in range(0, size, 8):
        now = np.flatnonzero(tied)
        if not len(now):
            break
        word = words[starts[order[now]] + k].astype(U)
        if size - k < 8:
            word >>= U(8 * (8 - (size - k)))
        by = np.lexsort((word, rank[now]))
        word, group = word[by], rank[now][by]
        order[now] = order[now][by]
        new = np.append(True, (word[1:] != word[:-1]) | (group[1:] != group[:-1]))
        head = np.flatnonzero(new)
        sizes = np.diff(np.append(head, len(now)))
        rank[now] = now[np.repeat(head, sizes)]  # a group is named by where it begins
        tied[now] = np.repeat(sizes, sizes) > 1
    return order, rank


def _covered_windows(buckets: int, size: int):
    def reducer(held: np.ndarray) -> Iterator[pa.RecordBatch]:
        units, texts, whole = [], [], []
        for row in held:
            raw = pa.Codec("zstd").decompress(row[8:], int.from_bytes(row[:8], "little"), asbytes=True)
            n, has_text = (int(x) for x in np.frombuffer(raw, "<i8", 2))
            part, place = np.empty(n, UNIT), 16
            for name in UNIT.names:
                part[name] = np.frombuffer(raw, UNIT[name], n, place)
                place += n * UNIT[name].itemsize
            if has_text:
                units.append(part)
                texts.append(np.frombuffer(raw, np.uint8, -1, 16 + n * UNIT.itemsize))
            else:
                whole.append(part)
        out = list(whole)
        if units:
            units, data = np.concatenate(units), np.concatenate(texts)
            length = units["more"].astype(np.int64) + size
            at = np.cumsum(length) - length
            # the dictionary: distinct phrases with their smallest document
            content = span_hashes(data, at, at + length)
            order = np.lexsort((units["did"], content))
            head = np.flatnonzero(np.append(True, content[order][1:] != content[order][:-1]))
            entry = np.empty(len(units), np.int64)
            entry[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(order))))
            one = order[head]
            smallest = units["did"][one]
            # its suffixes in order; equal neighbours are one string
            windows = units["more"][one].astype(np.int64) + 1
            first = np.cumsum(windows) - windows
            starts, of = ranges(at[one], windows), np.repeat(np.arange(len(one)), windows)
            order, rank = window_ranks(data, starts, size)
            heads = np.flatnonzero(rank == np.arange(len(rank)))
            least = np.minimum.reduceat(smallest[of[order]], heads)
            doc = np.empty(len(order), np.int64)
            doc[order] = np.repeat(least, np.diff(np.append(heads, len(order))))
            # back to where the phrases stand
            count = units["more"].astype(np.int64) + 1
            unit = np.repeat(np.arange(len(units)), count)
            step = np.arange(len(unit)) - np.repeat(np.cumsum(count) - count, count)
            hit = doc[first[entry][unit] + step] < units["did"][unit]
            unit, step = unit[hit], step[hit]
            if len(unit):
                new = np.append(True, (unit[1:] != unit[:-1]) | (step[1:] != step[:-1] + 1))
                run = np.flatnonzero(new)
                rows = units[unit[run]].copy()
                rows["at"] += step[run].astype(np.uint32)
                rows["more"] = np.diff(np.append(run, len(unit))) - 1
                out.append(rows)
        if out:
            yield encode_by_doc(np.concatenate(out), COVERED, buckets)

    return reducer


def _kept(size: int):
    def rows(found: np.ndarray, place: np.ndarray, texts: Texts) -> Iterator[pa.RecordBatch]:
        step = np.zeros(len(texts.data) + 1, np.int32)
        at = found["at"].astype(np.int64) + texts.starts[place]
        np.add.at(step, at, 1)
        np.add.at(step, at + found["more"] + size, -1)
        gone = np.cumsum(step[:-1]) > 0
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        border = texts.starts[:-1][np.diff(texts.starts) > 0]
        edge[border] = gone[border]
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, edge)]
        n_removed, n_spans = (x[texts.starts[1:]] - x[texts.starts[:-1]] for x in sums)
        kept = []
        touched = n_removed > 0
        data = texts.data.tobytes()
        for i in range(len(texts)):
            lo, hi = int(texts.starts[i]), int(texts.starts[i + 1])
            kept.append(texts.data[lo:hi][~gone[lo:hi]].tobytes() if touched[i] else data[lo:hi])
        yield rows_again(texts, pa.RecordBatch.from_arrays([
            pa.array(texts.did), pa.array(np.diff(texts.starts)), pa.array(n_removed.astype(np.int64)), pa.array(n_spans.astype(np.int64)),
            pa.array(kept, pa.binary())], names=["_did", "n_bytes", "n_removed", "n_spans", "kept"]))

    return rows


def dedup_bytes(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans and kept (binary).

    Texts are UTF-8 bytes, a null text is empty. Every byte is removed that a string of size bytes
    covers which also starts in a document with a smaller doc_id; strings are judged on the input and
    lie within one text. n_spans counts maximal removed runs. kept joins the other bytes and may cut
    characters. Texts shorter than size stay whole. A null doc_id counts as the largest. Rows that
    repeat a doc_id are the same document: they remove nothing from each other. Other columns are
    ignored. Strings that a bucket compares are compared byte by byte; equal phrases are found by
    64-bit hashes.
    """
    buckets = bucket_count(docs)
    keyed = docs.select(*doc_key(), F.coalesce("text", F.lit("")).alias("text"))
    phrases = keyed.mapInArrow(_phrase_rows(buckets, size), BUCKET_ROWS)
    shared = reduce_buckets(phrases, buckets, decoder(DOC, PHRASE), _shared_phrases(buckets), BUCKET_ROWS)
    fine = 2 * buckets
    units = with_texts(keyed, shared, buckets, decoder(DOC, SHARED), _unit_rows(fine, size), BUCKET_ROWS, 4 * BLOCK)
    covered = reduce_buckets(units, fine, _unit_parts, _covered_windows(buckets, size), BUCKET_ROWS)
    schema = "_did long, n_bytes long, n_removed long, n_spans long, kept binary"
    kept = with_texts(keyed, covered, buckets, decoder(DOC, COVERED), _kept(size), schema)
    return kept.select(F.nullif("_did", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
