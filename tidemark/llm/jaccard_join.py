"""N-gram Jaccard join with PartEnum signatures: exact, no similar pair is lost.

Sets with a Jaccard similarity of at least 3/4 and sizes a, b differ in at most (a + b) / 7 elements.
Sizes fall into bands (a doubling each; a set whose partner may be in the next band takes part there
too). Within a band the domain of shingle hashes is cut into m ranges. A set's signatures are its
contents of single ranges: sets that differ in at most k elements differ in at most k ranges, so of
the signatures of either, all but k are shared. Each signature enumerates a subset of one partition;
those of more than k + 1 partitions are not needed, so a set keeps the k + 1 that occur in the fewest
sets (in one order for all sets the first shared signature is among the first k + 1 of both). A
passage that many texts share therefore makes no candidates unless it is most of a text. A set with
at most k ranges that are not empty also takes every shingle as a range of its own.

Texts with equal sets are one class. Candidates are compared on their whole sets, in three steps, as
what is linked already needs no second link: a class with one partner; pairs that may connect the
components that still share a signature; all pairs across components that are left. The last two
look at pairs inside tasks first, by bitmaps whose distance is a lower bound of the sets' distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bucket_count, connected_components, doc_key, forget, small_batches, written
from tidemark.llm.packed import (
    BUCKET_ROWS, Texts, U, bucket_batch, decoder, encode, joined_dtype, lowered, mix, ranges, reduce_buckets, span_hashes, text_blocks, text_column,
    window_hashes, words_of,
)
from tidemark.llm.tiles import by_tiles, pairs_of_tiles, tile_starts, tiled

GRAM = 5
TILE = 1000
TILE_KEY = ("band", "sig", "lo", "hi")
#: What a set's signatures of one kind have in common. drop: how many of the most frequent it does without.
SLOT = np.dtype([("cls", "<i8"), ("drop", "<i4"), ("kind", "u1")])
SIG = np.dtype([("sig", "<i8")])
ENTRY = joined_dtype(SLOT, SIG)
COUNTED = joined_dtype(ENTRY, np.dtype([("sets", "<i8")]))
FLUSH = 500_000


def shingle_sequence(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in the order of the texts, and where each text's start (one more at the end)."""
    data = lowered(texts.data)
    starts, ends, first = words_of(Texts(texts.did, texts.th, data, texts.starts))
    words = span_hashes(data, starts, ends)
    count = np.diff(first)
    grams = np.maximum(count - GRAM + 1, np.minimum(count, 1))
    cut = np.concatenate([[0], np.cumsum(grams)])
    out = np.zeros(cut[-1], U)
    full = count >= GRAM
    if full.any():
        out[ranges(cut[:-1][full], grams[full])] = window_hashes(words, GRAM)[ranges(first[:-1][full], grams[full])]
    for i in np.flatnonzero((count > 0) & ~full):
        out[cut[i]] = window_hashes(words[first[i] : first[i + 1]], int(count[i]))[0] ^ U(count[i])
    return out, cut


def shingle_sets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ordered by text and hash, and where each text's start (one more at the end)."""
    hashes, cut = shingle_sequence(texts)
    owner = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(cut)))


def set_keys(hashes: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set."""
    keys = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(hashes ^ U(salt)))])
        keys.append(mix(total[cut[1:]] - total[cut[:-1]] + np.diff(cut).astype(U)).view(np.int64))
    return keys[0], keys[1]


def _set_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts in text_blocks(batches):
        hashes, cut = shingle_sets(texts)
        cls, check = set_keys(hashes, cut)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (texts.did, texts.th, cls, check, np.diff(cut))], names=["_did", "_th", "cls", "check", "n"])


def signatures(hashes: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, signature, drop, kind) for all signatures of the sets."""
    n = np.diff(cut)
    out = []
    top = np.int64(1) << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)  # the band's largest size
    largest = 4 * n // 3
    for own in (True, False):
        who = np.flatnonzero((n > 0) if own else (n > 0) & (largest > top))
        limit = top[who] if own else 2 * top[who]
        band = np.log2(limit).astype(np.uint8)
        k = (n[who] + np.minimum(largest[who], limit)) // 7
        single = np.full(len(who), np.int64(1) << 32)  # every shingle a range of its own
        m = np.where(limit <= 16, single, np.ceil(0.35 * limit).astype(np.int64))
        local, sig = _range_contents(hashes, cut, who, m, band)
        sizes = np.bincount(local, minlength=len(who))
        poor = sizes <= k
        drop = np.where(poor, 0, sizes - k - 1)
        out.append((who[local], sig, drop[local], 2 * band[local]))
        # of two sets that are both poor, the shared ranges may all be empty
        local, sig = _range_contents(hashes, cut, who[poor], single[poor], band[poor])
        drop = n[who[poor]] - k[poor] - 1
        out.append((who[poor][local], mix(sig), drop[local], 2 * band[poor][local] + 1))
    return tuple(np.concatenate([x[i] for x in out]) for i in range(4))


def _range_contents(hashes: np.ndarray, cut: np.ndarray, who: np.ndarray, m: np.ndarray, band: np.ndarray):
    """(set's place in who, signature) of every range that is not empty, of m ranges of the hash domain."""
    sizes = cut[who + 1] - cut[who]
    local = np.repeat(np.arange(len(who)), sizes)
    h = hashes[ranges(cut[who], sizes)]
    part = ((h >> U(32)) * m[local].astype(U)) >> U(32)  # rises with h, so ranges are runs
    new = np.ones(len(h), bool)
    new[1:] = (local[1:] != local[:-1]) | (part[1:] != part[:-1])
    start = np.flatnonzero(new)
    content = np.add.reduceat(mix(h), start) if len(start) else np.zeros(0, U)
    local = local[start]
    return local, mix(content ^ mix(part[start] * U(64) + band[local].astype(U)))


def _signature_rows(buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, slots, owners, count, base, seen = [], [], [], 0, 0, set()

        def flush() -> pa.RecordBatch:
            sigs = np.concatenate(entries)
            return encode(sigs.view(U) % U(buckets), sigs.view(SIG), np.concatenate(slots), np.concatenate(owners))

        for texts in text_blocks(batches):
            hashes, cut = shingle_sets(texts)
            cls, _ = set_keys(hashes, cut)
            # equal sets of a flush are sent once
            fresh = np.array([c not in seen and not seen.add(c) for c in cls.tolist()], bool)
            owner, sig, drop, kind = signatures(hashes, cut)
            keep = fresh[owner]
            owner, sig, drop, kind = owner[keep], sig[keep], drop[keep], kind[keep]
            _, first, slot = np.unique(owner * 256 + kind, return_index=True, return_inverse=True)
            table = np.empty(len(first), SLOT)
            table["cls"], table["drop"], table["kind"] = cls[owner[first]], drop[first], kind[first]
            entries.append(sig.view(np.int64))
            slots.append(table)
            owners.append(slot + base)
            base += len(table)
            count += len(sig)
            if count >= FLUSH:
                yield flush()
                entries, slots, owners, count, base, seen = [], [], [], 0, 0, set()
        if count:
            yield flush()

    return rows


def _count_sets(buckets: int):
    def reducer(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = rows[np.lexsort((rows["cls"], rows["sig"]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows["sig"][1:] != rows["sig"][:-1]) | (rows["cls"][1:] != rows["cls"][:-1])
        rows = rows[new]
        start = np.flatnonzero(np.append(True, rows["sig"][1:] != rows["sig"][:-1]))
        sizes = np.diff(np.append(start, len(rows)))
        sets = np.repeat(sizes, sizes)
        shared = sets > 1
        if shared.any():
            out = np.empty(int(shared.sum()), COUNTED)
            for name in ENTRY.names:
                out[name] = rows[name][shared]
            out["sets"] = sets[shared]
            yield bucket_batch(out["cls"].view(U) % U(buckets), out)

    return reducer


def _rarest(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each class and kind, all shared signatures but the most frequent that it does without."""
    rows = rows[np.lexsort((rows["sig"], rows["sets"], rows["kind"], rows["cls"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["cls"][1:] != rows["cls"][:-1]) | (rows["kind"][1:] != rows["kind"][:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(rows)))
    group = np.repeat(np.arange(len(start)), size)
    kept = rows[np.arange(len(rows)) - start[group] < size[group] - rows["drop"]]
    yield pa.RecordBatch.from_arrays([pa.array(kept["sig"]), pa.array(kept["cls"]), pa.array(kept["kind"].astype(np.int32) // 2)], names=["sig", "cls", "band"])


def candidates(docs: DataFrame) -> DataFrame:
    """(sig, cls, band): classes of sets and the signatures by which they may have partners."""
    buckets = bucket_count(docs, mb=5)
    rows = docs.select(*doc_key(), "text").mapInArrow(_signature_rows(buckets), BUCKET_ROWS)
    counted = reduce_buckets(rows, buckets, decoder(SLOT, SIG), _count_sets(buckets), BUCKET_ROWS)
    return reduce_buckets(counted, buckets, COUNTED, _rarest, "sig long, cls long, band int")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose sets have 100 * intersection >= 75 * union, from whole texts."""
    for batch in batches:
        step = 256
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            sets = []
            for name in ("text_a", "text_b"):
                data, offsets = text_column(part.column(name))
                ids = np.zeros(len(part), np.int64)
                hashes, cut = shingle_sets(Texts(ids, ids, data, offsets))
                sets.append((np.repeat(np.arange(len(part)), np.diff(cut)), hashes, np.diff(cut)))
            owner, hashes = (np.concatenate([s[j] for s in sets]) for j in (0, 1))
            order = np.lexsort((hashes, owner))
            owner, hashes = owner[order], hashes[order]
            both = (owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1])
            shared = np.bincount(owner[1:][both], minlength=len(part))
            union = sets[0][2] + sets[1][2] - shared
            keep = pa.array((union > 0) & (100 * shared >= 75 * union))
            yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], names=["a", "b"])


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of classes that are similar; texts: cls, n, text of one document of each class."""
    side = {x: texts.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab"}
    sizes = "100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)"
    joined = pairs.join(side["b"], "b").join(side["a"], "a").where(sizes)
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(_compare, "a long, b long")


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class, for the band of its size and the next: a bitmap in which every shingle turns one bit.

    Two sets' bitmaps differ in at most as many bits as the sets in elements, and in nearly as many.
    """
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            data, offsets = text_column(part.column("text"))
            cls = part.column("cls").to_numpy()
            hashes, cut = shingle_sets(Texts(cls, cls, data, offsets))
            n = np.diff(cut)
            own = np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)
            out = []
            for i in range(len(cls)):
                h = mix(hashes[cut[i] : cut[i + 1]])
                for band in (int(own[i]), int(own[i]) + 1):
                    bits = max(64, 2 << band)
                    turned = np.bincount((h % U(bits)).astype(np.int64), minlength=bits) & 1
                    out.append((cls[i], band, int(n[i]), np.packbits(turned.astype(np.uint8)).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)],
                    names=["cls", "band", "n", "bits"])


def _crossing(table: pa.Table, every: bool) -> pa.RecordBatch:
    """Pairs of a group in different components that their bitmaps do not rule out.

    All of them, or no more than it takes to connect a tile's components if every pair is a link.
    """
    cls, n, component, part, parts, lo, hi = (table.column(c).to_numpy() for c in ("cls", "n", "component", "part", "parts", "lo", "hi"))
    bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(cls), -1)
    start = tile_starts(table, TILE_KEY)
    tile = np.searchsorted(start, np.arange(len(cls)), "right")
    _, group = np.unique(np.stack([tile, component]), axis=1, return_inverse=True)
    group = group.ravel()
    root = np.arange(group.max() + 1)
    found = []
    for a, b in pairs_of_tiles(start, part, lo, hi, parts, max(1000, 2_000_000 // bits.shape[1])):
        able = (root[group[a]] != root[group[b]]) & (100 * np.minimum(n[a], n[b]) >= 75 * np.maximum(n[a], n[b]))
        a, b = a[able], b[able]
        apart = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
        able = 7 * apart <= n[a] + n[b]
        a, b = a[able], b[able]
        while not every and len(a):
            high = np.maximum(root[group[a]], root[group[b]])
            _, one = np.unique(high, return_index=True)  # each root hooks to a smaller one, by one pair
            found.append((cls[a[one]], cls[b[one]]))
            root[high[one]] = np.minimum(root[group[a[one]]], root[group[b[one]]])
            while (root[root] != root).any():
                root = root[root]
            open_ = root[group[a]] != root[group[b]]
            a, b = a[open_], b[open_]
        if every and len(a):
            found.append((cls[a], cls[b]))
    ends = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1)]
    pairs = np.unique(np.stack([np.minimum(*ends), np.maximum(*ends)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _without_repeats(members: DataFrame) -> DataFrame:
    """One signature of those that the same two or more classes have: similar sets share many."""
    x, y = (F.bit_xor(F.xxhash64("cls", F.lit(k))).alias(n) for k, n in ((1, "x"), (2, "y")))
    groups = members.groupBy("sig").agg(F.count("*").alias("size"), x, y).where("size > 1")
    kept = groups.groupBy("size", "x", "y").agg(F.min("sig").alias("sig")).select("sig")
    return members.join(kept, "sig", "left_semi")


def _across(members: DataFrame, components: DataFrame, parities: DataFrame, every: bool) -> DataFrame:
    """Distinct pairs (a, b) that share a signature and are in different components so far."""
    placed = members.join(components, F.col("cls") == F.col("node")).select("sig", "cls", "band", "component")
    mixed = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("sig")
    tiles = tiled(placed.join(mixed, "sig"), ["band", "sig"], "cls", TILE).join(parities, ["cls", "band"])
    return by_tiles(tiles, TILE_KEY, partial(_crossing, every=every), "a long, b long").distinct()


def grouped(docs: DataFrame) -> DataFrame:
    """For every row of docs (doc_id, text): _did, _th (its key), n (size of its set) and first, the key of its group's first text.

    Words are what stands between ASCII white space, A-Z lower-cased. The set of a text is its
    distinct 5-word shingles; with 1 to 4 words, the whole sequence; a null text, or one without
    words, has the empty set and is linked with nothing. A group is what links (similarity of at least
    0.75) reach; its first text is that with the smallest doc_id (a null one counts as the largest).
    Repeated rows have equal sets and so one group. Other columns are ignored. Sets are compared by
    64-bit hashes of their shingles.
    """
    keyed = docs.select("doc_id", *doc_key(), "text")
    sets = written(docs.select(*doc_key(), "text").mapInArrow(_set_table, "_did long, _th long, cls long, check long, n long"))
    classes = sets.where("n > 0").groupBy("cls", "check", "n").agg(F.min(F.struct("_did", "_th")).alias("rep"))
    classes = written(classes.select("cls", "n", "rep._did", "rep._th"))
    found = written(candidates(docs))
    members = written(_without_repeats(found))
    forget(found)
    nodes = written(members.select(F.col("cls").alias("node")).distinct())
    texts = classes.join(nodes, F.col("cls") == F.col("node"), "left_semi").join(keyed.select("_did", "_th", "text"), ["_did", "_th"])
    texts = written(texts.dropDuplicates(["cls", "_did", "_th"]).select("cls", "n", "text"))
    with small_batches(docs.sparkSession):
        parities = written(texts.select("cls", "text").mapInArrow(_parities, "cls long, band int, n long, bits binary"))
    # first one pair for each class, with the least class that it shares a signature with
    groups = members.groupBy("sig").agg(F.min("cls").alias("a"))
    first = members.join(groups, "sig").groupBy(F.col("cls").alias("b")).agg(F.min("a").alias("a")).where("a <> b").select("a", "b")
    with small_batches(docs.sparkSession):
        links = written(_similar(first, texts))
    # then pairs that may connect the components that a group still has, then all that are left
    for every in (False, True):
        found = connected_components(nodes, links)
        forget(links)
        pairs = written(_across(members, found, parities, every))
        more = _similar(pairs, texts)
        so_far = found.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")
        with small_batches(docs.sparkSession):
            links = written(so_far.unionByName(more))
        forget(found, pairs)
    found = connected_components(nodes, links)
    forget(members, nodes, texts, parities, links)
    of_class = written(classes.join(found, F.col("cls") == F.col("node"), "left").select(
        "cls", F.struct("_did", "_th").alias("rep"), F.coalesce("component", "cls").alias("component")))
    forget(found, classes)
    smallest = of_class.groupBy("component").agg(F.min("rep").alias("first"))
    by_class = of_class.join(smallest, "component").groupBy("cls").agg(F.min("first").alias("first"))
    alone = F.struct("_did", "_th")
    return sets.join(by_class, "cls", "left").select("_did", "_th", "n", F.when(F.col("n") > 0, F.col("first")).otherwise(alone).alias("first"))


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, n_shingles and component_id.

    component_id is the smallest doc_id that links reach, itself included; see grouped. A null doc_id
    counts as the largest id, and is null again as a component_id.
    """
    out = grouped(docs)
    null_id = F.lit(2**63 - 1)
    return out.select(
        F.nullif("_did", null_id).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif("first._did", null_id).alias("component_id"))


def first_of_groups(docs: DataFrame) -> DataFrame:
    """One row of docs, with all columns, for each group of linked texts: the one with the smallest doc_id.

    Repeated rows of one doc_id and text are one document. Texts without words are in no group and stay.
    """
    first = grouped(docs).where("_did = first._did AND _th = first._th").select("_did", "_th").distinct()
    keyed = docs.select(F.struct("*").alias("row"), *doc_key()).join(first, ["_did", "_th"], "left_semi")
    return keyed.dropDuplicates(["_did", "_th"]).select("row.*")
