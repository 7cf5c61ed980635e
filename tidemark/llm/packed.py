"""Arrays in tasks: blocks of texts, word and shingle hashes, and exchanges of packed arrays.

A key for every few words of a corpus is far more rows than documents. Tasks therefore sort their
keys by bucket and send one binary row for each bucket they have keys for; the task that reads a
bucket joins those arrays. The number of buckets follows the size of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
BASE = 0x9E6C63D0876A9A47  # odd
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Texts:
    """A block of whole texts: keys did and th, bytes, where each text starts (one more at the end), and how many rows it stands for."""

    def __init__(self, did: np.ndarray, th: np.ndarray, data: np.ndarray, starts: np.ndarray, times: np.ndarray | None = None):
        self.did, self.th, self.data, self.starts = did, th, data, starts
        self.times = np.ones(len(did), np.int64) if times is None else times

    def __len__(self) -> int:
        return len(self.did)


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[Texts]:
    """Blocks of about limit bytes from batches with columns _did, _th and text; a longer text is a block of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_column(batch.column("text"))
        did = batch.column("_did").to_numpy(zero_copy_only=False)
        th = batch.column("_th").to_numpy(zero_copy_only=False)
        i = 0
        while i < len(did):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
            yield Texts(did[i:j], th[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            i = j


def once_each(texts: Texts) -> Texts:
    """The block with rows that repeat did and th as one text that stands for all of them."""
    order = np.lexsort((texts.th, texts.did))
    did, th = texts.did[order], texts.th[order]
    new = np.ones(len(order), bool)
    new[1:] = (did[1:] != did[:-1]) | (th[1:] != th[:-1])
    if new.all():
        return texts
    head = np.flatnonzero(new)
    times = np.add.reduceat(texts.times[order], head)
    one = order[head]
    sizes = np.diff(texts.starts)[one]
    starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    return Texts(texts.did[one], texts.th[one], texts.data[ranges(texts.starts[one], sizes)], starts, times)


def rows_again(texts: Texts, batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch with one row for each text of the block as one with a row for each row that the texts stand for."""
    return batch if (texts.times == 1).all() else batch.take(pa.array(np.repeat(np.arange(len(texts)), texts.times)))


def words_of(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words between ASCII white space, and for each text its first word (one more at the end)."""
    blank = (texts.data == 32) | ((texts.data >= 9) & (texts.data <= 13))
    first = np.ones(len(blank) + 1, bool)  # the next byte belongs to another text
    first[:-1] = False
    first[texts.starts] = True
    word = ~blank
    starts = np.flatnonzero(word & (np.concatenate([[True], blank[:-1]]) | first[:-1])) if len(word) else np.zeros(0, np.int64)
    ends = np.flatnonzero(word & (np.concatenate([blank[1:], [True]]) | first[1:])) + 1 if len(word) else np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, texts.starts)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes anywhere."""
    power = np.full(len(data) + 1, BASE, U)
    power[0] = 1
    power = np.cumprod(power)
    back = np.full(len(data) + 1, pow(BASE, -1, 1 << 64), U)
    back[0] = 1
    back = np.cumprod(back)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * power[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes unchanged."""
    upper = (data >= 65) & (data <= 90)
    return np.where(upper, data + 32, data).astype(np.uint8) if upper.any() else data


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of size neighbours in h (across text borders too)."""
    if len(h) < size:
        return np.zeros(0, U)
    total = np.zeros(len(h) - size + 1, U)
    for j in range(size):
        total += h[j : len(h) - size + 1 + j] * U(pow(BASE, j + 3, 1 << 64))
    return mix(total)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0]+counts[0]-1, starts[1] .. and so on in one array."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)


def by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts rows by bucket, the buckets that occur, and where each starts (one more at the end)."""
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    return order, found, np.append(first, len(order))


def bucket_batch(bucket: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """One row (bucket, rows) for each bucket with the bytes of its rows (a structured array)."""
    order, found, cut = by_bucket(bucket)
    rows = rows[order]
    return pa.RecordBatch.from_arrays(
        [pa.array(found.astype(np.int32)), pa.array([rows[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
        names=["bucket", "rows"],
    )


BUCKET_ROWS = "bucket int, rows binary"


def reduce_buckets(
    df: DataFrame, buckets: int, decode: np.dtype | Callable[[bytes], np.ndarray],
    reducer: Callable[[np.ndarray], Iterator[pa.RecordBatch]], schema: str,
) -> DataFrame:
    """Brings the arrays of each bucket together and hands them, joined, to reducer."""
    if isinstance(decode, np.dtype):
        dtype, decode = decode, lambda rows: np.frombuffer(rows, dtype)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, rows in zip(batch.column("bucket").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                if bucket != now and held:
                    yield from reducer(np.concatenate(held))
                    held = []
                now = bucket
                held.append(decode(rows))
        if held:
            yield from reducer(np.concatenate(held))

    return df.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(read, schema)


DOC = np.dtype([("did", "<i8"), ("th", "<i8")])


def joined_dtype(slot: np.dtype, entry: np.dtype) -> np.dtype:
    return np.dtype([(n, d.fields[n][0]) for d in (slot, entry) for n in d.names])


def _squeezed(*parts: bytes, level: int = 1) -> bytes:
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", level).compress(raw, asbytes=True)


def _planes(name: str, values: np.ndarray) -> bytes:
    """A column byte by byte, places (at) as differences: what is small or alike compresses well."""
    if name == "at":
        values = np.diff(values, prepend=values.dtype.type(0))
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T).tobytes()


def _from_planes(name: str, dtype: np.dtype, raw: bytes, n: int, at: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
    values = np.ascontiguousarray(planes.T).view(dtype).ravel()
    return np.cumsum(values, dtype=dtype) if name == "at" else values


def _unsqueezed(rows: bytes) -> bytes:
    return pa.Codec("zstd").decompress(rows[8:], int.from_bytes(rows[:8], "little"), asbytes=True)


def encode(bucket: np.ndarray, entries: np.ndarray, slots: np.ndarray, slot: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket: what several entries have in common (slots) once, how many entries each has, the entries by column."""
    order = np.lexsort((slot, bucket))
    found, first = np.unique(bucket[order], return_index=True)
    edges = np.append(first, len(order))
    entries, slot, rows = entries[order], slot[order], []
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        used, counts = np.unique(slot[i:j], return_counts=True)
        table, part = slots[used], entries[i:j]
        rows.append(_squeezed(
            np.array([len(used), j - i], "<i8").tobytes(), *[table[n].tobytes() for n in slots.dtype.names],
            counts.astype("<u4").tobytes(), *[_planes(n, part[n]) for n in entries.dtype.names]))
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(rows, pa.binary())], names=["bucket", "rows"])


def decoder(slot: np.dtype, entry: np.dtype) -> Callable[[bytes | None], np.ndarray]:
    both = joined_dtype(slot, entry)

    def decode(rows: bytes | None) -> np.ndarray:
        if rows is None:
            return np.empty(0, both)
        raw = _unsqueezed(rows)
        n_slots, n = (int(x) for x in np.frombuffer(raw, "<i8", 2))
        out, at = np.empty(n, both), 16
        table = {}
        for name in slot.names:
            table[name] = np.frombuffer(raw, slot[name], n_slots, at)
            at += table[name].nbytes
        counts = np.frombuffer(raw, "<u4", n_slots, at)
        at += counts.nbytes
        for name in entry.names:
            out[name] = _from_planes(name, entry[name], raw, n, at)
            at += n * entry[name].itemsize
        for name in slot.names:
            out[name] = np.repeat(table[name], counts)
        return out

    return decode


def encode_by_doc(rows: np.ndarray, entry: np.dtype, buckets: int) -> pa.RecordBatch:
    """Rows with did and th, packed by the bucket of their document."""
    rows = rows[np.lexsort((rows["th"], rows["did"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["did"][1:] != rows["did"][:-1]) | (rows["th"][1:] != rows["th"][:-1])
    slots = np.empty(int(new.sum()), DOC)
    slots["did"], slots["th"] = rows["did"][new], rows["th"][new]
    entries = np.empty(len(rows), entry)
    for name in entry.names:
        entries[name] = rows[name]
    return encode(doc_bucket(rows["did"], rows["th"], buckets), entries, slots, np.cumsum(new) - 1)


def doc_hash(did: np.ndarray, th: np.ndarray) -> np.ndarray:
    return mix(mix(did) + th.astype(U))


def doc_bucket(did: np.ndarray, th: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of documents by id and text: the copies of one text are spread over all of them."""
    return (doc_hash(did, th) % U(buckets)).astype(np.int64)


def with_texts(
    docs: DataFrame, packed: DataFrame, buckets: int, decode: Callable[[bytes], np.ndarray],
    fn: Callable[[np.ndarray, np.ndarray, Texts], Iterator[pa.RecordBatch]], schema: str, block_bytes: int = 2 * BLOCK_BYTES,
) -> DataFrame:
    """Brings packed rows to the texts of their documents.

    docs: _did, _th, text; packed: rows by the bucket of the document. fn gets, for a block of texts,
    the bucket's rows of these documents, the place in the block of each, and the block. Rows that
    repeat _did and _th may be one text of the block (rows_again).
    """
    texts = docs.select("_did", "_th", "text").mapInArrow(_text_rows(buckets), "bucket int, kind int, rows binary")
    replies = packed.select("bucket", F.lit(0).alias("kind"), "rows")
    both = texts.unionByName(replies).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, rows, keys, blocks = None, [], None, None, []

        def judged() -> Iterator[pa.RecordBatch]:
            block = once_each(_joined(blocks))
            blocks.clear()
            yield from fn(*_of_block(rows, keys, block), block)

        for batch in batches:
            for bucket, kind, row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "rows")), strict=True):
                if bucket != now:
                    if blocks:
                        yield from judged()
                    now, held, rows = bucket, [], None
                if kind == 0:
                    held.append(decode(row))
                    continue
                if rows is None:
                    rows = np.concatenate(held) if held else decode(None)
                    keys, held = doc_hash(rows["did"], rows["th"]), []
                    order = np.argsort(keys, kind="stable")
                    rows, keys = rows[order], keys[order]
                for block in _blocks_of(_unsqueezed(row)):
                    blocks.append(block)
                    if sum(int((np.diff(b.starts) * b.times).sum()) for b in blocks) >= block_bytes:
                        yield from judged()
        if blocks:
            yield from judged()

    return both.mapInArrow(read, schema)


def _text_rows(buckets: int):
    """Compressed texts of each bucket: one row for each bucket of some MB of texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in map(once_each, text_blocks(batches, 8 * BLOCK_BYTES)):
            order, found, cut = by_bucket(doc_bucket(texts.did, texts.th, buckets))
            sizes = np.diff(texts.starts)
            packed = []
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                mine = order[i:j]
                data = texts.data[ranges(texts.starts[mine], sizes[mine])]
                packed.append(_squeezed(*[x.tobytes() for x in (np.int64(len(mine)), texts.did[mine], texts.th[mine], sizes[mine], texts.times[mine], data)], level=3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.astype(np.int32)), pa.array(np.ones(len(found), np.int32)), pa.array(packed, pa.binary())], names=["bucket", "kind", "rows"])

    return rows


def _blocks_of(raw: bytes) -> Iterator[Texts]:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    did, th, sizes, times = (np.frombuffer(raw, "<i8", n, 8 + 8 * n * k) for k in range(4))
    starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    data = np.frombuffer(raw, np.uint8, -1, 8 + 32 * n)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK_BYTES, side="right")) - 1)
        yield Texts(did[i:j], th[i:j], data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], times[i:j])
        i = j


def _joined(blocks: list[Texts]) -> Texts:
    did, th, data, times = (np.concatenate([getattr(b, n) for b in blocks]) for n in ("did", "th", "data", "times"))
    sizes = np.concatenate([np.diff(b.starts) for b in blocks])
    return Texts(did, th, data, np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)]), times)


def _of_block(rows: np.ndarray, keys: np.ndarray, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The rows (ordered by keys, the hashes of did and th) of the block's documents and each one's place in the block."""
    key = doc_hash(texts.did, texts.th)
    lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
    at, place = ranges(lo, hi - lo), np.repeat(np.arange(len(texts)), hi - lo)
    same = (rows["did"][at] == texts.did[place]) & (rows["th"][at] == texts.th[place])
    return rows[at[same]], place[same]
