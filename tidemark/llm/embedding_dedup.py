"""Embedding near-dedup with randomised-rotation binary codes.

A vector is turned by a random rotation; the signs of its coordinates are its code. The product of
the vector with its own code is stored as a correction factor, and the turned vector itself, rounded
at random to 4 bits, is what codes are multiplied with: <code, rounded> / factor estimates the cosine
without bias, with a known spread. Only pairs whose upper confidence bound reaches the threshold get
an exact cosine in double precision, and only that decides.

Pairs to estimate come from bands of sign bits of further rotations: vectors with equal bits in a
band meet. The number of bits follows the number of vectors, so a band's groups stay small, and the
number of bands follows from the bits so that a pair at the threshold meets with the wanted
probability. Equal vectors are one class. A group beyond TILE members is cut into tiles of two parts
each. A tile returns a count of links and one spanning edge for each member, so a cluster of close
vectors costs a row for each, not one for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NO_ID, connected_components, forget, written
from tidemark.llm.packed import U, mix
from tidemark.llm.tiles import by_tiles, pairs_of_tiles, tile_starts, tiled

TILE = 1000
TILE_KEY = ("dims", "band", "key", "lo", "hi")
#: Pairs that a task looks at together.
PAIRS = 50_000
#: Standard deviations of the estimate between it and its upper bound.
SPREADS = 6.0


def band_plan(n: int, threshold: float, missed: float) -> tuple[int, int]:
    """Bits of a band, about as many as tell n vectors apart, and bands so that a pair at the threshold is missed rarely enough."""
    bits = min(max(math.ceil(math.log2(max(n, 2))), 6), 40)
    same = (1 - math.acos(min(threshold, 1.0)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(missed) / math.log(1 - min(same, 1 - 1e-12))))


def rotation(dims: int, number: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(1000 * dims + number).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def unit_vectors(column: pa.ListArray, dims: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Codes:
    """Code, correction factor and rounded coordinates of unit vectors of one length."""

    def __init__(self, signs: np.ndarray, factor: np.ndarray, rounded: np.ndarray):
        self.signs, self.factor, self.rounded = signs, factor, rounded

    @classmethod
    def of(cls, turned: np.ndarray, ids: np.ndarray) -> Codes:
        dims = turned.shape[1]
        low, high = turned.min(axis=1, keepdims=True), turned.max(axis=1, keepdims=True)
        step = np.maximum((high - low) / 15, 1e-12)
        dither = (mix(ids.view(U)[:, None] * U(2 * dims + 1) + np.arange(dims, dtype=U)) >> U(11)) / float(1 << 53)
        rounded = np.minimum(np.floor((turned - low) / step + dither), 15)
        return cls((turned > 0), np.abs(turned).sum(axis=1) / math.sqrt(dims), low + step * rounded)

    def upper(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Upper bounds of the cosines of pairs, from the codes of a and the rounded coordinates of b."""
        dims = self.signs.shape[1]
        code = np.where(self.signs[a], 1.0, -1.0)
        estimate = np.einsum("ij,ij->i", code, self.rounded[b]) / (self.factor[a] * math.sqrt(dims))
        spread = np.sqrt(np.maximum(1 - self.factor[a] ** 2, 0)) / (self.factor[a] * math.sqrt(max(dims - 1, 1)))
        return estimate + SPREADS * spread


#: Fractional bits of coordinates in band keys. Whole numbers make a vector's keys the same wherever they are computed.
FIXED = float(1 << 24)


def band_keys(x: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """Keys of unit vectors in every band: sign bits of further rotations."""
    dims, wanted = x.shape[1], bits * bands
    fixed = np.rint(x * FIXED).astype(np.int64)
    signs = [fixed @ np.rint(rotation(dims, 1 + k) * FIXED).astype(np.int64).T > 0 for k in range(-(-wanted // dims))]
    signs = np.concatenate(signs, axis=1)[:, :wanted]
    return (signs.reshape(len(x), bands, bits) * (U(1) << np.arange(bits, dtype=U))).sum(axis=2).astype(np.int64)


def _band_rows(bits: int, bands: int):
    """For each class one small row for each band, with its key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == dims))
                for lo in range(0, part.num_rows, 500):
                    piece = part.slice(lo, 500)
                    keys = band_keys(unit_vectors(piece.column("embedding"), dims), bits, bands)
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.tile(np.arange(bands, dtype=np.int32), n)), pa.array(keys.ravel()), pa.array(np.full(n * bands, dims, np.int32)),
                        pa.array(np.repeat(piece.column("cls").to_numpy(), bands)),
                    ], names=["band", "key", "dims", "cls"])

    return rows


def _judged(table: pa.Table, threshold: float, bits: int, bands: int) -> pa.RecordBatch:
    """Links, and an edge to the least member reached, of each row of whole tiles of one vector length.

    Whether a pair met in an earlier band follows from the keys of both, which are computed from the
    vectors again: only rows of pairs that link need them.
    """
    ids, size, band, part, parts, lo, hi = (table.column(c).to_numpy() for c in ("cls", "n", "band", "part", "parts", "lo", "hi"))
    dims = table.column("dims")[0].as_py()
    x = unit_vectors(table.column("embedding").combine_chunks(), dims)
    keys, has_keys = np.zeros((len(ids), bands), np.int64), np.zeros(len(ids), bool)
    codes = Codes.of(x @ rotation(dims, 0).T, ids)
    start = tile_starts(table, TILE_KEY)
    links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    earlier = np.arange(bands)[None, :]
    for a, b in pairs_of_tiles(start, part, lo, hi, parts, PAIRS):
        possible = (codes.upper(a, b) >= threshold) & (codes.upper(b, a) >= threshold)
        a, b = a[possible], b[possible]
        near = np.einsum("ij,ij->i", x[a], x[b]) >= threshold  # exact
        a, b = a[near], b[near]
        new = np.unique(np.concatenate([a, b]))
        new = new[~has_keys[new]]
        for at in range(0, len(new), 500):
            keys[new[at : at + 500]] = band_keys(x[new[at : at + 500]], bits, bands)
        has_keys[new] = True
        # a pair that met in an earlier band is counted there
        first = ~((keys[a] == keys[b]) & (earlier < band[a][:, None])).any(axis=1)
        a, b = a[first], b[first]
        np.add.at(links, a, size[b])
        np.add.at(links, b, size[a])
        while True:
            least = np.minimum(label[a], label[b])
            if (label[a] == least).all() and (label[b] == least).all():
                break
            np.minimum.at(label, label[a], least)
            np.minimum.at(label, label[b], least)
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
    while (label[label] != label).any():
        label = label[label]
    keep = links > 0
    return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(ids[label][keep]), pa.array(links[keep])], names=["a", "b", "links"])


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, missed: float = 1e-3) -> DataFrame:
    """For every row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    n_links counts the other rows with a cosine of at least threshold; component_id is the smallest
    vec_id that links reach; kept says whether that is the row's own. Vectors that are null, empty or
    zero, or hold a null or a number that is not finite, link with nothing, as do vectors of different
    lengths. Rows with equal vectors link with each other, whatever their ids. A null vec_id counts
    as the largest and has a null component_id if nothing smaller is reached. Other columns are
    ignored. missed bounds the chance that a pair at the threshold is not found; closer pairs are
    missed less often.
    """
    x = F.col("embedding")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), "embedding", F.coalesce(fine, F.lit(False)).alias("fine"))
    classes = rows.where("fine").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()))
    bits, bands = band_plan(classes.count(), threshold, missed)
    banded = classes.select("cls", "embedding").mapInArrow(_band_rows(bits, bands), "band int, key long, dims int, cls long")
    banded = written(banded)
    tiles = tiled(banded, ["band", "key", "dims"], "cls", TILE).join(classes.select("cls", "embedding", "n"), "cls")
    judge = partial(_judged, threshold=threshold, bits=bits, bands=bands)
    found = written(by_tiles(tiles, TILE_KEY, judge, "a long, b long, links long"))
    counts = found.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    groups = connected_components(classes.select(F.col("cls").alias("node")), found.where("a <> b").select("a", "b"))
    placed = classes.join(groups, F.col("cls") == F.col("node")).select("cls", "least", "n", "component", "embedding")
    forget(banded)
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = placed.join(smallest, "component").join(counts, "cls", "left").select(
        F.col("embedding").alias("_e"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = rows.where("fine").join(placed, F.col("embedding") == F.col("_e")).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    null_id = F.lit(NO_ID)
    return out.select(
        F.nullif("vec_id", null_id).alias("vec_id"), F.col("n_links").cast("long").alias("n_links"),
        F.nullif("component_id", null_id).alias("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept"))
