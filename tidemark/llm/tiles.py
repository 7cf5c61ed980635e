"""Comparing the members of groups without a task that holds a large group, and without rows for pairs.

A group of more than a tile's members is cut into parts; a tile is two parts of a group (or the whole
small group). Tiles are sorted by Spark and read one after the other, so small groups share a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.packed import ranges


def tiled(members: DataFrame, group: Sequence[str], member: str, tile: int) -> DataFrame:
    """Rows of groups of two and more, with the tiles (lo, hi) in which each takes part: part, parts, lo, hi."""
    sizes = members.groupBy(*group).agg(F.count("*").alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / tile).cast("int")
    cut = members.join(sizes, list(group)).withColumn("part", F.pmod(F.xxhash64(member), parts).cast("int")).withColumn("parts", parts)
    cut = cut.drop("size").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    # a part's pairs with itself are looked at in one of its tiles with another part
    return cut.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")}).where("parts = 1 OR part <> other").drop("other")


def pairs_of_tiles(
    start: np.ndarray, part: np.ndarray, lo: np.ndarray, hi: np.ndarray, parts: np.ndarray, most: int,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one tile that this tile is for, a bounded number at a time. start: where tiles begin (one more at the end).

    A tile is for the pairs across its two parts; within part p for those of p in tile (p, p + 1) and
    of the last part in tile (0, last).
    """
    size = np.diff(start)
    row = np.arange(len(part))
    count = np.repeat(start[1:], size) - row - 1  # partners behind a row
    total = np.cumsum(count)
    begin = 0
    while begin < len(row):
        done = total[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(total, done + most, "right")))
        mine = row[begin:stop]
        a, b = np.repeat(mine, count[mine]), ranges(mine + 1, count[mine])
        same = part[a] == part[b]
        own = (parts[a] <= 2) | ((part[a] == lo[a]) & (hi[a] == lo[a] + 1)) | ((part[a] == parts[a] - 1) & (lo[a] == 0) & (hi[a] == parts[a] - 1))
        yield a[~same | own], b[~same | own]
        begin = stop


def tile_starts(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """Where a new combination of the columns begins (one more at the end)."""
    values = [table.column(c).to_numpy() for c in columns]
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for v in values:
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def by_tiles(rows: DataFrame, tile: Sequence[str], judge: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """Sorts rows by tile and hands whole tiles, some at a time and with one value of the first column, to judge."""
    tile = list(tile)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            edge = int(tile_starts(held, tile)[-2])  # the last tile may go on
            cuts = tile_starts(held.slice(0, edge), tile[:1]) if edge else []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                yield judge(held.slice(i, j - i).combine_chunks())
            held = held.slice(edge)
        if held is not None and held.num_rows:
            yield judge(held.combine_chunks())

    return rows.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(read, schema)
