"""Conversation prefix trie: a z-fast trie that grows by batches.

A conversation is a string of turns. A compacted node of their trie is an edge: the turns at depths
(f, e] below its parent's extent f. It is stored under its handle, the prefix at the two-fattest depth
of (f, e] (the one divisible by the highest power of two). A conversation finds its exit node by fat
binary search: it looks up its own prefix at the two-fattest depth of the open interval, goes on below
the node found, or above that depth, and so needs as many lookups as its length has binary digits. One
more lookup, by the first turn below the node found, and a comparison with that one edge give the depth
where it leaves the trie.

Conversations are inserted in batches: of those that leave the trie at one place with the same next
turn, the one with the smallest id goes in, the others go on below it in the next batch. An inserted
conversation owns the edges it brings (depths above b up to its length), so every node's smallest
member is its edge's owner. The number of batches is the greatest number of owners on a path, which
grows with the logarithm of the number of conversations unless ids follow the shape of the trie.

Totals are formed from the last batch to the first: an owner's own edges by a running sum from its end,
then one row for its parent. Expanding the edges gives a row for every distinct prefix.

Prefixes are 128-bit sums of hashes of (turn, depth). They are stored in blocks of BLOCK turns, so a
conversation of any length is many small rows, and looking up a prefix is a join by conversation and
block. Two prefixes are equal when their hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import forget, written
from tidemark.llm.packed import U, mix

#: Rows of a written table that one task writes, if its number of rows is known.
FILE_ROWS = 50_000
#: Turns of a conversation whose prefixes are one row.
BLOCK_BITS = 9
BLOCK = 1 << BLOCK_BITS
#: Bytes of a turn in a block: its prefix hash, the code points before it and those up to its end.
HASH, NUMBER = 16, 8
ENTRY = HASH + 2 * NUMBER
BLOCKS = "conv_id long, block long, k int, packed binary"
NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
NOBODY = hashlib.sha256(b"").hexdigest()


def _written(df: DataFrame, rows: int) -> DataFrame:
    """Writes a table of at most so many rows by as many tasks as that takes, not one for each partition of the last exchange."""
    return written(df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // FILE_ROWS + 1)))


def in_order(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns numbered from 0 within their conversation: (conv_id, i, s1, s2, n), and the parts of conversations (conv_id, part, k, shift).

    conversations: conv_id, turn, role, text. Null turns come first; equal ones are in an order that
    depends on their role and text only; repeated rows are repeated turns. Null roles and texts are
    empty. Rows without conv_id belong to no conversation and are left out. s1 and s2 are hashes of
    role and text, n counts the text's code points. Turns are sorted as a whole and numbered by the
    counts (k) of the parts before, so a long conversation is spread over tasks.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.xxhash64(role, text).alias("s1"),
        F.xxhash64(F.lit("second"), text, role).alias("s2"), F.length(text).cast("long").alias("n"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "s1", "s2"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.select("conv_id", "s1", "s2", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    parts = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("k"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written(parts.select("conv_id", "part", "k", (F.coalesce(F.sum("k").over(before), F.lit(0)) - F.col("first")).alias("shift")))
    return rows.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("i"), "s1", "s2", "n"), parts


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of prefix hashes and lengths from the blocks of turns of whole conversations, in order."""
    now, carry = None, (U(0), U(0), 0)
    with np.errstate(over="ignore"):
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            turns = batch.column("turns")
            flat = turns.flatten()
            depth, s1, s2, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("depth", "s1", "s2", "n"))
            k = turns.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            end = np.cumsum(k)
            at = depth.astype(U)
            sums = [np.cumsum(mix(s1.view(U) ^ mix(at * U(2)))), np.cumsum(mix(s2.view(U) ^ mix(at * U(2) + U(1)))), np.cumsum(n)]
            new = np.append(True, conv[1:] != conv[:-1])
            new[0] = conv[0] != now
            head = np.maximum.accumulate(np.where(new, np.arange(len(conv)), -1))  # -1: goes on from the batch before
            first = (end - k)[np.maximum(head, 0)]
            out = np.empty(len(flat), [("a", ">u8"), ("b", ">u8"), ("before", ">i8"), ("after", ">i8")])
            last = []
            for name, total, held in zip(("a", "b", "after"), sums, carry, strict=True):
                base = np.where(head < 0, total.dtype.type(0) - total.dtype.type(held), np.where(first > 0, total[first - 1], total.dtype.type(0)))
                out[name] = total - np.repeat(base, k)
                last.append(out[name][-1])
            out["before"] = out["after"] - n
            now, carry = conv[-1], (U(last[0]), U(last[1]), int(last[2]))
            raw, cut = out.tobytes(), (end * ENTRY).tolist()
            packed = [raw[i:j] for i, j in zip([0, *cut[:-1]], cut, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("block"), pa.array(k.astype(np.int32)), pa.array(packed, pa.binary())],
                names=["conv_id", "block", "k", "packed"])


def prefix_blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, block, k, packed) of turns (conv_id, depth from 1 without gaps, s1, s2, n)."""
    block = F.shiftright(F.col("depth") - 1, BLOCK_BITS).alias("block")
    blocks = turns.groupBy("conv_id", block).agg(F.sort_array(F.collect_list(F.struct("depth", "s1", "s2", "n"))).alias("turns"))
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_prefixes, BLOCKS)


def _part(packed: str, i: Column, start: int, length: int) -> Column:
    return F.substring(F.col(packed), (i * ENTRY + start + 1).cast("int"), F.lit(length))


def _number(x: Column) -> Column:
    return F.conv(F.hex(x), 16, 10).cast("long")


def _looked_up(df: DataFrame, blocks: DataFrame, conv: str, depth: Column, what: dict[str, tuple[int, int]]) -> DataFrame:
    """df with parts of the entry of a conversation's turn at a depth; null at depths below 1."""
    found = blocks.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.col("packed").alias("_p"))
    df = df.withColumn("_d", depth - 1)
    df = df.join(found, (F.col(conv) == F.col("_c")) & (F.shiftright("_d", BLOCK_BITS) == F.col("_b")), "left")
    parts = {name: _part("_p", F.col("_d").bitwiseAND(BLOCK - 1), *where) for name, where in what.items()}
    return df.withColumns(parts).drop("_c", "_b", "_p", "_d")


KEY = (0, HASH)
BEFORE, AFTER = (HASH, NUMBER), (HASH + NUMBER, NUMBER)


def fattest(low: str, high: str) -> Column:
    """The two-fattest number in (low, high], for low < high."""
    return F.expr(f"shiftleft(shiftright({high}, length(bin({low} ^ {high})) - 1), length(bin({low} ^ {high})) - 1)")


def _edges(owners: DataFrame, cuts: DataFrame) -> DataFrame:
    """Compacted nodes (r, f, e) from the depths at which the paths of owners are cut."""
    above = F.lag("x").over(Window.partitionBy("r").orderBy("x"))
    return cuts.join(owners.select("r", "b"), "r").select("r", F.coalesce(above, "b").alias("f"), F.col("x").alias("e"))


def _with_handles(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Nodes with their handle (its depth m and its prefix) and the prefix of their first turn."""
    nodes = edges.withColumn("m", fattest("f", "e"))
    nodes = _looked_up(nodes, blocks, "r", F.col("m"), {"handle": KEY})
    return _looked_up(nodes, blocks, "r", F.col("f") + 1, {"first": KEY})


def _fat_search(pending: DataFrame, nodes: DataFrame, blocks: DataFrame, steps: int) -> DataFrame:
    """pending (conv, L, lo, ...) with the edge (r, f, e) on which each conversation leaves the trie.

    What is found already keeps a probe of its own (a depth below 0), so that it is no hot key.
    """
    own = [c for c in pending.columns if c != "lo"]
    handles = nodes.select(F.col("m").alias("_m"), F.col("handle").alias("_key"), *[F.col(c).alias(f"_{c}") for c in "rfe"])
    nothing = F.lit(None).cast("long")
    state = pending.withColumns({"hi": F.col("L"), "r": nothing, "f": nothing, "e": nothing})
    for _ in range(steps):
        idle = -1 - F.pmod(F.xxhash64("conv"), F.lit(1 << 20))
        state = state.withColumn("m", F.when(F.col("lo") < F.col("hi"), fattest("lo", "hi")).otherwise(idle))
        state = _looked_up(state, blocks, "conv", F.greatest("m", F.lit(-1)), {"probe": KEY}).withColumn("probe", F.coalesce("probe", F.lit(b"")))
        state = state.join(handles, (F.col("m") == F.col("_m")) & (F.col("probe") == F.col("_key")), "left")
        hit, missed = F.col("_r").isNotNull(), (F.col("m") > 0) & F.col("_r").isNull()
        state = state.select(
            *own, F.when(hit, F.col("_e")).otherwise(F.col("lo")).alias("lo"), F.when(missed, F.col("m") - 1).otherwise(F.col("hi")).alias("hi"),
            *[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in "rfe"])
    # below the extent found: the edge that begins with the next turn
    firsts = nodes.select((F.col("f") + 1).alias("_m"), F.col("first").alias("_key"), *[F.col(c).alias(f"_{c}") for c in "rfe"])
    state = state.withColumn("m", F.when(F.col("lo") < F.col("L"), F.col("lo") + 1).otherwise(-1 - F.pmod(F.xxhash64("conv"), F.lit(1 << 20))))
    state = _looked_up(state, blocks, "conv", F.greatest("m", F.lit(-1)), {"probe": KEY}).withColumn("probe", F.coalesce("probe", F.lit(b"")))
    state = state.join(firsts, (F.col("m") == F.col("_m")) & (F.col("probe") == F.col("_key")), "left")
    return state.select(*own, *[F.coalesce(f"_{c}", c).alias(c) for c in "rfe"])


def _exits(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """The depth x at which each conversation leaves its edge: equal prefixes of it and of the edge's owner are counted, by blocks."""
    own = [c for c in found.columns if c not in ("f", "e")]
    top = F.least("e", "L")
    both = found.withColumn("top", top).withColumn("block", F.explode(F.sequence(F.shiftright("f", BLOCK_BITS), F.shiftright(F.col("top") - 1, BLOCK_BITS))))
    for conv, name in (("conv", "_mine"), ("r", "_other")):
        side = blocks.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.col("packed").alias(name))
        both = both.join(side, (F.col(conv) == F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b")
    start = F.col("block") * BLOCK
    places = F.sequence(F.greatest(F.col("f") - start, F.lit(0)), F.least(F.col("top") - start, F.lit(BLOCK)) - 1)
    same = F.size(F.filter(places, lambda i: _part("_mine", i, *KEY) == _part("_other", i, *KEY)))
    return both.select(*own, "f", same.alias("same")).groupBy(*own, "f").agg((F.col("f") + F.sum("same")).alias("x")).drop("f")


def _member_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, ids = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
        new = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
        edges = list(zip(new, [*new[1:], len(keys)], strict=True))
        yield pa.RecordBatch.from_arrays([
            pa.array([keys[i] for i, _ in edges], pa.binary()), pa.array([ids[i] for i, _ in edges], pa.int64()),
            pa.array([",".join(map(str, ids[i:j])).encode() for i, j in edges], pa.binary())], names=["key", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, running = None, None
    for batch in batches:
        out = []
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key != now:
                if running is not None:
                    out.append((now, running.hexdigest()))
                now, running = key, hashlib.sha256(ids)
            else:
                running.update(b"," + ids)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([d for _, d in out])], names=["key", "digest"])
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([running.hexdigest()])], names=["key", "digest"])


def member_digests(members: DataFrame) -> DataFrame:
    """(key, digest) of members (key, conv_id): SHA-256 of each key's ids, ascending, comma-joined.

    Ids are sorted over all tasks and joined to long texts there; one task then reads a key's texts in
    order and holds one of them at a time.
    """
    lists = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_member_lists, "key binary, first long, ids binary")
    return lists.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key binary, digest string")


def _grown(members: DataFrame, blocks: DataFrame, root: int, n: int) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Owners of each batch (r, b, parent, L), the cuts (r, x) of their paths, and where classes end (r, x, n, key); n: conversations."""
    classes = members.where("L > 0").groupBy("L", "key").agg(F.min("conv_id").alias("conv"), F.count("*").alias("n"))
    pending = _written(classes.select("conv", "L", F.lit(0).cast("long").alias("lo"), "n", "key"), n)
    first = pending
    batches, cuts, ends, nodes = [], None, None, None
    while True:
        size, steps = pending.agg(F.count("*"), F.max(F.expr("length(bin(lo ^ L))"))).first()
        if nodes is not None:
            forget(nodes)
        if not size:
            return batches, cuts, ends
        if not batches:
            left = pending.select("conv", "L", "n", "key", F.lit(root).cast("long").alias("r"), "lo").withColumnRenamed("lo", "x")
        else:
            owners = batches[0]
            for more in batches[1:]:
                owners = owners.unionByName(more)
            nodes = _written(_with_handles(_edges(owners, cuts), blocks), 2 * n)
            left = _exits(_fat_search(pending, nodes, blocks, int(steps)), blocks)
        left = _written(left, size)
        if not batches:
            forget(first)
        on = _looked_up(left.where("x < L"), blocks, "conv", F.col("x") + 1, {"next": KEY})
        chosen = on.groupBy("x", "next").agg(F.min(F.struct("conv", "L", "r", "n", "key")).alias("o"))
        inserted = chosen.select(F.col("o.conv").alias("r"), F.col("x").alias("b"), F.col("o.r").alias("parent"), F.col("o.L").alias("L"), F.col("o.n").alias("n"), F.col("o.key").alias("key"))
        inserted = _written(inserted, size)
        new_ends = left.where("x = L").select("r", "x", "n", "key").unionByName(inserted.select("r", F.col("L").alias("x"), "n", "key"))
        new_cuts = left.where("x > 0").select("r", "x").unionByName(inserted.select("r", F.col("L").alias("x")))
        ends = new_ends if ends is None else ends.unionByName(new_ends)
        cuts = (new_cuts if cuts is None else cuts.unionByName(new_cuts)).distinct()
        batches.append(inserted.drop("n", "key"))
        after = left.where("x < L").join(inserted.select(F.col("r").alias("conv")), "conv", "left_anti")
        pending = after.select("conv", "L", F.col("x").alias("lo"), "n", "key")


def prefix_trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the conversations, the empty one included.

    ids: conv_id of every conversation, each once, those without turns too; turns: conv_id, depth (1 and
    on), s1, s2 (hashes that tell turns apart), n (what the last turn of a prefix counts for). Returns
    conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs (conversations that
    start with the prefix), n_children, n_leaves (childless prefixes from here on), saved_tokens (over all
    prefixes from here on, (n_convs - 1) * n of the last turn) and ends_sha256 (of the sorted ids of those
    that end here). Without conversations there is no row.
    """
    spark = ids.sparkSession
    root, size = ids.agg(F.min("conv_id"), F.count("*")).first()
    if root is None:
        return spark.createDataFrame([], NODES)
    blocks = _written(prefix_blocks(turns), size)
    length = F.col("block") * BLOCK + F.col("k")
    last = blocks.groupBy("conv_id").agg(F.max(F.struct(length.alias("L"), _part("packed", F.col("k") - 1, *KEY).alias("key"))).alias("t"))
    members = ids.select("conv_id").join(last, "conv_id", "left")
    members = _written(members.select("conv_id", F.coalesce("t.L", F.lit(0)).cast("long").alias("L"), F.coalesce("t.key", F.lit(b"")).alias("key")), size)
    digests = _written(member_digests(members.select("key", "conv_id")), size)
    batches, cuts, ends = _grown(members, blocks, root, size)
    done, totals = [], None
    if batches:
        ends = ends.join(digests, "key").select("r", F.col("x").alias("e"), F.col("n").alias("ending"), "digest")
        owners = None
        for number, batch in enumerate(batches):
            batch = batch.withColumn("batch", F.lit(number))
            owners = batch if owners is None else owners.unionByName(batch)
        nodes = _edges(owners, cuts).join(owners, "r").join(ends, ["r", "e"], "left").withColumn("ending", F.coalesce("ending", F.lit(0)))
        nodes = _looked_up(nodes, blocks, "r", F.col("e"), {"_after": AFTER})
        nodes = _looked_up(nodes, blocks, "r", F.col("f") + 1, {"_before": BEFORE})
        nodes = _written(nodes.withColumns({"upto": _number(F.col("_after")), "before": _number(F.col("_before"))}).drop("_after", "_before"), 2 * size)
        below = Window.partitionBy("r").orderBy(F.desc("e")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        none = F.lit(0).cast("long")
        for number in reversed(range(len(batches))):
            mine = nodes.where(F.col("batch") == number)
            if totals is None:
                mine = mine.withColumns({"t_convs": none, "t_leaves": none, "t_saved": none, "t_branches": none})
            else:
                mine = mine.join(totals, ["r", "e"], "left").fillna(0, ["t_convs", "t_leaves", "t_saved", "t_branches"])
            leaf = ((F.col("e") == F.col("L")) & (F.col("t_branches") == 0)).cast("long")
            mine = mine.withColumns({"n_convs": F.sum(F.col("ending") + F.col("t_convs")).over(below), "n_leaves": F.sum(F.col("t_leaves") + leaf).over(below)})
            mine = mine.withColumn("own", (F.col("n_convs") - 1) * (F.col("upto") - F.col("before")))
            mine = mine.withColumn("saved", F.sum(F.col("own") + F.col("t_saved")).over(below))
            mine = _written(mine.select(
                "r", "f", "e", "b", "parent", "n_convs", "n_leaves", "saved", (F.col("saved") - F.col("own")).alias("further"), "upto", "digest",
                (F.col("t_branches") + (F.col("e") < F.col("L")).cast("long")).alias("n_children")), 2 * size)
            done.append(mine)
            tops = mine.where("f = b").groupBy(F.col("parent").alias("r"), F.col("b").alias("e"))
            totals = tops.agg(F.sum("n_convs").alias("t_convs"), F.sum("n_leaves").alias("t_leaves"), F.sum("saved").alias("t_saved"), F.count("*").alias("t_branches"))
        forget(nodes)
    top = totals.first() if totals is not None else None
    nobody = digests.where(F.length("key") == 0).select("digest").first()
    answer = [(root, 0, None, size, top.t_branches if top else 0, top.t_leaves if top else 1, top.t_saved if top else 0, nobody[0] if nobody else NOBODY)]
    out = spark.createDataFrame(answer, NODES)
    forget(members, digests)
    if not done:
        return out
    edges = done[0]
    for more in done[1:]:
        edges = edges.unionByName(more)
    return out.unionByName(_expanded(edges, blocks))


def _expanded(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row for each depth of each edge, block by block."""
    parts = edges.withColumn("block", F.explode(F.sequence(F.shiftright("f", BLOCK_BITS), F.shiftright(F.col("e") - 1, BLOCK_BITS))))
    parts = parts.join(blocks.select(F.col("conv_id").alias("r"), "block", "packed"), ["r", "block"])
    start = F.col("block") * BLOCK
    places = F.sequence(F.greatest(F.col("f") - start, F.lit(0)), F.least(F.col("e") - start, F.lit(BLOCK)) - 1)
    rows = parts.withColumn("i", F.explode(places)).withColumn("depth", start + F.col("i") + 1)
    end = F.col("depth") == F.col("e")
    before = _number(_part("packed", F.col("i"), *BEFORE))
    return rows.select(
        F.col("r").alias("conv_id"), "depth", F.when(F.col("depth") - 1 > F.col("b"), F.col("r")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs", F.when(end, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("further") + (F.col("n_convs") - 1) * (F.col("upto") - before)).alias("saved_tokens"),
        F.when(end, F.coalesce("digest", F.lit(NOBODY))).otherwise(NOBODY).alias("ends_sha256"))


def rebuilt(conversations: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(ids, turns) of conversations whose first h turns are replaced by those of another one.

    h is crc32 of the decimal conv_id modulo most + 1, the other one is conv_id - conv_id % 100. It gives
    its first h turns (all if it has fewer, none if it is not there); the own turns after the first h
    follow. See in_order for the order of turns and for nulls.
    """
    turns, parts = in_order(conversations)
    sizes = parts.groupBy("conv_id").agg(F.sum("k").alias("n_own"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("long")
    convs = sizes.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("hub"))
    heads = sizes.select(F.col("conv_id").alias("hub"), F.col("n_own").alias("n_hub"))
    convs = written(convs.join(heads, "hub", "left").select("conv_id", "hub", "h", F.least("h", F.coalesce("n_hub", F.lit(0))).alias("taken")))
    own = turns.join(convs, "conv_id").where("i >= h").select("conv_id", (F.col("taken") + F.col("i") - F.col("h") + 1).alias("depth"), "s1", "s2", "n")
    first = turns.where(F.col("i") < most).withColumnRenamed("conv_id", "hub")
    taken = convs.join(first.where("hub % 100 = 0"), "hub").where("i < h").select("conv_id", (F.col("i") + 1).alias("depth"), "s1", "s2", "n")
    return convs.select("conv_id"), own.unionByName(taken)
