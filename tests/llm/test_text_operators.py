import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from tidemark.llm import decontaminate, jaccard_join, packed, sentencepiece_trie, substring_dedup, suffix_dedup
from tidemark.llm.common import doc_key

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, _did string, _th string, bucket int, cls int, rows binary"


def corpus(seed=3, docs=120):
    """Texts with exact and near copies, shared passages, runs of one word, periodic and odd ones."""
    rnd = random.Random(seed)
    some = ["".join(rnd.choices("abcdeé", k=rnd.randint(1, 6))) for _ in range(300)]
    prose = lambda n: rnd.choices(some, k=n)
    passage, long_passage = prose(30), prose(90)
    out = []
    for _ in range(docs):
        kind = rnd.random()
        w = prose(rnd.randint(1, 160))
        if kind < 0.2 and out:
            w = list(rnd.choice(out))
        elif kind < 0.45 and out:
            w = list(rnd.choice(out))
            for _ in range(rnd.randint(1, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(some).upper()
        elif kind < 0.6:
            at = rnd.randint(0, len(w))
            w[at:at] = rnd.choice((passage, long_passage, long_passage[5:60]))
        elif kind < 0.7:
            w = [rnd.choice(some)] * rnd.randint(1, 70)
        elif kind < 0.75:
            w = prose(rnd.randint(1, 3)) * rnd.randint(5, 40)
        out.append(w)
    texts = [rnd.choice((" ", "\n", "  ", "\t")).join(w) for w in out]
    return list(enumerate([*texts, None, "", " \n ", "one", "one two three four", "One TWO three four", "x" * 300, "▁ ▁▁a\x00b 日本 🙂 ﬁ"]))


def frame(spark, rows):
    full = [(i, t, f"d{i}", "x", 1, 2, b"r") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs():
    return corpus()


def test_jaccard_groups_equal_brute_force(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(frame(spark, docs)).collect()}
    assert got == plain.jaccard(docs)


def test_jaccard_with_single_tiles(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(frame(spark, docs)).collect()}
    assert got == plain.jaccard(docs)


def test_one_text_of_each_group_stays(spark, docs):
    df = frame(spark, docs)
    kept = jaccard_join.first_of_groups(df.unionByName(df))
    want = {i for i, (_, c) in plain.jaccard(docs).items() if i == c}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert kept.columns == df.columns


def test_substring_dedup_equals_brute_force(spark, docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.dedup_substrings(frame(spark, docs)).collect()}
    assert got == plain.without_windows(docs)


@pytest.mark.parametrize("size", [2, 7, 40])
def test_substring_dedup_of_other_sizes(spark, docs, size):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.dedup_substrings(frame(spark, docs), size).collect()}
    assert got == plain.without_windows(docs, size)


def test_texts_without_repeats_keep_columns_and_bytes(spark, docs):
    df = frame(spark, docs).selectExpr("*", "cast(length(text) as long) n_chars")
    got = {r.doc_id: r for r in substring_dedup.without_repeats(df).collect()}
    texts = dict(docs)
    for i, (n, gone, kept) in plain.without_windows(docs).items():
        if gone and not kept:
            assert i not in got
        else:
            assert got[i].text == (kept if gone else texts[i]) and got[i].cls == 2
            assert got[i].n_chars == (None if texts[i] is None else len(got[i].text))


def test_suffix_dedup_equals_brute_force(spark, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup_bytes(frame(spark, docs)).collect()}
    assert got == plain.without_bytes(docs)


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (5, text), (5, text), (None, text + " z"), (7, None), (7, "a b")]
    df = frame(spark, rows)
    found = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(df).collect())
    assert found == [(-1, 56, 5), (-1, 57, 5), (5, 56, 5), (5, 56, 5), (7, 0, 7), (7, 1, 7)]
    kept = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(df).collect())
    assert kept == [(-1, 60, 60), (-1, 61, 60), (5, 60, 0), (5, 60, 0), (7, 0, 0), (7, 2, 0)]
    cut = sorted((r.doc_id or -1, r.n_removed) for r in suffix_dedup.dedup_bytes(df).collect())
    assert cut == [(-1, len(text)), (-1, len(text)), (5, 0), (5, 0), (7, 0), (7, 0)]


HOT = " ".join(f"h{i}" for i in range(70))


def bucket_sizes(spark, rows, buckets=24):
    """Rows that come back from each bucket when texts meet their replies, and the texts that were sent for them."""
    texts = frame(spark, rows).select(*doc_key(), "text")
    sent = []
    for batch in packed._text_rows(buckets)(iter(texts.toArrow().to_batches())):
        sent += [len(b) for raw in batch.column("rows").to_pylist() for b in packed._blocks_of(packed._unsqueezed(raw))]

    def back(found, place, block):
        yield packed.rows_again(block, pa.RecordBatch.from_arrays([pa.array(block.did)], names=["_did"]))

    none = spark.createDataFrame([], packed.BUCKET_ROWS)
    out = packed.with_texts(texts, none, buckets, packed.decoder(packed.DOC, suffix_dedup.COVERED), back, "_did long")
    return [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()], sum(sent)


def test_copies_of_a_text_are_spread_over_the_buckets(spark):
    got, _ = bucket_sizes(spark, [(i, HOT) for i in range(1200)])
    assert sum(got) == 1200 and max(got) < 200


def test_rows_that_repeat_id_and_text_are_sent_once_by_a_task(spark):
    got, sent = bucket_sizes(spark, [(7, HOT)] * 900 + [(i, f"text {i}") for i in range(30)])
    assert sum(got) == 930 and sent <= 40


def test_replies_are_looked_up_by_id_and_text():
    ids = np.full(4, 7, np.int64)
    rows = np.zeros(4, packed.joined_dtype(packed.DOC, suffix_dedup.COVERED))
    rows["did"], rows["th"], rows["at"] = 7, [1, 2, 3, 3], [10, 20, 30, 31]
    keys = packed.doc_hash(rows["did"], rows["th"])
    order = np.argsort(keys, kind="stable")
    block = packed.Texts(ids, np.array([3, 9, 1, 2]), np.zeros(0, np.uint8), np.zeros(5, np.int64))
    found, place = packed._of_block(rows[order], keys[order], block)
    assert sorted(zip(place.tolist(), found["at"].tolist())) == [(0, 30), (0, 31), (2, 10), (3, 20)]


def test_a_large_group_of_copies_loses_all_but_the_first(spark, tmp_path):
    rows = [(i, HOT) for i in range(400)] + [(1000 + i, f"own{i} " * 3 + HOT) for i in range(50)] + [(3, HOT)] * 40 + [(None, HOT)] * 60
    frame(spark, rows).write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    kept = [(r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(df).where("doc_id > 0 OR doc_id IS NULL").collect()]
    assert sorted(kept) == [(70, 70)] * 499 + [(73, 70)] * 50
    cut = [r.n_removed for r in suffix_dedup.dedup_bytes(df).where("doc_id > 0 OR doc_id IS NULL").collect()]
    # " h0 h1" and on: the blank in front is in a string of document 1001 and later only where it ends alike
    assert len(cut) == 549 and min(cut) >= len(HOT) and sum(c == len(HOT) for c in cut) >= 500


def test_empty_tables(spark):
    df = frame(spark, [])
    assert jaccard_join.jaccard_groups(df).count() == 0
    assert jaccard_join.first_of_groups(df).count() == 0
    assert substring_dedup.dedup_substrings(df).count() == 0
    assert suffix_dedup.dedup_bytes(df).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(df, items).count() == 0
    assert decontaminate.contaminated(frame(spark, [(1, "a b c d e f")]), items).count() == 0
    assert sentencepiece_trie.encode(df, PIECES).count() == 0


def test_very_long_text(spark):
    rnd = random.Random(5)
    text = " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(5000)) for _ in range(400_000))
    rows = [(1, text), (2, text[1000:3000] + " tail"), (3, "y" * 3_000_000)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(frame(spark, rows)).collect()}
    want = plain.without_windows(rows[:2])
    assert got == {i: want[i][:2] for i in (1, 2)} | {3: (1, 0)}
    cut = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.dedup_bytes(frame(spark, rows)).collect()}
    # " tail" begins with a blank, as what follows the copied part does
    assert text[3000] == " " and cut == {1: (len(text), 0), 2: (2005, 2001), 3: (3_000_000, 0)}
    assert {r.doc_id for r in jaccard_join.jaccard_groups(frame(spark, rows)).where("component_id <> doc_id").collect()} == set()


def items_of(docs):
    out = [(i, t) for i, t in docs[:20]]
    long = " ".join(f"q{i}" for i in range(900))
    return [*out, (100, long), (101, long[:200]), (None, "alpha beta gamma delta epsilon zeta eta theta"), (102, None), (103, ""), (104, "one two three four")]


@pytest.mark.parametrize("block_mb", [16, 0.001])
def test_decontamination_equals_brute_force(spark, docs, block_mb, monkeypatch):
    items = items_of(docs)
    long = dict(items)[100]
    hidden = [*docs, (900, "x y z " * 3000 + long[:3000] + " u v w" * 2000), (901, "p " * 5000 + "Alpha BETA gamma delta epsilon zeta eta theta" + " r" * 10), (902, long)]
    df = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    if block_mb < 1:
        df = df.where("length(text) < 2000 OR text IS NULL").unionByName(df.where("length(text) >= 2000"))
    got = {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in decontaminate.contaminated(frame(spark, hidden), df).collect()}
    assert got == plain.contained(hidden, items)


def test_small_items_and_recall_of_larger_ones(spark):
    """Every item of 5 to 12 words at any place is found; of larger ones with just 3/4 of their shingles nearly all."""
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(10**6)}"
    items, rows, k = [], [], 0
    for n in [5, 6, 7, 8, 10, 12] * 60 + [13, 20, 40, 90] * 60:
        text = [word() for _ in range(n)]
        lost = 0 if n < 13 else (n - 4) // 4  # the shingles behind the cut
        around = [[word() for _ in range(rnd.choice([0, 1, 2, 30, 200]))] for _ in range(2)]
        items.append((k, " ".join(text)))
        rows.append((k, " ".join([*around[0], *text[: n - lost], *around[1]])))
        k += 1
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(i, i) for i in range(360)} <= got and len(got) >= k - 2 and all(a == b for a, b in got)


def test_items_in_several_blocks(spark):
    words = [[f"i{k}w{j}" for j in range(40)] for k in range(60)]
    items = spark.createDataFrame([(k, " ".join(w) + " " + "pad " * 6000) for k, w in enumerate(words)], "item_id long, text string")
    docs = frame(spark, [(k, " ".join(w) + " pad" * 6000) for k, w in enumerate(words)])
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, block_mb=1).collect()}
    assert found == {(k, k) for k in range(60)}


def test_clean_drops_documents_with_items(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    df = frame(spark, [(1, "start " + item + " end"), (2, "nothing here"), (3, None)])
    kept = decontaminate.clean(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3] and kept.columns == df.columns


def best_score(word, v):
    """Greatest sum of scores over all segmentations, by recursion from the front."""
    best = [0.0] + [None] * len(word)
    for end in range(1, len(word) + 1):
        ways = [best[end - 1] + v.byte_score * len(word[end - 1].encode())]
        ways += [best[b] + v.tails[word[b:end]][0] for b in range(end) if v.tails.get(word[b:end])]
        best[end] = max(ways)
    return best[-1]


def test_pieces_have_the_best_score():
    v = sentencepiece_trie.load_vocabulary(PIECES)
    rnd = random.Random(1)
    words = sorted({"▁" + "".join(rnd.choices("theonaing日é", k=rnd.randint(0, 14))) for _ in range(400)})
    score = {i: v.tails[p][0] for p, i in v.ids.items()}
    for word, ids in zip(words, sentencepiece_trie.encode_sorted(words, v)):
        assert sum(score.get(i, v.byte_score) for i in ids) == pytest.approx(best_score(word, v))


def test_round_trip_of_whole_texts(spark, docs):
    rows = [*docs, (1000, "  lead and trail  "), (1001, "▁"), (1002, "a\r\n\tb "), (1003, "é" * 5000)]
    back = sentencepiece_trie.decode(sentencepiece_trie.encode(frame(spark, rows), PIECES), PIECES)
    for r in back.collect():
        assert r.decoded == (dict(rows)[r.doc_id] or "")
        assert (len(r.piece_ids) == 0) == (not dict(rows)[r.doc_id])
    for r in sentencepiece_trie.round_trip(frame(spark, rows), PIECES).collect():
        assert r.same and (len(r.piece_ids) == 0) == (not dict(rows)[r.doc_id])
    assert back.columns[:7] == ["doc_id", "text", "_did", "_th", "bucket", "cls", "rows"]
