import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import lexical_search, license_scan, prefix_trie, queries

SF = "/root/testdata/sf0.01"

# ------------------------------------------------------------------ license scan

#: text: n_base, first_word, last_word, base_labels, labels
TEXTS = {
    "Released under the MIT License. Under the MIT-license!": (2, 1, 5, "mit", "mit"),
    "under the mit license": (1, 0, 0, "mit", "mit"),
    "understand the mit licenses": (0, None, None, "", ""),
    "Licensed under the Apache License, Version 2.0.": (1, 3, 3, "apache-2", "apache-2"),
    "Licensed under CC BY-NC 4.0.": (1, 2, 2, "cc-by-nc", "cc-by-nc,cc-by-nc-4"),
    "cc by nc cc by nc sa 3.0 cc by": (2, 0, 3, "cc-by-nc", "cc-by,cc-by-nc,cc-by-nc-sa-3"),
    "the GNU General Public License, version 3 or any later version": (0, None, None, "", "gpl-3-or-later"),
    "the gnu lesser general public license v2.1 and the gpl": (0, None, None, "", "gpl,lgpl-2.1"),
    "SPDX-License-Identifier: GPL-2.0-only": (0, None, None, "", "gpl-2"),
    "https://creativecommons.org/licenses/by-sa/4.0/": (0, None, None, "", "cc-by-sa-4"),
    "_mit_license_ BSD 3-clause": (0, None, None, "", "bsd-3-clause,mit"),
    "Ünder thé mit licensé 中文": (0, None, None, "", ""),
    "": (0, None, None, "", ""), None: (0, None, None, "", ""), " .-_ ": (0, None, None, "", ""),
}


def test_license_places_and_labels(spark):
    rows = [(i, t, "a", "b", 1) for i, t in enumerate(TEXTS)] + [(None, "the MIT license", "a", "b", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, line string, n_words int")
    got = license_scan.scan(docs.repartition(3)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: tuple(r)[1:7] for r in got}
    for i, (text, want) in enumerate(TEXTS.items()):
        n = len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        assert by_id[i] == (n, *want), text
    assert by_id[None][5] == "mit" and all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)


def test_license_scan_of_odd_tables_and_long_texts(spark):
    schema = "doc_id long, text string"
    assert license_scan.scan(spark.createDataFrame([], schema)).count() == 0
    long = "word " * 300_000 + "under the mit license " * 3000 + "the gpl v3 " * 1500
    got = license_scan.scan(spark.createDataFrame([(1, long), (1, long)], schema)).collect()
    assert {tuple(r)[1:7] for r in got} == {(300_000 + 12_000 + 4500, 3000, 300_000, 311_996, "mit", "gpl-3,mit")} and len(got) == 2


def test_license_suppression_equals_all_pairs(spark):
    rules = [license_scan.Rule(f"r{k}", "a", p, prio) for k, (p, prio) in enumerate([("a", 1), ("a b", 2), ("a b c", 1), ("b a", 3), ("a(?: b)* c", 2), ("a b", 2), ("c a b c", 1)])]
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abcd") for _ in range(rnd.randrange(30))) for _ in range(60)]
    got = {r.doc_id: r.labels for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rules=rules).collect()}
    for i, text in enumerate(texts):
        found = [(m.start(), m.end(), -r.priority, k) for k, r in enumerate(rules) for m in re.finditer(rf"(?<![^ ]){r.pattern}(?![^ ])", text)]
        left = {f"r{k}" for s, e, p, k in found
                if not any(s2 <= s and e2 >= e and (p2 < p or (p2 == p and (e2 - s2 > e - s or k2 < k))) for s2, e2, p2, k2 in found if k2 != k or (s2, e2) != (s, e))}
        assert got[i] == ",".join(sorted(left)), text


def test_license_scan_is_native_and_has_hundreds_of_rules(spark):
    plan = queries.op11_license_scan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    rules = license_scan.license_rules()
    assert len(rules) > 300 and all(re.search(rf"(?:^|\W){r.keyword}", re.sub(r"\(\?:|\)\??|\?", "", r.pattern)) for r in rules)


# ------------------------------------------------------------------ lexical search


def plain_ranks(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    cut = lambda t: term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(i, Counter(cut(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in own]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for (i, c), size in zip(own, sizes):
            score = 0
            for t in set(cut(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * size * n // total)))
            if score > 0:
                scores.append((-score, i if i is not None else 2**63, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("spare, step", [(1 << 18, 1 << 21), (5, 30)])
def test_ranks_equal_a_plain_version(spark, monkeypatch, spare, step):
    monkeypatch.setattr(lexical_search, "SPARE", spare)
    monkeypatch.setattr(lexical_search, "SCORES", step)
    rnd = random.Random(8)
    vocabulary = ["the", "of", "café", "naïve", "x1", "日本", "rare", "A b", "Ünit", *[f"w{i}" for i in range(40)]]
    text = lambda n: " ".join(rnd.choice(vocabulary) + rnd.choice(["", "", ",", ".\n", "-", "_"]) for _ in range(n))
    docs = [(i, text(rnd.randrange(60))) for i in range(150)]
    docs += [(i, docs[i % 7][1].upper() if i % 2 else docs[i % 7][1]) for i in range(200, 260)] + [(900, None), (901, ""), (902, " ,. "), (None, docs[3][1]), (903, "w1 " * 30_000)]
    items = [(i, text(12)) for i in range(6)] + [(6, None), (7, ""), (8, "absent term"), (None, "rare 日本"), (9, "the the THE")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item string, score int").repartition(5)
    asked = spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, n int")
    for k, mb in ((50, 4), (3, 4)):
        got = lexical_search.ranked(frame, asked, k=k, block_mb=mb).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(plain_ranks(docs, items, k), key=repr)


def test_search_of_odd_tables(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    some = spark.createDataFrame([(1, "a b")], docs)
    assert lexical_search.ranked(spark.createDataFrame([], docs), spark.createDataFrame([(1, "a")], items)).count() == 0
    assert lexical_search.ranked(some, spark.createDataFrame([], items)).count() == 0
    assert lexical_search.ranked(spark.createDataFrame([(1, None), (2, "")], docs), spark.createDataFrame([(1, "a")], items)).count() == 0
    twice = lexical_search.ranked(some.union(some), spark.createDataFrame([(1, "a"), (1, "b")], items)).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id) for r in twice) == [(1, 1, 1), (1, 1, 1), (1, 2, 1), (1, 2, 1)] or not twice


# ------------------------------------------------------------------ prefix trie


def plain_nodes(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c in own:
        own[c] = [x[2:] for x in sorted(own[c])]
    again = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        again[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(again):
        for d in range(len(again[c]) + 1):
            members[again[c][:d]].append(c)
        ends[again[c]].append(c)
    children = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not children[p]
    digest = lambda p: hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()
    return {(m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items()}


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, part string, n int")


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_equal_a_plain_trie(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for c in range(0, 700, 3 if seed == 1 else 1):
        for t in range(rnd.randrange(12)):
            rows.append((c, t * 2, rnd.choice(["user", "assistant"]), rnd.choice(["yes", "no", "é" * 5])))
    copy = [r[1:] for r in rows if r[0] == 300]
    rows += [(c, *r) for c in range(1000, 1400, 100) for r in copy]
    rows += [(5001, None, None, None), (5001, None, None, None), (5001, 1, "user", None), (5002, 7, None, ""), (None, 0, "user", "nobody"), (-250, 0, "user", "yes"), (5003, 0, "b", "yes")]
    got = prefix_trie.prefix_trie(*prefix_trie.rebuilt(conversations(spark, rows).repartition(5)))
    assert set(map(tuple, got.collect())) == plain_nodes(rows) and got.count() == len(plain_nodes(rows))


def test_long_conversations_and_chains_of_prefixes(spark, monkeypatch):
    rnd = random.Random(5)
    long = [("user" if t % 2 else "bot", rnd.choice(["a", "bb"])) for t in range(1300)]
    rows = [(100_000, t, *x) for t, x in enumerate(long)]
    rows += [(200_000, t, *x) for t, x in enumerate(long[:1100])] + [(200_000, 2000, "user", "other end")]
    rows += [(300_000 - 100 * k, t, *x) for k in range(12) for t, x in enumerate(long[: 5 + k])]  # smaller ids are longer
    rows += [(400_000 + 100 * k, t, *x) for k in range(5) for t, x in enumerate([*long[:600], ("user", f"own {k}")])]
    got = prefix_trie.prefix_trie(*prefix_trie.rebuilt(conversations(spark, rows)))
    assert set(map(tuple, got.collect())) == plain_nodes(rows)


def test_tries_of_odd_tables(spark):
    run = lambda rows: prefix_trie.prefix_trie(*prefix_trie.rebuilt(conversations(spark, rows))).collect()
    assert run([]) == [] and run([(None, 1, "a", "b")]) == []
    lone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6)
    got = run([(lone, 0, "user", "x")])  # its only turn is replaced by one of a conversation that is not there
    assert [tuple(r) for r in got] == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert prefix_trie.in_order(conversations(spark, [(1, 2, "a", "b")] * 3))[0].count() == 3
