"""Plain restatements of what the operators return, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


def shingles(text, n=5):
    w = words(text, lower=True)
    if len(w) >= n:
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def jaccard(docs):
    """docs: (doc_id, text) with distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    having = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    shared = Counter((a, b) for ids in having.values() for a in ids for b in ids if a < b)
    links = [(a, b) for (a, b), c in shared.items() if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c)]
    found = components(sets, links)
    return {i: (len(sets[i]), found[i]) for i in sets}


def without_windows(docs, size=20):
    """docs: (doc_id, text) with distinct ids: doc_id -> (words, removed, kept text)."""
    first = {}
    tokens = {i: words(t) for i, t in docs}
    for i in sorted(tokens):
        for p in range(len(tokens[i]) - size + 1):
            first.setdefault(tuple(tokens[i][p : p + size]), (i, p))
    out = {}
    for i, w in tokens.items():
        keep = [True] * len(w)
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < (i, p):
                keep[p : p + size] = [False] * size
        out[i] = (len(w), len(w) - sum(keep), " ".join(x for x, k in zip(w, keep) if k))
    return out


def without_bytes(docs, size=50):
    first = {}
    data = {i: (t or "").encode() for i, t in docs}
    for i in sorted(data):
        for p in range(len(data[i]) - size + 1):
            first.setdefault(data[i][p : p + size], i)
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if first[b[p : p + size]] < i:
                gone[p : p + size] = b"\1" * size
        spans = sum(1 for x in bytes(gone).split(b"\0") if x)
        out[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


def contained(docs, items, share=0.75):
    have = {i: shingles((t or "").lower()) for i, t in docs}
    out = set()
    for item, text in items:
        want = shingles((text or "").lower())
        for i, s in have.items():
            both = len(want & s)
            if want and both >= share * len(want):
                out.add((i, item, both, len(want)))
    return out
