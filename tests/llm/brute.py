"""Plain versions of the operators, for comparison on small inputs."""

from __future__ import annotations

import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = WORD.findall(fold(text))
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def near_duplicates(rows, k=2, num=80, den=100):
    """rows of (id, text) to {id: (set size, component, kept)} by comparing all pairs; rows of one id are
    one document (its set size is that of its last row)."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if a and b and num * max(len(a), len(b)) <= den * min(len(a), len(b)):
                both = len(a & b)
                if den * both >= num * (len(a) + len(b) - both):
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def kept_words(rows, window):
    """rows of (id, text) to [(id, words, removed, kept text)]."""
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = {}
    for _, w in texts:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def leaks(docs, items, k=5, least=0.8):
    """{(doc, item): best similarity} over all item-sized windows, on word shingle counts."""
    from collections import Counter

    def words(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    out = {}
    for i, t in docs:
        w = words(t)
        for j, u in items:
            v = words(u)
            n, size = len(v), min(k, len(v))
            if not n:
                continue
            want = Counter(tuple(v[x : x + size]) for x in range(n - size + 1))
            for s in range(len(w) - n + 1):
                have = Counter(tuple(w[s + x : s + x + size]) for x in range(n - size + 1))
                both = sum((want & have).values())
                if both:
                    sim = both / (sum(want.values()) + sum(have.values()) - both)
                    if sim >= least and sim > out.get((i, j), 0):
                        out[i, j] = sim
    return out
