"""Awkward documents that every operator on texts must take, and brute-force versions."""

from __future__ import annotations

import hashlib
import random

LONG = " ".join(f"word{k % 997}x{k % 31}" for k in range(30000))
BASE = " ".join(f"alpha{k} beta{k % 7}" for k in range(60))
SPECIAL = "before <|endoftext|> after, it's 2 o'clock\r\n\r\n\t end"

#: doc_id, text: nulls, empties, ties, repeated rows, one long text, near and exact copies, characters of several bytes.
ROWS = [
    (1, BASE), (2, BASE), (3, BASE.replace("alpha3 ", "omega3 ")), (4, None), (5, ""), (6, "   \n "), (7, "one"), (8, "ONE"),
    (9, LONG), (9, LONG), (10, SPECIAL), (11, "日本語のテキスト " * 40), (12, "日本語のテキスト " * 40 + "x"), (13, "a" * 5000), (None, "no id at all " * 10), (None, BASE),
    (14, "prefix text here. " + BASE + " and a tail"), (15, "é" * 30 + "ß" * 40),
]


def documents(spark, rows=None):
    """The rows with extra columns whose names clash with those of operators."""
    rows = ROWS if rows is None else rows
    schema = "doc_id long, text string, lang string, source string, n_chars long, length int, band string, block string, score string, component_id long, sig binary"
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), 1, "b", "k", "z", -1, None) for i, t in rows], schema).repartition(3)


def removed(rows):
    """Brute force of substring removal: doc_id -> (bytes, removed, spans, hash)."""
    texts = [(1 << 62 if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in texts:
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = min(i, first.get(t[p : p + 50], i))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((None if i == 1 << 62 else i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def word_sets(rows, n):
    import re

    low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    out = []
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low))
        out.append((i, frozenset(zip(*(w[k:] for k in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    return out


def components(items, linked):
    """Brute force: component (smallest id) of each (id, value) under a symmetric predicate."""
    parent = {i: i for i, _ in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(items):
        for j, b in items[:k]:
            if i != j and linked(a, b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def near_family(seed=5, n=80, words=60):
    """Texts around one base with growing edits, so that links form chains and some members are strays."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append((100 + i, " ".join(w)))
    return out
