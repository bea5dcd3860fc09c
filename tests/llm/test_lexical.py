"""Lexical search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import cases
import pytest
from chronogrid.llm import lexical

LOW = str.maketrans(lexical.UPPER, lexical.LOWER)


def terms(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW)) if w]


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    total = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(1 for n in total if n), sum(total)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        ranked = []
        for (i, bag), n in zip(bags, total):
            score = 0
            for t in terms(text):
                if t in bag:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 75 + (75 * n * n_docs) // n_terms
                    score += w * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                ranked.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(ranked)[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, **settings):
    d = spark.createDataFrame([(*r, 0, 0, "z") for r in docs], "doc_id long, text string, n long, tid long, term string").repartition(3)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, row int")
    return sorted((tuple(r) for r in lexical.search(d, q, settings=lexical.Settings(**settings)).collect()), key=repr)


@pytest.mark.parametrize("settings", [{"k": 3, "block_postings": 40, "broadcast_bytes": 0, "entries": 7}, {"k": 10}])
def test_random_documents_with_hot_terms_and_ties(spark, settings):
    rng = random.Random(3)
    words = ["the", "of", "É", "日本"] + [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choice(words[:4]) if rng.random() < 0.5 else rng.choice(words) for _ in range(rng.choice((1, 4, 20, 200))))) for k in range(220)]
    docs += [(300 + k, docs[7][1]) for k in range(25)] + [(7, "The w1, w1; W1"), (None, docs[3][1])]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice((1, 3, 12, 30))))) for k in range(12)] + [(50, "the the of"), (51, "absent words"), (52, "..."), (53, None), (0, "w1 w2")]
    assert found(spark, docs, items, **settings) == brute(docs, items, settings["k"])


def test_awkward_rows_and_empty_tables(spark):
    items = [(1, "alpha3 beta2 word5x5 word5x5"), (2, "日本語のテキスト"), (3, "no ID at"), (4, "")]
    assert found(spark, cases.ROWS, items) == brute(cases.ROWS, items)
    assert found(spark, [], items) == []
    assert found(spark, cases.ROWS, []) == []
    assert found(spark, [(1, None), (2, "")], items) == []
