"""Near-duplicates, substring removal, fuzzy passages and vectors against brute force."""

import random

import cases
import numpy as np
import pyarrow as pa
import pytest

from chronogrid.llm import components, fuzzy_passages, lattice, minhash, suffix_dedup


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(7, None), (5, 5)] + [(400 + k, 401 + k) for k in range(40)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    real = [(a, b) for a, b in edges if b is not None and a != b]
    nodes = sorted({x for e in real for x in e})
    near = {frozenset(e) for e in real}
    want = cases.components([(n, n) for n in nodes], lambda a, b: frozenset((a, b)) in near)
    assert {r.node: r.component for r in components.components(df).collect()} == want
    assert components.components(df.limit(0)).count() == 0


def test_components_that_do_not_settle(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(64)], "a long, b long")
    with pytest.raises(RuntimeError):
        components.components(chain, rounds=1)


def test_one_id_with_different_texts(spark):
    """Its texts are one document: what is linked with any of them is linked with all."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(50)) for x in "abc")
    rows = [(5, a), (5, b), (3, b), (7, a), (9, c), (9, c), (9, None), (2, c + " more")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(cases.documents(spark, rows)).collect())
    assert got == sorted([(5, 3, False), (5, 3, False), (3, 3, True), (7, 3, False), (9, 2, False), (9, 2, False), (9, 9, True), (2, 2, True)])


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    rows = [*cases.ROWS, *cases.near_family()]
    s = minhash.Settings(words=words, block=16, stray_block=8)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(cases.documents(spark, rows), settings=s).collect()), key=str)
    sets = cases.word_sets(rows, words)
    of = cases.components([(i, x) for i, x in sets if i is not None], lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b))
    want = [(i, len(x), of.get(i), i is not None and of[i] == i) for i, x in sets]
    assert got == sorted(want, key=str)


def test_bucket_of_strays_is_dealt_in_blocks(spark, monkeypatch):
    """A bucket without a large component must not be one task; families of close signatures are still joined whole."""
    s = minhash.Settings(block=16)
    rng = np.random.default_rng(16)
    family = rng.integers(0, 1 << 32, (40, s.hashes), np.uint64).astype("<u4")
    reps = spark.createDataFrame([(i, bytearray(family[i % 40].tobytes())) for i in range(200)], "id long, sig binary")
    largest, dealt = [], minhash.grouped

    def spy(df, by, *rest):
        largest.append(df.groupBy(*by).count().agg({"count": "max"}).first()[0])
        return dealt(df, by, *rest)

    monkeypatch.setattr(minhash, "grouped", spy)
    members = spark.range(200).selectExpr("7L AS band", "id")
    labels = spark.createDataFrame([(0, 0), (40, 0)], "node long, component long")
    edges = minhash._neighbourhoods(members, labels, reps, s).unionAll(spark.createDataFrame([(40, 0)], "a long, b long"))
    assert {r.node: r.component for r in components.components(edges).collect()} == {i: i % 40 for i in range(200)}
    assert largest[0] <= 5 * s.block


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(cases.documents(spark, [])).count() == 0
    assert [r.kept for r in minhash.near_duplicates(cases.documents(spark, [(1, None), (2, "")])).collect()] == [True, True]


@pytest.mark.parametrize("block_bytes", [3000, 2 << 20])
def test_substring_removal(spark, block_bytes):
    rng = random.Random(7)
    passage = " ".join(f"p{rng.randrange(1000)}" for _ in range(40))
    rows = [*cases.ROWS[:9], *cases.ROWS[10:]] + [(200 + k, f"{k} {passage[k:]} {k * 7919} {passage[: 60 + k]}") for k in range(12)] + [(230, "ab" * 300), (231, "ba" * 200), (232, passage[:49]), (233, passage[:50])]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(cases.documents(spark, rows), block_bytes=block_bytes).collect()), key=str)
    assert got == cases.removed(rows)


def common_line(n, seed=9):
    """Documents that share one line, each time between other words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    line = "the line that a third of all documents has, between words of their own, every time."
    return [(k, " ".join([*(word() for _ in range(rng.randint(2, 30))), *([line] if k % 3 else []), *(word() for _ in range(rng.randint(2, 30)))])) for k in range(n)]


@pytest.mark.parametrize("most", [1 << 16, 5])
def test_substring_removal_over_many_ranges(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_SPLITTERS", most)
    rows = [*cases.ROWS[:8], *common_line(150), (500, common_line(2)[1][1]), (501, common_line(150, 10)[4][1]), (502, "ab" * 300), (503, "ba" * 200)]
    sizes = {"block_bytes": 1500, "part_bytes": 400, "range_bytes": 300}
    docs = cases.documents(spark, rows)
    _, runs = suffix_dedup.exchange(docs, **sizes)
    assert runs.select("range").distinct().count() > 15
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(docs, **sizes).collect()), key=str)
    assert got == cases.removed(rows)


def test_a_common_line_fills_no_range(spark):
    largest = []
    for n in (300, 1200):
        docs = cases.documents(spark, common_line(n))
        _, runs = suffix_dedup.exchange(docs, block_bytes=4000, part_bytes=2000, range_bytes=2000)
        largest.append(max(r.n for r in runs.where("at IS NOT NULL").selectExpr("range", "octet_length(at) div 4 AS n").groupBy("range").sum("n").withColumnRenamed("sum(n)", "n").collect()))
    print("entries of the largest range at 300 and 1200 documents:", largest)
    assert largest[1] < 2 * largest[0]


def test_substring_removal_of_nothing_and_texts(spark):
    assert suffix_dedup.deduplicate(cases.documents(spark, [])).count() == 0
    rows = [(1, "日本語" * 30), (2, "x" + "日本語" * 30)]
    kept = {r.doc_id: r.kept for r in suffix_dedup.deduplicate(cases.documents(spark, rows), with_text=True).collect()}
    assert kept == {1: "日本語" * 30, 2: "x"}


def test_loser_tree():
    rng = random.Random(8)
    common = lambda a, b: next((k for k in range(50) if a[k] != b[k]), 50)
    for _ in range(100):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.choice((3, 50)))).ljust(50, b"\0") for _ in range(rng.choice((0, 1, 9)))) for _ in range(rng.choice((1, 3, 8)))]
        run, prefix, at = suffix_dedup.merge_runs(runs, [[0] + [common(a, b) for a, b in zip(r, r[1:])] for r in runs])
        merged = [runs[a][b] for a, b in zip(run, at)]
        assert merged == sorted(x for r in runs for x in r)
        assert prefix[1:] == [common(a, b) for a, b in zip(merged, merged[1:])]


def test_fuzzy_passages(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**7)}"
    passage = [word() for _ in range(60)]
    rows, edited = [], {}
    for i in range(12):
        w = list(passage)
        for k in range(0, i % 4):
            w[10 + 12 * k] = word()
        if i % 3 == 2:
            del w[30]
        rows.append((i, " ".join([word() for _ in range(50)] + w + [word() for _ in range(50)])))
        edited[i] = w
    clean = [(100 + i, " ".join(word() for _ in range(200))) for i in range(5)]
    whole = [(50, rows[0][1]), (None, rows[0][1]), (60, None), (61, ""), (62, "short text")]
    got = fuzzy_passages.passages(cases.documents(spark, rows + clean + whole), settings=fuzzy_passages.Settings(block_bytes=4000)).collect()
    found = {}
    for r in got:
        assert r.ref_doc_id < r.doc_id and 40 <= r.end - r.start and r.identity >= 0.8
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == {*range(1, 12), 50}
    for i in range(1, 12):
        assert any(r.start <= 55 and r.end >= 45 + len(edited[i]) for r in found[i])
    assert any(r.end - r.start == 160 and r.identity == 1.0 for r in found[50])
    assert fuzzy_passages.passages(cases.documents(spark, [])).count() == 0


def fuzzy(spark, rows, **settings):
    return sorted(tuple(r)[:7] for r in fuzzy_passages.passages(cases.documents(spark, rows), settings=fuzzy_passages.Settings(**settings)).collect())


def test_passages_apart(spark):
    """Two exact passages with unrelated words between them are two passages, however long the gap."""
    rng = random.Random(13)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], []
    for k, (n, gap) in enumerate([(60, 31), (60, 40), (60, 150), (60, 299), (40, 21), (40, 100)]):
        p, q = words(n), words(n)
        for i in (2 * k, 2 * k + 1):
            rows.append((i, " ".join([*words(20), *p, *words(gap), *q, *words(20)])))
        want += [(2 * k + 1, at, at + n, 2 * k, at, at + n, n) for at in (20, 20 + n + gap)]
    assert fuzzy(spark, rows) == want


def joined(pairs):
    """Components of a list of pairs, as a set of frozensets."""
    groups = {}
    for a, b in pairs:
        both = groups.get(a, {a}) | groups.get(b, {b})
        for x in both:
            groups[x] = both
    return {frozenset(g) for g in groups.values()}


def brute_pairs(rows, least=40):
    """(doc, ref) of all pairs of different ids with a stretch of enough words on one diagonal of which 80 % are equal."""
    out = set()
    texts = [(i, t.lower().split()) for i, t in rows if i is not None and t]
    for k, (i, a) in enumerate(texts):
        at = {}
        for p, w in enumerate(a):
            at.setdefault(w, []).append(p)
        for j, b in texts[:k]:
            diagonals = {}
            for q, w in enumerate(b):
                for p in at.get(w, ()):
                    diagonals.setdefault(p - q, []).append(p)
            for x in diagonals.values():
                if i != j and len(x) >= 0.8 * least and any(x[e] - x[f] + 1 >= least and 100 * (e - f + 1) >= 80 * (x[e] - x[f] + 1) for f in range(len(x)) for e in range(f, len(x))):
                    out.add((max(i, j), min(i, j)))
    return out


def test_no_link_is_lost_to_other_holders(spark):
    """Fragments of a passage, rows that share an id, and blocks of any size do not hide a passage."""
    rng = random.Random(17)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    p, q, r = words(70), words(60), words(90)
    text = lambda *parts: " ".join(x for part in parts for x in part)
    rows = [(1, text(words(30), p, words(30))), (500, text(words(20), p, words(25)))]
    rows += [(10 + k, text(words(30), p[7 * k : 7 * k + 14], words(30))) for k in range(9)]
    rows += [(30, text(q, words(40))), (39, text(words(40), q))] + [(31 + k, text(words(30), q[20 * k : 20 * k + 20], words(30))) for k in range(3)]
    rows += [(2, "aaa"), (2, text(words(5), p)), (40, text(r)), (40, text(words(9), r)), (41, text(r, words(3))), (41, text(words(50))), (None, text(p)), (9, cases.LONG), (8, cases.LONG + " end"), (7, text(words(50), cases.LONG.split()[500:600], words(50)))]
    want = brute_pairs([x for x in rows if x[0] not in (7, 8, 9)]) | {(9, 8), (8, 7)}
    seen = set()
    for block_bytes in (1500, 20000, 2 << 20):
        found = fuzzy(spark, rows, block_bytes=block_bytes, part_bytes=2 * block_bytes)
        assert joined((x[0], x[3]) for x in found) == joined(want)
        assert all(x[0] > x[3] for x in found) and {(x[0], x[3]) for x in found if 7 not in x and 8 not in x and 9 not in x} <= want
        seen.add(frozenset(cover for x in found for cover in (*((x[0], k) for k in range(x[1], x[2])), *((x[3], k) for k in range(x[4], x[5])))))
    assert len(seen) == 1  # the words that are in passages


def test_families_of_edited_passages(spark):
    """An original, many copies with 12 % of their words changed and one with 16 %; families whose members differ from each other more than from the original."""
    rng = random.Random(18)
    word = lambda: f"w{rng.randrange(10**9)}"
    rows = []
    for f, (members, low, high) in enumerate([(50, 0.12, 0.16), (12, 0.05, 0.2), (5, 0.15, 0.18), (30, 0.02, 0.1)]):
        p = [word() for _ in range(60)]
        for k in range(members):
            share = 0 if k == 0 else high if k == members - 1 else low
            edits = set(rng.sample(range(60), round(60 * share)))
            rows.append((100 * f + k, " ".join([*(word() for _ in range(30)), *(word() if j in edits else w for j, w in enumerate(p)), *(word() for _ in range(30))])))
    want = brute_pairs(rows)
    found = {(x[0], x[3]) for x in fuzzy(spark, rows, block_bytes=6000)}
    assert found <= want and (49, 0) in found
    assert joined(found) == joined(want)


@pytest.mark.parametrize("n, share, least", [(40, 0.1, 1.0), (40, 0.15, 0.95), (60, 0.15, 1.0), (40, 0.2, 0.75), (120, 0.2, 0.97)])
def test_recall_of_pairs(n, share, least):
    """Two documents with one passage, words of it replaced at random, by the operator's own steps without Spark."""
    rng = random.Random(20)
    word = lambda: f"w{rng.randrange(10**9)}"
    s = fuzzy_passages.Settings()
    true = found = 0
    for _ in range(60):
        p = [word() for _ in range(n)]
        edits = set(rng.sample(range(n), int(n * share)))
        texts = [" ".join([*(word() for _ in range(25)), *q, *(word() for _ in range(30))]) for q in (p, [word() if j in edits else w for j, w in enumerate(p)])]
        if not brute_pairs(list(enumerate(texts))):
            continue
        true += 1
        docs = pa.table({"doc_id": pa.array([1, 2]), "key": pa.array([1, 2]), "text": pa.array([t.encode() for t in texts], pa.binary()), "block": pa.array([0, 0], pa.int64())})
        matches = fuzzy_passages.match(fuzzy_passages.send_seeds(docs, pa.table({"part": pa.array([], pa.int32()), "bits": pa.array([], pa.binary())}), 1, s), 1, s)
        chained = fuzzy_passages.make_chains(docs, matches, s) if matches.num_rows else None
        found += bool(chained and fuzzy_passages.passages_of(docs, chained, s).num_rows)  # a pair that is given back has its row too
    assert found >= least * true > 20


def test_passages_at_the_threshold(spark):
    """Every fifth or sixth word replaced, or words replaced at random, held against every diagonal of each pair."""
    rng = random.Random(15)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k in range(60):
        n = rng.choice((40, 60))
        p = words(n)
        q = [words(1)[0] if (j % (5 + k % 2) == 4 if k < 20 else j in edits) else w for edits in [set(rng.sample(range(n), n // 5))] for j, w in enumerate(p)]
        rows += [(2 * k, " ".join([*words(30), *p, *words(30)])), (2 * k + 1, " ".join([*words(rng.randrange(60)), *q, *words(30)]))]
    want = {}
    for (ref, a), (doc, b) in zip(rows[::2], rows[1::2]):
        a, b = a.split(), b.split()
        at = {w: j for j, w in enumerate(a)}
        x = [j for j, w in enumerate(b) if w in at]
        assert len({j - at[b[j]] for j in x}) == 1
        fits = [(i, j) for i in range(len(x)) for j in range(i, len(x)) if (n := x[j] - x[i] + 1) >= 40 and 100 * (j - i + 1) >= 80 * n]
        if fits:
            want[doc, ref] = {x[k] for i, j in fits for k in range(i, j + 1)}
    got, found = {}, fuzzy(spark, rows, block_bytes=8000, words=4, window=1)
    assert len({(r[0], r[1], r[2]) for r in found}) == len(found)
    for r in found:
        a, b = rows[r[3]][1].split(), rows[r[0]][1].split()
        got.setdefault((r[0], r[3]), set()).update(k for k in range(r[1], r[2]) if b[k] in a)
    assert len(want) > 40 and got == want


def test_a_passage_that_goes_on_beyond_a_certain_stretch(spark):
    """Documents 2 and 3 share 58 words, four fifths equal, whose exact part ends where what 1 and 3 share ends."""
    rng = random.Random(31)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    third = words(300)
    first = [*words(20), *third[80:200], *words(40)]
    passage = third[180:238]
    second = [*words(25), *(w if k < 20 or k % 4 != 1 else words(1)[0] for k, w in enumerate(passage)), *words(25)]
    rows = [(1, " ".join(first)), (2, " ".join(second)), (3, " ".join(third))]
    alone = fuzzy(spark, rows[1:])
    assert [(r[0], r[3]) for r in alone] == [(3, 2)] and 100 * alone[0][6] >= 80 * (alone[0][2] - alone[0][1])
    assert set(alone) <= set(fuzzy(spark, rows)) and {(r[0], r[3]) for r in fuzzy(spark, rows)} == {(3, 1), (3, 2)}


def test_a_long_passage_is_given_whole(spark):
    """416 words, every fifth of the last 400 replaced: no seed lies in those, and they are far more than a chain takes along."""
    rng = random.Random(32)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    p = words(416)
    q = [words(1)[0] if k >= 16 and k % 5 == 0 else w for k, w in enumerate(p)]
    for a, b in ((p, q), (p[::-1], q[::-1])):
        rows = [(1, " ".join([*words(50), *a, *words(50)])), (2, " ".join([*words(10), *b, *words(30)]))]
        (r,) = fuzzy(spark, rows)
        assert r[2] - r[1] >= 414 and r[5] - r[4] == r[2] - r[1] and r[6] == sum(x == y for x, y in zip(a, b))


def test_stretches_against_brute_force():
    rng = random.Random(14)
    s = fuzzy_passages.Settings(least_words=8)
    for _ in range(200):
        x = np.flatnonzero([rng.random() < 0.75 for _ in range(60)])
        y = x + np.cumsum([rng.random() < 0.1 for _ in x])
        if not len(x):
            continue
        fits = lambda i, j: (n := max(x[j] - x[i], y[j] - y[i]) + 1) >= 8 and 100 * (j - i + 1) >= 80 * n
        want = {k for i in range(len(x)) for j in range(i, len(x)) if fits(i, j) for k in range(i, j + 1)}
        got = fuzzy_passages.stretches(x, y, s)
        assert all(fits(i, j) for i, j in got)
        assert {k for i, j in got for k in range(i, j + 1)} == want


def test_covering_holds_all_words():
    rng = random.Random(25)
    for _ in range(500):
        found = [(a, a + n, b, b + n, n) for a, b, n in ((rng.randrange(60), rng.randrange(60), rng.randint(1, 25)) for _ in range(rng.randint(1, 12)))]
        for low in (0, 2):
            words = lambda g: {k for p in g for k in range(p[low], p[low + 1])}  # noqa: B023, E731
            assert words(fuzzy_passages.covering(found)) == words(found)
    assert len(fuzzy_passages.covering([(401 + 2 * k, 504 + 2 * k, 275, 378, 103) for k in range(60)])) <= 4


def test_chains_against_quadratic_search():
    rng = random.Random(10)
    for _ in range(60):
        seg = []
        for _ in range(rng.randint(1, 9)):
            a, b, n = rng.randrange(60), rng.randrange(60), rng.randint(5, 9)
            seg.append((a, a + n, b, b + n))
        seg = np.array(seg)
        best = [0.0] * len(seg)
        for i in sorted(range(len(seg)), key=lambda i: seg[i, 0]):
            best[i] = seg[i, 1] - seg[i, 0] + max([0, *(best[j] - fuzzy_passages.GAP_COST * (seg[i, 0] - seg[j, 1] + seg[i, 2] - seg[j, 3]) for j in range(len(seg)) if seg[j, 1] <= seg[i, 0] and seg[j, 3] <= seg[i, 2])])
        chain = fuzzy_passages.chains(seg)[0]
        score = sum(seg[i, 1] - seg[i, 0] for i in chain) - sum(fuzzy_passages.GAP_COST * (seg[y, 0] - seg[x, 1] + seg[y, 2] - seg[x, 3]) for x, y in zip(chain, chain[1:]))
        assert abs(score - max(best)) < 1e-9


@pytest.mark.parametrize("cell_rows", [8, 4096])
def test_vectors(spark, cell_rows):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((6, 64))
    rows, k = [], 0
    for b in base:
        for spread in (0, 0.01, 0.03, 0.035, 0.04, 0.045, 0.05, 0.3):
            rows.append((k, (b + rng.standard_normal(64) * spread * np.linalg.norm(b) / 2).astype(np.float32).tolist()))
            k += 1
    rows += [(k, rows[0][1]), (k + 1, rows[0][1]), (k + 2, None), (k + 3, []), (k + 4, [0.0] * 64), (k + 5, [float("nan")] * 64), (k + 6, [float("inf")] + [1.0] * 63), (k + 7, [None] + [1.0] * 63), (k + 8, [1.0, 2.0, 3.0]), (k + 9, [2.0, 4.0, 6.0]), (None, rows[5][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS cell", "3 AS n", "4 AS label").repartition(3)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.link_vectors(df, settings=lattice.Settings(cell_rows=cell_rows)).collect()), key=str)
    usable = [(i, np.float32(v).astype(float)) if v and None not in v and np.isfinite(np.float32(v)).all() and any(v) else (i, None) for i, v in rows]
    linked = lambda a, b: a is not None and b is not None and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95
    of = cases.components([(i, v) for i, v in usable if i is not None], linked)
    want = [(i, sum(1 for x, (_, w) in enumerate(usable) if x != y and linked(v, w)), of.get(i), i is not None and of[i] == i) for y, (i, v) in enumerate(usable)]
    assert got == sorted(want, key=str)


def test_vectors_of_nothing_and_one_id_with_different_vectors(spark):
    ddl = "vec_id long, embedding array<double>"
    assert lattice.link_vectors(spark.createDataFrame([], ddl)).count() == 0
    rng = np.random.default_rng(19)
    a, b, c = rng.standard_normal((3, 16)).tolist()
    rows = [(5, a), (5, b), (2, a), (9, b), (7, c), (None, c), (8, [2 * x for x in c])]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.link_vectors(spark.createDataFrame(rows, ddl)).collect()), key=str)
    assert got == sorted([(5, 1, 2, False), (5, 1, 2, False), (2, 1, 2, True), (9, 1, 2, False), (7, 2, 7, True), (None, 2, None, False), (8, 2, 7, False)], key=str)


def test_lattice_points():
    rng = np.random.default_rng(12)
    x = rng.standard_normal((500, 8)) * 2
    p = lattice.decode(x)
    every = p[:, None] + lattice.neighbours()[None]
    assert (((x[:, None] - every) ** 2).sum(2).min(1) >= ((x - p) ** 2).sum(1) - 1e-9).all()
    reach = 0.3
    row, cells = lattice.cells_near(x, reach)
    near = {(r, tuple(c)) for r, c in zip(row.tolist(), cells.tolist())}
    for k in range(500):
        step = rng.standard_normal(8)
        y = x[k] + step / np.linalg.norm(step) * reach * rng.random()
        assert (k, tuple(lattice.decode(y[None])[0].tolist())) in near


def test_texts_are_shuffled_once_for_pairs_over_whole_texts(spark, monkeypatch):
    """Pairs whose passages go on get the other text from its block: no table of texts is written and joined."""
    names = []
    monkeypatch.setattr(fuzzy_passages, "stored", lambda df, name: names.append(name) or df)
    rng = random.Random(32)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    long = words(500)
    rows = [(k, " ".join([*words(60), *(w if j % 15 != k else words(1)[0] for j, w in enumerate(long)), *words(60)])) for k in range(1, 4)]
    found = fuzzy(spark, rows, block_bytes=6000)
    assert names == ["passages"] and {(r[0], r[3]) for r in found} >= {(2, 1), (3, 1)} and all(r[2] - r[1] > 480 for r in found)


def test_segments_of_many_pairs_at_once():
    rng = np.random.default_rng(33)
    at, ref, n, pair = (rng.integers(0, high, 600) for high in (60, 60, 9, 40))
    seg, of = fuzzy_passages.segments(at, ref, n + 5, pair)
    for p in range(40):
        alone, _ = fuzzy_passages.segments(at[pair == p], ref[pair == p], n[pair == p] + 5)
        assert seg[of == p].tolist() == alone.tolist()


def test_hopeless_chains_have_no_passage():
    """Chains that are left out give nothing, and all others of one segment go on or have enough equal words."""
    rng = random.Random(34)
    s, around = fuzzy_passages.Settings(), fuzzy_passages.AROUND
    texts, rows = [], []
    for k in range(400):
        other = np.array([rng.randrange(10**6) for _ in range(rng.randrange(20, 140))], "<u4")
        ref = rng.randrange(len(other) - 12)
        at, share = rng.randrange(0, 90), rng.choice((0.1, 0.4, 0.55, 0.8))
        mine = np.array([rng.randrange(10**6) for _ in range(at + 12 + rng.randrange(0, 90))], "<u4")
        for j in range(len(mine)):
            if 0 <= (q := ref + j - at) < len(other) and (at <= j < at + 10 or rng.random() < share):
                mine[j] = other[q]
        base, stop = max(0, at - around), min(len(mine), at + 10 + around)
        texts.append(other)
        rows.append((k, k, k, base, -1, -1, fuzzy_passages.pack(np.array([at, at + 10, ref, ref + 10])), mine[base:stop].tobytes()))
    found = pa.table([list(c) for c in zip(*rows)], schema=fuzzy_passages.CHAIN)
    size = np.array([len(x) for x in texts])
    out = fuzzy_passages.hopeless(found, np.cumsum(size) - size, size, np.concatenate(texts), s)
    for k, gone in enumerate(out.tolist()):
        base, seg, mine = rows[k][3], fuzzy_passages.unpack(rows[k][6], 4).T, np.frombuffer(rows[k][7], "<u4")
        on = fuzzy_passages.goes_on(seg, base, mine, texts[k])
        enough = 100 * len(fuzzy_passages.equal_words(seg, base, mine, texts[k])[0]) >= s.percent * s.least_words
        assert gone == (not on and not enough) and not (gone and fuzzy_passages.aligned(seg, base, mine, texts[k], s))
    assert 50 < out.sum() < 350


def test_certain_stretches_of_a_document():
    """Against a mark for each word."""
    rng = random.Random(35)
    s = fuzzy_passages.Settings()
    for _ in range(200):
        size, chained = 400, []
        for ref in range(rng.randrange(1, 25)):
            at = sorted(rng.sample(range(size), 4))
            seg = np.array([[x, y, x, y] for x, y in (at[:2], at[2:])[: rng.randrange(1, 3)]])
            chained.append((ref, seg))
        covered, want = np.zeros(size + 1, bool), {}
        got = fuzzy_passages.needed(chained, size, s)
        for ref, c, *_ in got:
            start, end = int(c[0, 0]), int(c[-1, 1])
            if covered[start:end].all():
                before, after = np.flatnonzero(~covered[:start]), np.flatnonzero(~covered[end:])
                want[ref] = (int(before[-1]) + 1 if len(before) else 0, end + int(after[0]))
                continue
            want[ref] = (-1, -1)
            for x, y in c[:, :2].tolist():
                covered[x:y] |= y - x >= s.least_words
        assert {ref: (low, high) for ref, _, low, high in got} == want


def test_every_occurrence_of_a_frequent_seed(spark):
    """Two documents share a passage whose only seeds are in a line that many have; few=None matches each with each."""
    rng = random.Random(36)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    line, runs = words(15), [words(4) for _ in range(5)]
    passage = lambda: [*line, *(w for r in runs for w in (*words(1), *r))]
    rows = [(k, " ".join([*words(45), *(passage() if k > 30 else [*line, *words(25)]), *words(45)])) for k in range(1, 33)]
    (r,) = fuzzy(spark, rows, few=None, block_bytes=6000)
    assert (r[0], r[3]) == (32, 31) and r[1:3] == (45, 85) and r[6] == 35


@pytest.mark.parametrize("block_bytes", [6000, 1 << 20])
def test_frequent_seeds_are_matched_each_with_each(spark, block_bytes):
    """The same by the query's own settings, with the words nearby of the seeds of such a line: of a passage once, and of one that repeats itself."""
    rng = random.Random(37)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    line, runs = words(15), [words(4) for _ in range(5)]
    passage = lambda: [*line, *(w for r in runs for w in (*words(1), *r))]
    part = lambda k: passage() if k > 30 else [*line, *words(25)]
    rows = [(k, " ".join([*words(45), *(w for _ in range(k % 3 + 1) for w in (*part(k), *words(45)))])) for k in range(1, 36)]
    got = fuzzy(spark, rows, block_bytes=block_bytes)
    assert {r[0] for r in got} | {r[3] for r in got} == {31, 32, 33, 34, 35}
    assert {(r[0], r[3]) for r in got} == {(a, b) for a in range(31, 36) for b in range(31, a)}
    for k in (32, 33, 35):  # each of its passages is in one that is given
        assert {r[1] for r in got if r[0] == k} | {r[4] for r in got if r[3] == k} >= {45 + 85 * i for i in range(k % 3 + 1)}
