"""The Merkle manifest against a plain recursive tree."""

import hashlib
import zlib

import cases
from chronogrid.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fold(nodes, path):
    """Root of a list of digests; path[i] collects the siblings of leaf i as (before, after)."""
    held = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, kept = [], []
        for k in range(0, len(nodes), 3):
            run = nodes[k : k + 3]
            for j in range(len(run)):
                for i in held[k + j]:
                    path[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(h(*run))
            kept.append([i for g in held[k : k + 3] for i in g])
        nodes, held = up, kept
    return nodes[0]


def brute(rows):
    """rows of (doc_id, source, lang, n_chars, text) -> (doc_id, leaf, subroot, root, proof, folded, verified)."""

    def leaf(*values):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = {}
    for i, source, lang, n, text in rows:
        odd = i is None or zlib.crc32(str(i).encode()) % 2
        other = text if odd or text is None else text.replace("\n", "")
        groups.setdefault((source is not None, (source or "").encode()), []).append((i is not None, i or 0, leaf(i, source, lang, n, text), leaf(i, source, lang, n, other), i))
    order = sorted(groups)
    found = []
    for g in order:
        members = sorted(groups[g])
        paths = [[] for _ in members]
        found.append((fold([m[2] for m in members], paths), members, paths))
    tops = [[] for _ in order]
    root = fold([f[0] for f in found], tops) if found else None
    out = []
    for (subroot, members, paths), top in zip(found, tops):
        for (_, _, digest, got, i), path in zip(members, paths):
            for a, b in path + top:
                got = h(a, got, b)
            out.append((i, digest, subroot, root, h(*(a + b for a, b in path + top)), got, got == root))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, pos string, n int").repartition(3)


def check(spark, rows):
    got = sorted((tuple(r) for r in merkle.manifest(table(spark, rows)).collect()), key=repr)
    assert got == brute(rows)


def test_one_hot_source_and_all_group_sizes(spark):
    sizes = {"a": 41, "b": 1, "é": 2, None: 3, "": 4, "Z": 9, "hot": 250}
    rows = [(7 * k + 3, s, "en", k, f"line {k}\n\nend{s}\n") for s, n in sizes.items() for k in range(n)]
    check(spark, rows)


def test_awkward_rows(spark):
    rows = [(i, ("s", None, "t")[k % 3], None, None if t is None else len(t), t) for k, (i, t) in enumerate(cases.ROWS)]
    check(spark, rows + rows[:7] + [(5, "s", "en", 1, "\n"), (5, "s", "de", 1, "\n")])


def test_one_row_and_none(spark):
    check(spark, [(2, None, None, None, None)])
    assert merkle.manifest(table(spark, [])).count() == 0


def test_many_runs_give_the_same_tree(spark):
    rows = [(k, "s", None, None, f"{k}\n") for k in range(120)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
