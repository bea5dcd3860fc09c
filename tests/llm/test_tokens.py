"""Token counts, BPE replay, packing: against the libraries, brute force and exact round trips."""

import base64
import hashlib
import random
import zlib

import cases
import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from chronogrid.llm import bpe_replay, packing, token_counts
from chronogrid.llm.common import vocabulary_path


def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_counts_equal_the_library(spark):
    t = library()
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(cases.documents(spark), chunk_chars=2000, overlap_chars=32).collect()), key=str)
    n = [len(t.encode(x or "", add_special_tokens=False).ids) for _, x in cases.ROWS]
    assert got == sorted(((i, len((x or "").encode()), k, k > 1024) for (i, x), k in zip(cases.ROWS, n)), key=str)
    assert token_counts.count_tokens(cases.documents(spark, [])).count() == 0


def test_splices_and_widening():
    t = library()
    rng = random.Random(3)
    for chunk, overlap in ((40, 4), (200, 16)):
        e = token_counts.ChunkedEncoder(vocabulary_path("byte_bpe_50k.tiktoken"), chunk, overlap)
        widened = 0
        for _ in range(60):
            x = "".join(rng.choice(["the ", "  ", "\n", "ab", "é", "12", "'s", "<|endoftext|>", "日本", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz"]) for _ in range(rng.randint(0, 200)))
            pieces = list(e.spliced(x))
            widened += sum(w for _, w in pieces)
            assert np.concatenate([p for p, _ in pieces]).tolist() == t.encode(x, add_special_tokens=False).ids
        assert widened


def multi():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_equals_tiktoken(spark):
    enc = multi()
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_replay.encode_decode(cases.documents(spark), slice_chars=1000, part_bytes=20000).collect()), key=str)
    want = []
    for i, x in cases.ROWS:
        ids = enc.encode_ordinary(x or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe_replay.encode_decode(cases.documents(spark, [])).count() == 0


def test_ids_and_bytes_round_trip(spark):
    ids = bpe_replay.encode_ids(cases.documents(spark))
    back = bpe_replay.decode_ids(ids)
    assert sorted((r.doc_id, bytes(r.data)) for r in back.collect() if r.doc_id) == sorted((i, (x or "").encode()) for i, x in cases.ROWS if i)


def test_replay_of_random_words():
    enc, rng, table = multi(), random.Random(4), bpe_replay.merge_table(vocabulary_path("byte_bpe_multi_50k.tiktoken"))
    for _ in range(20):
        words = ["".join(rng.choice("aaabbcé1ß") for _ in range(rng.randint(1, 60))) for _ in range(10)]
        ids, counts = bpe_replay.replay([w.encode() for w in words], table)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == [enc._encode_single_piece(w) for w in words]


def test_each_distinct_word_is_replayed_once(spark):
    import regex

    split = regex.compile(P.PATTERN).findall
    docs = cases.documents(spark, [r for r in cases.ROWS if r[0] != 9]).selectExpr("doc_id", "coalesce(text, '') AS text")
    for slice_chars, part_bytes in ((200, 500), (12_000_000, 1 << 20)):
        _, learned = bpe_replay.word_ids(docs, vocabulary_path("byte_bpe_multi_50k.tiktoken"), slice_chars, part_bytes)
        assert learned.agg({"distinct": "sum"}).first()[0] == len({w for i, t in cases.ROWS if i != 9 for w in split(t or "")})


def test_a_slice_numbered_again_in_another_order():
    import pyarrow as pa
    import regex

    split, table, enc = regex.compile(P.PATTERN).findall, bpe_replay.merge_table(vocabulary_path("byte_bpe_multi_50k.tiktoken")), multi()
    rows = [(1, "one two, two three"), (2, "zwei \u00fc drei one"), (3, ""), (None, "three one\n\nfour")]

    def numbered(rows):
        return pa.Table.from_batches([bpe_replay.number_slice(7, [i for i, _ in rows], [t for _, t in rows], split, 3)])

    def ids(piece, words):
        parts = bpe_replay.by_part(words)
        learned = pa.concat_tables([bpe_replay.learn(parts.filter(pa.compute.equal(parts["part"], p)), table) for p in set(parts["part"].to_pylist())])
        return bpe_replay.id_arrays(piece, learned, table)["ids"].to_pylist()

    assert ids(numbered(rows), numbered(rows[::-1])) == [enc.encode_ordinary(t) for _, t in rows]
    for others in (rows[1:], [*rows, (5, "more")], [(i, t + " one") for i, t in rows]):
        with pytest.raises(RuntimeError, match="other rows"):
            ids(numbered(rows), numbered(others))


def test_packing(spark):
    t = library()
    rows = [r for r in cases.ROWS if r[0] != 9] + [cases.ROWS[8]]
    got = packing.pack(cases.documents(spark, rows)).collect()
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in rows if i is not None}
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, want in ids.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            piece = want[at : at + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(np.array(piece, "<u4").tobytes()))
            at += r.length
        assert at == len(want)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert sorted(r.doc_tokens for r in by_doc[None] if r.start == 0) == sorted(len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in rows if i is None)
    assert packing.pack(cases.documents(spark, [])).count() == 0


def test_groups_of_a_length_do_not_grow(spark):
    full = spark.range(3000).selectExpr("1L AS doc_id", "0L AS start", "1024L AS length", "7L AS ids_crc32", "1L AS doc_tokens", "id AS at")
    some = spark.range(500).selectExpr("id AS doc_id", "0L AS start", "id % 5 + 300 AS length", "7L AS ids_crc32", "1L AS doc_tokens", "id + 5000 AS at")
    got = packing.place(full.unionAll(some).checkpoint() if spark.sparkContext.getCheckpointDir() else full.unionAll(some), group_rows=100).collect()
    assert len(got) == 3500
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 1024 and [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] for x in held.values())
    assert len(held) == 3000 + 167


def test_patterns_place_every_copy_with_little_padding():
    rng = random.Random(5)
    for n in (0, 1, 50, 5000):
        h = {}
        for _ in range(n):
            k = min(1024, 1 + int(rng.expovariate(1 / 300)))
            h[k] = h.get(k, 0) + 1
        found = packing.patterns(h)
        seen = {}
        for lengths, count in found:
            assert sum(lengths) <= 1024
            for k in lengths:
                seen[k] = seen.get(k, 0) + count
        assert seen == h
        if n == 5000:
            assert sum(k * c for k, c in h.items()) / 1024 / sum(c for _, c in found) > 0.99
