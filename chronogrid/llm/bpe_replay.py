"""Byte-level BPE encoding and decoding by corpus-level merge replay.

1. *Slices.* A task splits its texts into words (matches of the split pattern) and
   numbers the distinct words of each slice of some 12 million characters. Texts
   are shuffled once, as word numbers, and that exchange serves both ends; the
   words go to parts by their hash, a row for each slice and part.
2. *Replay.* A part has the words of the whole corpus that fall to it. It lays the
   bytes of the distinct ones end to end and keeps an inverted index from the rank
   of a token pair to the positions where that pair stands. Ranks are replayed in
   order with a heap: all positions of a rank are merged at once, and only the
   pairs with the two touched neighbours enter the index anew. So each distinct
   word of the corpus is replayed once, in one place.
3. *Join.* The ids return to the slices, by slice and part, and stand for the word
   numbers; decoding maps them back to bytes.

Memory is bounded by a slice and by a part, whose number follows the size of the
input. A word that a third of all slices have is one entry of each of them.

Cases: null or empty text: 0 tokens, hashes of the empty string; a null id
stays; repeated rows each get their row; an empty table gives an empty result;
other columns are not read. Rows with one id and different texts are encoded each for itself.
A text longer than a slice makes a slice of its own.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from .common import id_text, ranks_of, vocabulary_path

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class MergeTable:
    """Pairs of token ids that merge, as sorted keys: what numpy can look up for many pairs at once."""

    def __init__(self, ranks: dict[bytes, int]):
        keys = [ranks[t[:k]] << 32 | ranks[t[k:]] for t in ranks for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        to = [r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.to = np.array(keys, np.int64)[order], np.array(to, np.int64)[order]
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.bytes_of = {r: t for t, r in ranks.items()}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank that each pair merges to, or -1."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)


@functools.lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(ranks_of(path))


def replay(words: list[bytes], table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words end to end and how many each has, by replaying every merge in rank order over all words."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    # one slot more on each side, so that neighbours always exist; -1 stands between words
    raw = table.single[np.frombuffer(b"".join(words), np.uint8)]
    place = np.arange(total) + np.repeat(np.arange(len(words)), sizes) + 1
    sym = np.full(total + len(words) + 1, -1, np.int64)
    sym[place] = raw
    right = np.arange(1, len(sym) + 1)
    left = np.arange(-1, len(sym) - 1)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(pos: np.ndarray) -> None:
        """Index the pairs that start at these positions."""
        b = sym[right[pos]]
        a = sym[pos]
        ok = (a >= 0) & (b >= 0)
        if not ok.all():
            pos, a, b = pos[ok], a[ok], b[ok]
        if not len(pos):
            return
        r = table.ranks(a, b)
        ok = r >= 0
        r, pos = r[ok], pos[ok]
        if not len(r):
            return
        order = np.argsort(r, kind="stable")
        r, pos = r[order], pos[order]
        starts = np.r_[0, np.flatnonzero(r[1:] != r[:-1]) + 1, len(r)].tolist()
        for at, end, k in zip(starts, starts[1:], r[starts[:-1]].tolist()):
            if k in index:
                index[k].append(pos[at:end])
            else:
                index[k] = [pos[at:end]]
                heapq.heappush(heap, k)

    enter(place[:-1] if total > 1 else place[:0])
    while heap:
        rank = heapq.heappop(heap)
        parts = index.pop(rank)
        pos = np.concatenate(parts)
        pos.sort()
        if len(parts) > 1:
            pos = pos[np.r_[True, pos[1:] != pos[:-1]]]
        nxt = right[pos]
        a, b = sym[pos], sym[nxt]
        live = (a >= 0) & (b >= 0)
        live[live] = table.ranks(a[live], b[live]) == rank
        pos, nxt = pos[live], nxt[live]
        if len(pos) > 1 and (clash := nxt[:-1] == pos[1:]).any():  # a run such as aaa: leftmost first
            keep = np.ones(len(pos), bool)
            for i in np.flatnonzero(clash):
                keep[i + 1] = not keep[i]
            pos, nxt = pos[keep], nxt[keep]
        if not len(pos):
            continue
        after = right[nxt]
        sym[pos] = rank
        sym[nxt] = -2
        right[pos] = after
        left[np.minimum(after, len(sym) - 1)] = pos
        before = left[pos]
        keep = before >= 0
        keep[1:] &= before[1:] != pos[:-1]  # those enter as merged themselves
        enter(np.concatenate([before[keep], pos]))
    alive = sym[place] >= 0
    ids = sym[place][alive]
    return ids, np.add.reduceat(alive.astype(np.int64), ends - sizes)


WRAP = (1 << 64) - 1


def joined(parts: list[bytes]) -> bytes:
    """Byte strings as one, each compressed and with its length in front."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return b"".join(len(z).to_bytes(4, "little") + z for z in map(squeeze, parts))


def parted(raw: bytes) -> list[bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    out, at = [], 0
    while at < len(raw):
        end = at + 4 + int.from_bytes(raw[at : at + 4], "little")
        out.append(expand(raw[at + 4 : end]))
        at = end
    return out


def planes(x: np.ndarray) -> list[bytes]:
    """The bytes of 32-bit numbers, lowest first, each kept apart, as that compresses well."""
    return [np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, k]).tobytes() for k in range(4)]


def from_planes(parts: list[bytes]) -> np.ndarray:
    return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in parts]).T).view("<u4").ravel().astype(np.int64)


def stamp(*data: bytes) -> int:
    """Hash of a slice's words for one part with their numbers."""
    out = hashlib.blake2b(digest_size=8)
    for x in data:
        out.update(len(x).to_bytes(8, "little"))
        out.update(x)
    return int.from_bytes(out.digest(), "little")


def number_slice(slice_id: int, ids: list[int | None], texts: list[str], split: Callable[[str], list[str]], parts: int) -> pa.RecordBatch:
    """A slice as one row: its texts as word numbers, and its distinct words by part.

    Frequent words get small numbers, equally frequent ones in the order of their bytes, so a
    word's number is the same in whatever order the rows of a slice are read. The sum of
    the stamps of all parts tells the numbering of a slice that holds other rows from this one.
    """
    numbers: dict[str, int] = {}
    of_text = [np.array([numbers.setdefault(w, len(numbers)) for w in split(t)], np.uint32) for t in texts]
    flat = np.concatenate(of_text)
    words = [w.encode() for w in numbers]
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    order = order[np.argsort(-np.bincount(flat, minlength=len(numbers))[order], kind="stable")]
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    words = [words[k] for k in order.tolist()]
    part = np.array([zlib.crc32(w) for w in words], np.int64) % parts
    lists, check = [], 0
    for p in np.unique(part).tolist():
        mine = np.flatnonzero(part == p)
        own = [words[k] for k in mine.tolist()]
        data = [b"".join(planes(np.diff(mine, prepend=0))), b"".join(planes(np.array([len(w) for w in own]))), b"".join(own)]
        check += stamp(*data)
        lists += [p.to_bytes(8, "little"), *data]
    known = np.array([i is not None for i in ids])
    text = joined([np.array([i or 0 for i in ids], "<i8").tobytes(), known.tobytes(), *planes(np.array([len(x) for x in of_text])), (check & WRAP).to_bytes(8, "little"), *planes(rank[flat])])
    return pa.RecordBatch.from_arrays([pa.array([slice_id], pa.int64()), pa.array([text], pa.binary()), pa.array([joined(lists)], pa.binary())], names=["slice", "text", "words"])


def by_part(pieces: pa.Table) -> pa.Table:
    """The words of slices, a row for each part."""
    rows = [(i, int.from_bytes(p, "little"), joined(data)) for i, raw in zip(pieces["slice"].to_pylist(), pieces["words"].to_pylist()) for p, *data in itertools.batched(parted(raw), 4)]
    return pa.table({"slice": pa.array([r[0] for r in rows], pa.int64()), "part": pa.array([r[1] for r in rows], pa.int64()), "data": pa.array([r[2] for r in rows], pa.binary())})


def four(raw: bytes) -> np.ndarray:
    n = len(raw) // 4
    return from_planes([raw[k * n : (k + 1) * n] for k in range(4)])


def learn(pieces: pa.Table, table: MergeTable) -> pa.Table:
    """The ids of all words of one part: each distinct word of the corpus is replayed here, once."""
    numbers: dict[bytes, int] = {}
    lists = []
    for raw in pieces["data"].to_pylist():
        steps, sizes, text = parted(raw)
        bounds = [0, *np.cumsum(four(sizes)).tolist()]
        words = [text[a:b] for a, b in itertools.pairwise(bounds)]
        lists.append((steps, stamp(steps, sizes, text), np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)))
    ids, counts = replay(list(numbers), table)
    starts = np.cumsum(counts) - counts
    out = []
    for steps, check, mine in lists:
        n = counts[mine]
        at = np.repeat(starts[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out.append(joined([steps, check.to_bytes(8, "little"), b"".join(planes(n)), b"".join(planes(ids[at]))]))
    return pa.table({"slice": pieces["slice"], "data": pa.array(out, pa.binary()), "distinct": pa.array([len(numbers)] + [0] * (len(out) - 1), pa.int64())})


@dataclass
class Slice:
    """A slice's texts as word numbers, and the ids of each word."""

    doc_ids: list[int | None]
    texts: list[np.ndarray]
    starts: np.ndarray
    counts: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, piece: pa.Table, learned: pa.Table) -> Slice:
        ids, known, *rest = parted(piece["text"][0].as_py())
        sizes, numbers = from_planes(rest[:4]), from_planes(rest[5:])
        lists = []
        check = 0
        for raw in learned["data"].to_pylist():
            steps, own, n, part = parted(raw)
            check += int.from_bytes(own, "little")
            lists.append((np.cumsum(four(steps)), four(n), four(part)))
        if check & WRAP != int.from_bytes(rest[4], "little"):
            raise RuntimeError("the words of a slice are not those of its texts: other rows came into the slice when a task ran again")
        starts, counts = (np.zeros(sum(len(r) for r, _, _ in lists), np.int64) for _ in range(2))
        at = 0
        for ranks, n, part in lists:
            counts[ranks] = n
            starts[ranks] = at + np.cumsum(n) - n
            at += len(part)
        doc_ids = [i if ok else None for i, ok in zip(np.frombuffer(ids, "<i8").tolist(), np.frombuffer(known, bool).tolist())]
        return cls(doc_ids, np.split(numbers, np.cumsum(sizes)[:-1]), starts, counts, np.concatenate([p for _, _, p in lists]) if lists else np.zeros(0, np.int64))

    def of_words(self, one: Callable[[int], object], join: Callable[[list], object]) -> list:
        """For each word number, what its ids give, joined."""
        every = [one(k) for k in self.ids.tolist()]
        return [join(every[a : a + n]) for a, n in zip(self.starts.tolist(), self.counts.tolist())]


def digests(piece: pa.Table, learned: pa.Table, table: MergeTable) -> pa.Table:
    """n_tokens and the hashes of the ids and of the bytes they decode to."""
    x = Slice.of(piece, learned)
    names, decoded = x.of_words(str, ",".join), x.of_words(table.bytes_of.__getitem__, b"".join)
    rows = []
    for i, numbers in zip(x.doc_ids, x.texts):
        every = numbers.tolist()
        rows.append((i, int(x.counts[numbers].sum()), hashlib.sha256(",".join([names[k] for k in every]).encode()).hexdigest(), hashlib.sha256(b"".join([decoded[k] for k in every])).hexdigest()))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), zip(*rows), kinds)})


def id_arrays(piece: pa.Table, learned: pa.Table, table: MergeTable) -> pa.Table:
    """The ids themselves."""
    x = Slice.of(piece, learned)
    of_word = x.of_words(int, list)
    return pa.table({"doc_id": pa.array(x.doc_ids, pa.int64()), "ids": pa.array([[i for k in t.tolist() for i in of_word[k]] for t in x.texts], pa.list_(pa.int32()))})


def slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[int | None, str]]]:
    """Rows in groups of about so many characters."""
    out, n = [], 0
    for batch in batches:
        for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            out.append(x)
            n += len(x[1])
            if n >= most:
                yield out
                out, n = [], 0
    if out:
        yield out


def word_ids(docs: DataFrame, path: str, slice_chars: int, part_bytes: int) -> tuple[GroupedData, DataFrame]:
    """(slices: texts as word numbers and distinct words, by slice; the ids of each slice's words by part, with the count of distinct words replayed)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / part_bytes))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import regex

        split = regex.compile(public_tokenizers.PATTERN).findall
        for k, rows in enumerate(slices(batches, slice_chars)):
            yield number_slice(TaskContext.get().partitionId() << 32 | k, [i for i, _ in rows], [t for _, t in rows], split, parts)

    by_slice = docs.mapInArrow(number, "slice long, text binary, words binary").groupBy("slice")
    words = by_slice.applyInArrow(by_part, "slice long, part long, data binary")
    return by_slice, words.groupBy("part").applyInArrow(lambda t: learn(t, merge_table(path)), "slice long, data binary, distinct long")


def _encoded(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None, slice_chars: int, part_bytes: int, finish: Callable, schema: str) -> DataFrame:
    path = vocabulary or vocabulary_path("byte_bpe_multi_50k.tiktoken")
    by_slice, learned = word_ids(id_text(df, id_col, text_col), path, slice_chars, part_bytes)
    return by_slice.cogroup(learned.groupBy("slice")).applyInArrow(lambda t, w: finish(t, w, merge_table(path)), schema)


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, slice_chars: int = 12_000_000, part_bytes: int = 32 << 20) -> DataFrame:
    """Encode every text and decode its ids; one row per input row."""
    return _encoded(df, id_col, text_col, vocabulary, slice_chars, part_bytes, digests, SCHEMA)


def encode_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, slice_chars: int = 12_000_000, part_bytes: int = 32 << 20) -> DataFrame:
    """The ids themselves: doc_id, ids array<int>."""
    return _encoded(df, id_col, text_col, vocabulary, slice_chars, part_bytes, id_arrays, "doc_id long, ids array<int>")


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Ids back to bytes: doc_id, data binary; null ids give null."""
    path = vocabulary or vocabulary_path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = merge_table(path).bytes_of
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else b"".join([of[i] for i in x]) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "data"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, data binary")
