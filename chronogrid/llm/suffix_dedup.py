"""Suffix-array substring deduplication by a common-prefix-aware distributed merge sort.

A byte goes if a 50-byte string that covers it also starts in a document with a
smaller id. Documents are dealt into blocks of a few megabytes; texts are
shuffled once and that exchange serves all passes.

1. *Anchors.* In every 50-byte window the 24-byte string with the smallest hash,
   the leftmost of equal ones, is its anchor, so equal windows have equal anchors
   at the same offset and about one position in fourteen is an anchor. Each block
   sends the sorted hashes of its anchors, and hears which occur in other blocks.
   Only suffixes that start at repeated anchors go on, which loses nothing.
2. *Runs.* A block sorts those suffixes, cut to what its windows need, and sends
   them front-coded: the common prefix with the one before, and the rest. The
   exchange is by key range: splitters of the sorted order come from a random
   sample of documents (``samples`` anchors for each; they decide only how evenly ranges
   are filled), and a block cuts its sorted run at them. Splitters are compared with
   the 24 bytes of an anchor, so equal anchors meet in one range and no class of
   equal windows crosses a border. Equal stretches of a block are sent once, for
   their smallest document; the others are settled in the block, so a passage that
   fills a third of all documents gives one entry per block. An anchor that alone
   would fill ranges (a line in many documents, each time between other words) is
   taken apart: each of its windows is an entry of its own, whose suffix starts with
   the window, dealt over all ranges by its 50 bytes. Ranges follow the input: beyond
   ``MOST_SPLITTERS``, which the driver can hold, each is cut again by a hash of the anchor.
3. *Merge.* A range merges its runs with a loser tree whose nodes keep common
   prefix lengths: unequal lengths decide without reading a byte, equal ones are
   compared only beyond them. The prefix lengths of the merged order give the
   classes of equal right parts for each offset; with a hash of the left part they
   are the classes of equal windows, and each window's smallest document is known.
4. Windows to remove return to their blocks, where the kept bytes are put together.

Cases: null or empty texts, and texts under 50 bytes, lose nothing; rows with
the same id count as one document; a row without an id counts after all others;
repeated rows each get their row; an empty table gives an empty result; other
columns are not read. A block is held in memory, and so any one document must fit
there; a document longer than ``block_bytes`` has a block nearly to itself. Rows
are dealt by id and text, so that the rows of one id, or of none, are not one block.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from .minhash import mix

WINDOW, KMER = 50, 24
SPREAD = WINDOW - KMER + 1  # anchors a window can have
LOW32, LOW48 = np.uint64(0xFFFFFFFF), np.uint64((1 << 48) - 1)
NO_ID = np.iinfo(np.int64).max
_rng = np.random.default_rng(7)
BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
ODD = _rng.integers(0, 1 << 64, 8, np.uint64) | np.uint64(1)


@dataclass
class Block:
    """Documents of a block in order of id, end to end."""

    ids: np.ndarray  # with NO_ID for null
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, docs: pa.Table) -> Block:
        ids = np.array([NO_ID if i is None else i for i in docs["doc_id"].to_pylist()], np.int64)
        texts = docs["text"].to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
        sizes = np.array([len(texts[k]) for k in order], np.int64)
        ends = np.cumsum(sizes)
        return cls(ids[order], ends - sizes, ends, np.frombuffer(b"".join([texts[k] for k in order]), np.uint8))


@dataclass
class Anchors:
    at: np.ndarray  # position in the block
    low: np.ndarray  # offsets low..high are those of the windows it stands for
    high: np.ndarray
    key: np.ndarray  # 64-bit hash of its 24 bytes
    doc: np.ndarray  # index of the document
    short: list[np.ndarray]  # hashes of 2 and 16 bytes at every position


def anchors(b: Block) -> Anchors | None:
    """The anchors of all windows of a block."""
    n = len(b.data)
    if n < WINDOW:
        return None
    joined = lambda x, y, shift, odd: x[: len(x) - shift] * odd + y[shift : shift + len(x) - shift]
    h1 = BYTE[b.data]
    h2 = joined(h1, h1, 1, ODD[0])
    h4 = joined(h2, h2, 2, ODD[1])
    h8 = joined(h4, h4, 4, ODD[2])
    h16 = joined(h8, h8, 8, ODD[3])
    del h1, h4
    k24 = h16[: n - KMER + 1] * ODD[4]
    k24 += h8[16 : 16 + len(k24)]
    del h8
    k24 ^= k24 >> np.uint64(29)
    k24 *= ODD[5]
    v = k24 & ~LOW32
    v |= np.arange(len(v), dtype=np.uint64)
    width = 1
    while width * 2 <= SPREAD:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    if width < SPREAD:
        v = np.minimum(v[: len(v) - (SPREAD - width)], v[SPREAD - width :])
    at = (v & LOW32).astype(np.int64)
    inside = np.zeros(len(at) + 2, bool)  # with a false one on each side
    sizes = b.ends - b.starts
    inside[1:-1] = np.arange(len(at)) + WINDOW <= np.repeat(b.ends, sizes)[: len(at)]
    change = np.ones(len(at) + 1, bool)
    change[1:-1] = at[1:] != at[:-1]
    first = np.flatnonzero(inside[1:-1] & (change[:-1] | ~inside[:-2]))
    last = np.flatnonzero(inside[1:-1] & (change[1:] | ~inside[2:]))
    a = at[first]
    return Anchors(a, a - last, a - first, mix(k24[a]), np.searchsorted(b.ends, first, side="right"), [h2, h16])


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """Which of so many parts a key belongs to; it does not fall as keys grow."""
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def split_sorted(keys: np.ndarray, parts: int) -> dict[int, np.ndarray]:
    p = part_of(keys, parts)
    cut = np.flatnonzero(np.diff(p)) + 1
    return {int(p[x[0]]): keys[x[0] : x[0] + len(x)] for x in np.split(np.arange(len(keys)), cut) if len(x)}


def six_bytes(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray((keys & LOW48).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def merge_runs(runs: list[list[bytes]], prefixes: list[list[int]], full: int = WINDOW) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs with a loser tree; prefixes[r][i] is the common prefix of items i - 1 and i of run r.

    Returns the run and the common prefix with the item before, of each item of
    the merged order. A node keeps its loser and the loser's common prefix with
    the winner that passed it; known prefixes are never compared again.
    """
    count = len(runs)
    size = 1
    while size < count:
        size *= 2
    heads = [r[0] if r else None for r in runs] + [None] * (size - count)
    at = [0] * count
    loser, common = [0] * size, [0] * size

    def start(node: int) -> int:
        """Winner below a node, by full comparison as nothing is known yet."""
        if node >= size:
            return node - size
        x, y = start(2 * node), start(2 * node + 1)
        a, b = heads[x], heads[y]
        if a is None or (b is not None and b < a):
            x, y, a, b = y, x, b, a
        loser[node] = y
        k = -1 if b is None else 0  # an ended run shares less than any other
        while b is not None and k < full and a[k] == b[k]:
            k += 1
        common[node] = k
        return x

    winner = start(1)
    h = 0
    out_run, out_prefix, out_at = [], [], []
    while heads[winner] is not None:
        i = at[winner]
        out_run.append(winner)
        out_prefix.append(h)
        out_at.append(i)
        run = runs[winner]
        at[winner] = i = i + 1
        if i < len(run):
            s = heads[winner] = run[i]
            h = prefixes[winner][i]
            if h == full:
                continue
        else:
            s, h = None, -1
            heads[winner] = None
        node = (winner + size) >> 1
        while node:
            g = common[node]
            if g < h:
                pass  # the contender shares more with what has just gone out: it wins
            elif g > h:
                winner, loser[node] = loser[node], winner
                common[node], h = h, g
                s = heads[winner]
            elif h >= 0:
                t = heads[loser[node]]
                if t is not None:
                    k = h
                    while k < full and s[k] == t[k]:
                        k += 1
                    if k < full and t[k] < s[k]:
                        winner, loser[node] = loser[node], winner
                        s = t
                    common[node] = k
            node >>= 1
    return out_run, out_prefix, out_at


def dup_flags(runs: pa.Table) -> pa.Table | None:
    """Which hashes of each block's list occur in another block's."""
    lists = [from_six_bytes(x) for x in runs["keys"].to_pylist()]
    every = np.sort(np.concatenate(lists))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    if not len(twice):
        return None
    rows = []
    for block, keys in zip(runs["block"].to_pylist(), lists):
        found = twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys
        if found.any():
            rows.append((block, np.packbits(found).tobytes()))
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "part": pa.array([runs["part"][0].as_py()] * len(rows), pa.int32()), "bits": pa.array([r[1] for r in rows], pa.binary())})


#: Bytes of text that are sampled for splitters at least.
LEAST_SAMPLE = 8 << 20
#: Splitters that a driver and every task can hold, at 24 bytes.
MOST_SPLITTERS = 1 << 16


@dataclass(frozen=True)
class Ranges:
    """How suffixes are dealt into ranges: splitters of the sorted order, times a hash of the anchor, and anchors too frequent for a range."""

    splitters: np.ndarray
    each: int
    frequent: np.ndarray

    @property
    def n(self) -> int:
        return (len(self.splitters) + 1) * self.each

    def of_anchors(self, anchor: np.ndarray) -> np.ndarray:
        """Range of each 24-byte string, given as rows of bytes."""
        which = np.searchsorted(self.splitters, as_strings(anchor), side="right")
        return which * self.each + (hashed(anchor) % np.uint64(self.each)).astype(np.int64) if self.each > 1 else which

    def of_windows(self, window: np.ndarray) -> np.ndarray:
        return (hashed(window) % np.uint64(self.n)).astype(np.int64)


def as_strings(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def hashed(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes."""
    h = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        h = mix(h * ODD[3] + BYTE[rows[:, c]])
    return h >> np.uint64(8)


RUN = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("prefix", pa.binary()), ("rest", pa.binary()), ("left", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("at", pa.binary()), ("doc", pa.binary()), ("settled", pa.binary())])
RUN_DDL = "range int, block long, prefix binary, rest binary, left binary, low binary, high binary, at binary, doc binary, settled binary"


def bits_between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Masks with the bits low..high."""
    one = np.uint32(1)
    return ((one << (high - low + 1).astype(np.uint32)) - one) << low.astype(np.uint32)


def make_runs(docs: pa.Table, flags: pa.Table, parts: int, ranges: Ranges) -> pa.Table:
    """Front-coded sorted runs of a block's repeated suffixes, one row for each range."""
    block = docs["block"][0].as_py()
    b = Block.of(docs)
    x = anchors(b)
    if x is None or not len(x.at):
        return RUN.empty_table()
    keys, inverse, counts = np.unique(x.key, return_inverse=True, return_counts=True)
    again = counts > 1
    lists = split_sorted(keys, parts)
    firsts = {p: int(np.searchsorted(keys, k[0])) for p, k in lists.items()}
    for p, bits in zip(flags["part"].to_pylist(), flags["bits"].to_pylist()):
        n = len(lists[p])
        again[firsts[p] : firsts[p] + n] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    pick = np.flatnonzero(again[inverse])
    if not len(pick):
        return RUN.empty_table()
    at, low, high, key, doc = (v[pick] for v in (x.at, x.low, x.high, x.key, x.doc))
    h2, h16 = x.short
    window = lambda p: ((h16[p] * ODD[6] + h16[p + 16]) * ODD[6] + h16[p + 32]) * ODD[7] + h2[p + 48]
    content = mix(mix(window(at - high)) * ODD[0] + mix(window(at - low)) + (high * 64 + low).astype(np.uint64))
    del x, h2, h16
    ids = b.ids[doc]
    order = np.lexsort((ids, content))
    same = np.zeros(len(order), bool)
    same[1:] = content[order][1:] == content[order][:-1]
    heads = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    later = ids[order] > ids[order[heads]]
    settled = order[later]
    rows = {c: [] for c in RUN.names}

    def add(**row) -> None:
        for c in RUN.names:
            rows[c].append(row.get(c))

    def add_settled(at: np.ndarray, mask: np.ndarray) -> None:
        if len(at):
            add(range=int(block % ranges.n), block=block, settled=np.stack([at.astype("<u4"), mask.astype("<u4")]).tobytes())

    settled = np.sort(settled)
    add_settled(at[settled], bits_between(low[settled], high[settled]))
    keep = np.sort(order[~later])
    at, low, high, ids = (v[keep] for v in (at, low, high, ids))
    data = np.append(b.data, np.zeros(WINDOW, np.uint8))
    columns = np.arange(WINDOW)
    back = np.arange(1, SPREAD)
    squeeze = zstandard.ZstdCompressor(level=1).compress

    def send(at: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, right: np.ndarray, which: np.ndarray) -> None:
        """Entries by range, each in sorted order and front-coded."""
        order = np.argsort(as_strings(right), kind="stable")
        order = order[np.argsort(which[order], kind="stable")]
        at, low, high, ids, right, which = (v[order] for v in (at, low, high, ids, right, which))
        differ = right[1:] != right[:-1]
        prefix = np.zeros(len(at), np.uint8)
        prefix[1:] = np.where(differ.any(1), differ.argmax(1), WINDOW)
        starts = np.r_[0, np.flatnonzero(np.diff(which)) + 1]
        prefix[starts] = 0
        kept = columns >= prefix[:, None]
        left = data[np.maximum(at[:, None] - back, 0)]
        left_kept = back <= high[:, None]
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(at)]):
            add(range=int(which[s]), block=block, prefix=prefix[s:e].tobytes(), rest=squeeze(right[s:e][kept[s:e]].tobytes()), left=squeeze(left[s:e][left_kept[s:e]].tobytes()), low=low[s:e].astype(np.uint8).tobytes(), high=high[s:e].astype(np.uint8).tobytes(), at=at[s:e].astype("<u4").tobytes(), doc=squeeze(ids[s:e].astype("<i8").tobytes()))

    right = data[at[:, None] + columns]
    frequent = np.isin(as_strings(right[:, :KMER]), ranges.frequent) if len(ranges.frequent) else np.zeros(len(at), bool)
    if frequent.any():
        n = (high - low + 1)[frequent].astype(np.int64)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[frequent].astype(np.int64), n)
        own_at, own_ids = np.repeat(at[frequent], n) - offset, np.repeat(ids[frequent], n)
        windows = data[own_at[:, None] + columns]
        _, same = np.unique(as_strings(windows), return_inverse=True)
        least = np.full(same.max() + 1, NO_ID)
        np.minimum.at(least, same, own_ids)
        later = own_ids > least[same]
        add_settled(own_at[later], np.ones(int(later.sum())))
        own_at, own_ids, windows = own_at[~later], own_ids[~later], windows[~later]
        none = np.zeros(len(own_at), low.dtype)
        send(own_at, none, none, own_ids, windows, ranges.of_windows(windows))
    at, low, high, ids, right = (v[~frequent] for v in (at, low, high, ids, right))
    if len(at):
        which = ranges.of_anchors(right[:, :KMER])
        right[columns >= (WINDOW - low)[:, None]] = 0
        send(at, low, high, ids, right, which)
    return pa.table(rows, schema=RUN)


def settle(runs: pa.Table) -> pa.Table:
    """Merge a range's runs; anchors whose windows also start in a smaller document, with a mask of offsets."""
    blocks, out = [], []
    strings, prefixes, of_block, low, high, at, doc, left = [], [], [], [], [], [], [], []
    expand = zstandard.ZstdDecompressor().decompress
    for r in runs.select(RUN.names[1:]).to_pylist():
        if r["settled"]:
            blocks.append(r["block"])
            out.append(r["settled"])
            continue
        p = list(r["prefix"])
        rest, k, s, run = expand(r["rest"]), 0, b"", []
        for n in p:
            s = s[:n] + rest[k : k + WINDOW - n]
            k += WINDOW - n
            run.append(s)
        strings.append(run)
        prefixes.append(p)
        of_block.append(r["block"])
        low.append(np.frombuffer(r["low"], np.uint8))
        high.append(np.frombuffer(r["high"], np.uint8))
        at.append(np.frombuffer(r["at"], "<u4"))
        doc.append(np.frombuffer(expand(r["doc"]), "<i8"))
        m = np.zeros((len(p), SPREAD - 1), np.uint8)
        m[np.arange(1, SPREAD) <= high[-1][:, None]] = np.frombuffer(expand(r["left"]), np.uint8)
        left.append(m)
    if strings:
        sizes = np.array([len(s) for s in strings])
        base = np.cumsum(sizes) - sizes
        run, prefix, index = merge_runs(strings, prefixes)
        order = base[np.array(run)] + np.array(index)
        prefix = np.array(prefix)
        lo, hi, ids, lefts = (np.concatenate(v)[order] for v in (low, high, doc, left))
        mask = np.zeros(len(order), np.uint32)
        side = np.zeros(len(order), np.uint64)
        for o in range(SPREAD):
            if o:
                side = mix(side * ODD[1] + BYTE[lefts[:, o - 1]])
            ok = np.flatnonzero((lo <= o) & (o <= hi))
            if len(ok) < 2:
                continue
            right_class = np.cumsum(prefix < WINDOW - o)
            k = mix(right_class[ok].astype(np.uint64) * ODD[2] + side[ok])
            by = np.argsort(k, kind="stable")
            first = np.r_[True, k[by][1:] != k[by][:-1]]
            least = np.minimum.reduceat(ids[ok][by], np.flatnonzero(first))[np.cumsum(first) - 1]
            hit = ok[by[ids[ok][by] > least]]
            mask[hit] |= np.uint32(1 << o)
        hits = np.flatnonzero(mask)
        where, positions = np.repeat(np.arange(len(strings)), sizes)[order][hits], np.concatenate(at)[order][hits]
        for w in np.unique(where):
            mine = where == w
            blocks.append(of_block[w])
            out.append(np.stack([positions[mine].astype("<u4"), mask[hits[mine]].astype("<u4")]).tobytes())
    return pa.table({"block": pa.array(blocks, pa.int64()), "windows": pa.array(out, pa.binary())})


def cut_out(docs: pa.Table, found: pa.Table, with_text: bool) -> pa.Table:
    """What stays of each document of a block."""
    b = Block.of(docs)
    n = len(b.data)
    edge = np.zeros(n + WINDOW + 1, np.int32)
    for raw in found["windows"].to_pylist():
        at, mask = np.frombuffer(raw, "<u4").reshape(2, -1)
        for o in range(SPREAD):
            p = at[(mask >> np.uint32(o)) & np.uint32(1) == 1].astype(np.int64) - o
            np.add.at(edge, p, 1)
            np.add.at(edge, p + WINDOW, -1)
    gone = np.cumsum(edge)[:n] > 0
    rows = []
    for i, s, e in zip(b.ids.tolist(), b.starts.tolist(), b.ends.tolist()):
        g = gone[s:e]
        stays = b.data[s:e][~g].tobytes()
        spans = int(g[:1].sum()) + int(np.count_nonzero(g[1:] & ~g[:-1])) if e > s else 0
        text = (hashlib.sha256(b.data[s:e]).hexdigest(), stays.decode("utf-8", "ignore")) if with_text else (None, None)
        rows.append((None if i == NO_ID else i, e - s, e - s - len(stays), spans, hashlib.sha256(stays).hexdigest(), *text))
    return pa.table({n: pa.array(c, k) for (n, k), c in zip(OUT.items(), zip(*rows))})


OUT = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "text_sha256": pa.string(), "kept": pa.string()}
OUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text_sha256 string, kept string"


def range_splitters(docs: DataFrame, total: int, ranges: int, samples: int) -> Ranges:
    """About so many ranges of the sorted order of all suffixes, from anchors of a random sample of documents.

    A value that more than one splitter has is a frequent anchor.
    """
    none = np.zeros(0, f"S{KMER}")
    wanted = min(ranges, MOST_SPLITTERS)
    if wanted < 2:
        return Ranges(none, 1, none)

    def run(batches):
        for batch in batches:
            b = Block.of(pa.Table.from_batches([batch])) if batch.num_rows else None
            x = anchors(b) if b else None
            if x is not None and len(x.at):
                at = x.at[np.random.default_rng(len(x.at)).random(len(x.at)) < 1 / 16]
                yield pa.RecordBatch.from_arrays([pa.array([b.data[k : k + KMER].tobytes() for k in at.tolist()], pa.binary())], names=["anchor"])

    text = wanted * samples * 16 * (SPREAD / 2)  # of an anchor each SPREAD / 2 bytes one in sixteen is taken
    sample = docs.sample(min(1.0, max(LEAST_SAMPLE, text) / max(1, total)), seed=11).select("doc_id", "text")
    found = np.sort(np.array([bytes(r[0]) for r in sample.mapInArrow(run, "anchor binary").collect()], f"S{KMER}"))
    if not len(found):
        return Ranges(none, 1, none)
    values, times = np.unique(found[np.arange(1, wanted) * len(found) // wanted], return_counts=True)
    return Ranges(values, math.ceil(ranges / wanted), values[times > 1])


def exchange(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2 << 20, part_bytes: int = 8 << 20, range_bytes: int = 8 << 20, samples: int = 16) -> tuple[GroupedData, DataFrame]:
    """Documents by block, and their sorted runs, a row for what a block has for a range."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, parts = max(1, math.ceil(total / block_bytes)), max(1, math.ceil(total / part_bytes))
    ranges = range_splitters(docs, total, math.ceil(total / range_bytes), samples)
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def send_keys(t: pa.Table) -> pa.Table:
        x = anchors(Block.of(t))
        lists = split_sorted(np.unique(x.key), parts) if x is not None and len(x.key) else {}
        return pa.table({"part": pa.array(list(lists), pa.int32()), "block": pa.array([t["block"][0].as_py()] * len(lists), pa.int64()), "keys": pa.array([six_bytes(k) for k in lists.values()], pa.binary())})

    by_block = dealt.groupBy("block")
    keys = by_block.applyInArrow(send_keys, "part int, block long, keys binary")

    def flag(t: pa.Table) -> pa.Table:
        got = dup_flags(t)
        return got if got is not None else pa.table({"block": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "bits": pa.array([], pa.binary())})

    flags = keys.groupBy("part").applyInArrow(flag, "block long, part int, bits binary")
    return by_block, by_block.cogroup(flags.groupBy("block")).applyInArrow(lambda d, f: make_runs(d, f, parts, ranges) if d.num_rows else RUN.empty_table(), RUN_DDL)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2 << 20, part_bytes: int = 8 << 20, range_bytes: int = 8 << 20, samples: int = 16, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    If asked for, with text_sha256, of the whole text, and kept, the text that stays (a character that lost some of its bytes goes whole).

    Hashes meet in parts and suffixes in ranges, each for so many bytes of text. A
    row of either exchange holds what one block has for one part or range: blocks
    times parts rows, and never more than there are anchors.
    """
    by_block, runs = exchange(df, id_col, text_col, block_bytes, part_bytes, range_bytes, samples)
    found = runs.groupBy("range").applyInArrow(settle, "block long, windows binary")
    nothing = pa.table({n: pa.array([], k) for n, k in OUT.items()})
    out = by_block.cogroup(found.groupBy("block")).applyInArrow(lambda d, f: cut_out(d, f, with_text) if d.num_rows else nothing, OUT_DDL)
    return out if with_text else out.drop("text_sha256", "kept")
