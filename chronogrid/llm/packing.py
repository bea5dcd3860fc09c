"""Packing by shortest-pack-first over the length histogram.

1. Every text becomes ids (and a closing id), cut into pieces of at most
   ``capacity``: whole pieces and a remainder. Ids are not kept, only lengths and
   checksums.
2. The histogram of piece lengths, at most ``capacity`` rows whatever the input,
   goes to the driver. Lengths are placed longest first: the copies of a length
   go to the pack pattern with the most room left that fits them, whose count is
   reduced and whose extended pattern gets the copies placed; what fits nowhere
   opens new patterns. Counts, not pieces, are handled, so the work is bounded by
   the number of distinct lengths.
3. Each pattern slot owns a range of ranks of its length. A piece's rank comes
   from counts by (length, salt) and its place within that group. A length has as many
   salts as it has ``group_rows`` pieces, so no group grows with the input, nor does a
   repeated row make one; the slots, a bounded table, are broadcast.

A sequence is padded to ``capacity`` unless its length is a power of two; a
length of ``capacity`` fills a sequence of its own.

Cases: a null or empty text has the closing id alone; a very long text is encoded whole, as
one row's value, and cut then; a null id stays and packs
like any other; repeated rows each get their pieces; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import encoder, id_text, per_batch, shared_dir, vocabulary_path

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = 1024, closing: int = 0) -> DataFrame:
    """The pieces of every document."""
    path = vocabulary or vocabulary_path("byte_bpe_50k.tiktoken")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(path).encode_to_numpy
        rows: list[tuple] = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.append(encode(text, allowed_special="all"), np.uint32(closing)).astype("<u4")
            raw = memoryview(ids.tobytes())
            rows += [(i, k, min(capacity, len(ids) - k), zlib.crc32(raw[4 * k : 4 * (k + capacity)]), len(ids)) for k in range(0, len(ids), capacity)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return per_batch(id_text(df, id_col, text_col), run, PIECES)


def patterns(histogram: dict[int, int], capacity: int = 1024) -> list[tuple[tuple[int, ...], int]]:
    """Pack patterns and how often each occurs, by shortest-pack-first over the histogram."""
    room: dict[int, list[list]] = {}  # room left -> patterns [lengths, count]
    order: list[int] = []  # rooms that have had patterns, the largest first

    def add(left: int, lengths: tuple[int, ...], count: int) -> None:
        if left not in room:
            room[left] = []
            heapq.heappush(order, -left)
        room[left].append([lengths, count])

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n and order and -order[0] >= length:
            left = -order[0]
            pattern = room[left][-1]
            k = min(n, pattern[1])
            n -= k
            pattern[1] -= k
            if not pattern[1]:
                room[left].pop()
                if not room[left]:
                    heapq.heappop(order)
                    del room[left]
            add(left - length, (*pattern[0], length), k)
        if n:  # a pack that has just been opened is the shortest, so it takes copies until it is full
            whole, rest = divmod(n, capacity // length)
            if whole:
                add(capacity % length, (length,) * (capacity // length), whole)
            if rest:
                add(capacity - rest * length, (length,) * rest, 1)
    return [(lengths, count) for left in sorted(room) for lengths, count in room[left] if count]


def slots(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) of each pattern slot."""
    next_rank: dict[int, int] = {}
    out, base = [], 0
    for lengths, count in found:
        offset = 0
        for n in lengths:
            at = next_rank.get(n, 0)
            out.append((n, at, at + count, base, offset))
            next_rank[n] = at + count
            offset += n
        base += count
    return out


def place(pieces: DataFrame, capacity: int = 1024, group_rows: int = 1 << 20) -> DataFrame:
    """sequence_id and offset of each piece; pieces must be stored, with a number ``at`` of their own, as they are read three times.

    What the driver holds, and what is broadcast, is a row for each length and for each group_rows pieces.
    """
    spark: SparkSession = pieces.sparkSession
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    salts = spark.createDataFrame([(k, -(-n // group_rows)) for k, n in histogram.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("at"), "salts")).drop("salts")
    before, so_far = [], dict.fromkeys(histogram, 0)
    for length, salt, n in sorted(salted.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()):
        before.append((length, salt, so_far[length]))
        so_far[length] += n
    before_df = spark.createDataFrame(before, "length long, salt long, before long")
    slot_df = spark.createDataFrame(slots(patterns(histogram, capacity)), "slot_length long, lo long, hi long, base long, offset long")
    within = Window.partitionBy("length", "salt").orderBy("at")
    ranked = salted.withColumn("k", F.row_number().over(within) - 1).join(F.broadcast(before_df), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("k"))
    met = ranked.join(F.broadcast(slot_df), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return met.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = 1024, closing: int = 0, group_rows: int = 1 << 20) -> DataFrame:
    """Cut and place. The pieces, a few dozen bytes each, are stored in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    pieces = cut(df, id_col, text_col, vocabulary, capacity, closing).withColumn("at", F.monotonically_increasing_id()).checkpoint()
    return place(pieces, capacity, group_rows)
