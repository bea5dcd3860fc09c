"""Embedding near-duplicates by lattice hashing.

A seeded random rotation splits a unit vector into blocks of eight coordinates,
one table for each. Two vectors at cosine c lie sqrt(2 - 2c) apart, so in at
least one of T tables their projections are within sqrt((2 - 2c) / T). Each
projection is decoded to the nearest point of a scaled E8 lattice, and its
vector goes to every cell, its own and neighbouring ones, that comes within half
that distance of it; the midpoint of a close pair lies in such a cell of both.
No pair is missed by design, and each is counted once: in the first table whose
projections are close enough, in the cell of the midpoint.

Equal vectors form a class that goes through this once. Within a cell cosines
are computed in double precision, block against block; cells over ``cell_rows``
are split into pairs of bounded parts. Pairs never leave a task: a cell returns,
for each vector, how many it links with and an edge of the local components.

Cases: vectors that are null, empty, zero or hold null or non-finite parts link
with nothing and are their own component; vectors of different dimensions never
link; a null id has a null component and is not kept; repeated rows each get
their row; rows with one id and different vectors each have their own count of
links and one component; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, per_batch, stored
from .components import components, local_components
from .minhash import mix


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.95
    scale: float = 0.3  # of the lattice, whose cells reach that far
    cell_rows: int = 4096
    seed: int = 11


@functools.lru_cache(maxsize=8)
def rotation(dim: int, seed: int) -> np.ndarray:
    """Orthonormal columns, padded with zero rows to a multiple of eight dimensions."""
    wide = -(-dim // 8) * 8
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((wide, wide)))
    return q[:dim]


@functools.lru_cache(maxsize=1)
def neighbours() -> np.ndarray:
    """E8 vectors of squared length 2 and 4, and zero: all that cells within 0.449 of a point can differ by."""
    whole = [v for v in itertools.product((-1, 0, 1), repeat=8) if sum(map(abs, v)) in (2, 4) ] + [tuple(2 * s if k == j else 0 for k in range(8)) for j in range(8) for s in (-1, 1)]
    half = [v for v in itertools.product((-0.5, 0.5), repeat=8) if (sum(v) % 2) == 0]
    long_half = [tuple(x * (3 if k == j else 1) for k, x in enumerate(v)) for v in itertools.product((-0.5, 0.5), repeat=8) for j in range(8)]
    long_half = [v for v in long_half if (sum(v) % 2) == 0]
    return np.array([(0,) * 8, *whole, *half, *long_half], np.float64)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    if len(odd):
        gap = x[odd] - r[odd]
        worst = np.abs(gap).argmax(1)
        k = np.arange(len(odd))
        r[odd, worst] += np.where(gap[k, worst] >= 0, 1.0, -1.0)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: whole or half coordinates, of even sum."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    closer = ((x - b) ** 2).sum(1) < ((x - a) ** 2).sum(1)
    a[closer] = b[closer]
    return a


def cell_key(points: np.ndarray, table: int, dim: int) -> np.ndarray:
    """64-bit key of each lattice point of a table."""
    out = np.full(len(points), np.uint64(table * 65536 + dim))
    for c in np.rint(points * 2).astype(np.int64).view(np.uint64).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + c)
    return out.view(np.int64)


def cells_near(x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, lattice point) for each cell that may come within reach of a row, in units of the lattice.

    A cell is left out if the plane halfway between its point and the row's own
    is farther away than reach, or its point is farther than a cell and reach.
    """
    t = neighbours()
    own = decode(x)
    off = x - own
    length = np.sqrt((t * t).sum(1))
    length[0] = 1.0
    plane = ((t * t).sum(1) - 2 * off @ t.T) / (2 * length)
    plane[:, 0] = 0
    far = ((off[:, None] - 0) ** 2).sum(2) - 2 * off @ t.T + (t * t).sum(1)
    row, k = np.nonzero((plane <= reach) & (far <= (1 + reach) ** 2))
    return row, own[row] + t[k]


def unit(raw: np.ndarray) -> np.ndarray:
    v = raw / np.abs(raw).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def canonical(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, dim, vec (the usable vectors' bytes in double precision, or in single if that is what they are), key (digest)."""
    double = dict(df.dtypes)[vector_col] != "array<float>"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims, vecs, keys = [], [], []
        for v in batch.column(1).to_pylist():
            x = None if not v or any(e is None for e in v) else np.array(v, "<f8" if double else "<f4")
            if x is None or not np.isfinite(x).all() or not x.any():
                dims.append(None), vecs.append(None), keys.append(None)
                continue
            raw = (x + 0).tobytes()
            dims.append(len(x)), vecs.append(raw), keys.append(hashlib.blake2b(raw, digest_size=16).digest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary()), pa.array(keys, pa.binary())], names=["vec_id", "dim", "vec", "key"])

    return per_batch(df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")), run, "vec_id long, dim int, vec binary, key binary")


def read_vectors(column, dim: int) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<f4" if len(raw[0]) == 4 * dim else "<f8").reshape(-1, dim).astype(np.float64)


def reach_of(dim: int, s: Settings) -> float:
    """How close the projections of a linked pair are in at least one table."""
    return math.sqrt(max(0.0, 2 - 2 * s.cosine) / -(-dim // 8)) * (1 + 1e-9) + 1e-9


def scale_of(dim: int, s: Settings) -> float:
    """The lattice's scale; half the reach stays below 0.449 of it, which neighbours() covers."""
    return max(s.scale, reach_of(dim, s) / 2 / 0.44)


def assign(classes: DataFrame, s: Settings) -> DataFrame:
    """Each class in all cells it is near: cell, table, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                for at in range(0, part.num_rows, 256):
                    piece = part.slice(at, 256)
                    y = unit(read_vectors(piece["vec"], int(dim))) @ rotation(int(dim), s.seed) / scale_of(int(dim), s)
                    for table in range(y.shape[1] // 8):
                        row, points = cells_near(y[:, 8 * table : 8 * table + 8], reach_of(int(dim), s) / 2 / scale_of(int(dim), s))
                        yield pa.RecordBatch.from_arrays([pa.array(cell_key(points, table, int(dim))), pa.array(np.full(len(row), table, np.int32)), piece["id"].take(pa.array(row))], names=["cell", "table", "id"])

    return classes.select("id", "dim", "vec").mapInArrow(run, "cell long, table int, id long")


def link_cell(t: pa.Table, s: Settings) -> pa.Table | None:
    """Links within a cell, or between two parts of one, that this cell must count."""
    if t.num_rows < 2:
        return None
    dim, table, cell = t["dim"][0].as_py(), t["table"][0].as_py(), t["cell"][0].as_py()
    ids, weight, side = t["id"].to_numpy(), t["n"].to_numpy(), t["side"].to_numpy()
    v = unit(read_vectors(t["vec"], dim))
    y = v @ rotation(dim, s.seed)
    reach, scale = reach_of(dim, s), scale_of(dim, s)
    tables = y.shape[1] // 8
    two_sided = bool(side.any())
    here = y[:, 8 * table : 8 * table + 8]
    square = (here * here).sum(1, keepdims=True)
    one = np.ones_like(square)
    rows, columns = np.hstack([-2 * here, square, one]).astype(np.float32), np.hstack([here, one, square]).astype(np.float32).T
    found_a, found_b = [], []
    for at in range(0, len(v), 512):
        # squared distances in this table first, in single precision with room for its error; few pairs are left
        a, b = np.nonzero(rows[at : at + 512] @ columns[:, at:] <= reach * reach + 1e-4)
        ok = a < b
        if two_sided:
            ok &= side[a + at] != side[b + at]
        a, b = a[ok] + at, b[ok] + at
        for k in range(0, len(a), 65536):
            i, j = a[k : k + 65536], b[k : k + 65536]
            ok = np.einsum("ij,ij->i", v[i], v[j]) >= s.cosine
            i, j = i[ok], j[ok]
            gap = ((y[i] - y[j]) ** 2).reshape(len(i), tables, 8).sum(2)
            ok = (gap <= reach * reach).argmax(1) == table
            i, j = i[ok], j[ok]
            if len(i):
                ok = cell_key(decode((here[i] + here[j]) / 2 / scale), table, dim) == cell
                found_a.append(i[ok]), found_b.append(j[ok])
    if not found_a:
        return None
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    if not len(a):
        return None
    links = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
    to = local_components(len(ids), a, b, ids)
    hit = np.flatnonzero(links)
    return pa.table({"id": ids[hit], "links": links[hit].astype(np.int64), "to": to[hit]})


def link_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    s = settings or Settings()
    rows = stored(canonical(df, id_col, vector_col), "vectors")
    usable = rows.where("key IS NOT NULL")
    classes = usable.groupBy("key", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec"))  # of equal keys the vectors are equal
    reps = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    classes = reps.select("key", "id", "rep", "n")
    reps = reps.select("id", "n", "dim", "vec")
    cells = stored(assign(reps, s), "cells")
    heavy = cells.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > s.cell_rows)
    sized = cells.join(heavy.select("cell", F.ceil(F.col("size") / s.cell_rows).cast("int").alias("parts")), "cell", "left")
    # a heavy cell's rows are dealt into parts, and a row goes to each pair of parts that holds its own
    parts = F.coalesce("parts", F.lit(1))
    sized = sized.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("i"), F.greatest(k, F.col("part")).alias("j"), (k < F.col("part")).cast("int").alias("side")))
    dealt = sized.withColumn("pair", F.explode(pairs)).select("cell", "table", "id", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "pair.side")
    dealt = dealt.join(reps, "id").select("cell", "i", "j", "side", "table", "id", "n", "dim", "vec")
    found = stored(grouped(dealt, ["cell", "i", "j"], [], lambda t: link_cell(t, s), "id long, links long, to long"), "links")
    several = usable.groupBy("vec_id").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most AND vec_id IS NOT NULL").select("vec_id")
    of_several = usable.join(several, "vec_id").select("vec_id", "key").distinct().join(classes.select("key", "id"), "key")
    same_id = of_several.join(of_several.groupBy("vec_id").agg(F.min("id").alias("b")), "vec_id").select(F.col("id").alias("a"), "b")
    labels = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")).unionAll(same_id)).withColumnRenamed("node", "id")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    smallest = labels.join(classes, "id").groupBy("component").agg(F.min("rep").alias("smallest"))
    per_class = classes.join(counts, "id", "left").join(labels.join(smallest, "component").select("id", "smallest"), "id", "left").select("key", "rep", "n", "links", "smallest")
    out = rows.select("vec_id", "key").join(per_class, "key", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("smallest", "rep", "vec_id"))
    out = out.select("vec_id", F.coalesce(F.col("n") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
