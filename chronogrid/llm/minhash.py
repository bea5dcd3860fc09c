"""MinHash near-duplicates: many universal hash minima, banding, signature verification, exact confirmation, components.

1. Every text becomes the set of its distinct word shingles as 64-bit hashes,
   and ``bands * rows`` minima of universal hashes of that set. Documents with
   equal sets form a class, whose smallest document stands for it.
2. Each band of minima is a bucket key. With 40 bands of 5 a pair at 0.8 is met
   with a chance of 1 - 1.3e-7.
3. First round: every member of a bucket is paired with the bucket's smallest
   document only, so a bucket of n gives n - 1 pairs. Pairs whose signatures
   agree too little are dropped; the rest are confirmed on full sets.
4. Components of the confirmed links are taken. Second round: in buckets that
   still hold several components, members of different ones are compared by
   signature in blocks of bounded size, which gives families of documents with
   close signatures; within a family, members outside its largest component are
   held against all others block by block, by signature and, where that is close,
   on full sets. So every pair that shares a bucket is linked, in one component
   already, or refuted, and no pairs leave a task.
5. Components by alternating large-star and small-star.

Cases: null or empty texts, and texts without words, have no shingles and link
with nothing; fewer words than a shingle count as one; a null id has a null
component and is not kept; repeated rows each get their row; rows with one id and
different texts count as one document, linked as any of its texts is; a very long
text is one set, held in a task; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, id_text, per_batch, stored
from .components import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    words: int = 2
    percent: int = 80
    bands: int = 40
    rows: int = 5
    block: int = 1024  # members compared at once in the second round
    stray_block: int = 128

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def least_agreeing(self) -> int:
        """Minima that must agree; six standard deviations below the threshold."""
        j = self.percent / 100
        return int(self.hashes * j - 6 * (self.hashes * j * (1 - j)) ** 0.5)


@functools.lru_cache(maxsize=4)
def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of n universal hashes."""
    rng = np.random.default_rng(20240101)
    return rng.integers(0, 1 << 64, (n, 1), np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, (n, 1), np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = np.random.default_rng(20240102).integers(0, 1 << 64, 256, np.uint64)


@functools.lru_cache(maxsize=2)
def _powers(bits: int) -> np.ndarray:
    """2**bits powers of an odd number."""
    return np.cumprod(np.full(1 << bits, np.uint64(0xD1342543DE82EF95)), dtype=np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word, A-Z as a-z, and where it starts: a polynomial over its bytes, all words at once."""
    x = np.frombuffer(data.translate(LOWER), np.uint8)
    inside = (x != 32) & ((x < 9) | (x > 13))
    change = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, sizes = change[::2], change[1::2] - change[::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
    h = np.add.reduceat(_BYTES[x[inside]] * _powers(max(10, int(sizes.max()).bit_length()))[place], first)
    return mix(h + sizes.astype(np.uint64) * MULTIPLIER), starts


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than a shingle count as one, no words as none."""
    h, _ = word_hashes(text.encode())
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    out = np.full(n, np.uint64(len(h) if len(h) < words else words))
    for k in range(min(words, len(h))):
        out = mix(out * MULTIPLIER + h[k : k + n])
    return np.unique(out)


def signature(s: np.ndarray, hashes: int) -> np.ndarray:
    a, b = _family(hashes)
    least = np.full(hashes, np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(0, len(s), 256):
        h = a * s[None, k : k + 256]
        h += b
        np.minimum(least, h.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def band_keys(sigs: np.ndarray, bands: int) -> np.ndarray:
    """Bucket keys of signatures (rows): one column for each band."""
    parts = sigs.reshape(len(sigs), bands, -1).astype(np.uint64)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        out = mix(out * MULTIPLIER + parts[:, :, k])
    return out.view(np.int64)


def sigs_of(column: pa.ChunkedArray | pa.Array, hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, hashes)


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (digest of the set), sig of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, keys, sigs = [], [], []
        for text in batch.column(1).to_pylist():
            x = shingles(text, s.words)
            n.append(len(x))
            keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
            sigs.append(signature(x, s.hashes).tobytes() if len(x) else None)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "text_key", "n_shingles", "set_key", "sig"])

    return per_batch(docs.withColumn("text_key", F.xxhash64("text")), run, "doc_id long, text_key long, n_shingles long, set_key binary, sig binary")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test on full sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirm(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    The last join is on b and has each b once on that side, so a hub's pairs can be
    split over tasks; in a task they come one after the other, and its set is kept.
    """
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        last, of_last = None, None
        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns)):
                if b != last:
                    last, of_last = b, shingles(tb, s.words)
                if _similar(shingles(ta, s.words), of_last, s.percent):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def agreeing(pairs: DataFrame, reps: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose signatures agree in enough minima."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = (sigs_of(batch.column(2), s.hashes) == sigs_of(batch.column(3), s.hashes)).sum(1) >= s.least_agreeing
        return pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok))

    return per_batch(met, run, "a long, b long")


def _deal(m: DataFrame, key: str, s: Settings, stray_block: int) -> DataFrame:
    """Members (key, id, component) of groups with several components, in pairs of bounded blocks.

    Members outside a group's largest component are its strays. They are cut into
    blocks (i), and so are all members (j); each pair of blocks is a task's work, in
    which every stray (asks) meets every member. Rows: key, i, j, id, component,
    stray, asks.
    """
    sizes = m.groupBy(key, "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy(key).agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("size"), F.count("*").alias("components")).where("components > 1")
    blocks = lambda n, per: F.ceil(n / per).cast("int")
    # stored, so that both sides of the join below are plain exchanges, of which adaptive execution splits a large bucket's
    mixed = mixed.select(key, F.col("top.component").alias("top"), blocks(F.col("size") - F.col("top.n"), stray_block).alias("stray_blocks"), blocks(F.col("size"), s.block).alias("blocks"))
    m = m.join(stored(mixed, "mixed"), key).withColumn("stray", F.col("component") != F.col("top"))
    own = lambda n, salt: F.array(F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int"))
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_member = m.withColumn("i", F.explode(all_of("stray_blocks"))).withColumn("j", F.explode(own("blocks", 1))).withColumn("asks", F.lit(False))
    as_stray = m.where("stray").withColumn("i", F.explode(own("stray_blocks", 2))).withColumn("j", F.explode(all_of("blocks"))).withColumn("asks", F.lit(True))
    return as_member.unionAll(as_stray).select(key, "i", "j", "id", "component", "stray", "asks")


def _asked(ids: np.ndarray, comp: np.ndarray, stray: np.ndarray, members: np.ndarray, k: int) -> np.ndarray:
    """The members that stray k has to meet: those of other components; of two strays the larger asks."""
    return members[(comp[members] != comp[k]) & (~stray[members] | (ids[members] < ids[k]))]


def _neighbourhoods(members: DataFrame, labels: DataFrame, reps: DataFrame, s: Settings) -> DataFrame:
    """Edges (a, b) that span the pairs with close signatures in one bucket but in different components so far.

    A task takes a pair of blocks and returns no pairs, but for each member the
    smallest it is joined with.
    """
    m = members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    dealt = _deal(m, "band", s, s.block).join(reps.select("id", "sig"), "id").select("band", "i", "j", "id", "component", "stray", "asks", "sig")

    def run(t: pa.Table) -> pa.Table | None:
        every, comp, stray, asks = (t[c].to_numpy() for c in ("id", "component", "stray", "asks"))
        sigs = sigs_of(t["sig"], s.hashes)
        ids, node = np.unique(every, return_inverse=True)
        label = np.arange(len(ids))
        members = np.flatnonzero(~asks)
        for k in np.flatnonzero(asks):
            at = _asked(every, comp, stray, members, k)
            at = at[label[node[at]] != label[node[k]]]
            at = at[(sigs[at] == sigs[k]).sum(1) >= s.least_agreeing]
            if len(at):
                joined = np.unique(label[np.r_[node[at], node[k]]])
                label[np.isin(label, joined)] = joined[0]
        hit = label != np.arange(len(ids))
        return pa.table({"a": ids[hit], "b": ids[label[hit]]})

    return grouped(dealt, ["band", "i", "j"], [], run, "a long, b long")


def _between(families: DataFrame, labels: DataFrame, reps: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) between different components of a family, at least one for each pair of components that has any.

    Pairs of blocks are first held against each other by signature; only texts that
    then have a partner in the block they meet go there, for the test on full sets.
    Tasks return links, not pairs.
    """
    m = families.withColumnRenamed("component", "family").join(labels, "node", "left").select(F.col("node").alias("id"), "family", F.coalesce("component", "node").alias("component"))
    names = ["family", "i", "j", "id", "component", "stray", "asks", "sig"]
    dealt = _deal(m, "family", s, s.stray_block).join(reps.select("id", "sig"), "id").select(names)

    def with_partner(t: pa.Table) -> pa.Table | None:
        ids, comp, stray, asks = (t[c].to_numpy() for c in ("id", "component", "stray", "asks"))
        sigs = sigs_of(t["sig"], s.hashes)
        members = np.flatnonzero(~asks)
        wanted = np.zeros(len(ids), bool)
        for k in np.flatnonzero(asks):
            at = _asked(ids, comp, stray, members, k)
            at = at[(sigs[at] == sigs[k]).sum(1) >= s.least_agreeing]
            wanted[at] = True
            wanted[k] |= len(at) > 0
        return t.filter(pa.array(wanted))

    near = grouped(dealt, ["family", "i", "j"], [], with_partner, "family long, i int, j int, id long, component long, stray boolean, asks boolean, sig binary")
    near = near.join(texts, "id").select(*names, "text")

    def run(t: pa.Table) -> pa.Table | None:
        ids, comp, stray, asks = (t[c].to_numpy() for c in ("id", "component", "stray", "asks"))
        sigs = sigs_of(t["sig"], s.hashes)
        members = np.flatnonzero(~asks)
        sets = [shingles(x, s.words) for x in t["text"].to_pylist()]
        sizes = np.array([len(x) for x in sets])
        out: list[tuple[int, int]] = []
        for k in np.flatnonzero(asks):
            at = _asked(ids, comp, stray, members, k)
            at = at[(100 * np.minimum(sizes[at], sizes[k]) >= s.percent * np.maximum(sizes[at], sizes[k]))]
            at = at[(sigs[at] == sigs[k]).sum(1) >= s.least_agreeing]
            if not len(at):
                continue
            mine = sets[k]
            every = np.concatenate([sets[x] for x in at])
            found = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
            both = np.add.reduceat(found, np.cumsum(sizes[at]) - sizes[at], dtype=np.int64)
            linked = at[100 * both >= s.percent * (sizes[at] + sizes[k] - both)]
            _, first = np.unique(comp[linked], return_index=True)
            out += [(int(ids[k]), int(ids[x])) for x in linked[first]]
        if not out:
            return None
        p = np.array(out)
        return pa.table({"a": p.max(1), "b": p.min(1)})

    return grouped(near, ["family", "i", "j"], [], run, "a long, b long")


def links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with set_key, classes of equal sets, component of each linked class); a class has an id and its smallest document."""
    s = settings or Settings()
    docs = id_text(df, id_col, text_col)
    sets = stored(signatures(docs, s), "signatures")
    usable = sets.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = usable.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("least"), F.first("sig").alias("sig"))
    classes = stored(classes.select("set_key", F.monotonically_increasing_id().alias("id"), F.col("least.doc_id").alias("rep"), F.col("least.text_key").alias("text_key"), "sig"), "classes")

    def banded(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = band_keys(sigs_of(batch.column(1), s.hashes), s.bands)
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), s.bands))], names=["band", "id"])

    bands = per_batch(classes.select("id", "sig"), banded, "band long, id long")
    hubs = stored(bands.groupBy("band").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1"), "hubs")
    members = stored(bands.join(hubs, "band"), "members")
    candidates = members.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    close = stored(agreeing(candidates, classes, s), "close")
    wanted = members.select("id").distinct().join(classes.select("id", F.col("rep").alias("doc_id"), "text_key"), "id")
    texts = docs.withColumn("text_key", F.xxhash64("text")).join(wanted, ["doc_id", "text_key"]).select("id", "text").dropDuplicates(["id"])
    texts = stored(texts, "texts")
    first = stored(confirm(close, texts, s), "links")
    labels = components(first)
    near = stored(_neighbourhoods(members.where("n > 2").select("band", "id"), labels, classes, s), "near")
    if not near.isEmpty() or close.count() > first.count():  # else every pair that shares a bucket is settled
        families = components(close.unionAll(near))
        first = stored(first.unionAll(_between(families, labels, classes, texts, s)), "links")
    several = usable.groupBy("doc_id").agg(F.min("set_key").alias("least"), F.max("set_key").alias("most")).where("least <> most").select("doc_id")
    of_several = usable.join(several, "doc_id").select("doc_id", "set_key").distinct().join(classes.select("set_key", "id"), "set_key")
    same_id = of_several.join(of_several.groupBy("doc_id").agg(F.min("id").alias("b")), "doc_id").select(F.col("id").alias("a"), "b")
    return sets.select("doc_id", "n_shingles", "set_key"), classes.select("set_key", "id", "rep"), components(first.unionAll(same_id))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    docs, classes, labels = links(df, id_col, text_col, settings)
    named = labels.withColumnRenamed("node", "id").join(classes, "id")
    smallest = named.groupBy("component").agg(F.min("rep").alias("smallest"))
    named = classes.join(named.select("id", "component").join(smallest, "component").select("id", "smallest"), "id", "left")
    out = docs.join(named.select("set_key", F.coalesce("smallest", "rep").alias("component")), "set_key", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
