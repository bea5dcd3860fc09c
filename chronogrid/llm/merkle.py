"""A Merkle manifest of a dataset: one tree over each group of rows and one over the groups, with proofs.

1. Every row becomes a leaf digest; only digests and keys are kept, in a stored table.
2. Leaves are sorted over the whole table by (group, id) in runs, one a range of keys.
   A run's first position within its group comes from the counts of the runs
   before it, so that no group, however large, is sorted or numbered by one task.
3. Levels go to Parquet, a folder each. A level is made from the one before it alone:
   runs of ``fan`` neighbours become the digest of their digests, and a node keeps its
   children's digests. A group stops when one node is left, its subroot. The subroots
   are the leaves of a last tree built in the same way, whose top is the root.
4. Proofs come from merging the levels by coordinate, from the top down: a node at
   position p has its siblings in its parent's row at p div fan, and the parent's own
   path behind them. That is one join of a level with the next, which has a third of its
   rows; leaves, the largest level, are joined once.

Cases: a null field is written ``-``, an empty one ``0:``; a null group is a group of its own,
first of all; rows with a null id come first in their group and are taken as they are, not
altered; rows that share an id are leaves of their own, in the order of their digests (equal
ones are interchangeable); a group of one row has its leaf as subroot, a table of one group
its subroot as root; a proof without siblings is the digest of nothing; an empty table gives
an empty result; other columns are not read. A text is held whole, as one row's value.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<before: string, after: string>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """A value with its length in bytes before it, so that fields cannot run into each other."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(df: DataFrame, fields: Sequence[str] = FIELDS, **instead: Column) -> Column:
    """The digest of a row's fields; ``instead`` gives other values for some of them."""
    return digest(*(field(instead.get(c, df[c])) for c in fields))


def positions(df: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """Adds pos (from 0 within its group by order) and n (rows of the group) to a stored table.

    Sorted runs are written once; the place of a row in its run is in its file for good, so a
    task that is run again cannot number rows otherwise than the counts were made.
    """
    runs = stored(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("at", F.monotonically_increasing_id()), name)
    run = F.shiftright("at", 33)
    counted = runs.groupBy(group, run.alias("run")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    of_group = Window.partitionBy(group)  # as many rows as runs that the group reaches into
    before = F.sum("rows").over(of_group.orderBy("run")) - F.col("rows")
    offsets = counted.select(group, "run", (before - F.col("first")).alias("shift"), F.sum("rows").over(of_group).alias("n"))
    return runs.withColumn("run", run).join(offsets, [group, "run"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "run", "shift")


class Tree:
    """Levels of nodes by group, each in a Parquet folder of its own.

    A node has its group, its position, how many nodes its group has at that level, its digest,
    and the digests of its children, ``fan`` of them or fewer.
    """

    def __init__(self, leaves: DataFrame, fan: int = 3):
        """leaves: group, pos, n, digest and what else a leaf is to keep."""
        spark = leaves.sparkSession
        self.fan, self.path = fan, f"{shared_dir(spark)}/merkle-nodes-{uuid.uuid4().hex}"
        self.levels: list[DataFrame] = []
        left = self._store(leaves)
        while left > 1:
            below = self.levels[-1].where("n > 1")
            parts = [F.max(F.when(F.col("pos") % fan == i, F.col("digest"))).alias(f"child{i}") for i in range(fan)]
            nodes = below.groupBy("group", F.expr(f"pos div {fan}").alias("pos"), F.expr(f"(n + {fan - 1}) div {fan}").alias("n")).agg(*parts)
            left = self._store(nodes.withColumn("digest", digest(*(F.coalesce(f"child{i}", F.lit("")) for i in range(fan)))))

    def _store(self, level: DataFrame) -> int:
        """Write one level; the most nodes that a group has on it."""
        at = f"{self.path}/level={len(self.levels)}"
        level.sortWithinPartitions("group", "pos").write.parquet(at)
        self.levels.append(level.sparkSession.read.schema(level.schema).parquet(at))
        return self.levels[-1].agg(F.max("n")).first()[0] or 0

    def tops(self) -> DataFrame:
        """group, digest: the last node of each group."""
        found = [level.where("n = 1").select("group", "digest") for level in self.levels]
        out = found[0]
        for more in found[1:]:
            out = out.unionAll(more)
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """The leaves with ``path``, siblings before and after them level by level, and what above has by group.

        above: group, path (that of the group's top node, perhaps empty) and other columns, which are passed down.
        """
        more = [c for c in above.columns if c not in ("group", "path")]
        known: DataFrame | None = None
        for k in reversed(range(len(self.levels))):
            level = self.levels[k]
            found = level.where("n = 1").join(above, "group")
            if known is not None:
                own = F.col("pos") % self.fan
                side = [F.concat(*(F.when(keep(i), F.coalesce(f"up_child{i}", F.lit(""))).otherwise("") for i in range(self.fan))) for keep in (lambda i: own > i, lambda i: own < i)]
                step = F.struct(side[0].alias("before"), side[1].alias("after"))
                parents = known.select(F.col("group").alias("up_group"), F.col("pos").alias("up_pos"), F.col("path").alias("up_path"), *more, *(F.col(f"child{i}").alias(f"up_child{i}") for i in range(self.fan)))
                met = level.where("n > 1").join(parents, (F.col("group") == F.col("up_group")) & (F.expr(f"pos div {self.fan}") == F.col("up_pos")))
                found = found.unionByName(met.withColumn("path", F.concat(F.array(step), "up_path")).select(found.columns))
            known = found
        return known


def proofs(leaves: DataFrame, fan: int = 3) -> DataFrame:
    """Leaves with subroot, root and path (array of siblings before and after, from the leaf up to the root).

    leaves: group (null for none), key (the order within the group), digest and more columns.
    """
    made = stored(leaves.withColumn("group", F.coalesce(F.concat(F.lit("1"), "group"), F.lit("0"))).withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    trees = Tree(positions(made, "group", ["key", "digest", "row"], "merkle-runs"), fan)
    subroots = stored(trees.tops(), "merkle-subroots")
    whole = Tree(positions(subroots.select(F.lit("").alias("group"), F.col("group").alias("key"), "digest"), "group", ["key"], "merkle-subroot-runs"), fan)
    start = whole.tops().select("group", F.col("digest").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"))
    above = stored(whole.paths(start).select(F.col("key").alias("group"), F.col("digest").alias("subroot"), "root", "path"), "merkle-subroot-paths")
    return trees.paths(above)


def folded(c: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, c, lambda h, step: digest(step["before"], h, step["after"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def manifest(df: DataFrame, altered: Column | None = None, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", fields: Sequence[str] = FIELDS, fan: int = 3) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and whether an altered copy of its text still verifies.

    altered: the text as received; by default a text without its line feeds, in the rows whose
    id has an even checksum.
    """
    if altered is None:
        altered = F.when(F.crc32(F.col(id_col).cast("string")) % 2 == 0, F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))
    leaves = df.select(F.col(group_col).alias("group"), F.col(id_col).alias("key"), leaf(df, fields).alias("digest"), leaf(df, fields, **{text_col: altered}).alias("received"))
    found = proofs(leaves, fan)
    root = folded(F.col("received"), F.col("path"))
    return found.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"), (root == F.col("root")).alias("verified"))


_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""

#: The same rows in DuckDB, level by level; the checksum's last bit is inverted at its end, so even means odd before.
ORACLE = f"""
WITH RECURSIVE received AS (
  SELECT *, CASE WHEN {_CRC} % 2 = 1 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents
), leaves AS (
  SELECT doc_id, coalesce('1' || source, '0') AS grp, {_LEAF} AS leaf, {_LEAF.replace("CAST(text", "CAST(other")} AS got FROM received
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves
), nodes AS (
  SELECT 0 AS lvl, grp, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT lvl + 1, grp, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lvl, grp, pos // 3, n
), subroots AS (
  SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS lvl, pos, n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lvl, pos // 3, n
), ups AS (
  SELECT a.lvl, a.grp, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.lvl = b.lvl AND a.grp = b.grp AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL
), top_ups AS (
  SELECT a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM tops a JOIN tops b ON a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL
), walk AS (
  SELECT doc_id, grp, leaf, 0 AS lvl, pos, n, got AS h, '' AS proof FROM placed
  UNION ALL
  SELECT doc_id, w.grp, leaf, w.lvl + 1, w.pos // 3, (n + 2) // 3, sha256(l || h || r), proof || l || r FROM walk w JOIN ups u ON w.lvl = u.lvl AND w.grp = u.grp AND w.pos = u.pos WHERE n > 1
), top_walk AS (
  SELECT doc_id, leaf, s.h AS subroot, 0 AS lvl, s.pos, s.n, w.h, proof FROM walk w JOIN subroots s ON w.grp = s.grp WHERE w.n = 1
  UNION ALL
  SELECT doc_id, leaf, subroot, w.lvl + 1, w.pos // 3, (n + 2) // 3, sha256(l || h || r), proof || l || r FROM top_walk w JOIN top_ups u ON w.lvl = u.lvl AND w.pos = u.pos WHERE n > 1
)
SELECT doc_id, leaf, subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = (SELECT h FROM tops WHERE n = 1) AS verified
FROM top_walk WHERE n = 1
"""
