"""Ranked lexical search by three phases of uniform thresholds over term-partitioned postings.

Only terms of the items have posting lists; every document counts in the statistics.

1. Heads: the ``k`` highest postings of every list (each task keeps ``k`` a list before the
   exchange) give items partial scores of documents. The k-th of an item is a lower bound of its
   k-th score.
2. Thresholds: that bound over the item's number of lists (and over ``fineness``, so that what
   is not fetched adds little to a sum) is one threshold for all its lists. A document below it
   in every list scores less than the bound. What lies above the lowest threshold of a list is
   fetched, cut by document into blocks, so that a list of a third of all documents is many
   parts, and the parts of one block lie together. A block adds up each item's lists and names
   the documents whose sum, with what the unfetched rest of each list can add, reaches the
   bound and the block's own k-th sum.
3. Candidates whose upper bound reaches the k-th sum of all blocks get their exact scores
   from the postings by (document, term).

The bounds are inclusive and in 64-bit integers, so ties and order are those of scoring every
document; nothing is capped.

Cases: null and empty texts have no terms, and count neither in N nor in L; a null id is ranked
behind equal scores; rows that share an id are documents of their own, rows of items that share
an id are items of their own; an item without terms, or none of whose terms occurs, gives no
row; equal scores by id; empty tables give an empty result; other columns are not read. A text
is split as one row's value. ``75 * n * N`` and the like must fit 64 bits, else Spark raises.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import grouped, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FOUND = "item long, row long, doc_id long, lower long, upper long"


@dataclass(frozen=True)
class Settings:
    """k: rows an item; block_postings: postings of a block, some 32 bytes each in a task; broadcast_bytes:
    up to this size the items' terms go to every task, beyond it they are joined by exchange;
    entries: (item, term) pairs that a pass over the lists takes along, in which items are dealt out;
    fineness: 1 fetches least and looks up most candidates.
    """

    k: int = 10
    block_postings: int = 1 << 20
    broadcast_bytes: int = 8 << 20
    entries: int = 1 << 19
    fineness: int = 16


def terms(text: Column) -> Column:
    """Runs of digits, letters and everything beyond ASCII, A-Z lower-cased, in order."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda t: t != "")


def wanted(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, item_id, term, mult: what each item asks for; item numbers rows, as ids may repeat."""
    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("item_id"), terms(F.col(text_col)).alias("words"))
    each = numbered.select("item", "item_id", F.explode("words").alias("term"))
    return each.groupBy("item", "item_id", "term").agg(F.count("*").alias("mult"))


def occurrences(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, n, tid, tf of the known terms, and a row with tid -1 for every document."""
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), terms(F.col(text_col)).alias("words"))
    each = words.select("row", "doc_id", F.size("words").cast("long").alias("n"), F.explode(F.concat(F.array(F.lit("")), "words")).alias("term"))
    return each.join(known, "term").groupBy("row", "doc_id", "n", "tid").agg(F.count("*").alias("tf"))


def _best(df: DataFrame, value: str, k: int) -> DataFrame:
    """The k rows of each item with the highest value."""
    order = Window.partitionBy("item").orderBy(F.desc(value), F.asc_nulls_last("doc_id"), "row")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _bounds(best: DataFrame, value: str, k: int) -> DataFrame:
    """item, bound: the k-th value; none for an item with fewer."""
    return best.groupBy("item").agg(F.min(value).alias("bound"), F.count("*").alias("got")).where(F.col("got") == k).select("item", "bound")


def block_scorer(asked: list[tuple[int, int, int, int]], bounds: dict[int, int], k: int) -> Callable[[pa.Table], pa.Table]:
    """Function of a block's postings, by tid, that names the candidates of each item.

    asked: (item, tid, mult, cap): for postings that are not fetched, mult * impact is cap at most.
    """
    of_item: dict[int, list[tuple[int, int, int]]] = {}
    for item, *entry in asked:
        of_item.setdefault(item, []).append(tuple(entry))

    def score(t: pa.Table) -> pa.Table:
        tid, impact, row = (t[c].to_numpy() for c in ("tid", "impact", "row"))
        rows, first, place = np.unique(row, return_index=True, return_inverse=True)
        starts = np.flatnonzero(np.r_[True, tid[1:] != tid[:-1]])
        span = {int(tid[a]): (a, b) for a, b in zip(starts, np.r_[starts[1:], len(tid)])}
        out: list[list[np.ndarray]] = []
        for item, entries in of_item.items():
            lower, seen_cap = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            for term, mult, cap in entries:
                if term in span:
                    a, b = span[term]
                    at = place[a:b]  # a document is in a list once
                    lower[at] += mult * impact[a:b]
                    seen_cap[at] += cap
            upper = lower + (sum(e[2] for e in entries) - seen_cap)
            least = bounds.get(item, 0)
            if len(rows) >= k:
                least = max(least, int(np.partition(lower, len(rows) - k)[len(rows) - k]))
            keep = np.flatnonzero((lower > 0) & (upper >= least))
            out.append([np.full(len(keep), item), rows[keep], first[keep], lower[keep], upper[keep]])
        item, row, at, lower, upper = (np.concatenate(c) for c in zip(*out))
        return pa.table([item, row, t["doc_id"].take(pa.array(at)), lower, upper], names=[c.split()[0] for c in FOUND.split(", ")])

    return score


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    k = settings.k
    asked = stored(wanted(items, item_col, item_text), "lexical-items")
    named = stored(asked.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "lexical-terms")
    marker = docs.sparkSession.createDataFrame([("", -1)], "term string, tid long")
    small = (named.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0) <= settings.broadcast_bytes
    hint = F.broadcast if small else (lambda df: df)  # one row a term of the items, of the checked size
    asked = asked.join(hint(named), "term").drop("term")

    found = stored(occurrences(docs, hint(named.unionAll(marker)), id_col, text_col), "lexical-postings")
    everything = found.where("tid = -1 AND n > 0").agg(F.count("*"), F.sum("n")).first()
    n_docs, n_terms = everything[0], everything[1] or 1
    lists = found.where("tid >= 0")
    frequency = lists.groupBy("tid").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = stored(frequency.select("tid", "df", weight.alias("w")), "lexical-weights")
    length = F.expr(f"25 + (75 * n * {n_docs}L) div {n_terms}L")
    impact = F.expr("w * ((1000000000 * tf) div (1000 * tf + 8 * m))")
    postings = lists.join(hint(weights), "tid").withColumn("m", length).withColumn("impact", impact).where("impact > 0").select("row", "doc_id", "tid", "impact")

    # heads
    by_list = Window.partitionBy("tid").orderBy(F.desc("impact"), F.asc_nulls_last("doc_id"), "row")
    heads = stored(postings.withColumn("rank", F.row_number().over(by_list)).where(F.col("rank") <= k), "lexical-heads")
    partial = heads.join(asked, "tid").groupBy("item", "doc_id", "row").agg(F.sum(F.col("mult") * F.col("impact")).alias("lower"))
    bounds = _bounds(_best(partial, "lower", k), "lower", k)

    # thresholds: a document under them in all of an item's lists scores lists * (threshold - 1) at most, less than the bound
    per_item = asked.groupBy("item").agg(F.count("*").alias("lists"))
    threshold = F.expr(f"greatest(1, (coalesce(bound, 0) + lists * {settings.fineness} - 1) div (lists * {settings.fineness}))")
    tops = heads.where("rank = 1").select("tid", F.col("impact").alias("top"))
    limits = per_item.join(bounds, "item", "left").select("item", "bound", threshold.alias("threshold"))
    limited = stored(asked.join(limits, "item").join(hint(tops), "tid"), "lexical-limits")
    lowest = limited.groupBy("tid").agg(F.min(F.expr("(threshold + mult - 1) div mult")).alias("least"))
    cap = F.expr("mult * least(least - 1, top)")
    entries = stored(limited.join(hint(lowest), "tid").select("item", "item_id", "tid", "mult", cap.alias("cap"), "bound"), "lexical-entries")
    sizes = (found.count(), entries.count())
    blocks = max(-(-sizes[0] // settings.block_postings), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fetched = postings.join(hint(lowest), "tid").where("impact >= least").select("row", "doc_id", "tid", "impact", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"))

    passes = max(1, -(-sizes[1] // settings.entries))
    candidates: DataFrame | None = None
    for i in range(passes):  # one, unless the items' terms outgrow what a task takes along
        rows = entries.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == i).select("item", "tid", "mult", "cap", "bound").collect()
        named_by = grouped(fetched, ["block"], ["tid"], block_scorer([tuple(r)[:4] for r in rows], {r.item: r.bound for r in rows if r.bound is not None}, k), FOUND) if rows else None
        if named_by is not None:
            candidates = named_by if candidates is None else candidates.unionAll(named_by)
    if candidates is None:
        return entries.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    candidates = stored(candidates, "lexical-candidates")

    # exact scores
    reached = _bounds(_best(candidates, "lower", k), "lower", k)
    left = candidates.join(reached, "item", "left").where("bound IS NULL OR upper >= bound").select("item", "row")
    lookups = stored(left.join(entries.select("item", "item_id", "tid", "mult"), "item"), "lexical-lookups")
    few = lookups.count() * 40 <= settings.broadcast_bytes
    exact = postings.join(F.broadcast(lookups) if few else lookups, ["row", "tid"])
    scores = exact.groupBy("item", "item_id", "row", "doc_id").agg(F.sum(F.col("mult") * F.col("impact")).alias("score"))
    return _best(scores, "score", k).select("item_id", "rank", "doc_id", "score")


_TERMS = f"regexp_extract_all(translate({{}}, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

#: Every document scored for every item, in DuckDB.
ORACLE = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("text")} AS t FROM documents
), totals AS (
  SELECT count(*) AS nn, sum(len(t))::BIGINT AS ll FROM docs WHERE len(t) > 0
), occurrences AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM docs) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM occurrences, totals GROUP BY term, nn
), impacts AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))) AS impact FROM occurrences JOIN weights USING (term), totals
), asked AS (
  SELECT i, item_id, term, count(*) AS mult FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark) GROUP BY ALL
), scored AS (
  SELECT i, item_id, r, doc_id, CAST(sum(mult * impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY ALL
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS INTEGER) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
