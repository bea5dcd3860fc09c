"""Connected components by alternating large-star and small-star.

Each round every node hands its larger neighbours to its smallest one
(large-star), then its smaller neighbours and itself (small-star). Edges never
grow in number. The least neighbour of a hub is a partial aggregate, and the join
with it has one row for each node on that side, so adaptive execution can split a
hub's edges. A round is cut off by a table in the shared folder; two places take
turns, so that no more than two rounds are kept.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 200) -> DataFrame:
    """node long, component long (the smallest node reachable) for every node that has an edge to another.

    Null ends, loops and repeated edges are dropped; no edges give an empty result.
    Rounds go on until nothing changes; more of them than the limit are an error.
    """
    run = uuid.uuid4().hex
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).distinct()
    e = stored(e, "edges", at=f"{run}-0")
    state = lambda d: tuple(d.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())
    seen = state(e)
    for k in range(1, rounds + 1):
        if not seen[0]:
            break
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # every edge now points from a larger node to a smaller one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).distinct()
        e = stored(small, "edges", at=f"{run}-{k % 2}")
        now = state(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components are not stable after {rounds} rounds")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def local_components(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest id of its component under the edges a-b."""
    label = ids.copy()
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        if (label == before).all():
            break
    return label
