"""Connected components of large edge lists, and all-pairs work within groups by blocks of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node in `edges` (columns a and b, long).

    Alternates the large-star and small-star steps until nothing changes; each round halves the distance to the
    smallest node at least. Minima are taken by partial aggregates, so a node with very many edges is no hot task,
    and the joins are ones that adaptive execution can split. Self-loops count as nodes.
    """
    own = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own.filter("a = b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        own = cut(small)
        now = own.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    stars = own.groupBy("a").agg(F.min("b").alias("component"))
    return stars.select(F.col("a").alias("node"), "component").unionByName(own.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))


def blocks(members: DataFrame, group: str, node: str, size: int) -> DataFrame:
    """Every two members of a group meet in exactly one block pair; adds `block_pair` (a key) and `side` (0, 1, or 2: both).

    A group of m members has ceil(m / size) blocks, chosen by a hash of the node; each member is copied once for each
    block that its own meets, so no task holds more than about two blocks.
    """
    sizes = members.groupBy(group).agg(F.count("*").alias("_n"))
    own = members.join(sizes, group).withColumn("_k", F.ceil(F.col("_n") / size).cast("int")).withColumn("_i", F.pmod(F.xxhash64(F.col(node), F.lit(3)), F.col("_k")).cast("int"))
    own = own.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    side = F.when(F.col("_i") == F.col("_j"), 2).when(F.col("_i") < F.col("_j"), 0).otherwise(1)
    pair = F.concat_ws(":", F.col(group), F.least("_i", "_j"), F.greatest("_i", "_j"))
    return own.withColumn("block_pair", pair).withColumn("side", side).drop("_n", "_k", "_i", "_j")


def forest(nodes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each, over links between places left[i] and right[i]."""
    root = np.argsort(np.argsort(nodes, kind="stable"), kind="stable")
    order = np.argsort(nodes, kind="stable")
    label = root.copy()
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = np.minimum(label, label[order[label]])
        if (label == before).all():
            break
    return nodes[order[label]]
