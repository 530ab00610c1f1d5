"""Connected components by alternating stars; every step is a join or an aggregate."""

import numpy as np
from pyspark.sql import functions as F

from probity.session import ensure_checkpoint_dir

#: Rounds after which something must be wrong: each round about halves the depth of every tree.
MOST_ROUNDS = 100


def _state(edges):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).head()
    return row["n"], row["h"]


def components(links):
    """(node, component) for every node of ``links`` (columns a, b of type long); component is its smallest node.

    Null ends and links of a node with itself are left out; repeated links and
    either direction are the same link. No links give no rows.
    """
    ensure_checkpoint_dir(links.sparkSession)
    edges = (
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    )
    before = _state(edges)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = (
            small.unionAll(lowest.select("a", F.col("m").alias("b")))
            .where(F.col("a") != F.col("b"))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
        )
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")
    found = edges.groupBy("a").agg(F.min("b").alias("component"))
    roots = found.select(F.col("component").alias("node")).distinct()
    return found.select(F.col("a").alias("node"), "component").unionAll(
        roots.select("node", F.col("node").alias("component")))


def stars(a, b, size):
    """(node, root) of a spanning forest of the links a-b; a root is the smallest node of its part."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(size))
    return node, label[node]
