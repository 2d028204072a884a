"""Distributed union-find: connected components by contraction, in DataFrame operations only.

Every round each node points at its smallest neighbour (or itself), pointers are doubled until they
reach roots, edges are renamed to roots and those within a root fall away. A round at least halves
the nodes that still have edges. Hubs are safe: minima are pre-aggregated before the shuffle, and
the joins back are plain equi-joins that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the smallest node reachable.

    Loops and repeated edges do no harm; edges with a null end are left out; without edges the
    result is empty.
    """
    e = stash(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = stash(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "parents")
        while True:
            up = p.select(F.col("node").alias("root"), F.col("root").alias("_up"))
            jumped = stash(p.join(up, "root").select("node", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("_moved")), "parents")
            p = jumped.select("node", "root")
            if jumped.where("_moved").isEmpty():
                break
        if found is None:
            found = p
        else:
            up = p.select(F.col("node").alias("root"), F.col("root").alias("_up"))
            found = stash(found.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root")), "roots")
        one = p.select(F.col("node").alias("a"), F.col("root").alias("_a"))
        two = p.select(F.col("node").alias("b"), F.col("root").alias("_b"))
        renamed = e.join(one, "a").join(two, "b").where("_a != _b")
        e = stash(renamed.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return found
