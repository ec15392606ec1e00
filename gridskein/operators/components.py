"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialise


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: longs); nodes linked in any number of steps share a root.

    Randomised contraction: in each round every node is renamed to the node of
    its neighbourhood that comes first in an order drawn anew (itself included),
    links are renamed alike, loops and repeats go.  A component loses a constant
    share of its nodes each round whatever its shape, so rounds grow with the
    logarithm of the longest chain.  Rounds, and roots on the way back through
    them, are written to the shared folder one at a time and meet by sorted
    partitions (no broadcast, which the driver would hold); nothing but whether
    links are left comes to the driver.  Null ends are ignored; loops don't make nodes.
    """
    links = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links, renames, k = materialise(links, "links"), [], 0
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("r"), F.col(c).alias("v"))  # noqa: B023, E731
        first = both.groupBy("a").agg(F.min(rank("b")).alias("n"))
        first = first.select(F.col("a").alias("node"), F.least("n", rank("a"))["v"].alias("next"))
        first = materialise(first, "rename")
        renames.append(first)
        left = first.select(F.col("node").alias("a"), F.col("next").alias("x"))
        right = first.select(F.col("node").alias("b"), F.col("next").alias("y"))
        moved = links.join(left.hint("merge"), "a").join(right.hint("merge"), "b").filter("x <> y")
        before, links = links, materialise(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        discard(before)
        k += 1
    if not renames:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    last = renames.pop()
    roots = materialise(last.select("node", F.col("next").alias("root")), "roots")
    discard(last)
    for step in reversed(renames):
        later = roots.select(F.col("node").alias("next"), "root")
        before, roots = roots, materialise(step.join(later.hint("merge"), "next", "left").select("node", F.coalesce("root", "next").alias("root")), "roots")
        discard(step, before)
    return roots
