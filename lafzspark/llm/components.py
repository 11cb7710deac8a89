"""Connected components of a graph given as a table of links, by contraction.

A round lets every node follow its smallest neighbour, and that one's, and rewrites the links between what remains;
links inside a group vanish. Nodes are hashes, so paths of ever smaller neighbours are short (about the logarithm of the
graph's size) and a round leaves at most about a third of the nodes; a star is gone after one. No group is held by a task: a node's
links are only ever reduced to their minimum, combined in each task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lafzspark.llm.scratch import discard, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) -> (node, component): component is the same for all nodes that links reach, and one of them.
    Nodes without a link to another one are left out."""
    links = edges.where("a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
    now, rounds = written(links.distinct()), []
    while not now.isEmpty():
        ends = now.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("a", "b"))
        low = written(ends.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m")))
        jump = low.select(F.col("u").alias("v"), F.col("m").alias("w"))
        low2 = written(low.join(jump, F.col("m") == F.col("v")).select("u", F.col("w").alias("m")))
        discard(low)
        first = now.join(low2.select(F.col("u").alias("a"), F.col("m").alias("x")), "a").select("x", "b")
        both = first.join(low2.select(F.col("u").alias("b"), F.col("m").alias("y")), "b").where("x <> y")
        after = written(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        discard(now)
        now = after
        rounds.append(low2)
    if not rounds:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds.pop()
    while rounds:
        before = rounds.pop()
        later = found.select(F.col("u").alias("v"), F.col("m").alias("w"))
        joined = written(before.join(later, F.col("m") == F.col("v"), "left").select("u", F.coalesce("w", "m").alias("m")))
        discard(before, found)
        found = joined
    out = found.select(F.col("u").alias("node"), F.col("m").alias("component"))
    out.lafz_path = found.lafz_path
    return out
