"""Connected components of a table of links, by alternating star contractions.

Every round is two aggregates and two joins on the link table, written to the shared folder. Neighbours are
reduced to their minimum before the shuffle, never gathered, so a vertex with very many links is no large group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbeam.llm.common import forget, stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the smallest vertex near it."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("least").alias("a"), "b").where("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are linked to the smallest of them; links hold a < b."""
    least = links.groupBy("b").agg(F.min("a").alias("least"))
    near = links.join(least, "b")
    moved = near.select(F.col("least").alias("p"), F.col("a").alias("q"))
    own = least.select(F.col("least").alias("p"), F.col("b").alias("q"))
    return moved.union(own).where("p < q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) of comparable values to (node, component): the smallest node reachable.

    Links may repeat, come in either order, or join a node with itself; nodes without a link to another
    one are not returned. An empty table gives an empty one. Rounds grow with the logarithm of the nodes.
    """
    ends = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = stored(ends, "links")
    state = _state(now)
    while state[0]:
        after = stored(_small_star(_large_star(now)), "links")
        before, state = state, _state(after)
        forget(now)
        now = after
        if state == before:
            break
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
