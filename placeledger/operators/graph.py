"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeledger.session import Scratch, cut, scratch


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a, b: long); the component is its least node.

    Links jump to the least neighbour by turns from large and from small nodes until only stars are left. That takes a number
    of rounds that grows with the logarithm of the longest path; each round reads and writes the links once and drops the last ones.
    """

    def run(own: Scratch) -> DataFrame:
        oriented = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        now = cut(oriented.distinct())
        state = _state(now)
        while state[0]:
            new = cut(_small_star(_large_star(now)))
            own.drop(now)
            before, now, state = state, new, _state(new)
            if state == before:
                break
        roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
        return own.keep(cut(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)))

    with scratch(links.sparkSession) as own:
        return run(own)
