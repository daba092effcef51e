"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, written


def components(links: DataFrame, left: str, right: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links``: root is the smallest node of its component.

    Alternating stars: each node hangs its larger neighbours on its smallest one, then each node hangs all
    its smaller neighbours on the smallest of them.  Links are written after every round; the state is stars
    when a round changes nothing, after a number of rounds like the logarithm of the longest path.  Every
    step is a minimum by key and a lookup that hot keys don't hold up.
    """
    links = written(links.select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo")).where("hi > lo").distinct())
    state = _state(links)
    for _ in range(rounds):
        if not state[0]:
            break
        both = links.select(F.col("hi").alias("node"), F.col("lo").alias("other")).union(links.select(F.col("lo"), F.col("hi")))
        large = written(_hung(both, 2 * state[0]).where("other > node").select(F.col("other").alias("node"), F.col("least").alias("other")).distinct())
        small = _hung(large, state[0])
        stars = small.where("other > least").select(F.col("other").alias("hi"), F.col("least").alias("lo"))
        links = written(stars.union(small.select("node", "least")).where("hi > lo").distinct())
        before, state = state, _state(links)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(links.select(F.col("lo"), F.col("lo")).distinct())


def _hung(arcs: DataFrame, total: int) -> DataFrame:
    """``arcs`` (node, other) with the least of the node and all its others."""
    least = arcs.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("least"), F.count(F.lit(1)).alias("degree"))
    return looked_up(arcs, least, "node", "degree", total)


def _state(links: DataFrame) -> tuple:
    """Number and digest of the links: equal when the links are."""
    n, digest = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
    return n, digest
