"""Connected components by alternating star contractions, with lineage cut in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch

#: Rounds halve the depth of trees at least, so that this is out of reach for any real input; beyond it an error is raised.
MOST_ROUNDS = 64


def _star(links: DataFrame, both: bool, scratch: Scratch) -> DataFrame:
    """Moves links to each node's least neighbour. links: (a, b) with b < a; both: from both ends (large star).

    A hub is met from its own end in large stars: there the least neighbours are stored, so that the join's sides are plain shuffles, of which
    Spark splits those of a hub.
    """
    sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else links
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    least = scratch.save(least, "least").hint("merge") if both else least
    met = sides.join(least, sides.a == least.u)
    if both:
        moved = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of links (a, b) that is not the least of its component.

    Links may be repeated, reversed or from a node to itself; null ends are left out. The result is
    empty for no links. No group of neighbours is gathered in one place: stars are joins and minima.
    """
    tidy = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    found = scratch.save(tidy, "links-0")
    seen = None
    for turn in range(1, MOST_ROUNDS):
        state = found.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state.n == 0 or state == seen:
            break
        seen = state
        large = scratch.save(_star(found, True, scratch), "large")
        found = scratch.save(_star(large, False, scratch), f"links-{turn}")
        if turn > 1:
            scratch.drop(f"links-{turn - 2}")
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return found.select(F.col("a").alias("node"), F.col("b").alias("root"))
