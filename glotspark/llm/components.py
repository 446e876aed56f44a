"""Connected components of a graph that no single machine holds.

Each round gives every node the smallest of itself and its neighbours, in an order that a
scrambling of the ids makes as good as random, and contracts the edges to those; the number of
nodes left falls by a constant factor a round, also on paths and stars. The rounds' parents are
kept as tables and followed back at the end. Grouping is a minimum, so a node with very many edges
costs its partial minima only; joins have exchanges on both sides, so that its rows can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotspark.llm.store import Stash


def _xor(x: Column, by: Column) -> Column:
    return x.bitwiseXOR(by)


def scramble(x: Column) -> Column:
    """A one-to-one map of the 64-bit integers."""
    x = _xor(x, F.shiftleft(x, 13))
    x = _xor(x, F.shiftrightunsigned(x, 7))
    return _xor(x, F.shiftleft(x, 17))


def unscramble(x: Column) -> Column:
    for n in (17, 34):
        x = _xor(x, F.shiftleft(x, n))
    for n in (7, 14, 28, 56):
        x = _xor(x, F.shiftrightunsigned(x, n))
    for n in (13, 26, 52):
        x = _xor(x, F.shiftleft(x, n))
    return x


def components(edges: DataFrame, stash: Stash, name: str = "cc", a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node that links reach), for every node with an edge.

    Edges with a null end or from a node to itself count for nothing.
    """
    start = edges.where(f"{a} <> {b}").select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    for end in ("a", "b"):  # step by step, or the expressions grow beyond use
        start = start.withColumn(end, F.transform(F.array(end), scramble)[0])
    left = stash.keep(start.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges0")
    parents, r = [], 0
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stash.keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("p")), f"{name}-parents{r}")
        pa, pb = parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = left.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        parents.append(parent)
        left = stash.keep(moved, f"{name}-edges{r + 1}")
        stash.drop(f"{name}-edges{r}")
        r += 1
    if not parents:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = parents[-1].select("v", F.col("p").alias("root"))
    for k in range(r - 2, -1, -1):
        step = parents[k].join(found.select(F.col("v").alias("p"), "root"), "p", "left").select("v", F.coalesce("root", "p").alias("root"))
        found = stash.keep(step, f"{name}-roots{k}")
    plain = lambda c: F.transform(F.array(c), unscramble)[0]
    # every root is a parent but need not be a node of the first round's table; it is one, as it has an edge
    named = stash.keep(found.select(plain("v").alias("node"), "root"), f"{name}-named")
    least = stash.keep(named.groupBy("root").agg(F.min("node").alias("component")), f"{name}-least")
    return named.join(least, "root").select("node", "component")
