"""Connected components of a table of links, without any graph on the driver.

Each round every node points to its smallest neighbour, the pointers are followed
twice, and the links are rewritten between the nodes pointed at, until none is
left. The rounds grow with the logarithm of the longest path. The smallest
neighbour is a partial aggregate and hubs only ever meet joins, which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``(id, component)`` for every node of ``links (a, b)``; the component is its smallest id.

    Nulls and loops are ignored; no links give an empty table.
    """
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = scratch.keep(edges, f"{name}-edges-0")
    pointers, rounds = None, 0
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("to"))
        to = scratch.keep(to, f"{name}-to-{rounds}-0")
        for jump in (1, 2):
            further = to.select(F.col("id").alias("to"), F.col("to").alias("further"))
            to = scratch.keep(to.join(further, "to", "left").select("id", F.coalesce("further", "to").alias("to")), f"{name}-to-{rounds}-{jump}")
        if pointers is None:
            pointers = to
        else:
            moved = to.select(F.col("id").alias("to"), F.col("to").alias("further"))
            pointers = scratch.keep(pointers.join(moved, "to", "left").select("id", F.coalesce("further", "to").alias("to")), f"{name}-all-{rounds}")
        a, b = to.select(F.col("id").alias("a"), F.col("to").alias("x")), to.select(F.col("id").alias("b"), F.col("to").alias("y"))
        rounds += 1
        rest = edges.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = scratch.keep(rest, f"{name}-edges-{rounds}")
    # the rounds' tables but for the last pointers and edges
    scratch.drop(*(f"{name}-to-{r}-{jump}" for r in range(rounds) for jump in (0, 1)), *(f"{name}-edges-{r}" for r in range(rounds)), *(f"{name}-all-{r}" for r in range(rounds - 1)))
    if pointers is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return pointers.select("id", F.col("to").alias("component"))
