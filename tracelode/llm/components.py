"""Connected components of a graph given as edges, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label) of every node that has an edge to another one: ``label`` is the least id connected to it.

    Alternates the large-star and small-star steps, each a grouped minimum (combined before the
    shuffle, so that a hub costs one row a task) joined back to the edges (a plain equi-join, which
    adaptive execution splits for a hub). The number of rounds grows with the logarithm of the size of
    a component. Each round is cut with a table in the shared folder; the driver sees two numbers.
    Null ends and loops are ignored.
    """
    edges = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                        .where("u is not null and v is not null and u > v").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        edges = cut_lineage(small, "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
